"""Published figures that the scoring operators must reproduce. Fixed values of the reference's result files."""

#: share, ttr, kl, perplexity ratio, coverage
COMPOSITE_ROWS = [
    (0.0, 0.22404, 4.163425, 0.927608, 0.724),
    (0.25, 0.203468, 4.472236, 1.252983, 0.702),
    (0.5, 0.174552, 4.834387, 1.45965, 0.669),
    (0.75, 0.14079, 5.283534, 2.618571, 0.656),
    (1.0, 0.094707, 5.859672, 8.277321, 0.618),
]
COMPOSITE_INDEX = {0.0: 0.0286, 0.25: 0.0746, 0.5: 0.1137, 0.75: 0.5229, 1.0: 0.7347}

#: generations 0 to 3
GENERATION_ROWS = {
    "ttr": [0.112272, 0.077335, 0.063922, 0.058467],
    "entropy_1gram": [10.542988, 10.449947, 10.269223, 10.216995],
    "kl_div_1gram": [5.056618, 5.149778, 5.330542, 5.382963],
    "zipf_alpha": [1.034293, 1.171198, 1.250064, 1.29121],
    "avg_pairwise_cos_dist": [0.965587, 0.968814, 0.964889, 0.964592],
    "tail_mass_fraction": [0.1588, 0.209, 0.204, 0.2042],
    "ppl_inversion_ratio": [1.0, 1.946737, 2.609683, 2.725384],
}

"""python -m driftloom build|measure|score: the steps of a study over Parquet tables.

build    RAW OUT           clean, filter, cap, deduplicate and sample RAW (doc_id, text); fit the reference pack
measure  PACK DOCS OUT     the lexical layer of DOCS (doc_id, text), or of each cohort, against the pack
score    PACK DOCS VECS BASE_VECS OUT
                           the composite index of DOCS with their vectors (id, vec), against the pack's
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from driftloom.functions.text import clean_light, clean_wiki
from driftloom.operators import lexical, nll
from driftloom.plans.baseline import Baseline, Config, build_corpus
from driftloom.plans.layers import score_dataset
from driftloom.session import get_session
from driftloom.sources.writers import write_table


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    corpus, rejects = build_corpus(spark.read.parquet(a.raw), Config(target_docs=a.docs), clean_light if a.plain else clean_wiki)
    write_table(corpus, f"{a.out}/corpus")
    write_table(rejects, f"{a.out}/rejects")
    vecs = spark.read.parquet(a.vectors).select("id", "vec") if a.vectors else None
    Baseline.fit(spark.read.parquet(f"{a.out}/corpus"), vecs).save(spark, f"{a.out}/pack")


def measure(spark: SparkSession, a: argparse.Namespace) -> None:
    base = Baseline.load(spark, a.pack)
    write_table(lexical.layer(spark.read.parquet(a.docs), base.unigram, a.by, baseline_entropy=base.meta["entropy_1gram"]), a.out)


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    base, docs = Baseline.load(spark, a.pack), spark.read.parquet(a.docs)
    scorer = nll.BigramScorer(spark.read.parquet(a.fit) if a.fit else docs)
    vecs, base_vecs = (spark.read.parquet(p).select("id", "vec") for p in (a.vectors, a.base_vectors))
    write_table(score_dataset(docs, base, scorer, vecs, base_vecs, a.name).withColumn("scored_at", F.current_timestamp()), a.out)


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="driftloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("--master", help="Spark master; without it the launcher decides")
    steps = top.add_subparsers(dest="step", required=True)
    s = steps.add_parser("build")
    s.add_argument("raw")
    s.add_argument("out")
    s.add_argument("--docs", type=int, default=Config.target_docs)
    s.add_argument("--plain", action="store_true", help="texts without markup")
    s.add_argument("--vectors", help="Parquet table (id, vec) of the corpus")
    s = steps.add_parser("measure")
    for name in ("pack", "docs", "out"):
        s.add_argument(name)
    s.add_argument("--by", nargs="*", default=[], help="columns of the cohorts")
    s = steps.add_parser("score")
    for name in ("pack", "docs", "vectors", "base_vectors", "out"):
        s.add_argument(name)
    s.add_argument("--fit", help="Parquet table of the texts that the scorer is fitted on; by default DOCS")
    s.add_argument("--name", default="dataset")
    a = top.parse_args(args)
    {"build": build, "measure": measure, "score": score}[a.step](get_session(a.master), a)


if __name__ == "__main__":
    main()

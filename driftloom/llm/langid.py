"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map
from .grams import GRAM_BITS, code_points, letter_grams, wide_codes

#: Labelled rows per language that training may use, and languages, the most frequent ones: they bound what comes to the driver.
ROWS_PER_LANG, MAX_LANGS = 800, 256
UNDETERMINED = "und"
#: Places of the grams of one, two and three letters in one row of weights.
STARTS = (0, 1 << GRAM_BITS[0], (1 << GRAM_BITS[0]) + (1 << GRAM_BITS[1]))
PLACES = STARTS[2] + (1 << GRAM_BITS[2])
_CODES: dict[str, np.ndarray] = {}


def _grams(text: str, skip: int = 0) -> np.ndarray:
    """Places of all grams of the text, 3 x places that say something; without those that end in the first `skip` characters."""
    if "c" not in _CODES:
        _CODES["c"] = wide_codes()
    return np.stack([g + start for g, start in zip(letter_grams(_CODES["c"][code_points(text)], skip), STARTS, strict=True)])


@dataclass
class LangModel:
    """weights: for each place of a gram its TF-IDF weight, per language."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    nonzero: float  # share of weights that the penalties left

    def logits(self, text: str) -> np.ndarray | None:
        total, n = np.zeros(len(self.langs)), 0
        for at in range(0, len(text), 1 << 20):  # bounded memory; the two characters before a piece complete its n-grams
            g = _grams(text[max(0, at - 2) : at + (1 << 20)], min(at, 2))
            for part in g:
                total += self.weights[part].sum(axis=0, dtype=np.float64)
            n += g.shape[1]
        has_letter = n > 0 and any(ch.isalpha() for ch in text)
        return total / n + self.bias if has_letter else None

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text) if text and self.langs else None
        if z is None:
            return UNDETERMINED, 0.0
        p = softmax(z / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and term frequencies of a text's 1-, 2- and 3-grams; the three orders have ranges of their own."""
    g = _grams(text)
    if not g.size:
        return np.zeros(0, np.int64), np.zeros(0)
    places, counts = np.unique(g, return_counts=True)
    return places, counts / g.shape[1]


def fit(rows: list[tuple[str, str]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.0005, scale: float = 20.0, seed: int = 7) -> LangModel:
    """Train on (text, lang) rows. Every fifth row calibrates the temperature and trains nothing.

    FTRL-proximal: per coordinate the running sums z and n give the weight in closed form,
    0 where |z| is within l1 - so unused n-grams stay exactly 0.
    """
    langs = sorted({x for _, x in rows})
    feats = [(p, tf, langs.index(y)) for t, y in rows for p, tf in [_features(t)] if len(p)]
    if not feats:
        return LangModel(langs if rows else [], np.zeros((PLACES, max(1, len(langs)))), np.zeros(max(1, len(langs))), 1.0, 0.0)
    size = PLACES
    df = np.zeros(size)
    for p, _, _ in feats:
        df[p] += 1
    idf = np.log((1 + len(feats)) / (1 + df)) + 1
    order = np.random.default_rng(seed).permutation(len(feats))
    held, train = order[::5], [i for k, i in enumerate(order) if k % 5] or list(order)
    n_l = len(langs)
    z, n = np.zeros((size, n_l)), np.zeros((size, n_l))
    zb, nb = np.zeros(n_l), np.zeros(n_l)

    def weigh(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in train:
            p, tf, y = feats[i]
            x = tf * idf[p] * scale
            w, wb = weigh(z[p], n[p]), weigh(zb, nb)
            err = softmax(x @ w + wb)
            err[y] -= 1
            g = x[:, None] * err
            sigma = (np.sqrt(n[p] + g * g) - np.sqrt(n[p])) / alpha
            z[p] += g - sigma * w
            n[p] += g * g
            sb = (np.sqrt(nb + err * err) - np.sqrt(nb)) / alpha
            zb += err - sb * wb
            nb += err * err
    w, bias = weigh(z, n), weigh(zb, nb)
    w *= idf[:, None] * scale
    logits = np.array([(feats[i][1] @ w[feats[i][0]]) + bias for i in held])
    truth = np.array([feats[i][2] for i in held])
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    return LangModel(langs, w.astype(np.float32), bias, float(grid[int(np.argmin(loss))]), float((w != 0).mean()))


def training_rows(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MAX_LANGS) -> list[tuple[str, str]]:
    """Of each of the `most` most frequent languages the rows_per_lang rows that come first by a hash of id and text; only these come to the driver.

    Rows without a text or a language teach nothing. Ties go by id, then by text.
    """
    spark = docs.sparkSession
    lean = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("y")).where("t is not null and y is not null")
    lean = lean.withColumn("h", F.pmod(F.xxhash64("i", "t", F.lit("langid")), F.lit(1 << 30)))
    counts = {r.y: r["count"] for r in lean.groupBy("y").count().orderBy(F.col("count").desc(), "y").limit(most).collect()}
    first = Window.partitionBy("y").orderBy("h", F.col("i").asc_nulls_first(), "t")

    def taken(limits: dict[str, int]) -> dict[str, list[str]]:
        if not limits:
            return {}
        bounds = F.broadcast(spark.createDataFrame(list(limits.items()), "y string, bound long"))  # `most` rows
        rows = lean.join(bounds, "y").where(F.col("h") < F.col("bound")).withColumn("r", F.row_number().over(first)).where(F.col("r") <= rows_per_lang)
        got: dict[str, list] = {}
        for r in rows.select("y", "r", "t").collect():
            got.setdefault(r.y, []).append((r.r, r.t))
        return {y: [t for _, t in sorted(x)] for y, x in got.items()}

    # a bound that lets about twice the wanted rows through; where that gives too few, as with repeated rows, none
    got = taken({y: min(1 << 30, int((1 << 30) * (2 * rows_per_lang + 50) / c)) for y, c in counts.items()})
    got |= taken({y: 1 << 30 for y, c in counts.items() if len(got.get(y, ())) < min(c, rows_per_lang)})
    return [(t, y) for y in sorted(got) for t in got[y]]


def identify(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its whole text.

    `und` with score 0 where the text is null or holds no letter, or where nothing was
    learned. Ties go to the language that sorts first. Rows stay as many as they were;
    only the id and text columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size: PLACES x languages x 4 bytes
    lean = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [shared.value.predict(t.as_py()) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return arrow_map(lean, apply, f"doc_id {lean.schema[0].dataType.simpleString()}, lang_pred string, score double")

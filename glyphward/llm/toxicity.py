"""Operator 2: toxicity by non-negative positive-unlabelled (nnPU) learning.

A numpy logistic classifier over word presence is trained from confirmed toxic
examples and unlabelled text. Its risk is class-prior corrected,

    R = prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)]),

and when the part under max() turns negative the step is reversed for it alone
(Kiryo et al. 2017). The prior is a parameter or the share of label 1 in the
training labels. Training uses bounded samples: about MAX_POSITIVE toxic and
MAX_UNLABELLED unlabelled documents, chosen by hash (documented bounds); scoring
covers every word of every text. The driver holds the distinct words of the positive
sample, and of the unlabelled one just which of their frequent words each text has.

Cases: null and empty texts get the score of the bias alone; documents without
label are scored too; null labels and null ids are not learned from; several labels
of one id count once (toxic if any says so); no toxic label at all gives the prior
as every score; repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphward.llm.common import ship, table, wider

ship(__name__)

MAX_POSITIVE = 4_000
MAX_UNLABELLED = 12_000
THRESHOLD = 0.3
STEPS = 300
#: A word is a feature if it is in so many distinct positive texts, and so many standard deviations above its unlabelled share.
MIN_POSITIVE, MIN_Z = 5, 5.0
L2 = 2e-4

_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def distinct_words(text: str | None) -> set[str]:
    return set(_LETTERS.findall(text.lower())) if text else set()


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(sorted(distinct_words(t))) for t in b.column(0).to_pylist()], pa.string())], names=["bag"])


def samples(docs: DataFrame, labels: DataFrame) -> tuple[list[str], DataFrame | None, float]:
    """Word bags of the sampled positive texts (equal texts once), the sampled unlabelled texts, and the prior."""
    mine = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    mine = mine.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_pos = mine.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    if not n_pos:
        return [], None, 0.0
    span = 1 << 30

    def sampled(seed: str, share: float, *cols):
        return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(span)) < int(min(1.0, share) * span)

    known = mine.filter((F.col("toxic") == 1) & sampled("p", MAX_POSITIVE / n_pos, "doc_id")).select(F.col("doc_id").alias("__gw_id"))
    d = docs.select("doc_id", "text")
    pos = d.join(F.broadcast(known), F.col("doc_id") == F.col("__gw_id")).select("text").mapInArrow(_bags, "bag string").distinct().collect()
    unl = d.filter(~held_out(F.col("doc_id")) & sampled("u", MAX_UNLABELLED / max(1, docs.count()), "doc_id", "text")).select("text")
    return sorted(r.bag for r in pos), unl, n_pos / n


def indices(texts: DataFrame, candidates: list[str]) -> list[np.ndarray]:
    """Of each text, the places of its words among the candidates; only these come to the driver."""
    shared = texts.sparkSession.sparkContext.broadcast(candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: k for k, w in enumerate(shared.value)}
        for b in batches:
            found = [np.array(sorted(place[w] for w in distinct_words(t) & place.keys()), np.int32).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["at"])

    return [np.frombuffer(r.at, np.int32) for r in texts.mapInArrow(run, "at binary").collect()]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], candidates: list[str], prior: float) -> tuple[dict[str, float], float]:
    """Weights by word and the bias, from the candidates' places in each text."""
    n_pos, n_unl = len(positive), len(unlabelled)
    if not n_pos or not n_unl:
        return {}, math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    count = lambda x: np.bincount(np.concatenate(x).astype(np.int64), minlength=len(candidates))
    p, u = count(positive), count(unlabelled)
    e = n_pos * (u + 0.5) / n_unl
    chosen = np.flatnonzero((p >= MIN_POSITIVE) & (p - e >= MIN_Z * np.sqrt(e)))
    at = np.full(len(candidates), -1)
    at[chosen] = np.arange(len(chosen))
    bags = [*positive, *unlabelled]
    n = len(bags)
    r = np.repeat(np.arange(n), [len(x) for x in bags])
    c = at[np.concatenate(bags)] if n else at
    r, c = r[c >= 0], c[c >= 0]
    is_pos = np.arange(n) < n_pos
    w, bias = np.zeros(len(chosen)), math.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0
    m = [np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)]
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(r, w[c], n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        # d loss(+)/dz = p - 1 and d loss(-)/dz = p, with logistic loss.
        minus = np.where(is_pos, -prior / n_pos, 1 / n_unl)
        softplus = np.logaddexp(0, z)
        negative_risk = float((minus * softplus).sum())
        if negative_risk >= 0:
            g = minus * p + np.where(is_pos, prior / n_pos * (p - 1), 0)
        else:
            g = -minus * p
        grad = np.append(np.bincount(c, g[r], len(chosen)) + L2 * w, g.sum())
        m[0] = 0.9 * m[0] + 0.1 * grad
        m[1] = 0.99 * m[1] + 0.01 * grad**2
        move = 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return {candidates[k]: float(v) for k, v in zip(chosen.tolist(), w, strict=True)}, float(bias)


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float]:
    """Weights by word and the bias."""
    bags, unlabelled, prior = samples(docs, labels)
    seen = Counter(w for bag in bags for w in bag.split(" ") if w)
    candidates = sorted(w for w, n in seen.items() if n >= MIN_POSITIVE)
    place = {w: k for k, w in enumerate(candidates)}
    positive = [np.array([place[w] for w in bag.split(" ") if w in place], np.int32) for bag in bags]
    return fit(positive, indices(unlabelled, candidates) if positive else [], candidates, prior)


def score(docs: DataFrame, model: tuple[dict[str, float], float]) -> DataFrame:
    """docs with __gw_score. The model has at most one weight per word of the bounded samples."""
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = shared.value
        known = w.keys()
        for b in batches:
            z = [b0 + sum(w[x] for x in sorted(known & distinct_words(t.as_py()))) for t in b.column(at)]
            s = 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, "__gw_score"])

    return docs.mapInArrow(run, wider(docs, __gw_score="double"))


def op2_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity; labels of held-out documents are never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__gw_score").alias("score"), (F.col("__gw_score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject."""
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model).filter(F.col("__gw_score") < THRESHOLD).select(*docs.columns)

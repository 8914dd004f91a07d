"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams (3 to 6 characters) of the lower-cased text in which every run of characters other
than letters is one space, hashed to 2**20 buckets. Each bucket's weight is its log-count ratio between toxic and
clean labelled documents times a coefficient of a logistic regression on the so scaled features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import lean, materialize, ship, text_of

SIZES = (3, 4, 5, 6)
BUCKETS = 20
#: Bound on the labelled rows a classifier is fitted on (by the smallest hash of their ids), and on its features.
MAX_TRAIN, MAX_FEATURES = 16_000, 6_000
#: A bucket can be a feature if so many toxic or clean documents have it, and if its number of toxic documents is so
#: many standard deviations from what its frequency leads to expect.
LEAST_DOCS, LEAST_Z = 3, 5.0
SLICES = 64
_BLOCK = 100_000
_NOT_LETTERS = regex.compile(r"[^\p{L}]+")


@dataclass
class Model:
    """weight[bucket], in document space; score = 1 / (1 + exp(-(bias + sum of weights of distinct n-grams)))."""

    bucket: np.ndarray
    weight: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BUCKETS, np.float32)
        out[self.bucket] = self.weight
        return out


def clean(text: str) -> str:
    return " " + _NOT_LETTERS.sub(" ", text.lower()) + " "


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each n-gram of the characters."""
    if len(codes) < n:
        return np.zeros(0, np.int64)
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i:len(codes) - n + 1 + i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
    return (h >> np.uint64(64 - BUCKETS)).astype(np.int64)


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded total length (a longer text stands alone)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _BLOCK:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def _hits(texts: list[str], wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of the distinct n-grams in wanted (all if None), sorted."""
    cleaned = [clean(t) for t in texts]
    ends = np.cumsum([len(c) for c in cleaned])
    codes = np.frombuffer("".join(cleaned).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    doc_of = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, ends]))
    found = []
    for n in SIZES:
        b = _grams(codes, n)
        if not len(b):
            continue
        ok = doc_of[:len(b)] == doc_of[n - 1:]
        if wanted is not None:
            ok &= wanted[b]
        at = np.flatnonzero(ok)
        found.append(doc_of[at] << BUCKETS | b[at])
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both >> BUCKETS, both & ((1 << BUCKETS) - 1)


# -- training ---------------------------------------------------------------------------------------------------------
def _count_batches(batches: Iterator[pa.RecordBatch]):
    """Documents with each bucket by label, as SLICES rows of this task's counts."""
    counts = np.zeros((2, 1 << BUCKETS), np.int32)
    for batch in batches:
        y = batch.column(1).to_numpy()
        for at, texts in _blocks(batch.column(0).to_pylist()):
            doc, bucket = _hits(texts, None)
            toxic = y[at + doc] == 1
            np.add.at(counts[1], bucket[toxic], 1)
            np.add.at(counts[0], bucket[~toxic], 1)
    clean_, toxic_ = counts.reshape(2, SLICES, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in clean_]), pa.array([x.tobytes() for x in toxic_])],
                                     names=["slice", "clean", "toxic"])


def _choose_batches(batches: Iterator[pa.RecordBatch], docs: np.ndarray):
    """Rows sorted by slice -> buckets that tell the labels apart: (bucket, ratio, z)."""
    width = (1 << BUCKETS) // SLICES
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, clean_, toxic_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            sums.setdefault(at, np.zeros((2, width)))
            sums[at] += np.array([np.frombuffer(clean_, np.int32), np.frombuffer(toxic_, np.int32)])
    for at, counts in sums.items():
        often = np.flatnonzero(counts.max(0) >= LEAST_DOCS)
        n0, n1 = counts[:, often]
        share = (n0 + n1) / docs.sum()
        z = np.abs(n1 - share * docs[1]) / np.sqrt(share * (1 - share) * docs[1] * docs[0] / docs.sum() + 1e-9)
        ratio = np.log((n1 + 0.5) / (docs[1] + 1)) - np.log((n0 + 0.5) / (docs[0] + 1))
        far = z >= LEAST_Z
        yield pa.RecordBatch.from_arrays([pa.array(often[far] + at * width), pa.array(ratio[far]), pa.array(z[far])], names=["bucket", "ratio", "z"])


def _row_batches(batches: Iterator[pa.RecordBatch], chosen: np.ndarray):
    wanted = np.zeros(1 << BUCKETS, bool)
    wanted[chosen] = True
    for batch in batches:
        rows = []
        for at, texts in _blocks(batch.column(0).to_pylist()):
            doc, bucket = _hits(texts, wanted)
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
            rows += [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.binary())], names=["y", "buckets"])


def _logistic(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, n: int, penalty: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse (row, column, value) by Adam on the whole sample, L2 on the weights."""
    w, b = np.zeros(n), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    mw, mb, vw, vb = np.zeros(n), 0.0, np.zeros(n), 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, val * w[col], minlength=len(y)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = (p - y) / max(1, len(y))
        gw, gb = np.bincount(col, val * g[row], minlength=n) + penalty / max(1, len(y)) * w, g.sum()
        mw, mb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb
        vw, vb = 0.99 * vw + 0.01 * gw * gw, 0.99 * vb + 0.01 * gb * gb
        step = 0.05 / (1 + t / 150)
        w -= step * (mw / (1 - 0.9 ** t)) / (np.sqrt(vw / (1 - 0.99 ** t)) + 1e-7)
        b -= step * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.99 ** t)) + 1e-7)
    return w, b


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on (doc_id, text, y): at most max_train rows, those with the smallest hash of their doc_id.

    N-gram counts are summed by slices of buckets on the executors; the driver gets at most MAX_FEATURES buckets, then
    the sample's rows as lists of those. Without rows of both labels the model is the prior alone.
    """
    spark = labelled.sparkSession
    ship(spark)
    hashed = labelled.withColumn("h", F.xxhash64("doc_id"))
    top = hashed.select("h").orderBy("h").limit(max_train).agg(F.max("h")).first()[0]
    sample = materialize(hashed.where(F.col("h") <= F.lit(top)).select(text_of().alias("text"), F.col("y").cast("int").alias("y"))).repartition(8)
    n = {r.toxic: r.n for r in sample.groupBy((F.col("y") == 1).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    docs = np.array([n.get(False, 0), n.get(True, 0)], float)
    if not docs.all():
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 20.0 if docs[1] else -20.0 if docs[0] else -2.0)
    counted = sample.mapInArrow(lean(_count_batches), "slice int, clean binary, toxic binary")
    best = (counted.repartition(8, "slice").mapInArrow(lean(lambda bs: _choose_batches(bs, docs)), "bucket long, ratio double, z double")
            .orderBy(F.col("z").desc(), "bucket").limit(MAX_FEATURES).collect())
    best = sorted((r.bucket, r.ratio) for r in best)
    chosen, ratio = np.array([x for x, _ in best], np.int64), np.array([x for _, x in best])
    got = sample.mapInArrow(lean(lambda bs: _row_batches(bs, chosen)), "y int, buckets binary").collect()
    y = np.array([r.y for r in got], float)
    row = np.repeat(np.arange(len(got), dtype=np.int32), [len(r.buckets) // 4 for r in got])
    col = np.searchsorted(chosen, np.frombuffer(b"".join([bytes(r.buckets) for r in got]), np.int32)).astype(np.int32)
    del got
    w, bias = _logistic(row, col, ratio[col].astype(np.float32) if len(col) else np.zeros(0, np.float32), y, len(chosen))
    return Model(chosen, (w * ratio).astype(np.float32), float(bias))


# -- scoring ----------------------------------------------------------------------------------------------------------
def _score_batches(batches: Iterator[pa.RecordBatch], model: Model, column: int, score: str):
    table = model.table()
    wanted = table != 0
    for batch in batches:
        texts = ["" if t is None else t for t in batch.column(column).to_pylist()]
        out = np.zeros(len(texts))
        for at, some in _blocks(texts):
            doc, bucket = _hits(some, wanted)
            out[at:at + len(some)] = np.bincount(doc, table[bucket].astype(float), minlength=len(some))
        p = 1 / (1 + np.exp(-np.clip(out + model.bias, -30, 30)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, score])


def with_score(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """docs with a score from 0 to 1. Null and empty texts get the score of the bias alone; no row is dropped."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights
    schema = StructType([*docs.schema.fields, StructField(score, DoubleType())])
    column = docs.columns.index("text")
    return docs.mapInArrow(lean(lambda bs: _score_batches(bs, sent.value, column, score)), schema)


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, y) of the rows of docs that labels mark and that are not held out.

    A document labelled more than once is toxic if any label says so; null labels are skipped.
    """
    mark = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
            .groupBy(F.col("doc_id").alias("_lx_id")).agg(F.max("toxic").alias("y")))
    # Only as many labelled documents as the fit may use, so that their ids are few enough to be sent to every task.
    mark = mark.orderBy(F.xxhash64("_lx_id"), "_lx_id").limit(MAX_TRAIN)
    return (docs.select("doc_id", "text").join(F.broadcast(mark), F.col("doc_id") == F.col("_lx_id"))
            .select("doc_id", "text", "y"))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; learns only from labelled rows that are not held out.

    Null texts count as empty, repeated rows are scored each, a null doc_id is not held out; an empty table gives no
    rows; without labels every score is the prior.
    """
    model = fit(labelled_rows(docs, labels))
    scored = with_score(docs.select("doc_id", text_of().alias("text")), model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))

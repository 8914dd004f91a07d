"""Document fingerprints by consistent weighted sampling (Ioffe 2010).

Terms are shingles of five words, weighted by how often they occur and named by a 64-bit hash. For each sample every
term has r and c drawn from Gamma(2, 1) and b from [0, 1); a term of weight S has t = floor(ln S / r + b)
and ln a = ln c - r * (t - b + 1), and the sample is the (term, t) with the least a. Two texts have the same sample
with a probability equal to the generalised Jaccard similarity of their weights.

The draws are made from four independent Exp(1) numbers: c is the sum of e and e2, r the sum of s = ln(c / e) and q,
and b = q / r. (A Gamma(2, 1) number times a uniform one is Exp(1), and so is the rest of it, independent of it.) Then
a = e at weight 1, so such terms, which are most, need one number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from .common import materialize, ship, shuffle_partitions, text_of

SAMPLES, SHINGLE = 64, 5
#: Bits of a sample that go into the fingerprint: 3 hexadecimal digits.
MARK = 12
_BLOCK = 1_000_000
_tables: dict[tuple, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


_PLACES = _mix(np.arange(1, 3 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(3, SAMPLES)


def _numbers(terms: np.ndarray, i: int) -> np.ndarray:
    """64 random bits of terms x samples, from a counter-based generator: the same wherever they are drawn."""
    return _mix(terms[:, None] ^ _PLACES[i])


def _single(terms: np.ndarray) -> np.ndarray:
    """Packed a of weight 1 (t = 0): 1 - exp(-a) in the upper 52 bits, the mark in the lower 12; the least is the sample."""
    return _numbers(terms, 0)


def _weighted(terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
    raw = _numbers(terms, 0)
    mark = raw & np.uint64((1 << MARK) - 1)
    e = -np.log1p(-((raw >> np.uint64(MARK)).astype(np.float64) + 0.5) / (1 << 64 - MARK))
    e2, q = -np.log(_uniform(_numbers(terms, 1))), -np.log(_uniform(_numbers(terms, 2)))
    s = np.log1p(e2 / e)
    r = s + q
    t = np.floor((np.log(weight)[:, None] + q) / r)
    a = e * np.exp(-r * t)
    turned = _mix(mark ^ _numbers(terms, 1) ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(64 - MARK)
    level = np.minimum(-np.expm1(-a) * (1 << 64 - MARK), float((1 << 64 - MARK) - 1)).astype(np.uint64)
    return np.where(t == 0, raw, level << np.uint64(MARK) | turned)


# -- terms ------------------------------------------------------------------------------------------------------------
_POWERS = 1 << 16


def _byte_codes() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, weight) of the block's shingles, sorted by text then term."""
    if "codes" not in _tables:
        _tables["codes"] = _byte_codes()
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.r_[True, space].astype(np.int8)))
    first, last = edge[::2], edge[1::2]  # words: data[first:last]
    none = np.zeros(0, np.int64)
    if not len(first):
        return none, none.view(np.uint64), none
    # Word hash: the sum over its bytes of code(byte) * g(place in the word), each well mixed, by prefix sums.
    place = np.arange(len(data), dtype=np.int64)
    word = np.repeat(np.arange(len(first)), last - first)
    inside = place[~space]
    value = _mix(_tables["codes"][data[inside]] + (inside - first[word]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sums = np.r_[np.uint64(0), np.cumsum(value, dtype=np.uint64)]
    bounds = np.r_[0, np.cumsum(last - first)]
    h = _mix(sums[bounds[1:]] - sums[bounds[:-1]])
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    doc = np.searchsorted(starts, first, "right") - 1
    begin = np.searchsorted(doc, np.arange(len(texts) + 1))
    left = begin[doc + 1] - np.arange(len(doc))  # words from this one to its text's end
    opens = (left >= SHINGLE) | (np.arange(len(doc)) == begin[doc])  # a short text is one shingle
    at = np.flatnonzero(opens)
    total = np.zeros(len(at), np.uint64)
    for n in range(SHINGLE):
        there = n < left[at]
        w = np.where(there, h[np.minimum(at + n, len(h) - 1)], np.uint64(0))
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(n + 1))
    of = doc[at]
    for lo, hi in zip(*(np.searchsorted(of, np.arange(len(texts)), side).tolist() for side in ("left", "right"))):
        total[lo:hi].sort()
    new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (total[1:] != total[:-1])])
    return of[new], total[new], np.diff(np.r_[new, len(total)])


def signatures(texts: list[bytes]) -> np.ndarray:
    """Samples of every text, SAMPLES marks of MARK bits each; a text without words has marks of its own (all 0)."""
    out = np.zeros((len(texts), SAMPLES), np.uint32)
    doc, terms, weight = _terms(texts)
    step = 1 << 11
    best = np.full((len(texts), SAMPLES), np.uint64((1 << 64) - 1))
    for lo in range(0, len(doc), step):
        d, x, w = doc[lo:lo + step], terms[lo:lo + step], weight[lo:lo + step]
        packed = _single(x)
        if (more := np.flatnonzero(w > 1)).size:
            packed[more] = _weighted(x[more], w[more].astype(float))
        cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        best[d[cut]] = np.minimum(best[d[cut]], np.minimum.reduceat(packed, cut, axis=0))
    have = np.unique(doc)
    out[have] = best[have] & np.uint64((1 << MARK) - 1)
    return out


def hex_marks(marks: np.ndarray) -> list[str]:
    return ["".join([f"{m:03x}" for m in row]) for row in marks.tolist()]


# -- rows with the next document's text -------------------------------------------------------------------------------
def edited_text(text: str, following: str) -> str:
    """The last half of text (rounded down) replaced by as many first code points of the following text, or all."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _pair_batches(batches: Iterator[pa.RecordBatch]):
    """Rows sorted by (bucket, only_next, doc_id, text): each row's next row is the text that follows it."""
    held = None  # (bucket, id scalar, text, marks)
    for batch in batches:
        buckets, nexts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = batch.column(3).to_pylist()
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= _BLOCK):
                size += len(texts[hi])
                hi += 1
            own = signatures([t.encode("utf-8", "surrogatepass") for t in texts[lo:hi]])
            todo = []  # (id, text, marks, next text, next marks)
            for i in range(lo, hi):
                if held is not None and held[0] == buckets[i]:
                    todo.append((*held[1:], texts[i], own[i - lo]))
                held = None if nexts[i] else (buckets[i], batch.column(2)[i].as_py(), texts[i], own[i - lo])
            yield _pair_rows(todo, batch.schema.field(2).type)
            lo = hi


def _pair_rows(todo: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    edited = [edited_text(x[1], x[3]).encode("utf-8", "surrogatepass") for x in todo]
    marks = signatures(edited) if edited else np.zeros((0, SAMPLES), np.uint32)
    own = np.array([x[2] for x in todo], np.uint32).reshape(-1, SAMPLES)
    following = np.array([x[4] for x in todo], np.uint32).reshape(-1, SAMPLES)
    cols = [pa.array([x[0] for x in todo], kind), pa.array([len(x[1]) for x in todo], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), pa.array(hex_marks(own), pa.string()),
            pa.array(hex_marks(marks), pa.string()), pa.array((own == marks).mean(1), pa.float64()),
            pa.array((own == following).mean(1), pa.float64())]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _print_batches(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        texts, marks = batch.column(1).cast(pa.binary()).to_pylist(), []
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= _BLOCK):
                size += len(texts[hi])
                hi += 1
            marks += hex_marks(signatures(texts[lo:hi]))
            lo = hi
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row: 3 hexadecimal digits per sample. Null and empty texts: all zeros."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(_print_batches, f"doc_id {kind}, fingerprint string")


def likeness(a, b, samples: int = SAMPLES):
    """Share of equal samples of two fingerprint columns: an estimate of the generalised Jaccard similarity."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(samples - 1)), F.lit(0), lambda s, i: s + (
        F.substr(a, i * 3 + 1, F.lit(3)) == F.substr(b, i * 3 + 1, F.lit(3))).cast("int"))
    return same / F.lit(float(samples))


def fingerprints_and_edits(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next row by doc_id, then text; after the last comes the first, and a lone row follows
    itself. Rows without an id come after all others. Null texts count as empty; texts without words have the
    fingerprint of zeros and are alike. No rows in, no rows out.

    Rows are dealt into ranges of ids; each range also gets the first row of the next one, so one shuffle of the
    texts is enough and no task holds more than its range.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of().alias("text"))
    at = F.coalesce(F.col("doc_id").cast("double"), F.lit(float(1 << 62)))
    n = shuffle_partitions(spark)
    ranges = 4 * n
    cuts = rows.select(at.alias("at")).approxQuantile("at", [i / ranges for i in range(1, ranges)], 0.1 / ranges)
    cuts = sorted(set(cuts))
    splits = [-float("inf"), *cuts, float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="at", outputCol="bucket").transform(rows.withColumn("at", at)) if cuts else (
        rows.withColumn("at", at).withColumn("bucket", F.lit(0.0)))
    dealt = dealt.withColumn("bucket", F.col("bucket").cast("int"))
    # A row for each range (at most 4 for each partition): its least place; the row there also goes to the range before.
    least = {r.bucket: r.at for r in dealt.groupBy("bucket").agg(F.min("at").alias("at")).collect()}
    order = sorted(least)
    heads = [(least[b], order[i - 1]) for i, b in enumerate(order)]
    given = F.broadcast(spark.createDataFrame(heads, "at double, to int")) if heads else spark.createDataFrame([], "at double, to int")
    first = (dealt.drop("bucket").join(given, "at").groupBy("to", "at").agg(F.min(F.struct("doc_id", "text")).alias("x"))
             .select(F.col("to").alias("bucket"), F.lit(True).alias("only_next"), F.col("x.doc_id").alias("doc_id"), F.col("x.text").alias("text")))
    both = dealt.select("bucket", F.lit(False).alias("only_next"), "doc_id", "text").unionByName(first)
    ready = (both.repartition(n, "bucket")
             .sortWithinPartitions("bucket", "only_next", F.col("doc_id").asc_nulls_last(), "text"))
    return ready.mapInArrow(_pair_batches, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                                           "edited_fingerprint string, near_edited double, near_next double")

"""Importance resampling towards a target distribution: array-scored weights, and a distributed LSD radix sort for the draw.

Runs of words are counted by hash bucket over all documents and over the target; the buckets' gains are one dense array
that every task holds, and a document's weight is the floored mean of the gains at its features. Weights plus Gumbel
noise are drawn from the top. The order is made by stable counting-sort passes over the digits of (score descending,
doc_id ascending), the least digit first: rows lie in blocks of consecutive positions, each pass counts (block, digit),
turns the counts into offsets and sends every row to its place, which after the last pass is its rank.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import lean, materialize, ship, text_of

#: Bits of a digit, and rows of a block: a pass looks at (rows / BLOCK) * 2**DIGIT counts at most.
DIGIT, BLOCK = 11, 1 << 18

#: Distinct runs whose buckets a worker keeps; a full cache is emptied.
CACHE = 1_000_000

#: Bytes of words: digits, small letters (capitals become small) and all bytes of characters beyond U+007F.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Buckets(dict):
    """The bucket of each run of words."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, run: bytes) -> int:
        bucket = zlib.crc32(run) % self.buckets
        if len(run) < 64:
            self[run] = bucket
        return bucket


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def features(text: str, most: int, known: Buckets) -> tuple[list[int], int]:
    """Buckets of all runs of 1 to ``most`` words, and the number of words."""
    if len(known) > CACHE:
        known.clear()
    words = words_of(text)
    out = [known[w] for w in words]
    for k in range(2, most + 1):
        out += [known[b" ".join(words[i:i + k])] for i in range(len(words) - k + 1)]
    return out, len(words)


def bucket_counts(table: DataFrame, buckets: int, most: int) -> np.ndarray:
    """How many features of all texts fall into each bucket: a dense array of ``buckets`` numbers."""
    ship(table.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = np.array(features(text, most, known)[0], np.int64)
                if len(found) * 8 < buckets:
                    np.add.at(total, found, 1)
                else:
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    counted = table.select(text_of().alias("text")).mapInArrow(lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():  # at most one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of smoothed shares, in thousandths, floored."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(seed: str, doc_id: object) -> int:
    """Gumbel noise in thousandths from a hash of the seed and the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, most: int, seed: str) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) of every row."""
    ship(docs.sparkSession)
    buckets, kind = len(gain), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        known = Buckets(buckets)
        for batch in batches:
            ids, sizes, words, weights, scores = batch.column(0).to_pylist(), [], [], [], []
            for doc_id, text in zip(ids, batch.column(1).to_pylist()):
                found, n = features(text, most, known)
                weight = int(gain[found].sum()) // len(found) if found else 0
                sizes.append(len(found)), words.append(n), weights.append(weight), scores.append(weight + noise(seed, doc_id))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, words, weights, scores))],
                                             names=["doc_id", "n_features", "n_words", "weight", "score"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(lean(run), f"doc_id {kind}, n_features long, n_words long, weight long, score long")


# -- the order --------------------------------------------------------------------------------------------------------
def _pass(rows: DataFrame, digit, position) -> DataFrame:
    """rows with _lx_at, their places after a stable counting sort by ``digit``; rows lie in blocks _lx_block, in each by ``position``."""
    dealt = rows.withColumn("_lx_digit", digit)
    counts = materialize(dealt.groupBy("_lx_digit", "_lx_block").agg(F.count(F.lit(1)).alias("_lx_n")))
    totals = dict(counts.groupBy("_lx_digit").agg(F.sum("_lx_n")).collect())  # at most 2**DIGIT rows
    below, starts = 0, []
    for d in sorted(totals):
        starts.append((d, below))
        below += totals[d]
    spark = rows.sparkSession
    start = F.broadcast(spark.createDataFrame(starts, "_lx_digit int, _lx_start long"))
    earlier = Window.partitionBy("_lx_digit").orderBy("_lx_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(start, "_lx_digit").select("_lx_block", "_lx_digit", (F.col("_lx_start") + F.coalesce(F.sum("_lx_n").over(earlier), F.lit(0))).alias("_lx_offset"))
    within = F.row_number().over(Window.partitionBy("_lx_block", "_lx_digit").orderBy(*position)) - 1
    placed = dealt.withColumn("_lx_in", within).join(offsets.hint("merge"), ["_lx_block", "_lx_digit"])
    return placed.withColumn("_lx_at", F.col("_lx_in") + F.col("_lx_offset")).drop("_lx_in", "_lx_offset", "_lx_digit", "_lx_block")


def radix_rank(rows: DataFrame, keys: list, rank: str, block: int = BLOCK, digit: int = DIGIT) -> DataFrame:
    """rows with their rank (1, 2, ...) by ``keys``, expressions of whole numbers, ascending, nulls last.

    Rows that agree in all keys get neighbouring ranks in any order. An empty table stays empty.
    """
    names = [f"_lx_key{i}" for i in range(len(keys))]
    held = rows.select("*", *(k.cast("long").alias(n) for k, n in zip(keys, names)))
    ends = held.agg(F.count(F.lit(1)).alias("n"), *(f(n).alias(f"{n}{f.__name__}") for n in names for f in (F.min, F.max))).first()
    if not ends["n"]:
        return rows.withColumn(rank, F.lit(None).cast("long"))
    low = {n: ends[f"{n}min"] or 0 for n in names}
    span = {n: (ends[f"{n}max"] or 0) - low[n] + 1 for n in names}  # nulls come after the greatest
    if max(span.values()) >= 1 << 63:
        raise ValueError("keys spread over more than 63 bits")
    held = held.select(*rows.columns, *(F.coalesce(F.col(n) - F.lit(low[n]), F.lit(span[n])).alias(n) for n in names))
    blocks = -(-ends["n"] // block)
    at, first = held.withColumn("_lx_block", F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int")), True
    for n in reversed(names):
        for shift in range(0, max(1, span[n].bit_length()), digit):
            part = F.shiftright(F.col(n), shift).bitwiseAND(F.lit((1 << digit) - 1)).cast("int")
            placed = materialize(_pass(at, part, names if first else ["_lx_at"]).select(*rows.columns, *names, "_lx_at"))
            at, first = placed.withColumn("_lx_block", F.floor(F.col("_lx_at") / block).cast("int")), False
    return placed.select(*rows.columns, (F.col("_lx_at") + 1).alias(rank))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, most: int = 1, buckets: int = 10_000, seed: str = "2024") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank is 1, 2, ... for the ``percent`` of the long enough rows that are drawn, else null.

    Null and empty texts have no features, weight 0, and are not drawn; a null id is hashed as an empty one and loses
    ties; repeated rows count and are ranked each; an empty target is smoothed like any other; other columns are not read.
    doc_id must be a whole number.
    """
    gain = gains(bucket_counts(docs, buckets, most), bucket_counts(target, buckets, most))
    rows = materialize(scored(docs, gain, most, seed))
    able = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    ranked = radix_rank(rows.where(able), [-F.col("score"), F.col("doc_id")], "rank")
    drawn = rows.where(able).count() * percent // 100
    kept = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return kept.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")


_CRC = """
crc_table AS (SELECT list(c ORDER BY i) AS crc_t FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda k: k::UBIGINT)),
                     lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    """DuckDB expression of the crc32 of a text's UTF-8 bytes; its FROM must hold ``crc_table``."""
    byte = f"(instr('0123456789ABCDEF', substr(hex({text}), 2 * k + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex({text}), 2 * k + 2, 1)) - 1"
    return (f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(length(hex({text})) // 2), lambda k: ({byte})::UBIGINT)), "
            f"lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)")


ORACLE = f"""
WITH {_CRC.strip()},
low AS (SELECT doc_id, row_number() OVER () AS place, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
split AS (SELECT doc_id, place, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM low),
aim AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
hashed AS (SELECT word, {crc_sql('word')} % 10000 AS bucket FROM (SELECT word FROM split UNION SELECT word FROM aim), crc_table),
s AS (SELECT bucket, count(*) AS s FROM split JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aim JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE
                / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT place, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM split JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY place),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
           FROM low LEFT JOIN weighed USING (place)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM ranked"""

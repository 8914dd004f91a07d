"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Every row gives 48 bits of the SHA-256 of its normalised text. Senders (runs of rows of one task) sort theirs by
   owner, the range of fingerprints a row falls into, and send each owner one Golomb-coded list of gaps.
   A fingerprint that one sender has several times is sent once, with a bit that says so.
2. Owners merge the lists they get and answer each with a bitmap, which is shuffled back to its sender: which of the
   sender's fingerprints occur more than once.
3. Senders mark their rows by the bitmaps. Only rows so marked (suspects) have their texts shuffled, and are grouped by
   the bytes themselves.

The exchange costs about 1.5 bits more than log2 of the mean gap for each row; texts that occur once stay put.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import hot_join, lean, materialize, ship, shuffle_partitions, sieve, sifted, text_of

BITS = 48
#: Rows in one sender's list, and the mean number of rows an owner answers for.
SENDER_ROWS, OWNER_ROWS = 100_000, 500_000
_SPACE = r"[\x20\x09-\x0D]+"


def normalized(text: Column | None = None) -> Column:
    return F.regexp_replace(text_of() if text is None else text, _SPACE, " ")


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _fp48(sha: Column) -> Column:
    return F.conv(F.substring(sha, 1, BITS // 4), 16, 10).cast("long")


# -- Golomb-Rice coding of sorted numbers -----------------------------------------------------------------------------
def golomb_encode(values: np.ndarray, low: int) -> tuple[int, bytes]:
    """Sorted values, each at least low -> (k, code): gap quotients in unary, then the k low bits of every gap."""
    gaps = np.diff(np.r_[np.int64(low), values]).astype(np.int64)
    if not len(gaps):
        return 0, b""
    k = max(0, int(np.floor(np.log2(max(1.0, 0.69 * float(gaps.mean()))))))
    quotient = gaps >> k
    ends = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    low_bits = ((gaps[:, None] >> np.arange(k, dtype=np.int64)) & 1).astype(np.uint8).ravel()
    return k, np.packbits(np.concatenate([unary, low_bits])).tobytes()


def golomb_decode(n: int, k: int, code: bytes, low: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits)[:n]
    quotient = np.diff(np.r_[-1, ends]) - 1
    at = int(ends[-1]) + 1
    rest = bits[at:at + n * k].reshape(n, k).astype(np.int64)
    return np.cumsum((quotient.astype(np.int64) << k) + (rest << np.arange(k, dtype=np.int64)).sum(1)) + low


# -- the three sides of the exchange ----------------------------------------------------------------------------------
def _owner(fp: np.ndarray, owners: int) -> np.ndarray:
    return (fp * owners) >> BITS if owners < 1 << 15 else fp // -(-(1 << BITS) // owners)


def _low(owner: int, owners: int) -> int:
    return -(-(owner << BITS) // owners) if owners < 1 << 15 else owner * -(-(1 << BITS) // owners)


def _send(batches: Iterator[pd.DataFrame], owners: int) -> Iterator[pd.DataFrame]:
    """One list for each owner of every run of SENDER_ROWS rows: distinct fingerprints, and a bit for those repeated here."""
    from pyspark import TaskContext
    task = TaskContext.get()
    part, run = task.partitionId() if task else 0, 0

    def lists(fps: np.ndarray) -> pd.DataFrame:
        once, count = np.unique(fps, return_counts=True)
        own = _owner(once, owners)
        cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        rows = []
        for a, b in zip(cut, np.r_[cut[1:], len(once)]):
            k, code = golomb_encode(once[a:b], _low(int(own[a]), owners))
            rows.append((f"{part}-{run}", int(own[a]), int(b - a), k, code, np.packbits(count[a:b] > 1).tobytes()))
        return pd.DataFrame(rows, columns=["sender", "owner", "n", "k", "code", "here"])

    held: list[np.ndarray] = []
    for batch in batches:
        held.append(batch["fp"].to_numpy(np.int64))
        if sum(map(len, held)) >= SENDER_ROWS:
            yield lists(np.concatenate(held))
            held, run = [], run + 1
    if sum(map(len, held)):
        yield lists(np.concatenate(held))


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8))[:n].astype(bool)


def _answer(batches: Iterator[pd.DataFrame], owners: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by owner; one owner's lists are held at a time, as numbers, never texts."""
    def bitmaps(owner: int, got: list[tuple]) -> pd.DataFrame:
        low = _low(owner, owners)
        values = [golomb_decode(n, k, code, low) for _, n, k, code, _ in got]
        once, count = np.unique(np.concatenate(values), return_counts=True)
        here = np.concatenate([v[_bits(h, len(v))] for (*_, h), v in zip(got, values)])
        twice = np.union1d(once[count > 1], here)
        rows = []
        for (sender, *_), v in zip(got, values):
            marked = np.isin(v, twice)
            if marked.any():
                rows.append((sender, owner, np.packbits(marked).tobytes()))
        return pd.DataFrame(rows, columns=["sender", "owner", "bitmap"])

    now, got = None, []
    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.owner != now and got:
                yield bitmaps(now, got)
                got = []
            now = row.owner
            got.append((row.sender, row.n, row.k, row.code, row.here))
    if got:
        yield bitmaps(now, got)


def _marked(batches: Iterator[pd.DataFrame], owners: int) -> Iterator[pd.DataFrame]:
    """A sender's list beside the bitmap it got for it -> the fingerprints of its rows that are suspects."""
    for batch in batches:
        found = [golomb_decode(r.n, r.k, r.code, _low(r.owner, owners))[_bits(r.bitmap, r.n)] for r in batch.itertuples(index=False)]
        yield pd.DataFrame({"fp": np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)})


def suspects(fps: DataFrame) -> DataFrame:
    """(fp): distinct fingerprints that more than one row of ``fps`` has, found by the exchange."""
    spark = fps.sparkSession
    ship(spark)
    parts = shuffle_partitions(spark)
    owners = max(parts, fps.count() // OWNER_ROWS + 1)
    # Written, so that the lists which senders keep are those which owners have answered, whatever is lost between.
    sent = materialize(fps.mapInPandas(lean(lambda bs: _send(bs, owners)), "sender string, owner int, n int, k int, code binary, here binary"))
    answered = (sent.repartition(parts, "owner").sortWithinPartitions("owner")
                .mapInPandas(lean(lambda bs: _answer(bs, owners)), "sender string, owner int, bitmap binary"))
    back = sent.select("sender", "owner", "n", "k", "code").join(answered.hint("merge"), ["sender", "owner"])
    return back.mapInPandas(lean(lambda bs: _marked(bs, owners)), "fp long").distinct()


# -- the operator -----------------------------------------------------------------------------------------------------
def copy_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, groups). rows: doc_id, text_sha256 of every row, _lx_maybe (false: surely without a copy). groups:
    text_sha256, keep_id, group_size of every normalised text that occurs more than once.

    Texts are read once for their digests. Then only texts of suspects are normalised again and shuffled, at every
    size: their ids pass a sieve where the texts lie. They are grouped by their bytes, so what the sieves let through
    without need ends as a group of one.
    """
    rows = materialize(docs.select("doc_id", _digest(normalized()).alias("text_sha256")).withColumn("fp", _fp48(F.col("text_sha256"))))
    told = sifted(rows, F.col("fp"), sieve(suspects(rows.select("fp")), "fp")).drop("fp")
    texts = sifted(docs.select("doc_id", "text"), F.col("doc_id"), sieve(told.where("_lx_maybe"), "doc_id")).where("_lx_maybe")
    same = (texts.select("doc_id", normalized().alias("norm"))
            .groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .where("group_size > 1").select(_digest(F.col("norm")).alias("text_sha256"), "keep_id", "group_size"))
    return told, materialize(same)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical once each run of ASCII white space is one space; null counts as empty, and empty
    texts are equal to each other. The row with the least doc_id stays. Rows that share that doc_id and the text are
    one document and all read kept; a null id is kept only in a group where every id is null. No rows in, no rows out.
    """
    told, groups = copy_groups(docs)
    alone = told.where("NOT _lx_maybe").withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("long"))
    joined = hot_join(told.where("_lx_maybe"), groups, "text_sha256", "group_size", told.count(), "left")
    single = F.col("group_size").isNull()
    return alone.select("doc_id", "keep_id", "group_size", F.lit(True).alias("kept"), "text_sha256").unionByName(joined.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text has no copy with a smaller doc_id, with the columns of docs.

    Rows whose id is surely not dropped are kept where they lie; only the others are shuffled, at every size.
    """
    told, groups = copy_groups(docs)
    gone = (hot_join(told.where("_lx_maybe"), groups, "text_sha256", "group_size", told.count())
            .where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("_lx_id"), F.col("text_sha256").alias("_lx_gone")))
    gone = materialize(gone.distinct())
    seen = sifted(docs, docs["doc_id"], sieve(gone, "_lx_id"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    left = (seen.where("_lx_maybe").withColumn("_lx_sha", _digest(normalized()))
            .join(gone.hint("merge"), (F.col("_lx_sha") == F.col("_lx_gone")) & F.col("doc_id").eqNullSafe(F.col("_lx_id")), "left_anti"))
    return seen.where("NOT _lx_maybe").select(*columns).unionByName(left.select(*columns))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g ON t.text_sha256 = g.text_sha256
"""

"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk may end where the top bits of the gear hash of the last 32 bytes are zero, so boundaries move with the text:
an insertion changes the chunks around it and no others. Chunks are deduplicated by digest, in pairs of neighbours: the
first document that holds a pair holds some hundred bytes of the passage, where that of a lone chunk may hold a common
line only. Overlapping repeated pairs of a document are one run, and runs that are long enough are passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import hot_join, lean, materialize, ship, text_of

#: Bytes in a chunk at least and at most; a boundary at one of 2**BITS places on average.
LEAST, MOST, BITS = 20, 200, 5
#: Code points in a run of repeated chunks that counts as a passage.
MIN_RUN = 128
_WINDOW = 32
_BLOCK = 2_000_000


def gear_table(seed: int = 7) -> np.ndarray:
    """256 random 32-bit numbers; byte 0 has none, so runs of it keep texts apart."""
    table = np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
    table[0] = 0
    return table


def gear(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: h = 2 * h + table[byte] modulo 2**32, by doubling the span that is summed."""
    h = table[data]
    for shift in (1, 2, 4, 8, 16):
        wider = h.copy()
        wider[shift:] += h[:-shift] << np.uint32(shift)
        h = wider
    return h


def boundaries(start: int, end: int, places: list[int], starts_char: np.ndarray) -> list[int]:
    """Ends of the chunks of data[start:end] from the sorted places at which a chunk may end."""
    out, at = [], start
    for p in [*places, end]:
        while p - at > MOST:
            at += MOST
            while at < end and not starts_char[at]:
                at += 1
            if at >= end:
                break
            out.append(at)
        if p - at >= LEAST and p < end:
            out.append(p)
            at = p
    if end > start:
        out.append(end)
    return out


def _block_chunks(texts: list[bytes], table: np.ndarray) -> Iterator[tuple[int, list[int], list[int], list[int], bytes]]:
    """(text, starts, lengths in code points, byte places in the block, block) of every text that is not empty."""
    gap = b"\0" * _WINDOW
    joined = gap.join(texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    starts_char = (data & 0xC0) != 0x80
    chars = np.cumsum(starts_char)
    ends = np.flatnonzero((gear(data, table)[:-1] >> np.uint32(32 - BITS) == 0) & starts_char[1:]) + 1
    at = 0
    for i, text in enumerate(texts):
        if text:
            a, b = np.searchsorted(ends, (at + 1, at + len(text)))
            cut = boundaries(at, at + len(text), ends[a:b].tolist(), starts_char)
            begin = [at, *cut[:-1]]
            first = np.array(begin)
            # chars counts the starts up to and with a byte, so a chunk that begins at a start has one less before it
            own = chars[first] - chars[at]
            size = chars[np.array(cut) - 1] - chars[first] + 1
            yield i, own.tolist(), size.tolist(), [at, *cut], joined
        at += len(text) + _WINDOW


def _joined_pairs(start: list[int], length: list[int], places: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, first byte, last byte) of every pair of neighbours, and of chunks that are a passage alone."""
    last = len(start) - 1
    for i in range(last):
        yield start[i], length[i] + length[i + 1], places[i], places[i + 2]
    for i in range(last + 1):
        if not last or length[i] >= MIN_RUN:
            yield start[i], length[i], places[i], places[i + 1]


def _chunk_batches(batches: Iterator[pa.RecordBatch], pairs: bool = False):
    table = gear_table()
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= _BLOCK):
                size += len(texts[hi])
                hi += 1
            row, start, length, digest = [], [], [], []
            for i, s, n, places, joined in _block_chunks(texts[lo:hi], table):
                for a, m, x, y in _joined_pairs(s, n, places) if pairs else zip(s, n, places, places[1:]):
                    row.append(lo + i)
                    start.append(a)
                    length.append(m)
                    digest.append(blake2b(joined[x:y], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int32())), pa.array(start, pa.int32()), pa.array(length, pa.int32()),
                 pa.array(digest, pa.binary())], names=["doc_id", "start", "length", "digest"])
            lo = hi


def chunks(docs: DataFrame, pairs: bool = False) -> DataFrame:
    """(doc_id, start, length, digest): the chunks of every text, in code points. Rows without an id are left out.

    With ``pairs`` a row is a chunk and the next one together; a text of one chunk, and a chunk of MIN_RUN or more, is
    a row alone.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_of().alias("text")).mapInArrow(
        lean(lambda bs: _chunk_batches(bs, pairs)), f"doc_id {kind}, start int, length int, digest binary")


def repeated_passages(docs: DataFrame, min_run: int = MIN_RUN, inside: bool = False) -> DataFrame:
    """(doc_id, start, length, n_pairs, first_doc_ids, first_lengths): runs of chunk pairs whose first place is elsewhere.

    A pair counts if documents with different ids have it; it is repeated in all of them but the one with the least
    id, its first document (with ``inside`` at every place but the first, so repeats inside one document count, too).
    Overlapping repeated pairs form a run; runs of at least min_run code points are returned, with all first documents
    of their pairs and how many code points of the run those are first to hold. Rows that share an id are one
    document, rows without an id are left alone, null and empty texts have no chunks; no rows in, no rows out.
    """
    cut = materialize(chunks(docs, pairs=True))
    place = F.struct("doc_id", "start")
    counts = [F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("n")]
    if inside:
        shared = cut.groupBy("digest").agg(*counts, F.min(place).alias("first_place")).where("n > 1")
        again = F.struct("doc_id", "start") != F.col("first_place")
    else:
        shared = cut.groupBy("digest").agg(*counts).where("first_doc < last_doc")
        again = F.col("doc_id") != F.col("first_doc")
    met = hot_join(cut, materialize(shared), "digest", "n", cut.count()).where(again)
    end = F.col("start") + F.col("length")
    spans = met.select("doc_id", "start", end.alias("end"), "first_doc")
    order = Window.partitionBy("doc_id").orderBy("start", "end", "first_doc")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("opens", F.coalesce(reach <= F.col("start"), F.lit(True)).cast("int")).withColumn(
        "run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    of_first = Window.partitionBy("doc_id", "run", "first_doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    own = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(of_first), F.col("start"))))
    per = (runs.withColumn("own", own).groupBy("doc_id", "run", "first_doc")
           .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("own").alias("own"), F.count(F.lit(1)).alias("n")))
    firsts = F.sort_array(F.collect_list(F.struct("first_doc", "own")))
    return (per.groupBy("doc_id", "run")
            .agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"), F.sum("n").alias("n_pairs"), firsts.alias("firsts"))
            .where(F.col("length") >= min_run)
            .select("doc_id", "start", "length", "n_pairs", F.col("firsts.first_doc").alias("first_doc_ids"), F.col("firsts.own").alias("first_lengths")))


def without_passages(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """docs with the repeated passages cut out of their texts (column text), all rows and columns kept."""
    spans = (repeated_passages(docs, min_run).groupBy(F.col("doc_id").alias("_lx_id"))
             .agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("_lx_spans")))
    kept = F.expr("""concat(aggregate(_lx_spans, named_struct('out', '', 'at', 1),
        (s, x) -> named_struct('out', s.out || substring(text, s.at, greatest(0, x.start + 1 - s.at)), 'at', x.start + x.length + 1)).out,
        substring(text, aggregate(_lx_spans, 1, (s, x) -> x.start + x.length + 1)))""")
    joined = docs.join(spans, docs["doc_id"] == F.col("_lx_id"), "left")
    return joined.select(*[F.when(F.col("_lx_spans").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text"
                           else F.col(f"`{c}`") for c in docs.columns])

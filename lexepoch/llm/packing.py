"""Best-fit packing by a length histogram.

Pieces of one length are interchangeable, so the plan needs only how many there are of each length: at most
``capacity`` numbers. Best-fit decreasing over those counts gives, for each length, runs of slots (sequence numbers
and an offset); a piece takes the slot whose run holds its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import lean, materialize, rank_within, ship, shuffle_partitions, text_of
from .tokens import default_path, encoder

PIECES = "piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole capacities, the rest first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))] if n else []


def _piece_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    encode = encoder(path).encode
    for batch in batches:
        row, piece, start, length, crc, ids = [], [], [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            own = np.append(encode(text), np.uint32(end_id)).astype("<u4")
            for n, (at, size) in enumerate(cut(len(own), capacity)):
                part = own[at:at + size]
                row.append(i), piece.append(n), start.append(at), length.append(size)
                crc.append(zlib.crc32(part.tobytes()))
                if with_ids:
                    ids.append(part.astype(np.int32))
        cols = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=names)


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's tokens with end_id after them."""
    ship(docs.sparkSession)
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(lean(lambda bs: _piece_batches(bs, path, capacity, end_id, with_ids)),
        f"doc_id {kind}, {PIECES}" + ", ids array<int>" * with_ids)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts -> runs (length, rank_from, rank_to, sequence, each, offset).

    The piece of that length with rank r, rank_from <= r < rank_to, goes to sequence + (r - rank_from) // each, at
    offset + (r - rank_from) % each * length. Equal open sequences are one class: (room, first, count).
    """
    room: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # rooms in use, ascending
    runs, new = [], 0

    def put(size: int, first: int, count: int) -> None:
        if size > 0 and count > 0:
            if size not in room:
                bisect.insort(sizes, size)
                room[size] = []
            room[size].append((first, count))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):  # none has room: new sequences, as many as the rest needs when filled up
                each = capacity // length
                count = -(-left // each)
                put(capacity, new, count)
                new += count
                continue
            size = sizes[at]
            first, count = room[size].pop()
            if not room[size]:
                del room[size]
                sizes.pop(at)
            each = size // length
            full = min(count, left // each)
            if full:
                runs.append((length, rank, rank + full * each, first, each, capacity - size))
                put(size - each * length, first, full)
                rank, left = rank + full * each, left - full * each
                put(size, first + full, count - full)
            else:  # fewer than one sequence takes
                runs.append((length, rank, rank + left, first, left, capacity - size))
                put(size - left * length, first, 1)
                put(size, first + 1, count - 1)
                left = 0
    return runs


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Pieces (doc_id, piece, length, ...) with sequence_id and offset: gapless, at most capacity tokens each.

    ``pieces`` must give the same rows each time it is read (a written table does).
    """
    spark = pieces.sparkSession
    counted = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    runs = plan(counted, capacity)
    kinds = "length long, rank_from long, rank_to long, first long, each long, at long"
    slots = spark.createDataFrame(runs, kinds)
    longest = max(counted.values(), default=0)
    ranked = rank_within(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "_lx_rank", max(shuffle_partitions(spark), longest // 1_000_000 + 1))
    # The plan has a few runs for each length however many pieces there are, so its broadcast has a fixed bound.
    slots = F.broadcast(slots) if len(runs) <= 100_000 else slots
    placed = ranked.join(slots, "length").where("_lx_rank >= rank_from AND _lx_rank < rank_to")
    step = F.col("_lx_rank") - F.col("rank_from")
    return placed.select(*pieces.columns, (F.col("first") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
                         (F.col("at") + step % F.col("each") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Null and empty texts are one piece of the end token; repeated rows are packed each; null ids are carried along;
    an empty table gives no rows. Every row's whole text is packed.
    """
    return pack(materialize(token_pieces(docs, path, capacity, end_id, with_ids)), capacity)

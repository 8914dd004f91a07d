"""SimHash near-duplicates: fingerprints, pigeonring candidate search, groups.

Two fingerprints within ``max_bits`` of each other have, on the ring of ``segments`` bit segments, a start from which
every chain of l segments differs in at most ``floor(l * max_bits / segments)`` bits (strong pigeonring principle).
The first segments of that chain have a budget of zero, so they are equal and serve as an equi-join key; the
segments after them have a budget of one together, so all but one of a few parts are equal and lengthen the key.
Candidates that meet under a key must keep every budget of the chain before the full distance is taken.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import hot_join, lean, materialize, rank_within, ship, shuffle_partitions, sieve, sifted, text_of
from .components import components

#: Groups of at most so many fingerprints under one key are compared pairwise; larger ones are walked breadth first,
#: or in the pipeline's stage in rounds. No result hangs on it.
PAIRWISE = 16


# -- fingerprints -----------------------------------------------------------------------------------------------------
def shingle_bytes(text: bytes, k: int) -> list[bytes]:
    """Shingles of k words (ASCII white space, A-Z lowered), repeats kept; fewer words: all of them; none: nothing."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= k:
        return [b" ".join(words)]
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-k]]
    return [line[s:e - 1] for s, e in zip(starts, ends[k - 1:])]


def majority(features: list[bytes], seed: int) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the features' XXH64; no features: 0."""
    if not features:
        return 0
    count = np.zeros(64, np.int64)
    for i in range(0, len(features), 65_536):
        raw = b"".join([xxhash.xxh64_digest(f, seed) for f in features[i:i + 65_536]])
        count += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(features)).tobytes(), "big")


def weighted_majorities(words: Counter[bytes], seeds: list[int]) -> list[int]:
    """A SimHash per seed of words weighted by the root of how often they occur (in sixteenths); no words: 0.

    Every word is hashed once; each seed mixes the hashes anew.
    """
    if not words:
        return [0] * len(seeds)
    h = np.frombuffer(b"".join([xxhash.xxh64_digest(w) for w in words]), ">u8").astype(np.uint64)
    weight = np.rint(16 * np.sqrt(np.fromiter(words.values(), np.float64, len(words)))).astype(np.int64)
    out = []
    for seed in seeds:
        x = h ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        count = weight.astype(np.float64) @ bits  # whole numbers, so exact in any order
        out.append(int.from_bytes(np.packbits(2 * count > weight.sum()).tobytes(), "big"))
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], k: int, seeds: list[int], words: bool, digest: bool):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
        marks = np.zeros((len(seeds), len(texts)), np.uint64)
        digests = []
        for i, text in enumerate(texts):
            if digest:
                digests.append(xxhash.xxh3_128_digest(b" ".join(text.lower().split())))
            if words:
                marks[:, i] = weighted_majorities(Counter(text.lower().split()), seeds)
            else:
                features = shingle_bytes(text, k)
                marks[:, i] = [majority(features, seed) for seed in seeds]
        yield pa.RecordBatch.from_arrays(
            [ids, *(pa.array(m.view(np.int64)) for m in marks), *([pa.array(digests, pa.binary())] if digest else [])],
            names=["doc_id", *(f"fp{j}" for j in range(len(seeds))), *(["digest"] if digest else [])])


def fingerprints(docs: DataFrame, k: int = 5, seeds: tuple[int, ...] = (42,), words: bool = False, digest: bool = False) -> DataFrame:
    """(doc_id, fp0, fp1, ...): signed 64-bit SimHashes, one for each seed. Null texts count as empty (0).

    Features are k-word shingles with repeats, or with ``words`` single words weighted by the root of their counts.
    With ``digest`` a last column has a 128-bit digest of the words in their order.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"fp{j} long" for j in range(len(seeds))), *(["digest binary"] if digest else [])])
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(lean(lambda bs: _fingerprint_batches(bs, k, list(seeds), words, digest)), schema)


# -- pigeonring keys --------------------------------------------------------------------------------------------------
def budgets(max_bits: int, segments: int) -> list[int]:
    return [n * max_bits // segments for n in range(segments + 1)]


def _segment(i: int, segments: int) -> int:
    """Mask of segment i (modulo the ring) of a 64-bit fingerprint."""
    i %= segments
    lo, hi = 64 * i // segments, 64 * (i + 1) // segments
    return ((1 << hi) - 1) ^ ((1 << lo) - 1)


def ring_keys(max_bits: int, segments: int) -> list[tuple[int, int]]:
    """(start, mask) of every key: the equal head of a chain from start, and all but one part of its next stretch."""
    limit = budgets(max_bits, segments)
    head = max(n for n in range(segments + 1) if limit[n] == 0)
    stretch = [n for n in range(head, segments) if limit[n + 1] == 1]
    half = (len(stretch) + 1) // 2
    parts = [stretch[:half], stretch[half:]] if len(stretch) >= 4 else [[n] for n in stretch]
    keys = []
    for start in range(segments):
        base = 0
        for n in range(head):
            base |= _segment(start + n, segments)
        for left_out in parts if len(parts) > 1 else [None]:
            mask = base
            for part in parts:
                if part is not left_out and left_out is not None:
                    for n in part:
                        mask |= _segment(start + n, segments)
            keys.append((start, mask))
    return keys


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ring_ok(diff: np.ndarray, start: np.ndarray, masks: np.ndarray, limit: list[int]) -> np.ndarray:
    """Which differences keep every budget of the chain that begins at their key's start."""
    ok, total = np.ones(len(diff), bool), np.zeros(len(diff), np.int64)
    for n in range(len(masks)):
        total += np.bitwise_count(diff & masks[(start + n) % len(masks)])
        ok &= total <= limit[n + 1]
    return ok


def _walk(members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect one large group: breadth first, each member is reached once, by a true link."""
    left, out = members[1:], []
    queue = [members[0]] if len(members) else []
    while queue or len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        here = queue.pop()
        near = np.bitwise_count(left ^ here) <= max_bits
        for x in left[near]:
            out.append((int(x), int(here)))
            queue.append(x)
        left = left[~near]
    return out


def _link_batches(batches: Iterator[pa.RecordBatch], max_bits: int, segments: int, starts: list[int]):
    limit = budgets(max_bits, segments)
    masks = np.array([_segment(i, segments) for i in range(segments)], np.uint64)
    first = np.array(starts, np.int64)

    def links(tag: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.r_[True, (tag[1:] != tag[:-1]) | (key[1:] != key[:-1])]) if len(tag) else np.zeros(0, np.int64)
        size = np.diff(np.r_[cut, len(tag)])
        u, v = [], []
        end = np.repeat(cut + size, size)
        rows = np.flatnonzero(np.repeat((size > 1) & (size <= PAIRWISE), size))
        for d in range(1, PAIRWISE):
            rows = rows[rows + d < end[rows]]
            if not len(rows):
                break
            diff = fp[rows] ^ fp[rows + d]
            ok = _ring_ok(diff, first[tag[rows]], masks, limit)
            u.append(fp[rows[ok]])
            v.append(fp[rows[ok] + d])
        for at, n in zip(cut[size > PAIRWISE], size[size > PAIRWISE]):
            if found := _walk(fp[at:at + n], max_bits):
                pairs = np.array(found, np.uint64)
                u.append(pairs[:, 0])
                v.append(pairs[:, 1])
        u, v = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (u, v))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    rest = (np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    for batch in batches:
        new = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64))
        tag, key, fp = (np.concatenate(x) for x in zip(rest, new))
        same = (tag == tag[-1]) & (key == key[-1]) if len(tag) else np.zeros(0, bool)
        last = int(np.argmax(same)) if same.any() else 0
        yield links(tag[:last], key[:last], fp[:last])
        rest = (tag[last:], key[last:], fp[last:])
    yield links(*rest)


def links(marks: DataFrame, max_bits: int, segments: int = 8) -> DataFrame:
    """Links (u, v) between distinct fingerprints of column ``fp`` that connect exactly what max_bits connects.

    Under each key, small groups give all their pairs within max_bits, large ones a spanning forest of such pairs:
    the rows out stay in proportion to the rows in, however many fingerprints share a key.
    """
    ship(marks.sparkSession)
    keys = ring_keys(max_bits, segments)
    tagged = F.explode(F.array(*[
        F.struct(F.lit(i).cast("tinyint").alias("tag"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))
        for i, (_, mask) in enumerate(keys)])).alias("k")
    spread = marks.select("fp", tagged).select("k.tag", "k.key", "fp")
    n = shuffle_partitions(marks.sparkSession)
    starts = [start for start, _ in keys]
    return (spread.repartition(n, "tag", "key").sortWithinPartitions("tag", "key", "fp")
            .mapInArrow(lean(lambda bs: _link_batches(bs, max_bits, segments, starts)), "u long, v long"))


# -- the operator -----------------------------------------------------------------------------------------------------
def near_duplicates(docs: DataFrame, k: int = 5, max_bits: int = 2, segments: int = 8, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over fingerprint links.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows may repeat: each keeps its row. Null
    ids never become a component_id unless all ids of a component are null. An empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, k, (seed,)).withColumnRenamed("fp0", "fp"))
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    group = components(links(nodes.select("fp"), max_bits, segments))
    least = group.join(nodes, group.node == nodes.fp).groupBy("root").agg(F.min("first").alias("component_id"))
    linked = hot_join(group, group.groupBy("root").agg(F.count(F.lit(1)).alias("m")).join(least, "root"), "root", "m", nodes.count())
    of = (nodes.join(linked.select(F.col("node").alias("fp"), "component_id"), "fp", "left")
          .select("fp", "n", F.coalesce("component_id", "first").alias("component_id")))
    return hot_join(marked, materialize(of), "fp", "n", marked.count()).select("doc_id", "fp", "component_id")


# -- the pipeline's stage: links checked on five-word shingles --------------------------------------------------------
#: A pair at the very threshold differs by 3 bits or fewer under one seed in about a quarter of cases, so under one of
#: twelve seeds in 97 %; most near copies are well above the threshold.
SEEDS = tuple(range(1, 13))

#: Members of a cluster in one task, and the ranks at which the rounds over large clusters end.
BLOCK, ROUNDS = 4096, (1, 64, 4096)


#: Bits of a parity bitmap: it tells sets apart that are unlike and have up to about twice as many shingles.
PARITY_BITS = 512


def parity(shingles: np.ndarray) -> bytes:
    """Bitmap of a set of hashes: a bit is set if an odd number of them falls on it.

    A hash that only one of two sets holds changes one bit, so bitmaps differ in no more bits than the sets differ in hashes.
    """
    odd = np.bincount(shingles & (PARITY_BITS - 1), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_agree(size: np.ndarray, bits: np.ndarray, own_size: int, own_bits: np.ndarray, similarity: float) -> np.ndarray:
    """False where two sets surely have a Jaccard similarity under ``similarity``, by their sizes and parity bitmaps.

    Sets of sizes a and b that reach it differ in at most (a + b) (1 - similarity) / (1 + similarity) elements, and so do their bitmaps.
    """
    most = (size + own_size) * (1 - similarity) / (1 + similarity) + 1e-6
    near = np.abs(size - own_size) <= most
    near[near] = np.bitwise_count(bits[near] ^ own_bits).sum(1, dtype=np.int64) <= most[near]
    return near


def _shingle_sets(batches: Iterator[pa.RecordBatch], k: int):
    for batch in batches:
        sets = [np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(s, 0) for s in shingle_bytes(t, k)]), ">u8")
                          .astype(np.uint64)).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array([len(x) for x in sets], pa.int64()),
                                          pa.array([parity(x) for x in sets], pa.binary())], names=["id", "shingles", "size", "parity"])


def _candidate_batches(batches: Iterator[pa.RecordBatch], max_bits: int, ring: list[tuple[int, int]], segments: int, pairwise: int):
    """Rows (tag, fp, id) sorted by tag and key -> (u, v, hot): pairs to check, and where hot an edge from each member of a large group to its least id.

    Small groups give all their pairs; members of large groups meet later, in clusters.
    """
    limit = budgets(max_bits, segments)
    masks = np.array([_segment(i, segments) for i in range(segments)], np.uint64)
    first = np.array([start for start, _ in ring], np.int64)
    key_mask = np.array([mask for _, mask in ring], np.uint64)

    def pairs(tag, fp, ids):
        which = tag % len(ring)
        key = fp & key_mask[which]
        cut = np.flatnonzero(np.r_[True, (tag[1:] != tag[:-1]) | (key[1:] != key[:-1])]) if len(tag) else np.zeros(0, np.int64)
        size = np.diff(np.r_[cut, len(tag)])
        u, v, hot = [], [], []
        end = np.repeat(cut + size, size)
        at = np.flatnonzero(np.repeat((size > 1) & (size <= pairwise), size))
        for d in range(1, pairwise):
            at = at[at + d < end[at]]
            if not len(at):
                break
            diff = fp[at] ^ fp[at + d]
            # Equal fingerprints meet under every key; the first key is enough for them.
            ok = _ring_ok(diff, first[which[at]], masks, limit) & ((diff != 0) | (which[at] == 0))
            u.append(ids[at[ok]]), v.append(ids[at[ok] + d]), hot.append(np.zeros(ok.sum(), bool))
        for start, n in zip(cut[size > pairwise].tolist(), size[size > pairwise].tolist()):
            i = ids[start:start + n]
            u.append(i), v.append(np.full(n, i.min())), hot.append(np.ones(n, bool))
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(np.concatenate(hot) if hot else np.zeros(0, bool))], names=["u", "v", "hot"])

    held, count = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()))
        count += batch.num_rows
        if count < 50_000 or not batch.num_rows:
            continue
        tag, fp, ids = (np.concatenate(x) for x in zip(*held))
        same = (tag == tag[-1]) & ((fp ^ fp[-1]) & key_mask[tag[-1] % len(ring)] == 0)
        last = int(np.argmax(same))
        if last:
            yield pairs(tag[:last], fp[:last], ids[:last])
        held, count = [(tag[last:], fp[last:], ids[last:])], min(len(tag) - last, 49_999) if last else 0
    if held:
        yield pairs(*(np.concatenate(x) for x in zip(*held)))


def _block_batches(batches: Iterator[pa.RecordBatch], max_bits: int, similarity: float):
    """Rows (root, block, pivot, rank, component, id, size, parity, fps) sorted by root, block and pivot, members before pivots -> pairs (u, v).

    A pivot meets the members of the block that come after it and are not joined with it yet, if they are within
    max_bits under any seed and their shingle sets may be alike. A block's members are held, pivots pass by.
    """
    at, held, members = None, [], None

    def columns(batch, a, b):
        part = batch.slice(a, b - a)
        rank, comp, ids, size = (part.column(i).to_numpy() for i in (3, 4, 5, 6))
        bits = np.frombuffer(b"".join(part.column(7).to_pylist()), np.uint64).reshape(-1, PARITY_BITS // 64)
        return rank, comp, ids, size, bits, part.column(8).flatten().to_numpy().view(np.uint64).reshape(len(rank), -1)

    for batch in batches:
        root, block, pivot = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
        cut = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (block[1:] != block[:-1]) | (pivot[1:] != pivot[:-1]), True]) if len(root) else []
        for a, b in zip(cut, cut[1:]):
            if (root[a], block[a]) != at:
                at, held, members = (root[a], block[a]), [], None
            if not pivot[a]:
                held.append(columns(batch, a, b))
                continue
            if not held:
                continue  # a pivot alone in its block
            if members is None:
                members = [np.concatenate(x) for x in zip(*held)]
            rank, comp, ids, size, bits, fps = members
            u, v = [], []
            for p_rank, p_comp, p_id, p_size, p_bits, p_fps in zip(*columns(batch, a, b)):
                met = np.flatnonzero((rank > p_rank) & (comp != p_comp))
                met = met[(np.bitwise_count(fps[met] ^ p_fps) <= max_bits).any(1)]
                if len(met):
                    met = met[may_agree(size[met], bits[met], p_size, p_bits, similarity)]
                u.append(ids[met]), v.append(np.full(len(met), p_id))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u), pa.int64()), pa.array(np.concatenate(v), pa.int64())], names=["u", "v"])


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(id, shingles, size, parity) of the texts whose doc_id is one of the distinct ids ``wanted``."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text"))
    texts = (sifted(ids, F.col("id"), sieve(wanted, "id")).where("_lx_maybe").select("id", "text")
             .join(wanted.hint("merge"), "id", "left_semi"))
    ship(docs.sparkSession)
    return materialize(texts.mapInArrow(lean(lambda bs: _shingle_sets(bs, k)), "id long, shingles array<long>, size long, parity binary"))


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of ids whose shingle sets have a Jaccard similarity of at least ``similarity``."""
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("s"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    return materialize(pairs.join(left, "u").join(right, "v")
                       .where(both >= F.lit(similarity) * (F.size("s") + F.size("t") - both)).select("u", "v"))


def _stars(links: DataFrame) -> DataFrame:
    """Links (u, v), u > v, that connect what ``links`` connect: each u with its least v, and with that v its other ones.

    A leader that many u share is linked once with each other leader, however many u they share. All links of a u meet in
    one task, so it is meant for links under keys, which are at most some hundreds for any u.
    """
    least = links.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return (least.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .distinct())


def near_duplicate_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8, max_bits: int = 3, segments: int = 8, seeds: tuple[int, ...] = SEEDS,
                          pairwise: int = PAIRWISE, block: int = BLOCK, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """(doc_id, group_id) of documents in groups of near copies; group_id is the least doc_id of its group.

    Candidates: SimHash over each document's words, within max_bits for any of the seeds; several seeds find what one
    misses by chance, and keep the keys of each long enough to be selective in a large corpus. A link stands only
    if the sets of k-word shingles have a Jaccard similarity of at least ``similarity``. Documents whose id is null
    and documents without words are left alone; documents of equal words in equal order are one
    candidate, named by the least doc_id, and all others meet each other even if their fingerprints are equal. Rows that
    share an id are one document: they are in one group, named by that id. doc_id must be a whole number.

    Small groups under a key give all their pairs. Large groups that share members are one cluster, whose members are
    met once, not once a key: in rounds the member of most groups, members up to some rank, and at last all, meet all later ones that are not yet
    joined with them by checked links, in blocks that many tasks share. So every candidate pair is checked or joined.
    Pairs that the sizes and parity bitmaps of their shingle sets prove to be under the similarity are not made.
    """
    spark = docs.sparkSession
    named = docs.where(F.col("doc_id").isNotNull() & text_of().rlike(r"[^\x20\x09-\x0D]"))
    marks = [f"fp{j}" for j in range(len(seeds))]
    marked = materialize(fingerprints(named, seeds=seeds, words=True, digest=True).withColumn("id", F.col("doc_id").cast("long")))
    nodes = materialize(marked.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"),
                                                     *[F.min(m).alias(m) for m in marks]))
    repeated = nodes.where("first < last").select("digest", "first", "n")
    linked = materialize(hot_join(marked.select("digest", "id"), repeated, "digest", "n", marked.count())
                         .where("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v")))

    ring = ring_keys(max_bits, segments)
    key = F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(_signed(mask)) for _, mask in ring]),
                                              F.pmod(F.col("tag").cast("int"), F.lit(len(ring))) + 1))
    seeded = nodes.select(F.posexplode(F.array(*marks)).alias("seed", "fp"), F.col("first").alias("id"))
    spread = (seeded.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(ring) - 1))).alias("which"))
              .select((F.col("seed") * len(ring) + F.col("which")).cast("smallint").alias("tag"), "fp", "id"))
    found = materialize(spread.repartition(F.col("tag"), key).sortWithinPartitions(F.col("tag"), key).mapInArrow(
        lean(lambda bs: _candidate_batches(bs, max_bits, ring, segments, pairwise)), "u long, v long, hot boolean"))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    before = materialize(ordered(found.where("NOT hot")))
    wanted = materialize(before.select(F.col("u").alias("id")).union(before.select(F.col("v").alias("id"))).distinct())
    checked = _checked(before, _sets_of(docs, wanted, k), similarity)
    joined = components(linked.unionByName(_stars(checked)))
    out = lambda: joined.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"))
    hot = materialize(ordered(found.where("hot")))
    if not hot.limit(1).count():
        return out()
    clusters = components(_stars(hot))
    sets = _sets_of(docs, materialize(clusters.select(F.col("node").alias("id"))), k)
    fps = nodes.select(F.col("first").alias("id"), F.array(*marks).alias("fps"))
    members = clusters.withColumnRenamed("node", "id").join(fps, "id").join(sets.select("id", "size", "parity"), "id")
    # The member of most groups comes first: most others are near to it.
    degree = found.where("hot").groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    members = materialize(rank_within(materialize(members.join(degree, "id")), ["root"], ["id"], "rank", shuffle_partitions(spark)))
    total = members.count()
    centres = members.groupBy("root").agg(F.max(F.struct("degree", "id"))["id"].alias("_lx_centre"), F.count(F.lit(1)).alias("_lx_m"))
    members = materialize(hot_join(members, materialize(centres), "root", "_lx_m", total).withColumn(
        "rank", F.when(F.col("id") == F.col("_lx_centre"), 0).otherwise(F.col("rank") + 1)).drop("_lx_centre", "_lx_m", "degree"))
    largest = members.agg(F.max("rank")).first()[0] + 1
    lo = 0
    for hi in [*(r for r in rounds if r < largest), largest]:
        placed = members.join(joined.select(F.col("node").alias("id"), F.col("root").alias("_lx_root")), "id", "left").withColumn("component", F.coalesce("_lx_root", "id")).drop("_lx_root")
        open_ = (placed.groupBy("root").agg(F.min("component").alias("_lx_a"), F.max("component").alias("_lx_b"), F.count(F.lit(1)).alias("_lx_n"))
                 .where("_lx_a < _lx_b").select("root", "_lx_n", F.floor(F.col("_lx_n") / block).cast("int").alias("_lx_last")))
        live = hot_join(placed, materialize(open_), "root", "_lx_n", total)
        own = F.floor(F.col("rank") / block).cast("int")
        columns = ["root", "block", "pivot", "rank", "component", "id", "size", "parity", "fps"]
        # Pivots go to the blocks of later members, members stay in their own.
        rows = (live.where(F.col("rank") > lo).withColumn("block", own).withColumn("pivot", F.lit(False)).select(columns).unionByName(
            live.where(F.col("rank").between(lo, hi - 1)).withColumn("block", F.explode(F.sequence(own, F.col("_lx_last")))).withColumn("pivot", F.lit(True)).select(columns)))
        pairs = rows.repartition("root", "block").sortWithinPartitions("root", "block", "pivot").mapInArrow(
            lean(lambda bs: _block_batches(bs, max_bits, similarity)), "u long, v long")
        pairs = materialize(ordered(pairs).join(before, ["u", "v"], "left_anti"))
        before, lo = before.unionByName(pairs), hi
        checked = _checked(pairs, sets, similarity)
        if checked.limit(1).count():
            # What is joined goes on as one edge from each member to its root.
            joined = components(joined.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(checked))
    return out()

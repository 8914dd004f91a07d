"""Mixing sources to target weights by the cube method.

A source whose target is p times its size gives floor(p) copies of every document and one more with probability
frac(p). Those probabilities are moved through the null space of two constraints, words and documents, until they are
0 or 1: the expected totals stay as they are at each move. Sources are cut into blocks, each block leaves at most two
probabilities open, open rows are regrouped into blocks, and the last block of a source lands: its few open rows are
rounded so that the source's words come nearest to the target, and a few roundings are taken back for what is left.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import materialize, ship, text_of

#: Fixed weights by the sources' order, repeating.
WEIGHTS = (5, 2, 1)
BLOCK = 4096


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves p to 0 or 1 within sum(p * size) and sum(p); at most two stay between."""
    p, eps = p.astype(float).copy(), 1e-9
    open_rows = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    p[p <= eps], p[p >= 1 - eps] = 0.0, 1.0
    draws = iter(rng.random(2 * len(open_rows) + 8).tolist())
    s, q = size.astype(float).tolist(), p.tolist()
    active, waiting = [], iter(open_rows)
    while True:
        while len(active) < 3 and (i := next(waiting, None)) is not None:
            active.append(i)
        if len(active) < 2 or len(active) == 2 and s[active[0]] != s[active[1]]:
            break
        if len(active) == 2:
            u = (1.0, -1.0)
        else:
            a, b, c = (s[i] for i in active)
            u = (b - c, c - a, a - b) if (b - c or c - a) else (1.0, -1.0, 0.0)
        up = min((1 - q[i]) / x if x > 0 else q[i] / -x for i, x in zip(active, u) if x)
        down = min(q[i] / x if x > 0 else (1 - q[i]) / -x for i, x in zip(active, u) if x)
        step = up if next(draws) * (up + down) < down else -down
        for i, x in zip(active, u):
            q[i] = min(1.0, max(0.0, q[i] + step * x))
            q[i] = 0.0 if q[i] <= eps else 1.0 if q[i] >= 1 - eps else q[i]
        active = [i for i in active if 0 < q[i] < 1]
    return np.array(q)


def land(size: np.ndarray, before: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rounds the open rows of p so that words, then documents, come nearest to what ``before`` had.

    What error that leaves is worked off by taking back a few roundings: single rows or pairs of rows with an open
    probability before, as long as the error shrinks.
    """
    p = p.copy()
    rows = np.flatnonzero((p > 0) & (p < 1))
    if len(rows):
        words, docs = (p[rows] * size[rows]).sum(), p[rows].sum()
        p[rows] = min(itertools.product((0.0, 1.0), repeat=len(rows)),
                      key=lambda x: (round(abs(np.dot(x, size[rows]) - words), 6), abs(sum(x) - docs), x))
    free = np.flatnonzero((before > 1e-9) & (before < 1 - 1e-9) & (size > 0))
    for _ in range(8 if len(free) else 0):
        error = float((p * size).sum() - (before * size).sum())
        change = np.where(p[free] > 0.5, -size[free], size[free])
        order = np.argsort(change, kind="stable")
        best = (abs(error), ())
        i = int(np.argmin(np.abs(error + change)))
        best = min(best, (abs(error + float(change[i])), (i,)))
        at = np.clip(np.searchsorted(change[order], -error - change), 1, len(free) - 1) if len(free) > 1 else None
        for shift in (0, 1) if at is not None else ():
            j = order[at - shift]
            left = np.where(j == np.arange(len(free)), np.inf, np.abs(error + change + change[j]))
            i = int(np.argmin(left))
            best = min(best, (float(left[i]), (i, int(j[i]))))
        if best[0] >= abs(error) - 0.5:
            break
        for i in best[1]:
            p[free[i]] = 1 - p[free[i]]
    return p


def _settle(key: tuple, rows: pd.DataFrame, last: bool) -> pd.DataFrame:
    rows = rows.sort_values(["_lx_h", "_lx_size"], kind="stable").reset_index(drop=True)
    size, p = rows["_lx_size"].to_numpy(float), rows["_lx_p"].to_numpy(float)
    rng = np.random.default_rng(zlib.crc32(repr([int(k) for k in key]).encode()))
    moved = flight(size, p, rng)
    rows["_lx_p"] = land(size, p, moved) if last else moved
    return rows


def source_targets(sized: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, n, target, sid) of sized (source, size): sources by code point, null last.

    One row per source, ranked by a distributed sort. Only scalars come to the driver: the level at which
    uncapped sources share what capped ones leave, found by rounds of sums.
    """
    spark = sized.sparkSession
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ordered = per.orderBy(F.col("source").asc_nulls_last()).withColumn("_lx_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_lx_at", 33)
    parts = ordered.groupBy(part.alias("_lx_part")).agg(F.count(F.lit(1)).alias("_lx_n"))  # a row per partition
    before = parts.select("_lx_part", F.coalesce(F.sum("_lx_n").over(Window.orderBy("_lx_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_lx_off"))
    ranked = (ordered.withColumn("_lx_part", part).join(before, "_lx_part")
              .withColumn("sid", (F.col("_lx_off") + F.col("_lx_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    of = ranked.select("source", "source_size", "n", "sid", weight.alias("_lx_w")).checkpoint()
    total = of.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    top = F.col("source_size") * F.lit(cap)
    while True:
        over = top <= F.lit(level) * F.col("_lx_w")
        got = of.agg(F.count_if(over), F.sum(F.when(over, top).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("_lx_w")))).first()
        if got[0] == capped or not got[2]:
            break
        capped = got[0]
        level = (share * total - got[1]) / got[2]
    return of.select("source", "source_size", "n", F.least(top, F.lit(level) * F.col("_lx_w")).alias("target"), "sid")


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken (= copies * size), text_hash.

    Size is the number of words (runs of non-white-space). Each row's copies are floor or ceil of its source's rate,
    never above 2. A document without words takes part in the document count only. Null texts have size 0, a null
    source is a source of its own and the last one, repeated rows are drawn each by their order, an empty table gives
    no rows. Draws hang on ids and sizes only, so reruns agree.
    """
    spark = docs.sparkSession
    ship(spark)
    size = F.size(F.expr(r"regexp_extract_all(coalesce(cast(text AS string), ''), '[^\\x20\\x09-\\x0D]+', 0)")).cast("long")
    sized = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("text_hash")))
    targets = materialize(source_targets(sized))
    t = targets.select(F.col("source").alias("_lx_s"), "source_size", "n", "target", "sid")
    n_sources = targets.count()
    t = F.broadcast(t) if n_sources <= 100_000 else t
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = sized.join(t, sized.source.eqNullSafe(F.col("_lx_s")))
    h = F.xxhash64("doc_id", "size", "text_hash")
    units = rated.select("doc_id", "source", "size", "text_hash", "source_size", "target",
                         F.floor(rate + 1e-9).cast("int").alias("_lx_base"), F.col("sid").alias("_lx_sid"), F.col("n").alias("_lx_n"),
                         F.col("size").alias("_lx_size"), h.alias("_lx_h"), F.greatest(F.lit(0.0), rate - F.floor(rate + 1e-9)).alias("_lx_p"))
    out, now = None, units
    while True:
        blocks = F.ceil(F.col("_lx_n") / block).cast("long")
        dealt = now.withColumn("_lx_blocks", blocks).withColumn("_lx_block", F.pmod(F.xxhash64("_lx_h"), F.col("_lx_blocks")))
        schema = dealt.schema
        settled = materialize(dealt.groupBy("_lx_sid", "_lx_block").applyInPandas(
            lambda key, rows: _settle(key, rows, bool((rows["_lx_blocks"] <= 1).all())), schema))
        is_open = (F.col("_lx_p") > 0) & (F.col("_lx_p") < 1)
        done = settled.where(~is_open)
        out = done if out is None else out.unionByName(done)
        still = settled.where(is_open)
        per = materialize(still.groupBy("_lx_sid").agg(F.count(F.lit(1)).alias("_lx_m")))
        if not per.limit(1).count():
            break
        per = F.broadcast(per) if n_sources <= 100_000 else per
        now = still.join(per, "_lx_sid").withColumn("_lx_n", F.col("_lx_m")).drop("_lx_m", "_lx_blocks", "_lx_block").select(*units.columns)
    copies = (F.col("_lx_base") + F.round("_lx_p").cast("int")).alias("copies")
    return out.select("doc_id", "source", "size", "source_size", "target", "text_hash", copies,
                      (F.col("size") * (F.col("_lx_base") + F.round("_lx_p").cast("int"))).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it (0, 1 or 2), with the columns of docs.

    Rows that share id, source and text share one number of copies.
    """
    taken = (mix(docs).groupBy(F.col("doc_id").alias("_lx_id"), F.col("source").alias("_lx_source"), F.col("text_hash").alias("_lx_of"))
             .agg(F.max("copies").alias("_lx_copies")))
    tagged = docs.withColumn("_lx_hash", F.xxhash64("text"))
    joined = tagged.join(taken, tagged["doc_id"].eqNullSafe(F.col("_lx_id")) & (F.col("_lx_hash") == F.col("_lx_of"))
                         & tagged["source"].cast("string").eqNullSafe(F.col("_lx_source")))
    return (joined.where("_lx_copies > 0").withColumn("_lx_i", F.explode(F.sequence(F.lit(1), F.col("_lx_copies"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))

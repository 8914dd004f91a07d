"""Spelling variants: words one edit apart, found in a trie over letter-group counts, and the chains of forms they give.

Every word has a vector of counts, one for each group of letters. The trie arranges words by these counts, one group a
level. A word looks for others depth-first with a budget of one surplus and one deficit: a level may hold one letter
more than the word once, and, after that, one letter less once. An inserted letter is one surplus, a replaced one a
surplus and a deficit (or none, within one group), so each pair is found from one of its two words: the shorter one, or
the one that gains a letter of the earlier group. Words that a leaf holds are verified.

Spread over tasks, the trie is cut into cells: the top levels are a join key, which is as long as it takes for a cell to
hold at most CELL words, and every word is sent with what is left of its budget to the cells that its search reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import lean, materialize, ship, text_of

#: Letter groups, the levels of the trie from the top; all other letters are one more group.
GROUPS = ("e", "a", "i", "n", "r", "s", "t", "o", "l", "ud", "cm", "pgb", "hfv", "ykw", "qjxz")

#: Levels of the shortest cell key, words of a cell, and searches in one block of a cell.
TOP, CELL, SEARCHES = 4, 50_000, 200_000

#: Words up to this length are compared as rows of an array, longer ones one by one.
WIDE = 40

#: Searches that go down the trie together, and comparisons at which a branch is a leaf.
TOGETHER, LEAF = 50_000, 8_192

_LEVELS = len(GROUPS) + 1
_GROUP_OF = np.full(1 << 16, _LEVELS - 1, np.uint8)
for _i, _letters in enumerate(GROUPS):
    for _c in _letters:
        _GROUP_OF[ord(_c)] = _i
_GROUP_OF[0] = _LEVELS  # padding

_RUN = r"[A-Za-zÀ-ÿ]"


# -- words ------------------------------------------------------------------------------------------------------------
def words(docs: DataFrame, least_length: int = 7, least_n: int = 2, every: int = 31) -> DataFrame:
    """(word, n): the runs of letters of all texts, one letter lost where ``every`` divides the hash of id and run."""
    # Shorter runs can not become long enough.
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text_of(), F.lit(f"({_RUN}{{{least_length},}})"), 1)).alias("run"))
    low = runs.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    hashed = low.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
    run = F.col("run")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    lost = hashed.select(F.when(F.pmod(F.col("h"), F.lit(every)) == 0, less).otherwise(run).alias("word"))
    return lost.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


# -- cells ------------------------------------------------------------------------------------------------------------
def _count(level: int) -> Column:
    """How many letters of the level's group the column ``word`` has."""
    word = F.col("word")
    if level < len(GROUPS):
        return F.length(word) - F.length(F.translate(word, GROUPS[level], ""))
    return F.length(F.translate(word, "".join(GROUPS), ""))


def _key(levels: int) -> Column:
    return F.concat_ws(".", *(_count(i).cast("string") for i in range(levels)))


#: What is left of a search: both, the deficit only, nothing.
BOTH, DEFICIT, NOTHING = 2, 1, 0


def _reached(levels: int) -> Column:
    """(key, left) of each cell at the given depth that a word's search reaches."""
    own = [_count(i) for i in range(levels)]

    def variant(up: int, down: int, left: int) -> Column:
        parts = [c + 1 if i == up else c - 1 if i == down else c for i, c in enumerate(own)]
        found = F.struct(F.concat_ws(".", *(p.cast("string") for p in parts)).alias("key"), F.lit(left).alias("left"))
        return found if down < 0 else F.when(own[down] > 0, found)

    return F.array(variant(-1, -1, BOTH), *(variant(i, -1, DEFICIT) for i in range(levels)),
                   *(variant(i, j, NOTHING) for i in range(levels) for j in range(i + 1, levels)))


def _deeper(level: int) -> Column:
    """The cells one level below the cell of a search."""
    own, key, left = _count(level), F.col("key"), F.col("left")

    def step(count: Column, rest: Column) -> Column:
        return F.struct(F.concat_ws(".", key, count.cast("string")).alias("key"), rest.alias("left"))

    return F.array(step(own, left), F.when(left == BOTH, step(own + 1, F.lit(DEFICIT))), F.when((left == DEFICIT) & (own > 0), step(own - 1, F.lit(NOTHING))))


def _cells(table: DataFrame, top: int, cell: int, searches: int) -> DataFrame:
    """(key, block, search, left, word, n): the words of every cell, and after them the searches that reach it."""
    level, parts = top, []
    asked = table.select("word", "n", F.explode(_reached(level)).alias("_lx_to")).where("_lx_to IS NOT NULL").select("word", "n", "_lx_to.*")
    held = table.select("word", "n", _key(level).alias("key"))
    while True:
        sizes = materialize(held.groupBy("key").agg(F.count(F.lit(1)).alias("_lx_words")))
        full = F.col("_lx_words") > cell
        more = level < _LEVELS and sizes.where(full).limit(1).count() > 0
        here = sizes.where(~full).select("key") if more else sizes.select("key")
        parts.append((held.join(here, "key"), asked.join(here, "key")))
        if not more:
            break
        below = sizes.where(full).select("key")
        asked = materialize(asked.join(below, "key").select("word", "n", F.explode(_deeper(level)).alias("_lx_to")).where("_lx_to IS NOT NULL").select("word", "n", "_lx_to.*"))
        held = held.join(below, "key").select("word", "n", F.concat_ws(".", "key", _count(level).cast("string")).alias("key"))
        level += 1
    held, asked = parts[0]
    for h, a in parts[1:]:
        held, asked = held.unionByName(h), asked.unionByName(a)
    asked = materialize(asked)
    # A cell that many searches reach is worked on by several tasks, each with all its words.
    blocks = asked.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / searches).cast("int").alias("_lx_blocks"))
    dealt = asked.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("word"), F.col("_lx_blocks")).cast("int"))
    copied = held.join(blocks, "key").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_lx_blocks") - 1)))
    columns = ["key", "block", "search", "left", "word", "n"]
    return (copied.withColumn("search", F.lit(False)).withColumn("left", F.lit(BOTH)).select(columns)
            .unionByName(dealt.withColumn("search", F.lit(True)).select(columns)))


# -- the trie of a cell -----------------------------------------------------------------------------------------------
def _letters(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the first WIDE letters of each word, zeros after them, and the lengths."""
    codes = np.array([w[:WIDE] for w in found], dtype=f"<U{WIDE}").view(np.uint32).reshape(len(found), WIDE).astype(np.uint16)
    return codes, np.array([len(w) for w in found], np.int64)


def _vectors(found: list[str], codes: np.ndarray) -> np.ndarray:
    groups = _GROUP_OF[codes]
    out = np.stack([(groups == g).sum(1) for g in range(_LEVELS)], axis=1).astype(np.int32)
    for i, w in enumerate(found):
        if len(w) > WIDE:
            out[i] = np.bincount(_GROUP_OF[np.array([ord(c) for c in w])], minlength=_LEVELS)[:_LEVELS]
    return out


def near(a: str, b: str) -> bool:
    """Whether b is a with exactly one letter inserted or replaced."""
    if len(a) == len(b):
        return sum(map(str.__ne__, a, b)) == 1
    if len(b) != len(a) + 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at:] == b[at + 1:]


class Trie:
    """The words of one cell in the order of their vectors, so that every node of the trie is a range of them."""

    def __init__(self, found: list[str], top: int):
        codes, _ = _letters(found)
        vectors = _vectors(found, codes)
        order = np.lexsort(vectors.T[::-1])
        self.words, self.top = [found[i] for i in order.tolist()], top
        self.codes, self.sizes = _letters(self.words)
        self.vectors = vectors[order]

    def search(self, found: list[str], left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a search and a word of the trie that is near it; of two words with equal vectors the lesser one searches."""
        codes, sizes = _letters(found)
        vectors = _vectors(found, codes)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self._down(0, len(self.words), self.top, np.arange(len(found)), left, vectors, pairs)
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, w = (np.concatenate(x) for x in zip(*pairs))
        kept = np.zeros(len(q), bool)
        for a in range(0, len(q), TOGETHER):
            kept[a:a + TOGETHER] = self._verify(found, codes, sizes, vectors, q[a:a + TOGETHER], w[a:a + TOGETHER])
        return q[kept], w[kept]

    def _down(self, lo: int, hi: int, level: int, q: np.ndarray, left: np.ndarray, vectors: np.ndarray, pairs: list) -> None:
        if not len(q):
            return
        if level == _LEVELS or (hi - lo) * len(q) <= LEAF or hi - lo <= 4:
            step = max(1, 64 * LEAF // (hi - lo))
            for a in range(0, len(q), step):
                self._leaf(lo, hi, level, q[a:a + step], left[a:a + step], vectors, pairs)
            return
        column = self.vectors[lo:hi, level]
        ends = [lo, *(lo + 1 + np.flatnonzero(np.diff(column))).tolist(), hi]
        own = vectors[q, level]
        for a, b in zip(ends, ends[1:]):
            count = int(self.vectors[a, level])
            same, more, less = own == count, (own == count - 1) & (left == BOTH), (own == count + 1) & (left == DEFICIT)
            go = same | more | less
            self._down(a, b, level + 1, q[go], np.where(more, DEFICIT, np.where(less, NOTHING, left))[go], vectors, pairs)

    def _leaf(self, lo: int, hi: int, level: int, q: np.ndarray, left: np.ndarray, vectors: np.ndarray, pairs: list) -> None:
        """The rest of the vectors must fit the rest of the budget, the surplus before the deficit."""
        fits = np.ones((len(q), hi - lo), bool)
        state = np.broadcast_to(left[:, None], fits.shape).copy()
        for k in range(level, _LEVELS):
            d = self.vectors[lo:hi, k][None, :] - vectors[q, k][:, None]
            up, down = d == 1, d == -1
            fits &= (d == 0) | (up & (state == BOTH)) | (down & (state == DEFICIT))
            state -= (up | down).astype(state.dtype)
        a, b = np.nonzero(fits)
        if len(a):
            pairs.append((q[a], b + lo))

    def _verify(self, found: list[str], codes: np.ndarray, sizes: np.ndarray, vectors: np.ndarray, q: np.ndarray, w: np.ndarray) -> np.ndarray:
        a, b, grown = codes[q], self.codes[w], self.sizes[w] - sizes[q]
        differ = a != b
        replaced = (grown == 0) & (differ.sum(1) == 1)
        first = np.where(differ.any(1), differ.argmax(1), WIDE)
        shifted = a[:, :-1] != b[:, 1:]
        inserted = (grown == 1) & ~(shifted & (np.arange(WIDE - 1)[None, :] >= first[:, None])).any(1)
        out = replaced | inserted
        for i in np.flatnonzero(np.maximum(sizes[q], self.sizes[w]) > WIDE).tolist():
            out[i] = near(found[q[i]], self.words[w[i]])
        # Equal vectors: both words search, one of them counts.
        for i in np.flatnonzero(out & (grown == 0)).tolist():
            if found[q[i]] > self.words[w[i]] and (vectors[q[i]] == self.vectors[w[i]]).all():
                out[i] = False
        return out


def _near_batches(batches: Iterator[pa.RecordBatch]):
    """Rows of cells in order, words before searches, to (word, n_near, other_n, other) rows of near words, both ways."""
    at, held, held_n, trie, asked = None, [], [], None, []

    def answers():
        words_, counts, lefts = [x[0] for x in asked], [x[1] for x in asked], np.array([x[2] for x in asked], np.int64)
        q, w = trie.search(words_, lefts)
        if not len(q):
            return
        near_n = dict(zip(held, held_n))
        mine, other = [words_[i] for i in q.tolist()], [trie.words[i] for i in w.tolist()]
        mine_n, other_n = [counts[i] for i in q.tolist()], [near_n[x] for x in other]
        yield pa.RecordBatch.from_pydict({"word": pa.array(mine + other, pa.string()), "other": pa.array(other + mine, pa.string()), "other_n": pa.array(other_n + mine_n, pa.int64())})

    for batch in batches:
        for key, block, search, left, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, block) != at:
                if asked:
                    yield from answers()
                at, held, held_n, trie, asked = (key, block), [], [], None, []
            if not search:
                held.append(word), held_n.append(n)
                continue
            if trie is None:
                trie = Trie(held, key.count(".") + 1)
            asked.append((word, n, left))
            if len(asked) >= TOGETHER:
                yield from answers()
                asked = []
    if asked:
        yield from answers()


def near_words(table: DataFrame, top: int = TOP, cell: int = CELL, searches: int = SEARCHES) -> DataFrame:
    """(word, other, other_n) for every pair of distinct words (word, n) of the table that are one edit apart, both ways."""
    spark = table.sparkSession
    ship(spark)
    rows = _cells(table, top, cell, searches)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = rows.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "search")
    return ordered.mapInArrow(lean(_near_batches), "word string, other string, other_n long")


# -- forms ------------------------------------------------------------------------------------------------------------
def roots(links: DataFrame) -> DataFrame:
    """(word, root): where each word's chain of forms (word, form) ends, by pointer doubling. Chains must not return."""
    now = materialize(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_lx_next"))
        moved = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("_lx_next", "root").alias("root"), F.col("_lx_next").isNotNull().alias("_lx_moved")))
        if not moved.where("_lx_moved").limit(1).count():
            return moved.select("word", "root")
        now = moved.select("word", "root")


def variants(docs: DataFrame, least_length: int = 7, least_n: int = 2, every: int = 31, times: int = 10, top: int = TOP, cell: int = CELL, searches: int = SEARCHES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of at least least_length letters and least_n occurrences.

    A form is the most frequent near word (the first in code-point order among equals) if it occurs at least ``times`` as
    often; the root is where forms lead to. Null and empty texts have no words, a null id is hashed as an empty one,
    repeated rows count each, other columns are not read; an empty table gives no rows.
    """
    table = materialize(words(docs, least_length, least_n, every))
    best = (near_words(table, top, cell, searches).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best")))
    joined = table.join(best, "word", "left")
    fits = F.coalesce(-F.col("best.less") >= times * F.col("n"), F.lit(False))
    formed = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                       F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    ends = roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _oracle() -> str:
    from .resampling import _CRC, crc_sql
    return f"""
WITH RECURSIVE {_CRC.strip()},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS hashed, run, count(*) AS n FROM runs GROUP BY ALL),
h AS (SELECT run, n, {crc_sql('hashed')} AS h FROM counted, crc_table),
lost AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM lost WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
         UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min(ROW(-other_n, other)) AS best FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 10 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 10 * n THEN -best[1] END AS form_n
           FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS steps FROM formed UNION ALL SELECT chain.word, formed.form, steps + 1 FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word) USING (word)"""


ORACLE = _oracle()

"""SentencePiece BPE over whole texts by vectorised merge rounds, and the way back from ids to text.

Texts are cut into words (a run of spaces and what follows it) and, within words, where no piece of the vocabulary
holds the two neighbouring characters; no merge crosses such a cut. All segments of a block of new words lie in one
flat numpy array of symbols. In each round every segment finds the lowest rank among its pairs, all its pairs of that
rank are merged at once, leftmost first where they overlap, and the array is compacted, until no pair remains.

Merging at once is what one merge after the other gives as long as no merge brings up a pair of a rank as low as the
round's. A segment where one does (runs of spaces, whose pieces tie, and pieces made in an unusual order) is finished for
that rank from left to right instead.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, ship, text_of

#: The sign for a space in pieces, a fixed value of such models.
SPACE = "▁"

#: Words kept by a worker with their ids; a full cache is emptied. Longer words are not kept.
CACHE, CACHED_LENGTH = 400_000, 64

#: Characters of text whose words are worked on together.
BLOCK = 1 << 20

_NONE = np.iinfo(np.int32).max
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_loaded: dict[str, Pieces] = {}


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A BPE model with byte fallback: symbols are vocabulary ids, and code points above them for characters that are no pieces."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        spec.ParseFromString(library.serialized_model_proto())
        rules, trained, kinds = spec.normalizer_spec, spec.trainer_spec, proto.ModelProto.SentencePiece
        odd = {p.type for p in spec.pieces} & {kinds.USER_DEFINED, kinds.UNUSED}
        if (trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix or rules.precompiled_charsmap
                or rules.remove_extra_whitespaces or not rules.escape_whitespaces or odd):
            raise ValueError(f"{path}: a BPE model with byte fallback, plain normalisation and learnt pieces only is needed")
        self.prefix = rules.add_dummy_prefix
        self.byte_id = np.zeros(256, np.int32)
        for i, p in enumerate(spec.pieces):
            if p.type == kinds.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
        learnt = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.byte_of = {int(i): b for b, i in enumerate(self.byte_id)}
        self.learnt = [p.type == kinds.NORMAL for p in spec.pieces]
        self.hidden = [p.type == kinds.CONTROL for p in spec.pieces]
        self.shown = [p.piece.replace(SPACE, " ") if p.type == kinds.NORMAL else trained.unk_surface if p.type == kinds.UNKNOWN else "" for p in spec.pieces]
        self.others = len(spec.pieces)
        self.of_char = np.arange(self.others, self.others + 0x110000, dtype=np.int32)
        for name, i in learnt.items():
            if len(name) == 1:
                self.of_char[ord(name)] = i
        symbol = {c: int(self.of_char[ord(c)]) for name in learnt for c in name} | learnt
        # Pieces of one score share a rank.
        scores = sorted({spec.pieces[i].score for i in learnt.values()}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        pairs, close = {}, set()
        for name, i in learnt.items():
            for k in range(1, len(name)):
                close.add(symbol[name[k - 1]] << 32 | symbol[name[k]])
                a, b = symbol.get(name[:k]), symbol.get(name[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (order[spec.pieces[i].score], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        self.close = np.array(sorted(close), np.int64)
        self.cache: dict[str, tuple[np.ndarray, str, str]] = {}

    # -- merging ------------------------------------------------------------------------------------------------------
    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each pair; a pair that is no piece has rank _NONE."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.rank[at], _NONE), self.made[at]

    def _chain(self, symbols: list[int], r: int) -> list[int]:
        """Symbols after every merge of rank r or lower, one after the other, the lowest and then the leftmost first.

        No pair may be lower than r at first, so later pairs as low as r only lie beside what was merged last.
        """
        pairs, none = self.pairs, (_NONE, -1)
        left, right = [], symbols[::-1]
        now = right.pop()
        while True:
            before = pairs.get(left[-1] << 32 | now, none) if left else none
            after = pairs.get(now << 32 | right[-1], none) if right else none
            if before[0] <= r and before[0] <= after[0]:
                left.pop()
                now = before[1]
            elif after[0] <= r:
                right.pop()
                now = after[1]
            elif right:
                left.append(now)
                now = right.pop()
            else:
                return [*left, now]

    def merged(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What remains of the segments that begin at ``starts``: the symbols, and how many of them each segment has."""
        sizes = np.diff(np.append(starts, len(symbols)))
        left_over, now, own = np.ones(len(sizes), np.int64), symbols, np.arange(len(sizes))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(now), _NONE, np.int32)
        if len(now):
            rank[:-1] = self._look(now[:-1], now[1:])[0]
            rank[np.cumsum(sizes) - 1] = _NONE
        while len(now):
            least = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
            if (least == _NONE).any():  # finished segments go
                stay = least != _NONE
                kept = np.repeat(stay, sizes)
                left_over[own[~stay]] = sizes[~stay]
                done.append((np.repeat(own[~stay], sizes[~stay]), now[~kept]))
                now, rank, own, sizes, least = now[kept], rank[kept], own[stay], sizes[stay], least[stay]
                if not len(now):
                    break
            first = np.cumsum(sizes) - sizes
            segment = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            hit = np.flatnonzero(rank == least[segment])
            # Of pairs that overlap every second one is merged, from the left.
            number = np.arange(len(hit))
            begins = np.append(True, np.diff(hit) != 1)
            hit = hit[(number - np.maximum.accumulate(np.where(begins, number, 0))) % 2 == 0]
            mine, product = segment[hit], self._look(now[hit], now[hit + 1])[1]
            after, keep, stale = now.copy(), np.ones(len(now), bool), np.zeros(len(now), bool)
            after[hit], keep[hit + 1], stale[hit] = product, False, True
            # The new pairs at both sides of each merge: the symbol before it has been merged by then, the one after it has not.
            left = np.maximum(hit - 1, 0)
            left = np.where(keep[left], left, left - 1)
            some = (hit > 0) & (segment[left] == mine)
            stale[left[some]] = True
            low = np.where(some, self._look(after[left], product)[0], _NONE)
            right = np.minimum(hit + 2, len(now) - 1)
            some = (hit + 2 < len(now)) & (segment[right] == mine)
            low = np.minimum(low, np.where(some, self._look(product, now[right])[0], _NONE))
            for k in np.unique(mine[low <= least[mine]]).tolist():
                a, b = int(first[k]), int(first[k] + sizes[k])
                chain = self._chain(now[a:b].tolist(), int(least[k]))
                after[a:a + len(chain)] = chain
                keep[a:b] = np.arange(b - a) < len(chain)
                stale[a:b] = True
            sizes = np.add.reduceat(keep.astype(np.int64), first)
            now, rank = after[keep], rank[keep]
            at = np.flatnonzero(stale[keep])
            rank[at] = self._look(now[at], now[np.minimum(at + 1, len(now) - 1)])[0]
            rank[np.cumsum(sizes) - 1] = _NONE
        if not done:
            return symbols, left_over[:0]
        order = np.argsort(np.concatenate([o for o, _ in done]), kind="stable")
        return np.concatenate([s for _, s in done])[order], left_over

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word, a text without cuts between words."""
        text = "".join(words)
        if not text:
            return [np.zeros(0, np.int32) for _ in words]
        symbols = self.of_char[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        word_ends = np.cumsum([len(w) for w in words])
        begins = np.zeros(len(symbols) + 1, bool)
        begins[0], begins[word_ends] = True, True
        key = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(self.close, key), len(self.close) - 1)
        begins[1:-1] |= self.close[at] != key
        starts = np.flatnonzero(begins[:-1])
        merged, counts = self.merged(symbols, starts)
        # A character that is no piece becomes the pieces of its bytes.
        odd = np.flatnonzero(merged >= self.others)
        wide = np.ones(len(merged), np.int64)
        if len(odd):
            raw = [chr(c - self.others).encode() for c in merged[odd].tolist()]
            wide[odd] = [len(r) for r in raw]
        ids = np.repeat(merged, wide)
        if len(odd):
            ids[np.repeat(merged >= self.others, wide)] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        # Segments end where words end.
        ends = np.cumsum(wide)[np.cumsum(counts) - 1]
        last = np.searchsorted(starts, word_ends) - 1
        out, a = [], 0
        for w, k in zip(words, last.tolist()):
            b = int(ends[k]) if k >= 0 else 0
            out.append(ids[a:b] if w else ids[:0])
            a = max(a, b)
        return out

    # -- texts --------------------------------------------------------------------------------------------------------
    def words(self, text: str) -> list[str]:
        """Words of a text, spaces as in pieces, with the space that the model puts before a text."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        return _WORD.findall(SPACE + text if self.prefix else text)

    def learn(self, texts: list[list[str]]) -> dict[str, tuple[np.ndarray, str, str]]:
        """(ids, ids as text, what they decode to) of every word of these texts; those worked out before come from the cache."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache, new = self.cache, set()
        for words in texts:
            new.update(w for w in words if w not in cache)
        new = list(new)
        found = {w: (ids, ",".join(map(str, ids.tolist())), self.joined(ids.tolist())) for w, ids in zip(new, self.encode_words(new))}
        cache.update((w, v) for w, v in found.items() if len(w) <= CACHED_LENGTH)
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        words = self.words(text)
        found, cache = self.learn([words]), self.cache
        return np.concatenate([np.zeros(0, np.int32), *((found.get(w) or cache[w])[0] for w in words)]).astype(np.int32)

    # -- and back -----------------------------------------------------------------------------------------------------
    def joined(self, ids: list[int]) -> str:
        """What ids show, with the space that was put before the text."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(shown_bytes(bytes(raw)))
                raw.clear()
            out.append(self.shown[i])
        if raw:
            out.append(shown_bytes(bytes(raw)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of any ids of the vocabulary: control pieces show nothing, bytes that are no UTF-8 show U+FFFD."""
        bad = [i for i in ids if not 0 <= i < len(self.shown)]
        if bad:
            raise ValueError(f"no such piece: {bad[0]}")
        # One space is taken back where the first piece that shows something begins with it.
        while ids and self.hidden[ids[0]]:
            ids = ids[1:]
        text = self.joined(ids)
        return text[1:] if self.prefix and ids and ids[0] not in self.byte_of and text.startswith(" ") and self.learnt[ids[0]] else text


def shown_bytes(raw: bytes) -> str:
    """Bytes as text; each byte that belongs to no character shows U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return raw[:e.start].decode() + "\ufffd" + shown_bytes(raw[e.start + 1:])


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


# -- tables -----------------------------------------------------------------------------------------------------------
def _blocks(texts: list[str]):
    """Ranges of texts of some BLOCK characters."""
    a = size = 0
    for b, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool):
    model = pieces(path)
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in _blocks(texts):
            split = [model.words(t) for t in texts[a:b]]
            found, cache = model.learn(split), model.cache
            sizes, ids, id_digests, text_digests = [], [], [], []
            for words in split:
                known = [found.get(w) or cache[w] for w in words]
                sizes.append(sum(len(k[0]) for k in known))
                if with_ids:
                    ids.append(np.concatenate([np.zeros(0, np.int32), *(k[0] for k in known)]).astype(np.int32))
                else:
                    id_digests.append(hashlib.sha256(",".join([k[1] for k in known]).encode()).hexdigest())
                    # A word's bytes make whole characters, so the words decode one by one; the first space was put there.
                    shown = "".join([k[2] for k in known])
                    text_digests.append(hashlib.sha256((shown[1:] if model.prefix else shown).encode()).hexdigest())
            columns = {"doc_id": keys.slice(a, b - a), "n_tokens": pa.array(sizes, pa.int64())}
            columns |= {"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {"ids_sha256": pa.array(id_digests, pa.string()), "decoded_sha256": pa.array(text_digests, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)


def _encoded(docs: DataFrame, path: str | None, with_ids: bool, columns: str) -> DataFrame:
    ship(docs.sparkSession)
    path, kind = path or default_path(), docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(lean(lambda bs: _encode_batches(bs, path, with_ids)), f"doc_id {kind}, n_tokens long, {columns}")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row, as the library encodes whole texts without begin or end ids and without sampling.

    Null and empty texts have no ids; repeated rows are encoded each; rows without doc_id stay; other columns are not read.
    """
    return _encoded(docs, path, True, "ids array<int>")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: digests of the ids and of the text that they decode to.

    Rows and odd texts are treated as in ``encode``.
    """
    return _encoded(docs, path, False, "ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows with ids, as the library decodes them; null ids give an empty text."""
    ship(encoded.sparkSession)
    path, kind = path or default_path(), encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = pieces(path)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array([model.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())})

    return encoded.select("doc_id", encoded["ids"].cast("array<int>").alias("ids")).mapInArrow(lean(run), f"doc_id {kind}, text string")

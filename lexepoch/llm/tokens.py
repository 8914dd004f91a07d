"""Byte-level BPE over whole texts: token counts by heap-and-list merging, and token ids by the tokenizers library.

Texts are cut at single spaces between two non-spaces, which always start a new piece of the pre-tokenizer, so the
pieces between such cuts can be looked up in a bounded cache. Texts with other white space next to a space, and texts
that hold the special token's string, take the longer way over the whole text.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ship, text_of

#: Entries in one worker's caches; a full cache is emptied, so memory does not follow the vocabulary of the corpus.
CACHE = 800_000

#: Fixed value: the pattern of byte-level pre-tokenizers, from its classes of letters and digits and of neither.
def _pattern(letter: str, digit: str, other: str) -> str:
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?{other}+|\s+(?!\S)|\s+"


PIECE = _pattern(r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]")

_loaded: dict[tuple, object] = {}


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def library_pieces() -> tuple[str, str]:
    """The pattern, and the characters that need it, with the letters and digits of the tokenizers library, whose Unicode tables are other than regex's.

    The library is asked for the class of each character that regex and Python's own tables (of other versions) class
    differently; the characters on which those two agree are classed alike by all three.
    """
    from unicodedata import category

    from tokenizers.pre_tokenizers import ByteLevel
    text = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    letters, digits = (set(regex.findall(rf"\p{{{k}}}", text)) for k in "LN")
    own = {k: {c for c in text if category(c)[0] == k} for k in "LN"}
    odd = sorted((letters ^ own["L"]) | (digits ^ own["N"]))
    cut = ByteLevel(add_prefix_space=False, use_regex=True)
    by: dict[str, list[str]] = {"L": [], "N": [], "": []}
    for c in odd:
        # A letter joins the letter before it, a digit the digit before it, any other the mark before it.
        by["L" if len(cut.pre_tokenize_str("a" + c)) == 1 else "N" if len(cut.pre_tokenize_str("1" + c)) == 1 else ""].append(c)

    def ranges(chars: list[str]) -> str:
        out: list[list[int]] = []
        for x in map(ord, chars):
            if out and x == out[-1][1] + 1:
                out[-1][1] = x
            else:
                out.append([x, x])
        return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in out)

    def kind(base: str, chars: list[str]) -> str:
        less = f"[{base}--[{ranges(odd)}]]" if odd else base
        return f"(?:{less}|[{ranges(chars)}])" if chars else less

    return _pattern(kind(r"\p{L}", by["L"]), kind(r"\p{N}", by["N"]), kind(r"[^\s\p{L}\p{N}]", by[""])), ranges(odd)


class Merger:
    """Counts the tokens of one pre-token: pairs wait in a heap by rank, symbols are a doubly linked list."""

    def __init__(self, path: str, pieces: tuple[str, str] | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        names = {s: i for i, s in enumerate(model["vocab"])}
        self.byte = [names[letters[b]] for b in range(256)]
        self.rank = {names[a] << 32 | names[b]: r for r, (a, b) in enumerate(merges)}
        self.made = [names[a + b] for a, b in merges]
        self.special = [t["content"] for t in spec.get("added_tokens", []) if not (t["lstrip"] or t["rstrip"] or t["single_word"])]
        exact, odd = pieces or library_pieces()
        self.piece, self.exact_piece, self.odd = regex.compile(PIECE), regex.compile(exact, regex.V1), re.compile(f"[{odd}]" if odd else r"(?!)")
        self.word = _Counts(self._of_piece)
        self.part = _Counts(self._of_part)

    def merged(self, raw: bytes) -> int:
        """Symbols left after merging: the bytes, less one for each merge."""
        symbol = [self.byte[b] for b in raw]
        n = len(symbol)
        if n < 2:
            return n
        rank, made = self.rank.get, self.made
        at = [rank(a << 32 | b, -1) for a, b in zip(symbol, symbol[1:])]  # rank of the pair that begins here
        at.append(-1)
        heap = [r << 32 | i for i, r in enumerate(at) if r >= 0]
        heapq.heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            x = heapq.heappop(heap)
            i, r = x & 0xFFFFFFFF, x >> 32
            if at[i] != r:
                continue  # one of the pair has been merged meanwhile
            merges += 1
            j = after[i]
            symbol[i], at[j] = made[r], -1
            k = after[i] = after[j]
            at[i] = -1
            if k < n:
                before[k] = i
                r = at[i] = rank(symbol[i] << 32 | symbol[k], -1)
                if r >= 0:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = at[h] = rank(symbol[h] << 32 | symbol[i], -1)
                if r >= 0:
                    heapq.heappush(heap, r << 32 | h)
        return n - merges

    def cut(self, text: str) -> list[str]:
        """Pre-tokens; the slower pattern is for texts with characters that the library classes otherwise than regex."""
        return (self.exact_piece if not text.isascii() and self.odd.search(text) else self.piece).findall(text)

    def _of_piece(self, piece: str) -> int:
        return self.merged(piece.encode())

    def _of_part(self, part: str) -> int:
        """Tokens of a space and what follows up to the next cut; -1 if the space is not a cut."""
        if not part or part[0].isspace() or part[-1].isspace():
            return -1
        word = self.word
        return sum([word[p] for p in self.cut(" " + part)])

    def plain(self, text: str) -> int:
        word = self.word
        return sum([word[p] for p in self.cut(text)])

    def count(self, text: str) -> int:
        for s in self.special:
            if s in text:
                parts = text.split(s)
                return len(parts) - 1 + sum(self.count(p) for p in parts)
        head, *rest = text.split(" ")
        if not head or head[-1].isspace():
            return self.plain(text)
        if len(self.part) > CACHE:
            self.part.clear()
        if len(self.word) > CACHE:
            self.word.clear()
        part = self.part
        counts = [part[p] for p in rest]
        if counts and min(counts) < 0:
            return self.plain(text)
        return self.plain(head) + sum(counts)


class _Counts(dict):
    """A dict that works out what it lacks; very long keys are not kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) < 256:
            self[key] = value
        return value


def merger(path: str, pieces: tuple[str, str] | None = None) -> Merger:
    if ("merger", path) not in _loaded:
        _loaded["merger", path] = Merger(path, pieces)
    return _loaded["merger", path]


def _count_batches(batches: Iterator[pa.RecordBatch], path: str, pieces: tuple[str, str]):
    bpe = merger(path, pieces)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        sizes = [len(t.encode()) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array([bpe.count(t) for t in texts], pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, as the tokenizers library counts without added special tokens.

    Null and empty texts have no tokens; repeated rows are counted each; other columns are not read.
    """
    ship(docs.sparkSession)
    path, pieces = path or default_path(), library_pieces()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        lambda bs: _count_batches(bs, path, pieces), f"doc_id {kind}, n_bytes long, n_tokens long")


# -- ids --------------------------------------------------------------------------------------------------------------
class Encoder:
    """Token ids of whole texts, as the tokenizers library gives them without added special tokens.

    For a byte-level vocabulary whose ids follow its merges, tiktoken gives the same ids from the same file several
    times faster; texts that hold a special token's string, and other vocabularies, go to the library itself.
    """

    #: Longer texts are encoded in pieces, cut at single spaces between two non-spaces.
    LONG = 100_000

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.fast = None
        if model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            byte = {c: b for b, c in byte_alphabet().items()}
            ids = {k: v for k, v in model["vocab"].items() if k not in self.special}
            merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
            if merged == sorted(merged):
                self.fast = tiktoken.Encoding("own", pat_str=PIECE, special_tokens={},
                                              mergeable_ranks={bytes(byte[c] for c in k): v for k, v in ids.items()})
        self.cut = regex.compile(r"(?<=\S) (?=\S)")

    @cached_property
    def library(self):
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        if len(text) <= self.LONG:
            return np.array(self.fast.encode_ordinary(text), "<u4")
        out, at = [], 0
        while at < len(text):
            found = self.cut.search(text, at + self.LONG)
            end = found.start() if found else len(text)
            piece = text[at:end]
            out.append(np.array(self.fast.encode_ordinary(piece) if len(piece) <= 2 * self.LONG
                                else self.library.encode(piece, add_special_tokens=False).ids, "<u4"))
            at = end
        return np.concatenate(out)


def encoder(path: str) -> Encoder:
    if ("encoder", path) not in _loaded:
        _loaded["encoder", path] = Encoder(path)
    return _loaded["encoder", path]

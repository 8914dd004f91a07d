import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexepoch.llm import packing, queries, tokens
from lexepoch.llm.common import rank_within

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokens.default_path())


def odd_texts(n=1500):
    rng = random.Random(4)
    signs = "ab é\n\t1.'s \x1c<|>日ß\r  "
    made = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(n)]
    wide = ["".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(32, 600)])) for _ in range(30)) for _ in range(n)]
    return [*made, *wide, "", " ", "  ", "x<|endoftext|>y <|endoftext|>", "a" * 3000, "it's we'll 's", " a  b", " a\n", "a \n b"]


def test_counts_and_ids_equal_the_library(library, texts):
    some = [*odd_texts(), *list(texts.values())[:60]]
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    bpe, enc = tokens.merger(tokens.default_path()), tokens.encoder(tokens.default_path())
    assert [bpe.count(t) for t in some] == [len(w) for w in want]
    assert [enc.encode(t).tolist() for t in some] == want


def test_long_texts_are_cut_where_it_does_not_matter(library, texts):
    enc = tokens.Encoder(tokens.default_path())
    enc.LONG = 25
    for t in [*odd_texts(300), *list(texts.values())[:20]]:
        assert enc.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_token_counts_query(spark, docs, none, small, library):
    got = sorted(tuple(r) for r in tokens.token_counts(docs.where("doc_id IS NOT NULL")).collect())
    want = sorted((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in small if r[0] is not None)
    assert got == want
    assert tokens.token_counts(none).count() == 0


@pytest.mark.parametrize("n, want", [(0, []), (5, [(0, 5)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (24, [(0, 8), (8, 8), (16, 8)])])
def test_cut(n, want):
    assert packing.cut(n, 8) == want


def brute_best_fit(histogram, capacity):
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [i for i, r in enumerate(rooms) if r >= length]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= length
            else:
                rooms.append(capacity - length)
    return len(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([10, 17, 64])
        histogram = {n: rng.randrange(1, 9) for n in rng.sample(range(1, capacity + 1), rng.randrange(1, 8))}
        runs = packing.plan(histogram, capacity)
        used, seen = defaultdict(list), Counter()
        for length, lo, hi, first, each, at in runs:
            for rank in range(lo, hi):
                used[first + (rank - lo) // each].append((at + (rank - lo) % each * length, length))
                seen[length] += 1
        assert seen == Counter(histogram)
        for slots in used.values():
            end = 0
            for at, length in sorted(slots):
                assert at == end
                end += length
            assert end <= capacity
        assert len(used) == brute_best_fit(histogram, capacity)


def test_rank_within_is_a_permutation(spark):
    df = spark.range(500).withColumn("k", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5))
    rows = rank_within(df, ["k"], ["id"], "r", 8).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.k].append(r.r)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(rows) == 500


def check_packed(rows, want):
    """rows: packed pieces; want: doc_id -> ids with the end token (a list for repeated rows)."""
    seq, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for slots in seq.values():
        end = 0
        for at, n in sorted(slots):
            assert at == end
            end += n
        assert end <= 1024
    for doc, ids in want.items():
        got = sorted(docs[doc], key=lambda r: r.piece)
        assert [r.start for r in got] == [s for s, _ in packing.cut(len(ids), 1024)]
        for r in got:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    return len(seq)


def test_op1_packs_every_document(spark, sf_dir, texts, library):
    rows = queries.QUERIES["op1_best_fit_packing"](spark, sf_dir).collect()
    want = {k: [*library.encode(t, add_special_tokens=False).ids, 2] for k, t in texts.items()}
    n = check_packed(rows, want)
    assert n <= 1.02 * sum(map(len, want.values())) / 1024 + 1


def test_odd_rows_are_packed(docs, none):
    rows = packing.pack_documents(docs, with_ids=True).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8, None, 10, 11}
    assert sum(r.doc_id == 8 for r in rows) == 2
    assert all(r.ids[-1] == 2 for r in rows if r.doc_id in (3, 4)) and [r.length for r in rows if r.doc_id == 3] == [1]
    assert all(len(r.ids) == r.length for r in rows)
    assert packing.pack_documents(none).count() == 0


def test_counts_and_ids_equal_the_library_on_every_code_point():
    from tokenizers import Tokenizer
    path = tokens.default_path()
    library, own, encoder = Tokenizer.from_file(path), tokens.merger(path), tokens.encoder(path)
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    for lo in range(0, len(every), 50_000):
        some = [f"{c}'s {c}." for c in every[lo:lo + 50_000]]
        want = [e.ids for e in library.encode_batch_fast(some, add_special_tokens=False)]
        assert [t for t, w in zip(some, want) if own.count(t) != len(w)] == []
        assert [t for t, w in zip(some[::7], want[::7]) if encoder.encode(t).tolist() != w] == []

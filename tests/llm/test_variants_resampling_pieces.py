import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexepoch.llm import pieces, queries, resampling, spelling

ASCII_LOW = {c: c + 32 for c in range(65, 91)}


# -- spelling variants ------------------------------------------------------------------------------------------------
def brute_words(rows, least=7, least_n=2):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= least_n}


def one_edit(a, b):
    """Exactly one letter inserted, deleted or replaced, by trying each."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return a != b and any(a[:i] == b[:i] and a[i + 1:] == b[i + 1:] for i in range(len(a)))
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n, times=10):
    by_length = defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def word_rows(seed, count=900):
    rng = random.Random(seed)
    base = ["".join(rng.choice("aeinrstoludé") for _ in range(rng.randrange(7, 12))) for _ in range(40)] + ["x" * 60 + "yz" * 4, "abcdefghij" * 9, "ÀÉÎõü×÷ß", "Banana" * 2]
    rows = []
    for i in range(count):
        words = []
        for _ in range(rng.randrange(12)):
            w = rng.choice(base[:6] if rng.random() < 0.6 else base)
            if rng.random() < 0.25:
                k, kind = rng.randrange(len(w)), rng.randrange(3)
                w = w[:k] + rng.choice("aenst") * (kind < 2) + w[k + (kind > 0):]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "1", "日"]).join(words)))
    return rows


@pytest.mark.parametrize("cell, searches, top", [(spelling.CELL, spelling.SEARCHES, spelling.TOP), (3, 5, 1), (40, 7, 4)])
def test_variants_equal_brute_force_at_any_cut_of_the_trie(spark, cell, searches, top):
    rows = word_rows(7)
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), cell=cell, searches=searches, top=top)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_variants(brute_words(rows))


def test_variants_of_odd_rows(spark, docs, none, small):
    rows = [(r[0], r[1]) for r in small]
    got = sorted((tuple(r) for r in spelling.variants(docs, least_length=3).collect()), key=str)
    assert got == brute_variants(brute_words(rows, 3))
    assert spelling.variants(none).count() == 0
    assert spelling.variants(docs.withColumn("text", F.lit(None).cast("string")).withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))).count() == 0


def test_chains_of_forms_lead_to_one_root(spark):
    links = [(f"w{i:03}", f"w{i + 1:03}") for i in range(37)] + [("v", "w036")]
    assert {r.word: r.root for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()} == {w: "w037" for w, _ in links}


def test_a_cell_of_one_vector_is_searched_in_blocks(spark):
    """Words of the same letters cannot be told apart by the trie: their pairs are found all the same."""
    rng = random.Random(1)
    words = {"".join(rng.sample("aabbccc", 7)) for _ in range(150)} | {"aabbccd", "aabbcc"}
    table = spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n long")
    got = {(r.word, r.other) for r in spelling.near_words(table, cell=10, searches=20).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


# -- importance resampling --------------------------------------------------------------------------------------------
def brute_resample(docs, target, most=1, buckets=10_000, least=20, percent=10, seed="2024"):
    def feats(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOW))
        return [zlib.crc32(" ".join(words[i:i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(words) - k + 1)], len(words)

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(feats(text)[0])
    for text in target:
        t.update(feats(text)[0])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in docs:
        f, n = feats(text)
        g = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in f]
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        w = sum(g) // len(g) if g else 0
        out.append([doc_id, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = {id(r): i + 1 for i, r in enumerate(able[:len(able) * percent // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize("most, percent", [(1, 10), (3, 60)])
def test_resampling_equals_brute_force(spark, sf_dir, texts, most, percent):
    aim = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = resampling.resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), most=most, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_resample(list(texts.items()), aim, most, percent=percent)


def test_resampling_of_odd_rows(spark, docs, none, small):
    rows = [(r[0], r[1]) for r in small]
    aim = spark.createDataFrame([(None,), ("",), ("w1 w2 no id Ünïcödé",)], "text string")
    got = sorted((tuple(r) for r in resampling.resample(docs, aim, percent=70, least_words=2).collect()), key=str)
    assert got == brute_resample(rows, ["w1 w2 no id Ünïcödé"], percent=70, least=2)
    assert resampling.resample(none, aim).count() == 0
    assert resampling.resample(docs, aim.limit(0)).where("rank IS NOT NULL").count() == 0
    crowded = docs.withColumn("rank", F.lit(1)).withColumn("score", F.lit("x"))
    assert resampling.resample(crowded, aim).columns == ["doc_id", "n_features", "weight", "score", "rank"]


@pytest.mark.parametrize("block, digit", [(7, 5), (64, 11), (1 << 18, 1)])
def test_radix_rank_sorts(spark, block, digit):
    rng = random.Random(5)
    rows = [(rng.choice([-2**40, -3, 0, 1, 1, 1, 5, 2**41 + rng.randrange(4), None]), i) for i in rng.sample(range(-200, 200), 150)] + [(1, None)] * 2
    keys = [F.col("a"), -F.col("b")]
    if digit == 1:
        rows = [(a if a is None else a % 4, b) for a, b in rows]
    got = resampling.radix_rank(spark.createDataFrame(rows, "a long, b long"), keys, "at", block, digit).orderBy("at").collect()
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, -(r[1] or 0)))
    assert [(r.a, r.b) for r in got] == want and [r["at"] for r in got] == list(range(1, len(rows) + 1))


# -- pieces -----------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.default_path())


def odd_texts():
    rng = random.Random(3)
    signs = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "日", "🙂", "▁", "<s>", "</s>", "<unk>", "<0x0A>", "th", "e", "ing", "    ", "0", "12", "\x00", "́", "�", "‍"]
    out = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(800)]
    out += ["".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(32, 600), rng.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(400)]
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for letters in ("abcdefghijklmnopqrstuvwxyz", "aehint") for _ in range(300)]
    out += [s * k for k in range(70) for s in (" ", "a", "\n", "=")] + [" " * k + "the" for k in range(70)]
    return [*out, " " * 50_000 + "the", "ab" * 20_000, "日" * 5_000]


def test_ids_and_texts_equal_the_library(model, library, texts):
    for text in [*odd_texts(), *texts.values()]:
        ids = model.encode(text or "").tolist()
        assert ids == library.encode(text or ""), text[:80]
        assert model.decode(ids) == library.decode(ids)


def test_any_ids_decode_as_the_library_does(model, library):
    rng = random.Random(8)
    some = [[rng.randrange(32_000) for _ in range(12)] for _ in range(1500)] + [[rng.choice([0, 1, 2, 3, 100, 131, 199, 200, 230, 259, 29871]) for _ in range(8)] for _ in range(4000)]
    assert [model.decode(i) for i in some] == [library.decode(i) for i in some]
    with pytest.raises(ValueError):
        model.decode([32_000])


def test_merges_at_once_are_merges_one_by_one(model):
    """Symbols of a segment after all rounds against a plain loop over the lowest and leftmost pair."""
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice("▁▁▁theinaars") for _ in range(rng.randrange(1, 60)))
        symbols = model.of_char[[ord(c) for c in text]].astype(np.int32)
        plain = symbols.tolist()
        while True:
            found = [(model.pairs[a << 32 | b][0], i) for i, (a, b) in enumerate(zip(plain, plain[1:])) if a << 32 | b in model.pairs]
            if not found:
                break
            i = min(found)[1]
            plain[i:i + 2] = [model.pairs[plain[i] << 32 | plain[i + 1]][1]]
        assert model.merged(symbols, np.array([0]))[0].tolist() == plain


def test_pieces_of_odd_rows(spark, docs, none, small, library):
    want = sorted(((r[0], library.encode(r[1] or "")) for r in small), key=str)
    encoded = pieces.encode(docs)
    assert sorted(((r.doc_id, list(r.ids)) for r in encoded.collect()), key=str) == want
    back = sorted(((r.doc_id, r.text) for r in pieces.decode(encoded).collect()), key=str)
    assert back == sorted(((i, library.decode(ids)) for i, ids in want), key=str)
    assert pieces.encode(none).count() == 0 and pieces.round_trip(none).count() == 0
    assert [r.text for r in pieces.decode(spark.createDataFrame([(1, None, 5)], "doc_id long, ids array<int>, text int")).collect()] == [""]


def test_sentencepiece_query(spark, sf_dir, texts, library):
    def digest(t):
        return hashlib.sha256(t.encode()).hexdigest()

    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_sentencepiece(spark, sf_dir).collect()}
    for doc_id, text in texts.items():
        ids = library.encode(text or "")
        assert got.pop(doc_id) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
    assert not got

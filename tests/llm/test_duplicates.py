import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexepoch.llm import cdc, common, components, cws, exactdedup, queries, simhash


# -- exact dedup ------------------------------------------------------------------------------------------------------
def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((1, 10), (5, 3), (1000, 1 << 40), (300, 50), (4, 1)):
        values = np.sort(rng.integers(0, top, n)) + 77
        k, code = exactdedup.golomb_encode(values, 77)
        assert (exactdedup.golomb_decode(n, k, code, 77) == values).all()
    assert exactdedup.golomb_decode(0, *exactdedup.golomb_encode(np.zeros(0, np.int64), 5), 5).size == 0


def test_golomb_is_compact():
    values = np.sort(np.random.default_rng(2).integers(0, 1 << 48, 10_000))
    k, code = exactdedup.golomb_encode(values, 0)
    assert len(code) * 8 / 10_000 < 48 - np.log2(10_000) + 2


def brute_exact(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc)
    return groups


def test_op4_equals_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op4_exact_dedup"](spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for text, ids in brute_exact(texts.items()).items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(ids), len(ids), i == min(ids))
            assert got[i].text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_exact_odd_rows(docs, none):
    rows = exactdedup.exact_duplicates(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert len(rows) == 12 and by[2][0].keep_id == 1 and not by[2][0].kept
    assert by[4][0].keep_id == 3 and by[5][0].group_size == 1  # a space is one space, not nothing
    assert [r.kept for r in by[8]] == [True, True] and by[8][0].group_size == 2 and by[None][0].kept
    assert exactdedup.exact_duplicates(none).count() == 0
    kept = exactdedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 5, 6, 7, 8, 8, 10, 11]


# -- SimHash ----------------------------------------------------------------------------------------------------------
def brute_fingerprint(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, bits):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, d in enumerate(ids)}


def test_op10_equals_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op10_simhash_near_dedup"](spark, sf_dir).collect()}
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[i], 3) for i in ids]
    assert {i: got[i].fingerprint for i in ids} == {i: f"{f:016x}" for i, f in zip(ids, fps)}
    assert {i: got[i].component_id for i in ids} == brute_components(ids, fps, 2)


def _clustered(n, bits, seed):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 60])):
            x = base
            for _ in range(rng.randrange(bits + 2)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return sorted(set(out[:n]))


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_ring_keys_lose_no_link(spark, bits):
    """Every pair within the budget meets under some key, and links connect what brute force connects."""
    fps = _clustered(500, bits, bits)
    keys = simhash.ring_keys(bits, 8)
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                assert any((fps[i] ^ fps[j]) & mask == 0 for _, mask in keys)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    found = components.components(simhash.links(df, bits)).collect()
    signed = [simhash._signed(f) for f in fps]
    want = brute_components(signed, fps, bits)
    got = {r.node: r.root for r in found}
    assert {f: got.get(f, f) for f in signed} == want


def test_pigeonring_budgets():
    assert simhash.budgets(2, 8) == [0, 0, 0, 0, 1, 1, 1, 1, 2] and len(simhash.ring_keys(2, 8)) == 16


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(200))
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_odd_rows(docs, none):
    rows = simhash.near_duplicates(docs, k=3).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 12 and by[1].component_id == by[2].component_id == 1
    assert {by[i].component_id for i in (3, 4, 5)} == {3} and by[3].fp == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.near_duplicate_groups(none).count() == 0


def test_near_groups_find_edits_and_leave_the_rest(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    rows, copies = [], {}
    for i in range(120):
        words = [word() for _ in range(rng.randrange(60, 400))]
        rows.append((i, " ".join(words)))
        if i % 4 == 0:
            for c in range(3):
                changed = list(words)
                for _ in range(max(1, len(words) // 120)):
                    changed[rng.randrange(len(words))] = word()
                rows.append((1000 + i * 10 + c, " ".join(changed)))
                copies[1000 + i * 10 + c] = i
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(copies.get(d, d) == copies.get(g, g) for d, g in got.items())
    assert sum(got.get(d) == i for d, i in copies.items()) >= 0.85 * len(copies)


def brute_near_groups(rows, bits=3, least=0.8):
    """Components of all pairs within the bits for any seed whose sets of five-word shingles are alike."""
    ids = [d for d, _ in rows]
    fps = np.array([simhash.weighted_majorities(Counter(t.encode().lower().split()), list(simhash.SEEDS)) for _, t in rows], np.uint64)
    sets = [set(simhash.shingle_bytes(t.encode(), 5)) for _, t in rows]
    column = {s: j for j, s in enumerate(s for s, n in Counter(s for x in sets for s in x).items() if n > 1)}
    has = np.zeros((len(rows), len(column)), np.float32)
    for i, x in enumerate(sets):
        has[i, [column[s] for s in x if s in column]] = 1
    size, root = np.array([len(x) for x in sets]), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        near = (np.bitwise_count(fps[:i] ^ fps[i]) <= bits).any(1)
        both = has[:i] @ has[i]
        for j in np.flatnonzero(near & (both >= least * (size[:i] + size[i] - both))):
            root[find(i)] = find(int(j))
    groups = defaultdict(list)
    for i, d in enumerate(ids):
        groups[find(i)].append(d)
    return {d: min(g) for g in groups.values() if len(g) > 1 for d in g}


def test_large_near_group_loses_no_link(spark):
    """Copies that are near their original and far from each other: only checked links may thin a large group."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9)))
    base = ["the"] * 100 + [word() for _ in range(200)]
    rng.shuffle(base)
    rows = [(5000, " ".join(base))]
    for i in range(1000):
        changed = list(base)
        for at in rng.sample([p for p, w in enumerate(base) if w != "the"], 5):
            changed[at] = word()
        rows.append((i, " ".join(changed)))
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near_groups(rows)


def test_texts_of_one_fingerprint_meet_each_other(spark):
    """Reordered lines share the bag of words: the near pair among them is not the one with the least doc_id."""
    rng = random.Random(13)
    lines = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(6)) for _ in range(60)]
    turned = rng.sample(lines, 60)
    near = [*turned[:20], turned[21], turned[20], *turned[22:]]
    other = rng.sample(lines, 60)
    rows = [(i, "\n".join(x)) for i, x in enumerate((lines, turned, near, other, [*other[1:], other[0]]))] + [(9, "\n".join(turned).upper())]
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near_groups(rows) == {1: 1, 2: 1, 9: 1, 3: 3, 4: 3}


def test_failed_candidate_does_not_hide_a_true_pair(spark):
    """Document 2 is document 1 shuffled (not alike), document 3 is document 2 with two words swapped (alike)."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    turned = rng.sample(words, 300)
    near = list(turned)
    near[150], near[151] = near[151], near[150]
    rows = [(i, " ".join(w)) for i, w in enumerate((words, turned, near), 1)]
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: 2, 3: 2}


def _alike(texts):
    """All pairs of different texts whose five-word shingle sets have a similarity of 0.8 or more, by an inverted index."""
    sets = {i: set(simhash.shingle_bytes((t or "").encode(), 5)) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = Counter()
    for ids in holders.values():
        both.update((a, b) for n, b in enumerate(ids) for a in ids[:n])
    return {p for p, n in both.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}


@pytest.mark.parametrize("sf, least", [("sf0.001", 1), ("sf0.01", 0.8), ("sf0.1", 0.95)])
def test_near_groups_on_the_tables(spark, sf, least):
    """Recall of pairs, and no document is put to one that no chain of true pairs leads to.

    The middle table has five pairs, the large one 48; one of the five, with a block of other words, lies 4 to 13 bits apart under each of 24 seeds.
    """
    table = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    one = exactdedup.drop_exact_duplicates(table)
    texts = {r.doc_id: r.text for r in one.collect()}
    # Frequent shingles make long lists; a pair at 0.8 shares rarer ones, too, so texts of few distinct words are left to the bits.
    pairs = _alike({i: t for i, t in texts.items() if len(set((t or "").lower().split())) > 5})
    ids = sorted(texts)
    edges = defaultdict(set)
    for a, b in pairs:
        edges[a].add(b)
        edges[b].add(a)
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(one).collect()}
    together = sum(got.get(a, a) == got.get(b, b) for a, b in pairs)
    assert together >= least * len(pairs)
    for i, g in got.items():
        seen, todo = {i}, [i]
        while todo:
            more = edges[todo.pop()] - seen
            seen |= more
            todo += more
        assert g in seen or len(set((texts[i] or "").lower().split())) <= 5
    assert set(got) <= set(ids)


def test_bound_of_small_groups_changes_nothing(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for g in range(4):
        base = [word() for _ in range(150)]
        for c in range(30):
            changed = list(base)
            for _ in range(c % 3):
                changed[rng.randrange(150)] = word()
            rows.append((g * 100 + c, " ".join(changed)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [{r.doc_id: r.group_id for r in simhash.near_duplicate_groups(df, pairwise=n, block=b, rounds=r).collect()} for n, b, r in ((2, 7, (3, 11)), (2, 1, ()), (1000, 4096, (64,)))]
    assert found[0] == found[1] == found[2] == brute_near_groups(rows)


def test_links_of_large_groups_are_thinned_before_they_are_joined(spark, monkeypatch):
    """Members of one large group share many keys, each with a least id of its own: the links stay in proportion to the members."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, rows = [word() for _ in range(150)], []
    for i in range(150):
        changed = list(base)
        for _ in range(rng.randrange(1, 3)):
            changed[rng.randrange(150)] = word()
        rows.append((i, " ".join(changed)))
    calls = []

    def counted(edges, *a):
        calls.append((edges.count(), edges.selectExpr("explode(array(u, v)) AS x").distinct().count()))
        return components.components(edges, *a)

    monkeypatch.setattr(simhash, "components", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(df).collect()}
    assert got == brute_near_groups(rows)
    assert calls[1][1] > 100 and calls[1][0] <= 2 * calls[1][1]


def test_stars_connect_what_the_links_connect(spark):
    rng = random.Random(23)
    edges = sorted({(u, v) for u in range(1, 400) for v in rng.sample(range(u), min(u, rng.randrange(0, 4))) if u % 5 == v % 5})
    df = spark.createDataFrame(edges, "u long, v long")
    of = lambda x: {r.node: r.root for r in components.components(x).collect()}
    assert of(simhash._stars(df)) == of(df)
    wide = spark.createDataFrame([(u, v) for u in range(50, 350) for v in range(40)], "u long, v long")
    assert simhash._stars(wide).count() == 300 + 39 and set(of(simhash._stars(wide)).values()) == {0}


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.95])
def test_parity_bitmaps_leave_out_no_pair_that_agrees(similarity):
    """Whatever reaches the similarity passes, at the very threshold and beyond the bits of the bitmap; most others do not."""
    rng = np.random.default_rng(7)
    passed = unlike = 0
    for n in (1, 2, 5, 9, 45, 90, 300, 900, 5000):
        own = np.unique(rng.integers(-2**63, 2**63 - 1, n))
        others = []
        for share in np.linspace(0, 1, 40):
            kept = own[:round(share * len(own))]
            others.append(np.unique(np.r_[kept, rng.integers(-2**63, 2**63 - 1, rng.integers(0, len(own) - len(kept) + 1))]))
        bits = np.frombuffer(b"".join(simhash.parity(x) for x in [*others, own]), np.uint64).reshape(len(others) + 1, -1)
        size = np.array([len(x) for x in others])
        may = simhash.may_agree(size, bits[:-1], len(own), bits[-1], similarity)
        for x, ok in zip(others, may):
            both = len(np.intersect1d(own, x))
            if both >= similarity * (len(own) + len(x) - both):
                assert ok
            elif n in (45, 90, 300):
                unlike += 1
                passed += ok
    assert unlike > 10 and passed < 0.25 * unlike


@pytest.mark.parametrize("bits, least", [(1, 2), (20, 10_000)])
def test_full_sieve_and_hot_keys_change_no_result(spark, sf_dir, docs, monkeypatch, bits, least):
    """A sieve that lets all rows through, and keys that count as hot from the third row on, give the same rows."""
    monkeypatch.setattr(common, "SIEVE_BITS", bits)
    monkeypatch.setattr(common, "HOT_LEAST", least)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").union(spark.range(900, 990).selectExpr("id", "'' AS text", "'en'", "'s'", "0L"))
    rows = {r.doc_id: r for r in exactdedup.exact_duplicates(table).collect()}
    for ids in brute_exact([(r.doc_id, r.text) for r in table.collect()]).values():
        assert {(rows[i].keep_id, rows[i].group_size) for i in ids} == {(min(ids), len(ids))}
    assert exactdedup.drop_exact_duplicates(table).count() == sum(r.kept for r in rows.values())
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(table, k=3).collect()}
    ids = sorted(found)
    fps = [brute_fingerprint(r.text, 3) for r in table.orderBy("doc_id").collect()]
    assert found == brute_components(ids, fps, 2)


def test_senders_get_their_bitmaps_back(spark):
    """Owners see each fingerprint of a sender once; a repeat inside one sender is marked by its bit."""
    fps = spark.createDataFrame([(x,) for x in [5, 5, 7, 9, 1 << 47, 1 << 47, 11]], "fp long").repartition(3)
    assert {r.fp for r in exactdedup.suspects(fps).collect()} == {5, 1 << 47}
    alone = spark.createDataFrame([(3,), (3,), (4,)], "fp long").coalesce(1)
    assert {r.fp for r in exactdedup.suspects(alone).collect()} == {3}


# -- content-defined chunks -------------------------------------------------------------------------------------------
def test_gear_by_doubling_equals_rolling():
    table, data = cdc.gear_table(), np.frombuffer(random.Random(1).randbytes(400), np.uint8)
    h, want = 0, []
    for b in data:
        h = (2 * h + int(table[b])) % (1 << 32)
        want.append(h)
    assert cdc.gear(data, table).tolist() == want


def test_chunks_cover_each_text_and_do_not_hang_on_neighbours(spark, texts):
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    some = list(texts.items())[:40]
    by = defaultdict(list)
    for r in cdc.chunks(df(some)).collect():
        by[r.doc_id].append((r.start, r.length, bytes(r.digest)))
    for doc, text in some:
        cut, at = sorted(by[doc]), 0
        for start, n, digest in cut:
            assert start == at and digest == hashlib.blake2b(text[start:start + n].encode(), digest_size=16).digest()
            at += n
        assert at == len(text)
    alone = sorted((r.start, r.length) for r in cdc.chunks(df(some[3:4])).collect())
    assert alone == sorted((a, b) for a, b, _ in by[some[3][0]])


def test_insertion_moves_few_boundaries(spark, texts):
    text = max(texts.values(), key=len)
    df = spark.createDataFrame([(1, text), (2, "một " + text[:500] + " chèn thêm " + text[500:])], "doc_id long, text string")
    by = defaultdict(set)
    for r in cdc.chunks(df).collect():
        by[r.doc_id].add(bytes(r.digest))
    assert len(by[1] - by[2]) <= 12


def test_op2_catches_planted_passages_and_leaves_clean_texts(spark):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 10))) for _ in range(n))
    passages = [words(60) for _ in range(25)]
    rows = [(i, f"{words(80)} {passages[i % 25]} {words(50)}") for i in range(75)] + [(i, words(150) + "\nLicensed under the Apache License, Version 2.0.") for i in range(100, 160)]
    got = cdc.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hit = {r.doc_id for r in got}
    assert len(hit & set(range(25, 75))) >= 48 and not hit & set(range(100, 160)) and not hit & set(range(25))
    text = dict(rows)
    for r in got:
        assert text[r.doc_id][r.start:r.start + r.length] in text[r.first_doc_ids[0]]


def test_op2_equals_brute_force(spark, sf_dir, texts):
    """Documents that share 51 or more words with one of a smaller id, or repeat them, are found; every named first document holds text of the run."""
    got = defaultdict(list)
    for r in queries.QUERIES["op2_substring_dedup"](spark, sf_dir).collect():
        got[r.doc_id].append(r)
    first, later = {}, set()
    for i in sorted(texts):
        w = texts[i].split(" ")
        at = {}
        for k in range(len(w) - 50):
            run = tuple(w[k:k + 51])
            if len(set(run)) > 10 and (first.setdefault(run, i) != i or k - at.setdefault(run, k) > 51):
                later.add(i)
    assert later <= set(got)
    for i, runs in got.items():
        for r in runs:
            assert r.length >= cdc.MIN_RUN and r.first_doc_ids and len(r.first_doc_ids) == len(r.first_lengths)
            own = texts[i][r.start:r.start + r.length]
            for j, n in zip(r.first_doc_ids, r.first_lengths):
                assert j <= i and n >= 1
                assert any(own[a:a + 2 * cdc.LEAST] in texts[j] for a in range(max(1, len(own) - 2 * cdc.LEAST + 1)))
    # What other documents hold exactly is covered: a pair of chunks that an earlier document has lies in some run or is too short.
    pairs = defaultdict(list)
    for r in cdc.chunks(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string"), pairs=True).collect():
        pairs[bytes(r.digest)].append((r.doc_id, r.start, r.start + r.length))
    for places in pairs.values():
        least = min(places)[0]
        for i, a, b in places:
            if i != least and b - a >= cdc.MIN_RUN:
                assert any(r.start <= a and b <= r.start + r.length and least in r.first_doc_ids for r in got[i])


def test_repeats_inside_one_document_on_request(spark):
    line = " ".join(f"từ{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"{line} mở {line}"), (2, "khác hẳn")], "doc_id long, text string")
    assert cdc.repeated_passages(df).count() == 0
    assert [r.doc_id for r in cdc.repeated_passages(df, inside=True).collect()] == [1]


def test_passages_are_cut_out(spark, docs, none):
    shared = " ".join(f"từ{i}" for i in range(80))
    df = spark.createDataFrame([(1, "đầu " + shared), (2, shared + " cuối là đây"), (3, None), (None, shared), (4, "")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in cdc.without_passages(df).collect()}
    spans = cdc.repeated_passages(df).collect()
    assert [r.doc_id for r in spans] == [2] and out[1] == "đầu " + shared and out[3] is None and out[None] == shared and out[4] == ""
    gone = shared + " cuối là đây"
    assert out[2] == gone[:spans[0].start] + gone[spans[0].start + spans[0].length:]
    assert cdc.repeated_passages(none).count() == 0 and cdc.repeated_passages(docs).count() >= 1


# -- consistent weighted sampling -------------------------------------------------------------------------------------
def weights(text, k=5):
    w = text.encode().split()
    out = defaultdict(int)
    for i in range(max(1, len(w) - k + 1) if w else 0):
        out[tuple(w[i:i + k])] += 1
    return out


def test_collision_rate_is_the_generalised_jaccard_similarity():
    rng = random.Random(6)
    gap = []
    for share in (0.1, 0.3, 0.5, 0.8):
        for _ in range(40):
            base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
            other = base[:int(150 * share)] * 2 + [f"w{rng.randrange(10**6)}" for _ in range(80)]
            a, b = " ".join(base), " ".join(other)
            x, y = weights(a), weights(b)
            true = sum(min(x[t], y[t]) for t in {*x, *y}) / sum(max(x[t], y[t]) for t in {*x, *y})
            m = cws.signatures([a.encode(), b.encode()])
            gap.append((m[0] == m[1]).mean() - true)
    assert abs(np.mean(gap)) < 0.01 and np.std(gap) < 0.07


def test_long_unrelated_texts_are_not_alike():
    rng = random.Random(14)
    a, b = (" ".join(f"{side}{rng.randrange(10**7)}" for _ in range(200_000)).encode() for side in "ab")
    m = cws.signatures([a, b])
    assert (m[0] == m[1]).mean() <= 1 / 64


def test_signatures_do_not_hang_on_neighbours(texts):
    some = [t.encode() for t in list(texts.values())[:30]] + [b"", b" ", b"one", b"a b", b"\n"]
    together = cws.signatures(some)
    for t, m in zip(some, together):
        assert (cws.signatures([t])[0] == m).all()
    assert not together[30].any() and (cws.signatures([b"a\tb  c"]) == cws.signatures([b"a b c"])).all()


def test_op3_equals_brute_force(spark, sf_dir, texts):
    rows = queries.QUERIES["op3_document_fingerprints"](spark, sf_dir).collect()
    ids = sorted(texts)
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(ids) == len(got)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        edited = cws.edited_text(texts[i], texts[j])
        assert got[i].n_chars == len(texts[i]) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = cws.signatures([x.encode() for x in (texts[i], edited, texts[j])])
        assert got[i].fingerprint == cws.hex_marks(a[None])[0] and got[i].edited_fingerprint == cws.hex_marks(b[None])[0]
        assert got[i].near_edited == (a == b).mean() and got[i].near_next == (a == c).mean()


def test_fingerprints_odd_rows(spark, docs, none):
    rows = cws.fingerprints_and_edits(docs).collect()
    assert len(rows) == 12 and {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8, None, 10, 11}
    assert cws.fingerprints_and_edits(none).count() == 0
    lone = cws.fingerprints_and_edits(docs.where("doc_id = 10")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0
    both = cws.fingerprints(docs).where("doc_id IN (6, 7)").collect()
    near = spark.createDataFrame([(both[0].fingerprint, both[1].fingerprint)], "a string, b string").select(cws.likeness(F.col("a"), F.col("b"))).first()[0]
    assert near > 0.95

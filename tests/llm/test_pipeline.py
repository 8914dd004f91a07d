"""Each stage of the pipeline against a plain version on its own input, and that the rest stands without it."""

import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from lexepoch.llm.common import materialize

ROOT = Path(__file__).resolve().parents[2]


def shingles(text, k=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The table before the first stage and after each."""
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], sf_dir)))
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mixing to target weights", "best-fit packing"]
    assert all(df.columns == ["doc_id", "text", "lang", "source", "n_chars"] for df in stages[:5])


def test_exact_stage(stages):
    before = {r.doc_id: re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in stages[1].collect()}
    least = {}
    for i in sorted(before):
        least.setdefault(before[i], i)
    assert set(ids(stages[2])) == set(least.values())


def test_near_stage_drops_only_near_copies(stages):
    before = {r.doc_id: shingles(r.text) for r in stages[2].collect()}
    kept = set(ids(stages[3]))
    for i in set(before) - kept:
        assert any(jaccard(before[i], before[j]) >= 0.8 for j in before if j != i)
    assert max(ids(stages[3]).values()) == 1


def test_mixing_stage_repeats_at_most_twice(stages):
    assert set(ids(stages[4])) <= set(ids(stages[3])) and max(ids(stages[4]).values()) <= 2


def test_packing_stage_packs_every_row(stages):
    rows = stages[5].collect()
    want = ids(stages[4])
    assert Counter(r.doc_id for r in rows if r.piece == 0) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in by.values():
        end = 0
        for at, n in sorted(slots):
            assert at == end
            end += n
        assert end <= 1024


def test_planted_cases(spark, tmp_path):
    """Toxic documents, exact and near copies go; clean documents stay until the mix."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioubcdfg") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, toxic = [], {}
    for i in range(800):
        t = text(rng.randrange(40, 160))
        toxic[i] = int(i % 8 == 0)
        rows.append((i, t + " zzotwick " + text(5) + " kkrump" if toxic[i] else t, "en", f"s{i % 3}", 0))
    base = dict((r[0], r[1]) for r in rows)
    rows += [(1000 + i, base[i].replace(" ", "  ", 1), "en", "s1", 0) for i in range(1, 80) if i % 8]
    near = {}
    for i in range(100, 180):
        if i % 8:
            w = base[i].split(" ")
            w[len(w) // 2] = "đổi"
            near[2000 + i] = i
            rows.append((2000 + i, " ".join(w), "en", "s2", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    one = materialize(corpus_pipeline.toxic_out(spark, docs, str(tmp_path)))
    left = set(ids(one))
    assert not any(toxic[i] for i in left if i < 800) and sum(i in left for i in range(800) if not toxic[i]) >= 695
    two = materialize(corpus_pipeline.exact_copies_out(spark, one, str(tmp_path)))
    assert not any(1000 <= i < 2000 for i in ids(two))
    three = set(ids(materialize(corpus_pipeline.near_copies_out(spark, two, str(tmp_path)))))
    assert sum(i in three for i in near) <= 0.15 * len(near)
    assert all(i in three for i in ids(two) if i < 800)


def test_odd_rows_pass_every_stage(spark, docs, none, tmp_path):
    """Nulls, empties, repeated rows and ids, a long text and an extra column; and an empty table."""
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (2, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs, none):
        now = rows
        for _, stage in corpus_pipeline.STAGES[:4]:
            now = materialize(stage(spark, now, str(tmp_path)))
            assert now.columns == docs.columns
        packed = corpus_pipeline.packed(spark, now, str(tmp_path)).collect()
        assert bool(packed) == bool(rows.count())
    one = materialize(corpus_pipeline.exact_copies_out(spark, docs, str(tmp_path)))
    two = ids(materialize(corpus_pipeline.near_copies_out(spark, one, str(tmp_path))))
    assert two[8] == 2 and two[None] == 1 and two[3] == 1 and two[7] == 0 and two[6] == 1


@pytest.mark.parametrize("pipeline", [False, True])
def test_rest_imports_without_these_folders(tmp_path, pipeline):
    import shutil
    shutil.copytree(ROOT / "lexepoch", tmp_path / "lexepoch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline:
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), [n for n in q if n.startswith('op') or n == 'pipeline'])"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0 and out.stdout.strip().endswith("[]"), out.stderr

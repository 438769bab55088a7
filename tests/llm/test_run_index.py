from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caremeter.llm import queries as Q, run_index as R

RANDOM = random.Random(5)


def words(n, rng=RANDOM):
    return " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "é", "omega", "x")) + str(rng.randrange(10 ** 6)) for _ in range(n))


PASSAGE = words(30)
ROWS = [(5, PASSAGE), (1, f"{words(20)} {PASSAGE} {words(5)}"), (2, PASSAGE[10:80]), (3, PASSAGE[:49]), (4, PASSAGE[:50]), (6, None), (7, ""),
        (8, "a" * 400), (9, "b" + "a" * 120), (10, "ab" * 60), (11, "ba" * 40), (12, words(2000)), (12, f"{PASSAGE} other"), (12, PASSAGE),
        (None, f"{words(3)} {PASSAGE[200:]}"), (14, "é" * 60), (15, "é" * 26 + "\0" * 70), (16, "\0" * 60), (17, f"{PASSAGE}\n{PASSAGE}\n{words(4)}"),
        (18, f"{words(4)}{PASSAGE[:60]}{words(3)}{PASSAGE[100:170]}"), (5, PASSAGE)]
ROWS += [(100 + i, f"{words(8)}{PASSAGE[20:75]}{words(8)}") for i in range(40)]


def brute(rows, least=50):
    first = {}
    data = [(-1 << 63 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - least + 1):
            w = b[p:p + least]
            first[w] = min(first.get(w, i), i)
    out = []
    for (i, b), (own, _) in zip(data, rows):
        gone = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if first[b[p:p + least]] < i:
                gone[p:p + least] = b"\1" * least
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((own, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept_bytes)).hexdigest()) for r in df.collect()], key=str)


@pytest.mark.parametrize("least", [50, 20, 80])
def test_removes_like_brute_force(docs, least):
    assert got(R.drop_repeats(docs(ROWS), least=least)) == brute(ROWS, least)


def test_query_like_brute_force(spark, docs, tmp_path):
    docs(ROWS).write.parquet(str(tmp_path / "documents.parquet"))
    out = Q.QUERIES["op12_run_index"](spark, str(tmp_path))
    assert sorted([tuple(r) for r in out.collect()], key=str) == brute(ROWS)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_sample_like_brute_force(sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert got(R.drop_repeats(sample)) == brute(rows)


def test_crowded_anchors_and_chunks(docs, monkeypatch):
    """The same rows whether an anchor's stretches are indexed together or its windows grouped one by one."""
    monkeypatch.setattr(R, "CROWDED", 3)
    assert got(R.drop_repeats(docs(ROWS))) == brute(ROWS)


def test_stretches_cover_all_windows_at_any_chunk(monkeypatch):
    text = (words(300) + "z" * 200).encode()
    whole = {}
    for chunk in (1 << 20, 7, 64):
        monkeypatch.setattr(R, "CHUNK", chunk)
        seen = {}
        for base, part, prints in R.seeds(text, 50):
            wanted = np.ones(len(part) - 49, bool)
            for s, e, fp in zip(*R.stretches(part, prints, wanted, 50)):
                assert bytes(part[s:e]) == text[base + s:base + e]
                seen.update({base + p: fp for p in range(s, e - 49)})
            first, last = R.folds(part, prints, 50, 16)
            assert first[0] == 0 and last[-1] == len(wanted) and list(first[1:]) == list(last[:-1])
        assert sorted(seen) == list(range(len(text) - 49))
        whole = whole or seen
        assert seen == whole                          # a window's anchor depends on its bytes alone


@pytest.mark.parametrize("fold", [4, 1 << 40])
def test_folds_change_nothing(docs, fold):
    assert got(R.drop_repeats(docs(ROWS), fold=fold)) == brute(ROWS)


@pytest.mark.parametrize("least", [50, 1200])
def test_thue_morse_texts_stay_apart(docs, least):
    """A sequence and its complement have the same polynomial modulo 2 ** 64 for any base."""
    text = "a"
    while len(text) < 4096:
        text += text.translate(str.maketrans("ab", "ba"))
    other = text.translate(str.maketrans("ab", "ba"))
    rows = [(1, text[:2048]), (2, other[:2048]), (3, f"{text[:1024]}{words(3)}"), (4, f"x{other}"), (5, other[:1024]), (6, text[700:2500])]
    for k in range(10, 22, 2):
        start = words(3)[:30]
        rows += [(k, start + text[:1024]), (k + 1, start + other[:1024])]
    assert got(R.drop_repeats(docs(rows), least=least)) == brute(rows, least)


def test_index_streams_smallest_owners():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab\0") for _ in range(rng.randrange(8, 60))).encode() for _ in range(50)]
    owners = np.array([rng.randrange(-5, 9) for _ in texts])
    for least in (7, 8, 12):
        index = R.RunIndex(texts, owners, least)
        found = {(t, p): o for t, p, o in zip(*(c.tolist() for c in index.stream()))}
        want = {(t, p): min(o for u, o in zip(texts, owners) if text[p:p + least] in u)
                for t, text in enumerate(texts) for p in range(len(text) - least + 1)}
        assert found == want
    copies = [texts[0] * 3] * 400
    index = R.RunIndex(copies, np.arange(400), 50)
    assert len(index.starts) < 150 and index.sizes.sum() > 10_000        # runs, not rows


def test_empty_tables_and_clashing_columns(docs):
    assert R.drop_repeats(docs([])).count() == 0
    df = docs(ROWS).withColumn("i", F.lit("mine")).withColumn("spans", F.lit(1)).withColumn("x", F.col("text")).withColumn("all", F.lit(2))
    out = R.drop_repeats(df)
    assert got(out) == brute(ROWS) and {r.i for r in out.collect()} == {"mine"} and "lang" in out.columns
    with pytest.raises(ValueError):
        R.drop_repeats(docs(ROWS), least=5)


def test_disk_stays_in_proportion(spark, docs, tmp_path, monkeypatch):
    """Tables and what is left of shuffles, for texts of which half are copies with a new word in every fifty."""
    rng = random.Random(11)
    texts = [words(400, rng) for _ in range(300)]
    for text in texts[:300]:
        parts = text.split(" ")
        parts[::50] = [words(1, rng) for _ in parts[::50]]
        texts.append(" ".join(parts))
    monkeypatch.setattr("caremeter.llm.common.shared_dir", lambda spark: str(tmp_path))
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def on_disk():
        files = manager.getAllFiles()
        return sum(files.apply(k).length() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle"))
    before = on_disk()
    out = R.drop_repeats(docs(list(enumerate(texts))))       # all is done but the join with the texts
    taken = on_disk() - before + sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert taken < 4 * sum(map(len, texts))
    assert out.where("n_removed > 0").count() == 300


def test_long_texts_beside_short_ones(docs):
    """Texts of several parts, of one, and short ones that are read together."""
    rng = random.Random(13)
    long = words(140_000, rng)
    at = [rng.randrange(len(long) - 900) for _ in range(60)] + [R.CHUNK - 300, R.CHUNK - 40]
    rows = [(50, long), (3, long[70_000:160_000]), (60, words(12_000, rng) + long[-3000:])]
    rows += [(k, long[a:a + rng.randrange(20, 900)] + words(rng.randrange(4), rng)) for k, a in enumerate(at, 10)]
    assert len(long) > R.CHUNK and got(R.drop_repeats(docs(rows))) == brute(rows)

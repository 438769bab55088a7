from __future__ import annotations

import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caremeter.llm import collocations as C, queries as Q

ROWS = [(i, f"Red wine, red wine! a{i % 3}\tb  c{i} ; New York City hall", "en") for i in range(6)]
ROWS += [(10, "red wine red wine red wine", None), (11, "red wine.red wine", "und"), (12, None, "en"), (13, "", "en"),
         (14, " \t.,;\n\r\x0b\x0c:!?", "en"), (15, "ÉA éa " * 5, "fr"), (15, "ÉA éa " * 5, "fr"), (None, "New York City hall", "en"),
         (16, "x" * 70 + " " + "x" * 69 + "y " + "x" * 70 + " " + "x" * 69 + "y", "zz"), (17, "nb sp nb sp q \x00 \x00", "zz"),
         (18, "red wine " * 400, "en"), (19, "w " * 1000, "zz")]


def brute(rows, least, top=2000, longest=4):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f.update((lang, *words[i:i + size]) for i in range(len(words) - size + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *w), a in cand.items():
        score, k, l, r = min((2_000_000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])])
                             for k in range(1, len(w)))
        if not any(p[0] == lang and len(p) > len(w) + 1 and 100 * b >= 80 * a
                   and any(list(p[i:i + len(w)]) == w for i in range(1, len(p))) for p, b in cand.items()):
            out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    found, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            found.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return found


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=lambda r: r[:2])


def test_query_like_brute_force(spark, sample):
    rows = [(r.doc_id, r.text, r.lang) for r in sample.collect()]
    out = Q.QUERIES["op11_collocations"](spark, "/root/testdata/sf0.001")
    assert got(out) == brute(rows, 30) and out.count() > 20
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("least, longest", [(2, 4), (3, 2), (5, 5)])
def test_small_fixture_like_brute_force(docs, least, longest):
    assert got(C.mine(docs(ROWS), min_count=least, longest=longest)) == brute(ROWS, least, longest=longest)
    assert got(C.mine(docs(ROWS), k=1, min_count=least, longest=longest)) == brute(ROWS, least, 1, longest)


def test_counts_and_places(docs):
    rows = {(r.lang, r.phrase): r for r in C.phrase_counts(docs(ROWS), min_count=2).collect()}
    assert rows["en", "new york city hall"]["count"] == 7
    hall = rows["en", "york city"]
    assert hall.first_doc == 0 and ROWS[0][1].encode()[hall.first_at:].startswith(b"York City")
    assert rows["fr", "Éa éa"]["count"] == 10 and rows["fr", "éa Éa"]["count"] == 8
    assert rows["und", ""]["count"] == 10


def test_empty_tables_and_clashing_columns(docs):
    assert C.mine(docs([])).collect() == []
    assert C.mine(docs([(1, None), (2, "")]), min_count=1).collect() == []
    df = docs(ROWS).withColumn("fp", F.lit(1)).withColumn("phrase", F.lit("x")).withColumn("n", F.col("lang")).withColumn("c", F.lit(2))
    assert got(C.mine(df, min_count=2)) == brute(ROWS, 2)


def test_collided_fingerprints_are_told_apart_by_the_text():
    words = C.Words([(b"a b c a b c d", "en", 1, 0), (b"a b", "fr", 2, 0)])
    honest = words.ids()
    words.prints[:] = 7                          # every word under one fingerprint
    ids = words.ids()
    assert [list(ids).index(i) for i in ids] == [list(honest).index(i) for i in honest]
    first, _ = words.grams(2)
    rows = list(C._phrases(words, ids, first, np.zeros(len(first), np.uint64), 2))
    assert sorted(r[:4] for r in rows) == [("en", 2, "a b", 2), ("en", 2, "b c", 2), ("en", 2, "c a", 1), ("en", 2, "c d", 1), ("fr", 2, "a b", 1)]


def test_long_texts_are_cut_between_pieces(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(C, "BLOCK", 20)
    monkeypatch.setattr(C, "CHUNK", 16)
    text = b"one two three. four five six, seven eight nine ten eleven twelve thirteen fourteen; fifteen. x"
    batch = pa.record_batch([pa.array([text, b"one two"]), pa.array(["en", "en"]), pa.array([1, None], pa.int64())], names=["a", "b", "c"])
    found = list(C.blocks([batch]))
    assert len(found) > 2 and b"".join(d[0] for w in found for d in w.docs) == text + b"one two"
    assert {len(w.grams(4)[0]) for w in found if b"seven" in w.raw} == {5}
    one = [w.prints[0] for w in found if w.raw.startswith(b"one")]
    assert len(set(one)) == 1 and len({int(p) for w in found for p in w.prints}) == 16


def test_score_is_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    counts = spark.createDataFrame([("en", 0, "", big), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 3)],
                                   "lang string, n int, phrase string, count long")
    row = C.score_phrases(counts).first()
    assert row.score == 2_000_000 * (big - 3) // (2 * big - 1) and row.a == big - 3


def test_a_block_needs_little_more_memory_than_its_words():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(20_000)]
    texts = [" ".join(words[k] for k in rng.integers(0, len(words), 100_000)).encode() for _ in range(32)]      # more than two blocks
    batches = [pa.record_batch([[t], ["en"], [i]], names=["text", "lang", "doc"]) for i, t in enumerate(texts)]
    size = sum(map(len, texts))
    assert size > 2 * C.BLOCK
    sum(len(b) for b in C._counter([2], None)(batches[:1]))          # powers are made once
    tracemalloc.start()
    total = sum(b["c"].to_numpy().sum() for b in C._counter([2], None)(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 32 * 99_999
    assert peak < 28 * C.BLOCK


@pytest.mark.parametrize("run", [1, 2, 7])
def test_grams_do_not_depend_on_the_words_hashed_at_a_time(monkeypatch, run):
    words = C.Words([(t.encode(), lang or "und", i, 0) for i, t, lang in ROWS if t])
    whole = [words.grams(n) for n in (1, 2, 3, 4)]
    monkeypatch.setattr(C, "RUN", run)
    for n, (first, prints) in enumerate(whole, 1):
        again = words.grams(n)
        assert (again[0] == first).all() and (again[1] == prints).all()

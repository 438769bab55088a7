from __future__ import annotations

import random

import numpy as np
import pandas as pd
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from caremeter.llm import order_minhash as O


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 15))
def test_banded_alignment_is_exact(a, b, limit):
    d = levenshtein(a, b)
    assert O.edit_distance(a, b, limit) == (d if d <= limit else None)


def test_alignment_beyond_few_edits_is_exact():
    rng = random.Random(12)
    for n in (40, 90, 200):
        for size in (3, 50, 1000):
            a = [rng.randint(0, size) for _ in range(n)]
            b = edited(rng, [str(x) for x in a], rng.choice([0.1, 0.4, 0.9]))
            a = [str(x) for x in a]
            d = levenshtein(a, b)
            assert O._columns(a, b, 10**6) == d
            for limit in (d - 1, d, d + 40):
                assert O.edit_distance(a, b, limit) == (d if d <= limit else None)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=14), st.lists(st.integers(0, 3), min_size=1, max_size=14), st.integers(0, 15))
def test_columns_of_bits_are_exact(a, b, limit):
    d = levenshtein(a, b)
    assert O._columns(a, b, limit) == (d if d <= limit else None)


def test_sketches_keep_order_and_occurrences():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**62, 200).astype(np.uint64)
    assert (O.sketches(h) == O.sketches(h.copy())).all() and len(O.sketches(h[:0])) == 0
    moved = np.concatenate([h[100:], h[:100]])
    kept = (O.sketches(h)[:O.SKETCHES] == O.sketches(moved)[:O.SKETCHES]).mean()
    assert kept < 0.6                               # the same content in another order: order counts
    assert len(set(O.labelled_kmers(np.repeat(h[:1], 50)))) == 46
    for n in (1, 2, 4, 5, 6, 7, 8):
        assert len(O.sketches(h[:n])) == 2 * O.SKETCHES


def words(rng, n):
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


def edited(rng, ws, rate):
    out = []
    for w in ws:
        r = rng.random()
        out += [] if r < rate / 3 else [f"n{rng.randint(0, 9999)}"] if r < rate * 2 / 3 else [w, "ins"] if r < rate else [w]
    return out


def fixture():
    rng = random.Random(4)
    rows, group = [], {}
    passage = words(rng, 60)
    for g in range(12):
        base = words(rng, rng.choice([40, 120, 400, 900]))
        for c in range(rng.randint(1, 4)):
            i = g * 10 + c
            rows.append((i, " ".join(edited(rng, base, 0.015) if c else base)))
            group[i] = g * 10
    hot = words(rng, 150)
    for i in range(1000, 1300):                      # one large group of near copies
        rows.append((i, " ".join(edited(rng, hot, 0.02))))
        group[i] = 1000
    for i in range(2000, 2100):                      # a passage that many documents share, and nothing else
        rows.append((i, " ".join(words(rng, 120) + passage + words(rng, 80))))
        group[i] = i
    for i in range(3000, 3050):                      # exact copies
        rows.append((i, "exactly the same words here as there"))
        group[i] = 3000
    return rows, group


def test_classes_of_planted_copies(docs):
    rows, group = fixture()
    out = {r.doc_id: r for r in O.near_duplicates(docs(rows)).collect()}
    assert {i: r.class_id for i, r in out.items()} == group
    assert out[1000].class_size == 300 and out[3000].class_size == 50


def test_links_like_brute_force(sample):
    rows = sample.collect()
    texts = {r.doc_id: r.text for r in rows}
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in texts:
        for j in texts:
            if i < j and O.similar(texts[i], texts[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    out = {r.doc_id: r.class_id for r in O.near_duplicates(sample).collect()}
    assert out == {i: root(i) for i in texts}


def test_edges_and_clashes(docs):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "a"), (4, "a"), (None, "no id here at all in this row"), (6, "No ID here at all in this ROW"),
            (7, long), (8, long + " end"), (9, "  "), (3, "a"), (3, "another text of the same id")]
    df = docs(rows).withColumn("d", F.lit(1)).withColumn("class_id", F.lit(1)).withColumn("keys", F.lit(1))
    out = sorted([(r.doc_id, r.class_id, r.class_size) for r in O.near_duplicates(df).collect()], key=str)
    assert out == sorted([(1, 1, 2), (2, 1, 2), (3, 3, 3), (4, 3, 3), (3, 3, 3), (3, 3, 1), (None, 6, 2), (6, 6, 2), (7, 7, 2), (8, 7, 2),
                          (9, 9, 1)], key=str)
    left = O.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted([r.doc_id for r in left.collect()], key=str) == sorted([1, 3, 3, 3, None, 6, 7, 9], key=str)
    assert O.near_duplicates(docs([])).count() == 0


def replaced(rng, ws, n):
    out = list(ws)
    for at in rng.sample(range(len(ws)), n):
        out[at] = f"n{rng.randint(0, 10**9)}"
    return out


def test_family_of_loose_copies_is_one_class(docs):
    rng = random.Random(7)
    original = words(rng, 200)
    rows = [(i, " ".join(replaced(rng, original, 24) if i else original)) for i in range(100)]
    assert {r.class_size for r in O.near_duplicates(docs(rows)).collect()} == {100}


def test_pairs_away_from_the_centre_are_tried(docs):
    rng = random.Random(8)
    passage = words(rng, 80)                         # makes one text of many the centre of the keys they share
    rows = []
    for i in range(0, 60, 2):
        own = words(rng, 40) + passage + words(rng, 40)
        rows += [(i, " ".join(own)), (i + 1, " ".join(replaced(rng, own[:40], 14) + passage + replaced(rng, own[120:], 14)))]
    out = {r.doc_id: r.class_id for r in O.near_duplicates(docs(rows)).collect()}
    assert out == {i: i // 2 * 2 for i in range(60)}


def test_recall_per_band_of_edit_similarity():
    rng = random.Random(9)
    for n in (10, 20, 100, 400):
        for similarity in (0.80, 0.85, 0.90, 0.95):
            found = 0
            for _ in range(100):
                a = [rng.getrandbits(62) for _ in range(n)]
                b = list(a)
                for at in rng.sample(range(n), int((1 - similarity) * n + 1e-9)):
                    b[at] = rng.getrandbits(62)
                found += bool(set(O.sketches(np.array(a, np.uint64)).tolist()) & set(O.sketches(np.array(b, np.uint64)).tolist()))
            assert found >= 98, (n, similarity, found)


def test_texts_that_share_an_id_are_dropped_one_by_one(docs):
    rng = random.Random(10)
    x, other, third = words(rng, 60), words(rng, 60), words(rng, 60)
    rows = [(2, " ".join(x)), (5, " ".join(x[:30] + ["changed"] + x[31:])), (5, " ".join(other)), (7, " ".join(other[:-1])),
            (1, " ".join(third)), (2, " ".join(third[:-1]))]
    left = O.drop_near_duplicates(docs(rows).withColumn("gone", F.lit(1)).withColumn("gone_text", F.lit(1)))
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted([rows[0], rows[2], rows[4]])


def test_a_passage_in_many_texts_does_not_pair_them(docs, monkeypatch):
    rng = random.Random(11)
    passage = words(rng, 60)
    rows = [(i, " ".join([f"x{i}y{k}" for k in range(120)] + passage + [f"x{i}z{k}" for k in range(60)])) for i in range(200)]
    own = rows[0][1].split()
    # apart from rows[0] by more than a fifth, from each other by less: away from the centre of the keys
    tables = {}
    keep = O.saved
    monkeypatch.setattr(O, "saved", lambda df, name: tables.setdefault(name, keep(df, name)) if name in ("met", "met-pairs") else keep(df, name))
    loose = [own[:60] + [f"q{k}" for k in range(60)] + own[120:], own[:60] + [f"q{k}" for k in range(58)] + ["r", "s"] + own[120:]]
    rows += [(1000 + k, " ".join(ws)) for k, ws in enumerate(loose)]
    out = {r.doc_id: r.class_id for r in O.near_duplicates(docs(rows)).collect()}
    assert out == {i: min(i, 1000) for i, _ in rows}
    assert tables["met"].count() < 1000 and tables["met-pairs"].count() < 50


def test_texts_of_one_word_meet_in_chunks(docs, monkeypatch):
    monkeypatch.setattr(O, "CHUNK", 7)
    monkeypatch.setattr(O, "SMALL", 1)
    test_pairs_away_from_the_centre_are_tried(docs)
    rows, group = fixture()
    assert {r.doc_id: r.class_id for r in O.near_duplicates(docs(rows)).collect()} == group


class _Levels:
    def __init__(self, texts):
        words = np.concatenate([t for _, found in O._tokens(iter([texts])) for t in found])
        counts = np.bincount(O._bucket(words), minlength=1 << O.BUCKETS)
        self.value = np.floor(np.log2(np.maximum(counts, 1)) * 4).astype(np.uint8).tobytes()


def test_words_of_one_text_are_not_sent_and_rows_follow_the_texts():
    def sent(n):
        texts = pd.DataFrame({"d": [b"%d" % i for i in range(n)], "label": [b"%016d" % i for i in range(n)], "large": [True] * n,
                              "t": [" ".join([f"own{i}x{k}" for k in range(12)] + [f"two{i // 2}x{k}" for k in range(3)]
                                             + [f"all{k}" for k in range(45)]) for i in range(n)]})
        return [len(x) for part in O._profile(0.8, _Levels(texts))(iter([texts])) for x in part["tokens"]]

    few, many = sent(200), sent(400)
    # 13 of 60 words, 12 of them of this text alone; a word may share its bucket by chance
    assert max(many) <= 13 and sum(few) < 2 * 200 and sum(many) < 2 * 400

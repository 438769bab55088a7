from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caremeter.llm.packing import WordEncoder, pack, piece_lengths, write_buckets

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(PATH)
    return lambda t: [*own.encode(t or "", add_special_tokens=False).ids, 1]


def test_words_give_the_ids_of_the_whole_text(whole):
    random.seed(5)
    own = WordEncoder(PATH)
    parts = [*"aAbB'sStTreEéÉßẞİıſŉΣσçÇñ12²½ªµº_-.,!?<|>&*  \n\t\x0b\x1c\x1f\x85\xa0　​日本🙂é̀\xad\0\x7f\x80",
             "<|endoftext|>", "<|startoftext|>", "it's", "we'll", "</w>", "'re"]
    for _ in range(5000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 18)))
        assert [*own.ids(text), 1] == whole(text), text


def test_piece_lengths():
    assert piece_lengths(1, 2048) == [1] and piece_lengths(2048, 2048) == [2048] and piece_lengths(0, 8) == []
    assert piece_lengths(4096 + 13, 2048) == [2048, 2048, 8, 4, 1]


def check(out, rows, whole, longest=2048):
    pieces = defaultdict(list)
    seen = set()
    for r in out.collect():
        assert r.length == r.bucket == len(r.ids) // 4 and r.length & (r.length - 1) == 0 and r.length <= longest and r.offset == 0
        assert r.sequence_id not in seen
        seen.add(r.sequence_id)
        pieces[r.doc_id, r.doc_tokens].append(r)
    expected = defaultdict(list)
    for i, t in rows:
        ids = whole(t)
        expected[i, len(ids)].append(ids)
    assert set(pieces) == set(expected)
    for key, own in pieces.items():
        for ids in expected[key]:
            for start, length in zip(np.cumsum([0, *piece_lengths(len(ids), longest)]), piece_lengths(len(ids), longest)):
                at = [r for r in own if r.start == start and list(np.frombuffer(r.ids, "<u4")) == ids[start:start + length]]
                assert at and at[0].length == length
        assert len(own) == len(expected[key]) * len(piece_lengths(key[1], longest))


def test_every_id_in_one_piece(docs, sample, whole):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (None, "no id"), (4, "twice"), (4, "twice"), (5, "x" * 30_000)]
    check(pack(docs(rows), PATH), rows, whole)
    check(pack(sample.withColumn("ids", F.lit(1)).withColumn("d", F.lit(1)), PATH, longest=256),
          [(r.doc_id, r.text) for r in sample.collect()], whole, 256)
    assert pack(docs([]), PATH).count() == 0
    with pytest.raises(ValueError):
        pack(docs(rows), PATH, longest=1000)


def test_checksum_and_buckets(spark, docs, whole, tmp_path):
    out = pack(docs([(1, "some words of text"), (2, "others")]), PATH)
    r = out.withColumn("crc", F.crc32("ids")).where("doc_id = 2").orderBy("start").first()
    assert r.crc == zlib.crc32(np.array(whole("others")[:r.length], "<u4").tobytes())
    write_buckets(out, str(tmp_path / "packed"))
    back = spark.read.parquet(str(tmp_path / "packed"))
    assert back.count() == out.count() and back.where("bucket != length").count() == 0

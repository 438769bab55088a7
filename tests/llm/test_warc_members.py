from __future__ import annotations

import gzip
import io

import pytest
from pyspark.sql import functions as F

from caremeter.llm import warc_members as W
from caremeter.llm.common import new_dir

DATE = "2026-01-01T00:00:00Z"


def test_normaliser_keeps_every_byte():
    records = [W.record(str(i), "http://a/b c\n", b"\r\n\r\n" * i + bytes(range(256)) * 3000 * (i % 2), None, DATE) for i in range(6)]
    records.append(W.record("9", None, b"", "5", DATE))
    for whole in (gzip.compress(b"".join(records)), b"".join(gzip.compress(r) for r in records)):
        out = io.BytesIO()
        places = W.normalise(io.BytesIO(whole), out)
        data = out.getvalue()
        assert [gzip.decompress(data[o:o + n]) for o, n in places] == records
        assert places[0][0] == 0 and places[-1][0] + places[-1][1] == len(data)
        with pytest.raises(EOFError):
            W.normalise(io.BytesIO(whole[:-12]), io.BytesIO())
    assert W.normalise(io.BytesIO(gzip.compress(b"")), io.BytesIO()) == []


def test_records_are_read_back_and_checked():
    good = W.record("7", "http://x", "é".encode(), None, DATE)
    assert W.parse_record(good) == ("7", 2, W.payload_digest("é".encode()), "response", None)
    assert W.parse_record(W.record("3", "http://x", b"abc", "7", DATE)) == ("3", 3, W.payload_digest(b"abc"), "revisit", "7")
    assert W.payload_digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    with pytest.raises(ValueError):
        W.parse_record(good.replace("é".encode(), b"zz"))


def brute(rows, least=0):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        last = max([j for j, _, g in rows if (g or "") == (h or "") and j is not None], default=None)
        revisit = len(data) >= least and i is not None and i < last
        out.append((i, len(data), W.payload_digest(data), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_archives_like_brute_force(spark, monkeypatch, least):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (5, "a\r\nb: c", "long" * 50_000), (6, "u", "long" * 50_000),
            (None, "u", "same"), (2, "u", "same"), (7, "é", "WARC/1.1\r\n\r\n"), (8, "u", "other page")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit(1)).repartition(3)
    folder = new_dir(spark, "warc-test")
    index = W.normalise_archives(W.write_archives(df, folder, min_bytes=least), folder)
    out = W.read_archives(spark, index, folder)
    assert sorted([tuple(r) for r in out.collect()], key=str) == brute(rows, least)
    assert index.agg(F.sum("records")).first()[0] == len(rows)


def test_files_of_lost_tasks_do_not_count(spark):
    df = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string")
    folder = new_dir(spark, "warc-test")
    manifest = W.write_archives(df, folder)
    index = W.normalise_archives(manifest, folder)
    W.normalise_archives(manifest, folder)                # as if a first attempt had left its files
    assert W.read_archives(spark, index, folder).count() == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = new_dir(spark, "warc-test")
    index = W.normalise_archives(W.write_archives(df, folder), folder)
    assert W.read_archives(spark, index, folder).count() == 0

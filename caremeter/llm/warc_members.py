"""WARC archives: written as one gzip stream per file, then normalised to one gzip member per record.

A file compressed as a whole cannot be read from the middle. The normaliser inflates such a stream once, front to back,
writes every record again as a member of its own, and lists the members' places in a sidecar index. A record is then
read by seeking to its place, whatever the size of the file.

Files go to a folder that all executors share, by Arrow's file systems (local or mounted paths, ``hdfs://``, ``s3://``,
``gs://``). A task's files carry a random name and count only once a written manifest lists them, so tasks may be
retried at any time.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from caremeter.llm.common import saved

FILE_BYTES = 64_000_000       # inflated size after which a task begins another file
CHUNK = 1 << 20
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def _open(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, which has the HTTP head of the page but not its payload."""
    revisit = refers_to is not None
    head = [("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", record_id(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"),
            ("WARC-Date", date),
            ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url or "")),
            ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}")]
    if page_id is not None:
        head.append(("WARC-Page-ID", page_id))
    if revisit:
        head += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Page-ID", refers_to)]
    body = HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


class Inflated:
    """The bytes of a gzip file, of one or many members, read front to back."""

    def __init__(self, raw):
        self.raw, self.buffer, self.gzip = raw, bytearray(), zlib.decompressobj(31)

    def _more(self) -> bool:
        data = self.gzip.unused_data if self.gzip.eof else self.raw.read(CHUNK)
        if not data and self.gzip.eof:
            data = self.raw.read(CHUNK)
        if not data:
            if not self.gzip.eof:
                raise EOFError("the gzip stream ends early")
            return False
        if self.gzip.eof:
            self.gzip = zlib.decompressobj(31)
        self.buffer += self.gzip.decompress(data)
        return True

    def until(self, end: bytes) -> bytes:
        """Bytes up to and with ``end``; empty at the end of the stream."""
        seen = 0
        while (at := self.buffer.find(end, seen)) < 0:
            seen = max(0, len(self.buffer) - len(end) + 1)
            if not self._more():
                if self.buffer:
                    raise EOFError("the archive ends within a record")
                return b""
        out = bytes(self.buffer[:at + len(end)])
        del self.buffer[:at + len(end)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in chunks."""
        while n:
            if not self.buffer and not self._more():
                raise EOFError("the archive ends within a record")
            out = bytes(self.buffer[:min(n, CHUNK)])
            del self.buffer[:len(out)]
            n -= len(out)
            if out:
                yield out


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:] if line)}


def normalise(raw, out) -> list[tuple[int, int]]:
    """Rewrite a gzip stream of records as one member per record; returns (offset, length) of each member."""
    stream, offset, places = Inflated(raw), 0, []
    while head := stream.until(b"\r\n\r\n"):
        member, length = zlib.compressobj(6, zlib.DEFLATED, 31), 0

        def put(data: bytes) -> int:
            out.write(data)
            return len(data)
        length += put(member.compress(head))
        for chunk in stream.take(int(parse_head(head)["content-length"]) + 4):
            length += put(member.compress(chunk))
        length += put(member.flush())
        places.append((offset, length))
        offset += length
    return places


def _write(folder: str, date: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, gz, size, path, done = None, None, 0, "", []
        target, base = _open(folder)
        target.create_dir(base, recursive=True)

        def close():
            file.write(gz.flush())
            file.close()
            done.append(path)
        for batch in batches:
            for r in batch.itertuples(index=False):
                if file is None:
                    path = f"whole-{uuid.uuid4().hex}.warc.gz"
                    file, gz, size = target.open_output_stream(f"{base}/{path}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0
                data = record(r.page_id, r.url, (r.html or "").encode("utf-8", "surrogatepass"), r.refers_to, date)
                file.write(gz.compress(data))
                size += len(data)
                if size >= FILE_BYTES:
                    close()
                    file = None
        if file is not None:
            close()
        yield pd.DataFrame({"name": done}, dtype=object)
    return run


def _normalise(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, base = _open(folder)
        for batch in batches:
            for name in batch["name"]:
                own = f"records-{uuid.uuid4().hex}.warc.gz"
                with target.open_input_stream(f"{base}/{name}", compression=None) as raw, \
                        target.open_output_stream(f"{base}/{own}", compression=None) as out:
                    places = normalise(raw, out)
                with target.open_output_stream(f"{base}/{own}.idx", compression=None) as index:
                    for offset, length in places:
                        index.write(json.dumps({"name": own, "offset": offset, "length": length}).encode() + b"\n")
                yield pd.DataFrame({"index": [f"{own}.idx"], "records": [len(places)]})
    return run


def parse_record(data: bytes) -> tuple:
    """(page, payload bytes, payload digest, type, page referred to) of one record; a payload must fit its digest."""
    head, body = data.split(b"\r\n\r\n", 1)
    fields = parse_head(head)
    http, payload = body[:-4].split(b"\r\n\r\n", 1)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response":
        size, found = len(payload), payload_digest(payload)
        if found != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} does not fit its digest")
    return fields.get("warc-page-id"), size, digest, fields["warc-type"], fields.get("warc-refers-to-page-id")


def _read(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, base = _open(folder)
        file, name = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.name != name:
                    if file:
                        file.close()
                    name, file = r.name, target.open_input_file(f"{base}/{r.name}")
                file.seek(r.offset)
                out.append(parse_record(zlib.decompress(file.read(r.length), 31)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RECORDS.split(", ")])
        if file:
            file.close()
    return run


def find_revisits(df: DataFrame, id_col: str = "page_id", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``df`` with ``refers_to``: of equal payloads of at least ``min_bytes`` the largest id is the response of the others.

    NULL html is empty. Pages with a NULL id, and repeats of the largest id, are responses.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    content = F.when(F.octet_length(html) >= min_bytes, F.sha2(html, 256))
    largest = df.select(content.alias("__c"), F.col(id_col).alias("__i")).groupBy("__c").agg(
        F.max("__i").alias("__last"), F.count("*").alias("__n")).where("__n > 1 AND __c IS NOT NULL").select("__c", "__last")
    found = df.withColumn("__content", content).join(largest, F.col("__content") == F.col("__c"), "left")
    refers = F.when(F.col(id_col) < F.col("__last"), F.col("__last"))
    return found.withColumn("refers_to", refers).drop("__content", "__c", "__last")


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write every row as a record, each file one gzip stream; returns the manifest (``name``), a written table."""
    rows = find_revisits(df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")),
                         min_bytes=min_bytes)
    sent = rows.select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"))
    return saved(sent.mapInPandas(_write(folder, date), "name string"), "warc-manifest")


def normalise_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrite the files of ``manifest``, a task per file; returns (``index``, ``records``), a written table."""
    spread = manifest.repartition(F.col("name"))
    return saved(spread.mapInPandas(_normalise(folder), "index string, records long"), "warc-index")


def read_archives(spark: SparkSession, index: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """Records of the normalised files listed in ``index``, each found by its place."""
    if index.isEmpty():
        return spark.createDataFrame([], RECORDS).withColumns({c: F.lit(None).cast(id_type) for c in ("page_id", "refers_to")})
    # the sidecar files themselves say what is read; the manifest says which of the folder's files count
    listed = spark.read.schema("name string, offset long, length long").json(f"{folder}/*.idx")
    counted = listed.join(index.select(F.regexp_replace("index", r"\.idx$", "").alias("name")), "name", "left_semi")
    near = counted.repartition("name", F.expr("offset div 8000000")).sortWithinPartitions("name", "offset")
    out = near.mapInPandas(_read(folder), RECORDS)
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})

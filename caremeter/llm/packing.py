"""Packing by powers of two: no sequence crosses a document, none needs padding.

A document of n ids is cut into pieces whose lengths are the binary digits of n, longest first, with the full length
as often as it fits. Each piece is a sequence by itself; sequences of one length form a bucket, so a training batch
takes rows of one bucket and has no padding at all.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

SLICE_CHARS = 4_000_000      # text that a task tokenizes before it hands on the pieces
WORDS, PARTS = 500_000, 400_000      # entries of a worker's memo of words and of parts of words
PIECE_BITS = 21      # of a sequence id, for the piece within the document: a text of 2 GB has at most 2**20 + 11
ODD_SPACE = re.compile("[\x1c-\x1f]")      # str.split() takes these for white space, the tokenizer does not


class WordEncoder(dict):
    """Ids of a text whose tokenizer never joins what white space divides, as packed 16-bit numbers.

    The dict is a memo from word to ids. Words of common Latin letters are lower-cased and cut as the tokenizer's
    pattern cuts them, and only parts not met before go to its BPE model; any other word goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.bpe = self.whole.model.tokenize
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        # letters and signs on which Unicode versions agree, composed, with lower cases of one letter; no control signs
        self.plain = regex.compile("[!-~\xa1-\xac\xae-\xffĀ-įı-ňŊ-ž]*").fullmatch
        self.parts: dict[str, bytes] = {}
        self.as_byte = _byte_letters()

    def _other(self, text: str) -> bytes:
        return array("H", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            if len(self.parts) >= PARTS:
                self.parts.clear()
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.as_byte)
            got = self.parts[part] = array("H", [t.id for t in self.bpe(shown)]).tobytes()
        return got

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(".,;:!?")
        if core.isascii() and core.isalpha():           # letters, then one run of signs: two parts without a pattern
            tail = word[len(core):]
            got = self._part(core.lower()) + (self._part(tail) if tail else b"")
        elif "<|" in word or not self.plain(word):
            got = self._other(word)
        else:
            got = b"".join(map(self._part, self.cut(word.lower())))
        self[word] = got
        return got

    def ids(self, text: str) -> np.ndarray:
        if len(self) >= WORDS:
            self.clear()
        if ODD_SPACE.search(text):
            return np.frombuffer(self._other(text), np.uint16)
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), np.uint16)


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, others from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: b for b in shown}, **{b: 256 + i for i, b in enumerate(hidden)}}


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process and file: the memo outlives a task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def piece_lengths(n: int, longest: int) -> list[int]:
    """Binary pieces of ``n``, longest first: 2048 as often as it fits, then a power of two for each bit of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(longest.bit_length())) if rest >> b & 1]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``SLICE_CHARS`` of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + SLICE_CHARS, "right")))
        yield begin, end
        begin = end


def _pieces(path: str, longest: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for a, b in _slices(batch.column(1)):
                part = batch.slice(a, b - a)
                docs = [np.append(own.ids(t or ""), np.uint16(end_id)) for t in part.column(1).to_pylist()]
                lengths = [piece_lengths(len(d), longest) for d in docs]
                which = np.repeat(np.arange(len(docs)), [len(x) for x in lengths])
                length = np.fromiter((n for x in lengths for n in x), np.int64)
                ends = np.cumsum(length)
                sizes = np.array([len(d) for d in docs], np.int64)
                starts = ends - length - (np.cumsum(sizes) - sizes)[which]
                data = np.concatenate(docs).astype("<u4")
                cuts = np.concatenate([[0], ends * 4]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
                taken, names = [part.column(0).take(pa.array(which))], ["d", "start", "length", "doc_tokens", "ids"]
                if part.num_columns > 2:        # the place of the document comes with it
                    first = np.cumsum([0, *map(len, lengths)])[:-1]
                    nth = np.arange(len(length)) - first[which]
                    place = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)[which]
                    taken, names = [*taken, pa.array((place << PIECE_BITS) + nth)], ["d", "sequence_id", *names[1:]]
                yield pa.RecordBatch.from_arrays(
                    [*taken, pa.array(starts), pa.array(length), pa.array(sizes[which]), ids], names)
    return run


def in_file_order(df: DataFrame) -> Column | None:
    """Number of a row of a table just read from files: in the order of their part numbers, then by row; None for others.

    Spark packs files into tasks by size, so the order of a written table is only in its names. The driver gets one row
    per file.
    """
    try:
        files = df.groupBy(F.col("_metadata.file_path").alias("f")).agg((F.max("_metadata.row_index") + 1).alias("n")).collect()
    except AnalysisException:
        return None
    start, found = 0, []
    for r in sorted(files, key=lambda r: _part_number(r["f"])):
        found.append((r["f"], start))
        start += r["n"]
    if not found:
        return None
    starts = F.create_map(*[F.lit(x) for pair in found for x in pair])
    return F.element_at(starts, F.col("_metadata.file_path")) + F.col("_metadata.row_index")


def _part_number(path: str) -> tuple:
    folder, _, name = path.rpartition("/")
    return folder, [int(x) if x.isdigit() else x for x in re.findall(r"^part-(\d+)", name)], [
        int(x) for x in re.findall(r"-c(\d+)\.", name)], name


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 2048,
         end_id: int = 1, order: Column | None = None) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``doc_tokens``, ``ids``, ``bucket``, ``sequence_id``, ``offset``.

    ``ids`` are little-endian unsigned 32-bit numbers; every document ends with ``end_id``, also a NULL or empty one,
    which is that id alone. ``bucket`` is the length that all its sequences share, ``offset`` is 0 as each piece is a
    sequence of its own. ``longest`` is a power of two. NULL ids stay NULL and equal rows are packed each for itself.
    ``sequence_id`` follows ``order``, a different number from 0 for each document, and within a document its pieces;
    without it the order in which tasks read. Other columns are not read. No shuffle: a task cuts the documents it reads.
    """
    if longest & (longest - 1) or not 0 <= end_id < 1 << 16:
        raise ValueError("longest must be a power of two, end_id an id of 16 bits")
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    number = "" if order is None else "sequence_id long, "
    if order is not None:
        rows = df.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"), order.cast("long").alias("o"))
    cut = rows.mapInArrow(_pieces(tokenizer, longest, end_id),
                          f"d {kind}, {number}start long, length long, doc_tokens long, ids binary")
    sequence = F.monotonically_increasing_id() if order is None else F.col("sequence_id")
    return cut.select(F.col("d").alias(id_col), "start", "length", "doc_tokens", "ids",
                      F.col("length").cast("int").alias("bucket"), sequence.alias("sequence_id"),
                      F.lit(0).cast("long").alias("offset"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per sequence length, for readers that batch equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)

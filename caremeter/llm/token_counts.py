"""Token counts without token ids: pieces are counted once per distinct pre-token.

A pre-token is a run of blanks and the characters up to the next blank. The vocabulary has no piece that goes on past
a blank, so a text has exactly the pieces of its pre-tokens. Documents are cut into blocks; a block sends each of its
distinct pre-tokens once, to the bucket that the pre-token hashes to, together with the documents of the block that
hold it and how often. A bucket meets all occurrences of its pre-tokens, counts the pieces of each once, and answers
with pieces per document, which are summed.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

PRE_TOKEN = re.compile(" +[^ ]*")
BLANK = "▁"         # how the vocabulary writes a blank; a text's own sign of this kind is one too
BLOCK_CHARS = 8_000_000  # text of one block; bounds a Python worker's memory
BLOCK_DOCS = 20_000
HELD_SUMS = 4_000_000    # documents whose sums a task gathers before it sends them on

SENT = "bucket int, block long, tokens binary, holders binary, docs binary, freqs binary, ids binary, sizes binary"
COUNTED = "block long, sums binary, ids binary, sizes binary"
OUT = "i long, missing boolean, n_bytes long, n_tokens long"


def pre_tokens(text: str) -> list[str]:
    return PRE_TOKEN.findall(" " + text.replace(BLANK, " ")) if text else []


class PieceCounter:
    """Pieces of a pre-token; the library puts the first blank of every text back itself."""

    def __init__(self, model: str):
        import sentencepiece
        self.encode = sentencepiece.SentencePieceProcessor(model_file=model).encode

    def many(self, tokens: list[str]) -> list[int]:
        return [len(ids) or 1 for ids in self.encode([t[1:] for t in tokens], num_threads=1)]


def check_vocabulary(model: str) -> None:
    """Pre-tokens are only independent if no piece has a blank after another character."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    bad = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if BLANK in p.lstrip(BLANK)]
    if bad:
        raise ValueError(f"pieces go on past a blank: {bad[:5]}")


def _pack(array: np.ndarray, kind) -> bytes:
    return zlib.compress(array.astype(kind).tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


class _Block:
    """Documents of one task until they are sent on together."""

    def __init__(self, buckets: int):
        self.buckets, self.vocabulary, self.chars = buckets, {}, 0
        self.ids, self.hashes, self.sizes, self.tokens, self.freqs = [], [], [], [], []

    def add(self, ident: int, missing: bool, hashed: int, text: str) -> None:
        known, ids = Counter(pre_tokens(text)), self.vocabulary
        self.tokens.append(np.fromiter((ids.setdefault(t, len(ids)) for t in known), np.int64, len(known)))
        self.freqs.append(np.fromiter(known.values(), np.int64, len(known)))
        self.ids.append((ident, missing))
        self.hashes.append(hashed)
        self.sizes.append(len(text.encode("utf-8", "surrogatepass")))
        self.chars += len(text)

    def full(self) -> bool:
        return self.chars >= BLOCK_CHARS or len(self.ids) >= BLOCK_DOCS

    def rows(self) -> pd.DataFrame:
        """One row with the documents, and one for each bucket with pre-tokens of the block.

        The block's number comes from its documents, so a recomputed task gives the same; blocks of equal documents
        share it and are told apart again by their copies.
        """
        ids = np.array(self.ids, np.int64)
        known = ids.tobytes() + np.array(self.hashes, np.int64).tobytes()
        block = int.from_bytes(hashlib.blake2b(known, digest_size=8).digest(), "little", signed=True)
        out = [(-1, block, b"", b"", b"", b"", _pack(ids, np.int64), _pack(np.array(self.sizes), np.int64))]
        tokens = list(self.vocabulary)
        if tokens:
            home = np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) % self.buckets for t in tokens), np.int64, len(tokens))
            doc = np.repeat(np.arange(len(ids)), [len(x) for x in self.tokens])
            token, freq = np.concatenate(self.tokens), np.concatenate(self.freqs)
            order = np.lexsort((token, home[token]))
            doc, token, freq = doc[order], token[order], freq[order]
            starts = np.flatnonzero(np.diff(home[token], prepend=-1))
            for a, b in zip(starts, [*starts[1:], len(token)]):
                firsts = np.flatnonzero(np.diff(token[a:b], prepend=-1))
                text = BLANK.join([tokens[j] for j in token[a:b][firsts]])
                out.append((int(home[token[a]]), block, zlib.compress(text.encode("utf-8", "surrogatepass"), 1),
                            _pack(np.diff(firsts, append=b - a), np.uint32), _pack(doc[a:b], np.uint16),
                            _pack(freq[a:b], np.uint32), b"", b""))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SENT.split(", ")])


def _blocks(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = _Block(buckets)
        for batch in batches:
            for row in zip(batch["i"], batch["missing"], batch["x"], batch["t"]):
                block.add(*row)
                if block.full():
                    yield block.rows()
                    block = _Block(buckets)
        if block.ids:
            yield block.rows()
    return run


class _Sums:
    """Pieces of the documents of some blocks, as far as one task has counted them."""

    def __init__(self):
        self.of_block: dict[int, np.ndarray] = {}
        self.held = 0

    def add(self, block: int, docs: np.ndarray, pieces: np.ndarray) -> None:
        new = np.bincount(docs, pieces).astype(np.int64)
        old = self.of_block.get(block)
        if old is None or len(old) < len(new):
            old, new = new, old
            self.of_block[block] = old
            self.held += len(old) - (0 if new is None else len(new))
        if new is not None:
            old[:len(new)] += new

    def rows(self) -> pd.DataFrame:
        out = [(block, _pack(sums, np.int64), b"", b"") for block, sums in self.of_block.items()]
        self.of_block, self.held = {}, 0
        return pd.DataFrame(out, columns=["block", "sums", "ids", "sizes"])


def _count(model: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter, bucket, known, sums = PieceCounter(model), None, {}, _Sums()
        for batch in batches:
            listed = batch["bucket"] < 0
            if listed.any():
                yield batch.loc[listed, ["block", "ids", "sizes"]].assign(sums=b"")[["block", "sums", "ids", "sizes"]]
            for r in batch[~listed].itertuples(index=False):
                if r.bucket != bucket:       # rows come sorted by bucket: one bucket's pre-tokens are held at a time
                    bucket, known = r.bucket, {}
                tokens = zlib.decompress(r.tokens).decode("utf-8", "surrogatepass").split(BLANK)
                new = [t for t in tokens if t not in known]
                if new:
                    known.update(zip(new, counter.many(new)))
                each = np.repeat(np.array([known[t] for t in tokens], np.int64), _unpack(r.holders, np.uint32))
                sums.add(r.block, _unpack(r.docs, np.uint16), each * _unpack(r.freqs, np.uint32))
                if sums.held >= HELD_SUMS:
                    yield sums.rows()
        yield sums.rows()
    return run


def _sum(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by block: sums its parts and lists its documents."""
    block, copies, ids, sizes, parts = None, 0, b"", b"", []

    def listed() -> pd.DataFrame:
        own, bytes_ = _unpack(ids, np.int64).reshape(-1, 2), _unpack(sizes, np.int64)
        total = np.zeros(len(own), np.int64)
        for p in parts:
            total[:len(p)] += p
        out = pd.DataFrame({"i": own[:, 0], "missing": own[:, 1] > 0, "n_bytes": bytes_, "n_tokens": total // copies})
        return pd.concat([out] * copies, ignore_index=True)     # blocks of equal documents were summed together

    for batch in batches:
        for r in batch.itertuples(index=False):
            if r.block != block:
                if block is not None:
                    yield listed()
                block, copies, parts = r.block, 0, []
            if r.ids:
                copies, ids, sizes = copies + 1, r.ids, r.sizes
            else:
                part = _unpack(r.sums, np.int64)
                if parts and len(parts[0]) >= len(part):
                    parts[0][:len(part)] += part
                else:
                    parts.insert(0, part.copy())
    if block is not None:
        yield listed()


def count_tokens(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text",
                 buckets: int | None = None) -> DataFrame:
    """One row per row of ``df``: id, ``n_bytes`` (UTF-8) and ``n_tokens`` of its whole text.

    ``model`` is a sentencepiece file, present on every executor. NULL texts count as empty (0 tokens). Equal rows
    come back as often as they came in; NULL ids stay NULL. Other columns are not read. The rows of a partition must
    come in the same order when it is computed again, as they do from files.
    """
    check_vocabulary(model)
    buckets = buckets or max(1024, 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text, ident = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    rows = df.select(F.coalesce(ident, F.lit(0)).alias("i"), ident.isNull().alias("missing"),
                     F.xxhash64(text).alias("x"), text.alias("t"))
    sent = rows.mapInPandas(_blocks(buckets), SENT)
    # document rows stay spread; a bucket's rows meet in one task and follow each other
    home = F.when(F.col("bucket") < 0, F.xxhash64("block")).otherwise(F.col("bucket"))
    counted = sent.repartition(home).sortWithinPartitions("bucket").mapInPandas(_count(model), COUNTED)
    documents = counted.repartition("block").sortWithinPartitions("block").mapInPandas(_sum, OUT)
    return documents.select(F.when(~F.col("missing"), F.col("i")).alias(id_col), "n_bytes", "n_tokens")

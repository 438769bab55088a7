"""Collocations: phrases that hold together, found by Rabin-Karp fingerprints.

Blocks of texts turn words and n-grams into 64-bit fingerprints with prefix polynomials in numpy; the shuffle sums counts
by fingerprint. Length by length only n-grams whose parts are frequent are counted; what is frequent goes back to the
blocks as a bitmap of fixed size, in which a chance hit costs a count and never a result. Fingerprints only decide what
to look at: at last every block follows its pointers to the occurrences of frequent fingerprints, verifies their words
against the text, and sends the phrases themselves, which are counted anew by their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from caremeter.llm.common import saved

BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"    # fixed values: ends of pieces, and of words inside them
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)], KIND[list(BREAKS)] = 1, 2

FILTER_BITS = 27             # the bitmap of frequent fingerprints has 2 ** 27 bits (16 MB) at every size of input
BLOCK = 8 << 20              # bytes of text that a block counts together
CHUNK = 1 << 20              # bytes hashed at a time
RUN = 1 << 17                # words whose n-grams are hashed at a time
LONG = 64                    # words of more bytes are compared one by one
SLICE = 200_000              # rows of an Arrow batch of numbers
SPELLED = 20_000             # rows of one of phrases
BASE = 0x9E3779B97F4A7C15    # odd, so it has an inverse modulo 2 ** 64
PHRASE = "lang string, n int, phrase string, c long, doc_id long, at long"


@cache
def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    done = 1
    while done < size:
        more = min(done, size - done)
        out[done:done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


def polynomials(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprint of ``values[s:e]`` for every start and end: differences of prefix polynomials modulo 2 ** 64."""
    size = 1 << max(10, len(values).bit_length())
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(BASE, size)[:len(values)], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * _powers(pow(BASE, -1, 1 << 64), size)[starts]


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """Numbers below the size of a block, in 32 bits where they fit."""
    return numbers.astype(np.int32) if not len(numbers) or numbers.max() < 2**31 else numbers


def mixed(x: np.ndarray, salt) -> np.ndarray:
    """Spread fingerprints over all 64 bits, differently for each salt."""
    x = x ^ salt
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a block: byte ranges in ``text``, fingerprints, piece numbers and languages."""

    def __init__(self, docs: list[tuple[bytes, str, object, int]]):
        self.docs = docs
        self.raw = b"".join(t + b"\n" for t, *_ in docs)
        self.text = np.frombuffer(self.raw, np.uint8)
        kind = KIND[self.text]
        inside = kind == 0                                   # every text ends with a break, so the last word ends inside the block
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[::2].copy(), edges[1::2].copy()
        del inside, edges
        self.piece = _narrow(np.searchsorted(np.flatnonzero(kind == 2), self.starts))
        del kind
        self.doc_ends = np.cumsum([len(t) + 1 for t, *_ in docs])
        self.doc = _narrow(np.searchsorted(self.doc_ends, self.starts, "right"))
        self.langs = sorted({lang for _, lang, *_ in docs})
        number = {lang: k for k, lang in enumerate(self.langs)}
        self.lang = _narrow(np.array([number[lang] for _, lang, *_ in docs]))[self.doc]
        seeds = [int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") for lang in self.langs]
        self.seeds = np.array(seeds, np.uint64)
        self.prints = self._prints()

    def _prints(self) -> np.ndarray:
        out, at = np.empty(len(self.starts), np.uint64), 0
        while at < len(out):
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + CHUNK, "right")))
            part = self.text[low:self.ends[to - 1]].astype(np.uint64) + np.uint64(1)
            out[at:to] = polynomials(part, self.starts[at:to] - low, self.ends[at:to] - low)
            at = to
        return mixed(out, (self.ends - self.starts).astype(np.uint64))

    def grams(self, n: int, keep: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(first word, fingerprint) of every run of ``n`` words inside a piece whose first word ``keep`` marks."""
        m = len(self.prints) - n + 1
        if m < 1:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        first = _narrow(np.flatnonzero((self.piece[n - 1:] == self.piece[:m]) & keep))
        found = np.empty(len(first), np.uint64)
        for at in range(0, len(first), RUN):                 # a fingerprint does not depend on where its run of words begins
            own = first[at:at + RUN]
            low = own[0]
            prints = polynomials(self.prints[low:own[-1] + n], own - low, own + (n - low))
            found[at:at + RUN] = mixed(prints, self.seeds[self.lang[own]] + np.uint64(n))
        return first, found

    def ids(self) -> np.ndarray:
        """A number for every word, equal only where the bytes are."""
        _, first, ids = np.unique(self.prints, return_index=True, return_inverse=True)
        same, size = first[ids], self.ends - self.starts
        if (size != size[same]).any() or not self._equal(same, size):
            number: dict[bytes, int] = {}
            return np.array([number.setdefault(self.raw[s:e], len(number)) for s, e in zip(self.starts, self.ends)])
        return ids

    def _equal(self, same: np.ndarray, size: np.ndarray) -> bool:
        for i in np.flatnonzero(size > LONG):
            j = same[i]
            if self.raw[self.starts[i]:self.ends[i]] != self.raw[self.starts[j]:self.ends[j]]:
                return False
        order = np.flatnonzero(size <= LONG)
        order = order[np.argsort(-size[order], kind="stable")]
        a, b, size = self.starts[order], self.starts[same[order]], size[order]
        for at in range(int(size[0]) if len(size) else 0):
            k = np.searchsorted(-size, -at, "left")          # words longer than ``at``
            if (self.text[a[:k] + at] != self.text[b[:k] + at]).any():
                return False
        return True


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[Words]:
    """Blocks of whole texts (columns text, lang, doc); a text longer than a block is cut between two pieces."""
    docs, size = [], 0
    for batch in batches:
        for text, lang, doc in zip(*(batch.column(k) for k in range(3))):
            text, at = text.as_py().lower(), 0               # of bytes: A-Z only
            while at < len(text):
                part = text if len(text) <= BLOCK else text[at:_piece_end(text, at + BLOCK)]
                docs.append((part, lang.as_py(), doc.as_py(), at))
                at, size = at + len(part), size + len(part)
                if size >= BLOCK:
                    yield Words(docs)
                    docs, size = [], 0
    if docs:
        yield Words(docs)


def _piece_end(text: bytes, at: int) -> int:
    """End of the first piece that ends at or after byte ``at``."""
    while at < len(text) and text[at] not in BREAKS:
        at += 1
    return min(at + 1, len(text))


def holds(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    at = prints >> np.uint64(64 - FILTER_BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _counter(lengths: list[int], bits) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of n-grams per block; with ``bits``, only of those whose parts of ``lengths[0] - 1`` words are all in it."""
    def count(batches):
        allowed = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for words in blocks(batches):
            for n in lengths:
                found, c = _counted(words, n, lengths[0] - 1, allowed)
                for at in range(0, len(found), SLICE):
                    yield pa.record_batch([found[at:at + SLICE].view(np.int64), c[at:at + SLICE]], names=["fp", "c"])
            words = found = c = None                         # before the next block is made
    return count


def _counted(words: Words, n: int, part: int, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a block's n-grams and their counts; with ``allowed`` only if all their parts of ``part`` words are in it."""
    keep = True
    if allowed is not None:
        whole = np.zeros(len(words.prints), bool)
        first, prints = words.grams(part)
        whole[first] = holds(allowed, prints)
        del first, prints
        keep = np.ones(max(0, len(whole) - n + 1), bool)
        for k in range(n - part + 1):
            keep &= whole[k:k + len(keep)]
    prints = words.grams(n, keep)[1]
    prints.sort()
    new = np.ones(len(prints), bool)
    new[1:] = prints[1:] != prints[:-1]
    at = np.flatnonzero(new)
    return prints[at], np.diff(at, append=len(prints))


def _speller(longest: int, bits) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The phrases of a block whose fingerprint is in ``bits``, verified against the text; n = 0 counts all words."""
    def spell(batches):
        allowed = np.frombuffer(bits.value, np.uint8)
        for words in blocks(batches):
            rows = _spelled(words, longest, allowed)
            while some := list(islice(rows, SPELLED)):
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*some), kinds)],
                                      names=["lang", "n", "phrase", "c", "doc_id", "at"])
            words = rows = None                              # before the next block is made
    return spell


def _spelled(words: Words, longest: int, allowed: np.ndarray) -> Iterator[tuple]:
    ids = _narrow(words.ids())
    for k, c in zip(*np.unique(words.lang, return_counts=True)):
        yield words.langs[k], 0, "", int(c), None, None
    for n in range(1, longest + 1):
        first, prints = words.grams(n)
        hit = holds(allowed, prints)
        first, prints = first[hit], prints[hit]
        yield from _phrases(words, ids, first, prints, n)


def _phrases(words: Words, ids: np.ndarray, first: np.ndarray, prints: np.ndarray, n: int) -> Iterator[tuple]:
    _, pointer, group, c = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
    pointed = first[pointer]
    lead = pointed[group]
    same = words.lang[first] == words.lang[lead]
    for k in range(n):
        same &= ids[first + k] == ids[lead + k]
    if not same.all():                                       # other words under one fingerprint: group by the words
        table = np.column_stack([words.lang[first], *[ids[first + k] for k in range(n)]])
        _, pointer, c = np.unique(table, axis=0, return_index=True, return_counts=True)
        pointed = first[pointer]
    raw, starts, ends = words.raw, words.starts, words.ends
    for i, count in zip(pointed.tolist(), c.tolist()):
        phrase = b" ".join([raw[starts[j]:ends[j]] for j in range(i, i + n)]).decode()
        d = words.doc[i]
        doc, base = words.docs[d][2:]
        begin = words.doc_ends[d - 1] if d else 0
        yield words.langs[words.lang[i]], n, phrase, count, doc, base + int(starts[i] - begin)


def bitmap(frequent: DataFrame):
    """Broadcast of a bitmap of the fingerprints ``fp``; its size is fixed, whatever their number."""
    at = F.shiftrightunsigned("fp", 64 - FILTER_BITS)
    words = (frequent.select(F.shiftright(at, 6).alias("word"), (at % 64).cast("int").alias("bit"))
             .groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow())
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)         # at most this many rows came to the driver
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(out.tobytes())


def phrase_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  min_count: int = 30, longest: int = 4) -> DataFrame:
    """Frequent phrases: ``lang``, ``n`` words, ``phrase`` (space-joined), ``count``, ``first_doc``, ``first_at``.

    Texts are lower-cased (A-Z only) and split into pieces at ``.,;:!?`` and line ends, pieces into words at blanks.
    All phrases of 1 to ``longest`` words inside a piece are counted, overlaps included, for each language by itself;
    NULL is the language ``und``. Those found ``min_count`` times stay. Row ``n = 0`` of a language counts all its words. NULL and empty texts
    have no words, repeated rows count each time, long texts are read whole, a table without rows gives no rows.
    ``first_doc`` is the smallest id with the phrase (NULL last), ``first_at`` a place in it, in UTF-8 bytes. Further columns play no part.
    """
    texts = df.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
                      F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(id_col).cast("long").alias("doc"))

    def frequent(lengths: list[int], bits) -> DataFrame:
        counts = texts.mapInArrow(_counter(lengths, bits), "fp long, c long")
        return saved(counts.groupBy("fp").agg(F.sum("c").alias("c")).where(F.col("c") >= min_count).select("fp"), "fingerprints")

    found, bits = [], None
    for lengths in ([1], [2], list(range(3, longest + 1))):
        if lengths and lengths[0] <= longest:
            found.append(frequent(lengths, bits))
            bits = bitmap(found[-1])
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    spelled = texts.mapInArrow(_speller(longest, bitmap(every)), PHRASE)
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "at")))
    return (spelled.groupBy("lang", "n", "phrase").agg(F.sum("c").alias("count"), first.alias("first"))
            .where((F.col("n") == 0) | (F.col("count") >= min_count))
            .select("lang", "n", "phrase", "count", F.col("first.doc_id").alias("first_doc"), F.col("first.at").alias("first_at")))


def _joined(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def score_phrases(counts: DataFrame, scale: int = 2_000_000, absorb_percent: int = 80) -> DataFrame:
    """Phrases of two words or more of ``phrase_counts`` with ``a``, ``l``, ``r``, ``n``, ``score``.

    Cutting a phrase of count ``a`` in two gives the counts ``l`` and ``r`` of its parts and a score
    floor(scale * a / (l + r)); the lowest cut counts, ties go to the shortest left part. Phrases contained in a longer one
    that has ``absorb_percent`` per cent of their count or more go.
    """
    known = counts.where("n > 0").select("lang", "phrase", F.col("count").alias("f"))
    phrases = counts.where("n > 1").select("lang", "phrase", F.col("n").alias("words_n"), F.col("count").alias("a"),
                                           F.split("phrase", " ").alias("words"))
    cuts = phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words_n") - 1)).alias("k"), "words_n")
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("words"), F.lit(1), F.col("k")).alias("left_part"),
                       _joined(F.col("words"), F.col("k") + 1, F.col("words_n")).alias("right_part"))
    halves = (cuts.join(known.select("lang", F.col("phrase").alias("left_part"), F.col("f").alias("l")), ["lang", "left_part"])
              .join(known.select("lang", F.col("phrase").alias("right_part"), F.col("f").alias("r")), ["lang", "right_part"]))
    whole = "decimal(20,0)"
    halves = halves.withColumn("score", F.expr(f"(cast(a as {whole}) * cast({scale} as decimal(10,0))) div (cast(l as {whole}) + cast(r as {whole}))"))
    best = halves.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # (start, length) of every shorter phrase inside a phrase
    inner = phrases.where("words_n > 2").select("lang", "a", "words", "words_n", F.explode(F.sequence(F.lit(2), F.col("words_n") - 1)).alias("size"))
    inner = inner.select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("words_n") - F.col("size") + 1)).alias("start"))
    around = (inner.select("lang", _joined(F.col("words"), F.col("start"), F.col("size")).alias("phrase"), F.col("a").alias("around"))
              .groupBy("lang", "phrase").agg(F.max("around").alias("around")))
    free = best.join(around, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (F.col("around").cast(whole) * 100 < F.col("a").cast(whole) * absorb_percent))
    totals = counts.where("n = 0").select("lang", F.col("count").alias("n"))
    return free.join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"))


def best_phrases(scored: DataFrame, k: int = 2000, salts: int = 64) -> DataFrame:
    """The first ``k`` phrases of each language with ``rank``: by score, then count, both descending, then by bytes.

    A language is ranked in ``salts`` parts first, so the last window sees at most ``salts * k`` of its phrases.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.hash("phrase"), F.lit(salts))
    near = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    near = near.where(F.col("rank") <= k).drop("part", "rank")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= k).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(df: DataFrame, k: int = 2000, **options) -> DataFrame:
    """The best ``k`` collocations of each language; see ``phrase_counts``, ``score_phrases`` and ``best_phrases``."""
    return best_phrases(score_phrases(saved(phrase_counts(df, **options), "phrases")), k)

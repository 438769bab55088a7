"""Long repeats between documents, found with run-length compressed Burrows-Wheeler indexes.

Texts are cut into folds where their bytes say so, and of equal folds only the one of the smallest id is looked into.
Equal windows hold the same anchor, the window's smallest 24-byte fingerprint, at the same place. So a stretch of windows
round an anchor that only one document has cannot repeat, and stretches round a shared anchor can be indexed together:
every index is built over the distinct stretches of some anchors, wherever in the corpus they occur. An anchor with one
distinct stretch needs none. An index keeps the transform as runs, with samples at their ends, and streams each stretch
through it byte by byte from the right; where the match is long enough, the sample says which document has it first.

Anchors and stretches travel by bucket, packed, one row for each block of texts. Blocks learn what is repeated from
bitmaps. A chance hit there sends more to be compared and never decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from hashlib import blake2b
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from caremeter.llm.collocations import bitmap, holds, mixed, polynomials
from caremeter.llm.common import saved, without

SEED = 24                    # bytes of an anchor
CHUNK = 1 << 20              # windows handled at a time
BATCH = 1 << 16              # bytes of short texts that are handled together
BLOCK = 8 << 20              # bytes of text whose anchors are folded together before they are sent
PLACES = 200_000             # places of stretches that are folded together
INDEX = 1 << 17              # bytes of an index, unless one anchor has more; larger ones leave the caches
CROWDED = 4096               # distinct stretches of an anchor from which they are split by more bytes than the anchor's
PACK = 7                     # symbols of nine bits in one integer; more of fewer bits
NOBODY = -(1 << 63)          # stands for a NULL id, below all others
FOLD = 512                   # windows in a fold, on average; a power of two
SPREAD = 0x5EED              # salt: anchors are smallest fingerprints, so their own upper bits are far from even
BUCKETS = 10                 # bits of the number of buckets, at least; more for texts of over 64 GB
MARKS = 27, 29               # bits of the number of places in the bitmap of anchors, at least and at most
FOLD_PLACE = "i long, x long, s long, e long, k1 long, k2 long"
FOLD_NAMES = [c.split()[0] for c in FOLD_PLACE.split(", ")]
PLACE = "i long, x long, at long, k1 long, k2 long, bucket int, off binary, size binary, first binary, more binary, bytes binary"
PLACE_NAMES = [c.split()[0] for c in PLACE.split(", ")]
ADDED = ("n_bytes", "n_removed", "spans", "kept_bytes")
SPANS = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))


def seeds(text: bytes, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Parts of a text by their windows: (place of the part, its bytes, fingerprints of all its seeds)."""
    size = min(SEED, least)
    for base in range(0, len(text) - least + 1, CHUNK):
        part = np.frombuffer(text, np.uint8, min(CHUNK + least - 1, len(text) - base), base)
        n = len(part) - size + 1
        yield base, part, mixed(polynomials(part.astype(np.uint64) + np.uint64(1), slice(0, n), slice(size, size + n)), np.uint64(size))


def blocks(texts: Iterable[bytes], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
    """Parts of texts, several short ones in one: (numbers of the texts, where they begin, place of the part, its bytes, its seeds)."""
    held, size = [], 0
    for k, text in enumerate(texts):
        if len(text) >= BATCH:
            for base, part, prints in seeds(text, least):
                yield np.array([k]), np.array([0]), base, part, prints
            continue
        held.append((k, size, text))
        size += len(text)
        if size >= BATCH:
            yield from _together(held, least)
            held, size = [], 0
    if held:
        yield from _together(held, least)


def _together(held: list[tuple[int, int, bytes]], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
    numbers, begin, texts = zip(*held)
    for base, part, prints in seeds(b"".join(texts), least):
        yield np.array(numbers), np.array(begin), base, part, prints


def text_at(begin: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of a part's texts holds each place."""
    return np.searchsorted(begin, places, "right") - 1


def folds(part: np.ndarray, prints: np.ndarray, least: int, fold: int, begin: np.ndarray = np.zeros(1, np.int64)) -> tuple[np.ndarray, np.ndarray]:
    """First and last window (exclusive) of a part's folds: they begin where the seed says so, whatever is around, and with a text."""
    end = np.append(begin[1:], len(part)) - least + 1        # windows do not leave their text
    seen = np.flatnonzero((prints[:end[-1]] & np.uint64(fold - 1)) == 0)
    first = np.union1d(begin, seen[seen < end[text_at(begin, seen)]])
    return first, np.minimum(np.append(first[1:], end[-1]), end[text_at(begin, first)])


def anchored(part: np.ndarray, prints: np.ndarray, wanted: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and place of the anchor of the stretches of ``wanted`` windows that share an anchor."""
    # the smallest of the upper halves, the leftmost of equal ones
    lowest = (prints & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(prints), dtype=np.uint64)
    reach, width = 1, least - min(SEED, least) + 1
    while reach < width:
        more = min(reach, width - reach)
        lowest = np.minimum(lowest[:len(lowest) - more], lowest[more:])
        reach += more
    anchor = (lowest & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (wanted[1:] != wanted[:-1])]))
    end = np.append(new[1:], len(anchor)) + least - 1
    keep = wanted[new]
    return new[keep], end[keep], anchor[new[keep]]


def stretches(part: np.ndarray, prints: np.ndarray, wanted: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and anchor's fingerprint of the stretches of ``wanted`` windows that share an anchor."""
    start, end, anchor = anchored(part, prints, wanted, least)
    return start, end, prints[anchor]


def digests(bodies: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of 128-bit digests. They decide, so no polynomial: modulo 2 ** 64 those of Thue-Morse texts are equal."""
    both = np.frombuffer(b"".join([blake2b(body, digest_size=16).digest() for body in bodies]), np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def keys(part: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of byte ranges."""
    data = part.tobytes()
    k1, k2 = digests(data[s:e] for s, e in zip(start.tolist(), end.tolist()))
    return k1.view(np.uint64), k2.view(np.uint64)


class RunIndex:
    """Run-length transform of some texts with, per run, the smallest owner of the windows that start in it.

    Suffixes are sorted in full, texts end in terminators of their own. Runs also end where two neighbours differ within
    ``least`` bytes, so all rows of a run belong to one window, and the samples taken at run ends hold for all its rows.
    """

    def __init__(self, texts: list[bytes], owners: np.ndarray, least: int):
        self.least, self.sizes = least, np.array([len(t) for t in texts])
        symbols = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.int64) + 1
        self.stops = np.cumsum(self.sizes + 1) - 1
        symbols[self.stops] = 0
        text_of = np.repeat(np.arange(len(texts)), self.sizes + 1)
        rows, same = self._sorted(symbols, self.stops[text_of])
        before = np.where(rows > 0, symbols[rows - 1], 0)                        # the transform
        window = np.concatenate([[True], ~same])
        self.starts = np.flatnonzero(window | np.concatenate([[True], before[1:] != before[:-1]]))
        heads, lengths = before[self.starts], np.diff(np.append(self.starts, len(rows)))
        self.run_of = np.repeat(np.arange(len(heads), dtype=np.int32), lengths)
        order = np.argsort(heads.astype(np.uint16), kind="stable")               # by radix
        self.lands = np.empty(len(heads), np.int64)                              # where a run's first row goes
        self.lands[order] = np.cumsum(lengths[order]) - lengths[order]
        in_run = np.minimum.reduceat(owners[text_of[rows]], self.starts)
        group = np.cumsum(window[self.starts]) - 1
        self.owner = np.minimum.reduceat(in_run, np.flatnonzero(window[self.starts]))[group]

    def _sorted(self, symbols: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order, and for each row but the first whether it shares ``least`` bytes with the one above (or both are shorter)."""
        n, here = len(symbols), np.arange(len(symbols))
        code = np.cumsum(np.bincount(symbols) > 0) - 1                           # terminators are 0
        width = max(1, int(code[-1]).bit_length())
        reach, left = min(63 // width, self.least), stop - here                  # PACK symbols or more
        ahead, packed = np.append(code[symbols], np.zeros(reach, np.int64)), np.zeros(n, np.int64)
        for k in range(reach):
            packed <<= width
            packed |= np.where(left > k, ahead[k:k + n], 0)
        packed[left == 0] = np.arange(len(self.stops)) - len(self.stops)         # terminators come first, in order
        times = 3 if n < 1 << 21 else 2                                          # ranks that fit into one integer
        while True:
            rows = np.argsort(packed)
            up = packed[rows]
            rank = np.empty(n, np.int64)
            rank[rows] = np.cumsum(np.concatenate([[0], up[1:] != up[:-1]]))
            if reach <= self.least:
                half, width = rank, reach
            if reach >= self.least and rank[rows[-1]] == n - 1:
                break
            packed = rank
            for k in range(1, times):
                packed = packed * n + rank[np.minimum(here + k * reach, stop)]
            reach *= times
        fits = here + self.least <= stop
        a, b = rows[1:], rows[:-1]
        same = fits[a] & fits[b]
        for at in {*range(0, self.least - width, width), self.least - width}:
            piece = half[np.minimum(here + at, stop)]
            same &= piece[a] == piece[b]
        return rows, same | (~fits[a] & ~fits[b])

    def stream(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, smallest owner) of every window: all texts walk through the runs together, from right to left."""
        text, row = np.arange(len(self.sizes)), np.arange(len(self.sizes))       # terminators are the first rows
        run, found = self.run_of[row], []
        for step in range(1, int(self.sizes.max(initial=0)) + 1):
            more = self.sizes[text] >= step
            if not more.all():
                text, row, run = text[more], row[more], run[more]
            row = self.lands[run] + row - self.starts[run]
            run = self.run_of[row]
            if step >= self.least:
                found.append((text, self.sizes[text] - step, self.owner[run]))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(c) for c in zip(*found))


class Folded:
    """Which windows go to the indexes: of folds that repeat only the smallest id's."""

    def __init__(self, least: int, fold: int, repeated, owned):
        self.least, self.fold, self.repeated, self.owned = least, fold, repeated, owned

    def open(self) -> Folded:
        return Folded(self.least, self.fold, *(np.frombuffer(b.value, np.uint8) for b in (self.repeated, self.owned)))

    def parts(self, texts: Iterable[bytes], ids: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Per part: its bytes, and of its stretches number and place in the text, first byte, end, anchor and its fingerprint."""
        for numbers, begin, base, part, prints in blocks(texts, self.least):
            first, last = folds(part, prints, self.least, self.fold, begin)
            k1, _ = keys(part, first, last + self.least - 1)
            mine = ~holds(self.repeated, k1) | holds(self.owned, owner_print(k1, ids[numbers[text_at(begin, first)]]))
            if mine.any():
                # between texts no window is wanted
                reaches = np.column_stack([last - first, np.append(first[1:], last[-1]) - last]).ravel()
                wanted = np.repeat(np.column_stack([mine, np.zeros(len(mine), bool)]).ravel(), reaches)
                start, end, anchor = anchored(part, prints, wanted, self.least)
                own = text_at(begin, start)
                yield part, numbers[own], start - begin[own] + base, start, end, anchor, mixed(prints[anchor], np.uint64(SPREAD))


def owner_print(k1: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mixed(k1, ids.view(np.uint64))


def read(batch: pa.RecordBatch) -> tuple:
    """Texts one by one, and the numbers beside them: their ids, and hashes where they are needed."""
    return (text.as_py() for text in batch.column(0)), *(c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])


def marked(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether the fingerprints are in a bitmap over their upper bits, of any size."""
    at = prints >> np.uint64(65 - (8 * len(bits)).bit_length())
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of ``data`` between the bounds, each stretch of it as one value."""
    ends = pa.py_buffer(np.ascontiguousarray(bounds * data.itemsize, np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, ends, pa.py_buffer(np.ascontiguousarray(data))])


def _fold_places(least: int, fold: int):
    """Where all folds are: (i, x, s, e, k1, k2)."""
    def send(held: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([np.concatenate(c) for c in zip(*held)], names=FOLD_NAMES)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            texts, ids, hashes = read(batch)
            for numbers, begin, base, part, prints in blocks(texts, least):
                first, last = folds(part, prints, least, fold, begin)
                k1, k2 = keys(part, first, last + least - 1)
                own = text_at(begin, first)
                shift = base - begin[own]
                held.append((ids[numbers[own]], hashes[numbers[own]], first + shift, last + shift + least - 1, k1.view(np.int64), k2.view(np.int64)))
                size += len(first)
                if size >= PLACES:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)
    return find


def _holding(bits):
    """The rows whose ``k1`` is in a bitmap, and chance hits."""
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(holds(allowed, batch.column("k1").to_numpy(zero_copy_only=False).view(np.uint64))))
    return find


def _owner_prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of (k1, first)."""
    for batch in batches:
        k1, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "first"))
        yield pa.record_batch([owner_print(k1.view(np.uint64), ids).view(np.int64)], names=["fp"])


def _anchor_prints(folded: Folded, split: int):
    """By bucket, the 32 bits after its number of a block's anchors in order, twice for those that several of its texts have."""
    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = np.sort(np.concatenate(held))
        found = found[np.concatenate([[True, True], found[2:] != found[:-2]])[:len(found)]]
        bounds = np.searchsorted(found >> np.uint64(64 - split), np.arange((1 << split) + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(bounds))
        low = (found >> np.uint64(32 - split)).astype(np.uint32)
        yield pa.record_batch([some.astype(np.int32), binaries(low, bounds[np.append(some, 1 << split)])], names=["bucket", "prints"])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size = folded.open(), [], 0
        for batch in batches:
            texts, ids = read(batch)
            for part, numbers, *_, prints in own.parts(texts, ids):
                order = np.lexsort((prints, numbers))
                prints, numbers = prints[order], numbers[order]
                held.append(prints[np.concatenate([[True], (prints[1:] != prints[:-1]) | (numbers[1:] != numbers[:-1])])[:len(prints)]])
                size += len(part)
                if size >= BLOCK:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)
    return find


def _by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each bucket, which come one bucket after the other."""
    bucket, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket and rows:
                yield bucket, rows
                rows = []
            bucket = row["bucket"]
            rows.append(row)
    if rows:
        yield bucket, rows


def _shared_anchors(split: int, size: int):
    """A bucket's piece of a bitmap of ``2 ** size`` places, of the anchors that several texts have."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            found = np.sort(np.concatenate([np.frombuffer(r["prints"], np.uint32) for r in rows]))
            places = np.zeros(1 << (size - split), bool)
            places[found[1:][found[1:] == found[:-1]] >> np.uint32(32 + split - size)] = True
            if places.any():
                bits = np.packbits(places, bitorder="little").tobytes()
                yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([bits])], names=["bucket", "bits"])
    return run


def _places(folded: Folded, bits, split: int):
    """Where stretches with a shared anchor are (i, x, at, k1, k2), and by bucket each distinct stretch of a block: where its
    anchor is in it, its size, the smallest id that has it there, how much larger the largest is, and its bytes."""
    def send(held: list[tuple], bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, hashes, at, off, fp = (np.concatenate(c) for c in zip(*held))
        k1, k2 = digests(bodies)
        kinds = [pa.int32(), *[pa.binary()] * 5]
        yield pa.record_batch([ids, hashes, at, k1, k2, *[pa.nulls(len(ids), kind) for kind in kinds]], names=PLACE_NAMES)
        bucket = (fp >> np.uint64(64 - split)).astype(np.int64)
        order = np.lexsort((k2, k1, bucket))
        k1, k2, bucket, ids = k1[order], k2[order], bucket[order], ids[order]
        new = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
        least_id, largest = np.minimum.reduceat(ids, new), np.maximum.reduceat(ids, new)
        one, bucket = order[new], bucket[new]
        texts = [bodies[k] for k in one.tolist()]
        sizes = np.array([len(t) for t in texts], np.int32)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        new = np.flatnonzero(np.diff(bucket, prepend=-1))
        bounds = np.append(new, len(bucket))
        packed = [binaries(c, bounds) for c in (off[one].astype(np.int32), sizes, least_id, largest.view(np.uint64) - least_id.view(np.uint64))]
        yield pa.record_batch([*[pa.nulls(len(new), pa.int64())] * 5, pa.array(bucket[new], pa.int32()), *packed,
                               binaries(np.frombuffer(b"".join(texts), np.uint8), ends[bounds])], names=PLACE_NAMES)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed, own = np.frombuffer(bits.value, np.uint8), folded.open()
        held, bodies = [], []
        for batch in batches:
            texts, ids, hashes = read(batch)
            for part, numbers, at, start, end, anchor, prints in own.parts(texts, ids):
                hit = marked(allowed, prints)
                if not hit.any():
                    continue
                numbers, start, data = numbers[hit], start[hit], part.tobytes()
                held.append((ids[numbers], hashes[numbers], at[hit], anchor[hit] - start, prints[hit]))
                bodies += [data[s:e] for s, e in zip(start.tolist(), end[hit].tolist())]
                if len(bodies) >= PLACES:
                    yield from send(held, bodies)
                    held, bodies = [], []
        if held:
            yield from send(held, bodies)
    return find


def _unpacked(rows: list[dict]) -> dict[bytes, dict[bytes, list]]:
    """The distinct stretches of a bucket by the bytes of their anchor: {stretch: [place of the anchor, smallest id, largest id]}."""
    by_anchor: dict[bytes, dict[bytes, list]] = {}
    for r in rows:
        sizes, first = np.frombuffer(r["size"], np.int32), np.frombuffer(r["first"], np.int64)
        last = (first.view(np.uint64) + np.frombuffer(r["more"], np.uint64)).view(np.int64)
        ends, data = np.cumsum(sizes).tolist(), r["bytes"]
        for s, e, a, lo, hi in zip([0, *ends], ends, np.frombuffer(r["off"], np.int32).tolist(), first.tolist(), last.tolist()):
            body = data[s:e]
            own = by_anchor.setdefault(body[a:a + SEED], {})
            if (row := own.get(body)) is None:
                own[body] = [a, lo, hi]
            else:
                row[1], row[2] = min(row[1], lo), max(row[2], hi)
    return by_anchor


def _narrowed(own: dict[bytes, list], least: int, crowded: int) -> Iterator[list[tuple]]:
    """Stretches round an anchor, or parts of them, that may share windows: lists of (bytes, smallest id, largest id, stretch, its
    byte where they begin). At most ``crowded`` are in a list, unless they are one and the same window.

    An anchor in more stretches is looked at by where it stands in a window. Windows where it stands in one half of these
    places also share the bytes that all of them have beside it; groups are told by these, and halved again.
    """
    stack = [(0, least - min(SEED, least) + 1, [(body, *row) for body, row in own.items()])]
    while stack:
        low, high, rows = stack.pop()                        # the anchor is ``low`` to before ``high`` bytes behind a window's start
        if len(rows) <= crowded or high - low == 1:
            group = []
            for body, a, first, last in rows:
                start, stop = max(0, a - high + 1), min(len(body), a - low + least)
                group.append((body[start:stop], first, last, body, start))
            yield group
            continue
        middle = (low + high) // 2
        for lo, hi in ((low, middle), (middle, high)):
            parts: dict[bytes, list] = {}
            for row in rows:
                body, a = row[:2]
                if max(lo, a + least - len(body)) <= min(hi - 1, a):           # it has such a window
                    parts.setdefault(body[a - lo:a - hi + 1 + least], []).append(row)
            stack += [(lo, hi, part) for part in parts.values() if min(r[2] for r in part) < max(r[3] for r in part)]


def _indexed(least: int, crowded: int):
    """Ranges of windows of every stretch with the smallest id that has them, whole anchors in an index."""
    def ranged(rows: list[tuple]) -> Iterator[tuple[bytes, int, int, int]]:
        texts, owners = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)
        text, place, owner = RunIndex(texts, owners, least).stream()
        keep = owner < np.array([r[2] for r in rows], np.int64)[text]
        text, place, owner = text[keep], place[keep], owner[keep]
        order = np.lexsort((place, text))
        text, place, owner = text[order], place[order], owner[order]
        if len(text):
            new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)]))
            end = place[np.append(new[1:], len(text)) - 1] + least
            for t, s, e, o in zip(text[new].tolist(), place[new].tolist(), end.tolist(), owner[new].tolist()):
                yield rows[t][3], s + rows[t][4], e + rows[t][4], o

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bytes, int, int, int]]:
        rows, size = [], 0
        for _, packed in _by_bucket(batches):
            for own in _unpacked(packed).values():
                if len(own) == 1:                             # no index is needed
                    (body, (_, owner, last)), = own.items()
                    if owner < last:
                        yield body, 0, len(body), owner
                    continue
                if min(r[1] for r in own.values()) == max(r[2] for r in own.values()):
                    continue                                  # nobody else asks
                for group in _narrowed(own, least, crowded):
                    owner = min(r[1] for r in group)
                    if len(group) == 1 or len(group) > crowded:
                        # one stretch, or one window in all of them: no index is needed to find it
                        yield from ((body, at, at + len(part), owner) for part, _, last, body, at in group if owner < last)
                        continue
                    rows += group
                    size += sum(len(r[0]) for r in group)
                    if size >= INDEX:
                        yield from ranged(rows)
                        rows, size = [], 0
        if rows:
            yield from ranged(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = found(batches)
        while some := list(islice(ranges, PLACES)):
            yield pa.record_batch([*digests(r[0] for r in some), *(np.array([r[k] for r in some], np.int64) for k in (1, 2, 3))],
                                  names=["k1", "k2", "s", "e", "first"])
    return run


@F.pandas_udf(SPANS)
def merged(spans):
    """Overlapping and touching spans as one, in order."""
    def merge(own):
        own = sorted((r["s"], r["e"]) for r in own)
        out = [list(own[0])]
        for s, e in own[1:]:
            if s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return [{"s": s, "e": e} for s, e in out]
    return spans.map(merge)


@F.pandas_udf(T.BinaryType())
def cut(text, spans):
    """The bytes outside the spans; NULL where the text is."""
    import pandas as pd

    def keep(t, own):
        ends = [0, *[r["e"] for r in own]]
        return b"".join(bytes(t[a:b]) for a, b in zip(ends, [*[r["s"] for r in own], len(t)]))
    return pd.Series([None if t is None else keep(t, own) for t, own in zip(text, spans)], index=text.index, dtype=object)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Inside, what a query shuffles goes when it ends: all that is read again is written to tables."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def repeated_ranges(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50,
                    fold: int = FOLD) -> DataFrame:
    """``i``, ``x`` (id and hash of a text) and ``spans`` of its bytes that windows of documents with smaller ids cover."""
    if least < PACK:
        raise ValueError(f"repeats of fewer than {PACK} bytes are not supported")
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = df.select(data.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NOBODY)).alias("i"), F.xxhash64(data).alias("x"))
    texts = texts.where(F.length("text") >= least)

    # equal folds: all but the smallest id's go at once, and only that one's windows go on
    all_folds = saved(texts.mapInArrow(_fold_places(least, fold), FOLD_PLACE), "folds")
    again = bitmap(all_folds.groupBy("k1").agg(F.min("i").alias("a"), F.max("i").alias("z")).where("a < z").select(F.col("k1").alias("fp")))
    fold_places = saved(all_folds.mapInArrow(_holding(again), FOLD_PLACE), "repeated-folds")
    owners = saved(fold_places.groupBy("k1", "k2").agg(F.min("i").alias("first")), "fold-owners")
    folded = Folded(least, fold, again, bitmap(owners.select("k1", "first").mapInArrow(_owner_prints, "fp long")))
    copied = (fold_places.join(owners, ["k1", "k2"]).where(F.col("first") < F.col("i")).select("i", "x", "s", "e"))

    # about one anchor in 14 bytes; few of them are shared
    total = all_folds.agg(F.sum(F.col("e") - F.col("s"))).first()[0] or 0
    split = max(BUCKETS, (total >> 26).bit_length())
    size = max(split + 3, min(max((total // 25).bit_length(), MARKS[0]), MARKS[1]))
    sent = texts.select("text", "i").mapInArrow(_anchor_prints(folded, split), "bucket int, prints binary")
    pieces = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared_anchors(split, size), "bucket int, bits binary").toArrow()
    marks = np.zeros((1 << split, 1 << (size - split - 3)), np.uint8)
    for bucket, bits in zip(*(pieces[c].to_pylist() for c in ("bucket", "bits"))):
        marks[bucket] = np.frombuffer(bits, np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(marks.tobytes())
    stored = saved(texts.mapInArrow(_places(folded, shared, split), PLACE), "stretches", compression="zstd")

    # the smallest id owns a stretch; where it is the largest as well, nobody else asks
    packed = stored.where("bucket IS NOT NULL").select(*PLACE_NAMES[5:]).repartition("bucket").sortWithinPartitions("bucket")
    ranges = saved(packed.mapInArrow(_indexed(least, CROWDED), "k1 long, k2 long, s long, e long, first long"), "repeated-ranges")
    places = stored.where("bucket IS NULL").select(*PLACE_NAMES[:5])
    places = places.mapInArrow(_holding(bitmap(ranges.select(F.col("k1").alias("fp")))), ", ".join(PLACE.split(", ")[:5]))

    # both sides are written tables, so a stretch of very many documents is split over tasks
    hits = places.join(ranges, ["k1", "k2"]).where(F.col("first") < F.col("i"))
    found = hits.select("i", "x", (F.col("at") + F.col("s")).alias("s"), (F.col("at") + F.col("e")).alias("e")).unionByName(copied)
    spans = found.groupBy("i", "x").agg(F.collect_list(F.struct("s", "e")).alias("all"))
    return spans.select("i", "x", merged("all").alias("spans"))


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, fold: int = FOLD) -> DataFrame:
    """Every row of ``df`` with ``n_bytes``, ``n_removed``, ``spans`` and ``kept_bytes`` (the text without them, as bytes).

    Texts are UTF-8 bytes. A byte goes when a string of ``least`` bytes over it also starts in a document with a smaller
    id, judged on the texts as they came in; ``spans`` are the maximal runs of such bytes, from ``s`` to before ``e``.
    Repeats inside one document stay. NULL and empty texts, and texts shorter than ``least``, lose nothing. Rows that
    share an id never take from each other; a NULL id is below all others. Equal rows lose the same bytes. Long texts
    are read whole; a table without rows gives none. Input columns named like an added one are replaced.
    """
    df = without(df, *ADDED)
    with swept(df.sparkSession):
        found = saved(repeated_ranges(df, id_col, text_col, least, fold), "repeats")
    data: Column = F.coalesce(F.col(f"d.{text_col}"), F.lit("")).cast("binary")
    joined = df.alias("d").join(found.alias("f"), (F.coalesce(F.col(f"d.{id_col}").cast("long"), F.lit(NOBODY)) == F.col("f.i"))
                                & (F.xxhash64(data) == F.col("f.x")), "left")
    spans = F.coalesce(F.col("f.spans"), F.array().cast(SPANS))
    kept = F.coalesce(cut(F.when(F.col("f.i").isNotNull(), data), F.col("f.spans")), data)
    removed = F.aggregate(spans, F.lit(0).cast("long"), lambda n, r: n + r["e"] - r["s"])
    return joined.select("d.*", F.length(data).cast("long").alias("n_bytes"), removed.alias("n_removed"), spans.alias("spans"),
                         kept.alias("kept_bytes"))

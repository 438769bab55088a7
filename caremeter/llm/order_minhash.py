"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text is its lower-cased words; every run of ``k`` words is a k-mer, labelled with how often it occurred before. One
sketch takes the ``ELL`` labelled k-mers of smallest hash and keeps them in the order of the text, so texts share a
sketch if they share k-mers in the same order, which follows edit similarity and not just common content. A text has
``SKETCHES`` sketches of ``NEAR`` words, and texts of up to ``SHORT`` words as many of two words, as few edits leave no
longer run whole there; each is a key.

Texts that share a key are candidates, and linked if the word-level edit distance is at most a fifth of the longer
text. First each is aligned with the key's centre, the text that shares keys with most others. Where a key's texts are
not connected then, those of a small key are compared with each other, and those of all larger keys meet by their rarest
words: similar texts share one of them, so the passage that all texts of a key hold does not pair them. Lengths and
words rule pairs out exactly. Classes are the connected components.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from caremeter.llm.common import fresh, saved

K, NEAR, ELL, SKETCHES = 5, 3, 2, 64
SHORT = 50               # words
SIMILARITY = 0.8
BUCKETS = 20             # words are counted in 2 ** 20 buckets; the counts order the words and never decide
BITS = 4096              # parities that the words of a text are summed to at most, to rule out pairs
SMALL = 32               # texts of a key that are all compared with each other
CHUNK = 2000             # texts with a word that one task pairs with as many others
EARLIER = 256            # words by which a pair that was met before is known
PAIRS = 20_000           # pairs held at a time
WORDS = 400_000          # entries of a worker's memo of word hashes
FEW = 32                 # edits up to which diagonals are faster than columns of bits
CELLS = 2_000_000        # hashes held at a time
MULTIPLIER, LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(2**64 - 1)


def _spread(x: np.ndarray) -> np.ndarray:
    """Mixes the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


SEEDS = _spread(np.arange(1, SKETCHES + 1, dtype=np.uint64) * MULTIPLIER) | np.uint64(1)


def words_of(text: str) -> list[str]:
    return text.lower().split()


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def labelled_kmers(hashes: np.ndarray, size: int = K) -> np.ndarray:
    """Hashes of the k-mers, those that repeat labelled by occurrence; a text under ``size`` words is one k-mer."""
    k = min(size, len(hashes))
    n = len(hashes) - k + 1
    mers = np.full(n, len(hashes) if k < size else 0, np.uint64)
    for j in range(k):
        mers = mers * MULTIPLIER + hashes[j:j + n]
    mers = _spread(mers)
    order = np.argsort(mers, kind="stable")
    same = np.flatnonzero(mers[order][1:] == mers[order][:-1]) + 1
    if len(same):
        nth, last, run = np.zeros(n, np.uint64), -1, 0
        for at in same:
            run = run + 1 if at == last + 1 else 1
            nth[order[at]], last = run, at
        mers = np.where(nth > 0, _spread(mers + nth * MULTIPLIER), mers)
    return mers


def sketches(hashes: np.ndarray) -> np.ndarray:
    """``SKETCHES`` keys of ``ELL`` ordered k-mers of ``NEAR`` words, for short texts as many of two words; none without words."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    keys = [_keys(labelled_kmers(hashes, NEAR))]
    if len(hashes) <= SHORT:
        keys.append(_spread(_keys(labelled_kmers(hashes, 2)) + MULTIPLIER))
    return np.concatenate(keys).view(np.int64)


def _keys(mers: np.ndarray) -> np.ndarray:
    n = len(mers)
    keys = np.zeros(SKETCHES, np.uint64)
    step = max(1, CELLS // n)
    for a in range(0, SKETCHES, step):
        seeds = SEEDS[a:a + step]
        ranks = mers[None, :] * seeds[:, None]       # the k-mers are well mixed: an odd factor orders them anew
        every = np.arange(len(seeds))
        least = np.empty((len(seeds), min(ELL, n)), np.int64)
        for j in range(least.shape[1]):
            least[:, j] = ranks.argmin(axis=1)
            ranks[every, least[:, j]] = LAST
        least.sort(axis=1)
        own = seeds.copy()
        for j in range(least.shape[1]):
            own = _spread(own * MULTIPLIER + mers[least[:, j]])
        keys[a:a + step] = own
    return keys


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo = _WordHashes()
    for batch in batches:
        keys = []
        for text in batch["t"]:
            words = words_of(text)
            keys.append(sketches(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))))
            if len(memo) > WORDS:
                memo.clear()
        yield pd.DataFrame({"i": batch["i"], "d": batch["d"], "keys": keys})


def edit_distance(a: list, b: list, limit: int) -> int | None:
    """Edits (replace, insert, delete) from ``a`` to ``b`` if at most ``limit``, else None.

    Furthest-reaching points on the diagonals of the band that ``limit`` leaves; exact within it. From ``FEW`` edits on, whose
    points grow with the square of the edits, the whole matrix as columns of bits.
    """
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if limit <= FEW or not a or not b or abs(len(a) - len(b)) > limit:
        return _reach(a, b, limit)
    few = _reach(a, b, FEW)
    return _columns(a, b, limit) if few is None else few


def _columns(a, b, limit):
    """Myers' bit vectors: where the distance rises or falls down a column of the matrix, one integer each."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, edits, left = every, 0, len(a), len(b)
    for w in b:
        same = where.get(w, 0)
        across = ((same & up) + up ^ up) | same
        more, less = down | every & ~(across | up), up & across
        edits += bool(more & last) - bool(less & last)
        left -= 1
        if edits - left > limit:
            return None
        more, less = more << 1 | 1, less << 1
        up, down = every & (less | ~(same | down | more)), every & more & (same | down)
    return edits


def _reach(a, b, limit):
    n, m = len(a), len(b)
    goal = m - n
    if abs(goal) > limit:
        return None
    far: dict[int, int] = {}
    for edits in range(limit + 1):
        now = {}
        spare = limit - edits
        for k in range(max(-edits, -n, goal - spare), min(edits, m, goal + spare) + 1):
            i = 0 if edits == 0 else max(far.get(k, -2) + 1, far.get(k - 1, -2), far.get(k + 1, -2) + 1)
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            while i < n and i + k < m and a[i] == b[i + k]:
                i += 1
            now[k] = i
            if k == goal and i == n:
                return edits
        far = now
    return None


def similar(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """Whether the word edit distance is at most ``1 - similarity`` of the longer text."""
    x, y = words_of(a), words_of(b)
    longer = max(len(x), len(y))
    limit = int((1 - similarity) * longer + 1e-9)
    if abs(len(x) - len(y)) > limit:
        return False
    if longer - sum((Counter(x) & Counter(y)).values()) > limit:      # words without a partner are edits in any case
        return False
    number: dict[str, int] = {}
    p, q = ([number.setdefault(w, len(number)) for w in words] for words in (x, y))
    return edit_distance(p, q, limit) is not None


def _verify(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [similar(a, b, similarity) for a, b in zip(batch["ta"], batch["tb"])]
            yield batch.loc[keep, ["a", "b"]]
    return run


def linked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    left = pairs.join(texts.select(F.col("d").alias("a"), F.col("t").alias("ta")), "a")
    both = left.join(texts.select(F.col("d").alias("b"), F.col("t").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInPandas(_verify(similarity), "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for each node of an edge (a, b), the smallest node it is connected to.

    Labels move to neighbours, then jump to the label of their label; every round is a written table, and the number
    of rounds follows the logarithm of the longest path.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("near"))
        moved = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("next"))
        of_label = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        labels = saved(moved.join(of_label, "next").select("node", "old", F.least("next", "jump").alias("label")), "labels")
        if labels.where("label != old").isEmpty():
            return labels.select("node", "label")


def allowed(words, similarity: float):
    """Word edits that texts may be apart if the longer one has ``words`` words."""
    return ((1 - similarity) * np.asarray(words) + 1e-9).astype(np.int64)


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """The batches with the hashed words of their texts, those that repeat labelled by occurrence."""
    memo = _WordHashes()
    for batch in batches:
        found = []
        for text in batch["t"]:
            words = words_of(text)
            found.append(labelled_kmers(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)), 1))
            if len(memo) > WORDS:
                memo.clear()
        yield batch, found


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BUCKETS)).astype(np.int64)


def _bucket_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(1 << BUCKETS, np.int64)
    for _, found in _tokens(batches):
        if found:
            counts += np.bincount(_bucket(np.concatenate(found)), minlength=1 << BUCKETS)
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"bucket": at, "c": counts[at]})


def levels(texts: DataFrame):
    """Broadcast of how frequent the words of a bucket are, on a logarithmic scale; one byte a bucket at every size of input."""
    counts = texts.select("t").mapInPandas(_bucket_counts, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c"))
    level = F.least(F.floor(F.log2("c") * 4), F.lit(127)).alias("level")
    words = (counts.select(F.shiftright("bucket", 3).alias("word"), (F.col("bucket") % 8 * 8).cast("int").alias("bit"), level)
             .groupBy("word").agg(F.expr("bit_or(shiftleft(level, bit))").alias("bytes")).toArrow())
    out = np.zeros(1 << (BUCKETS - 3), np.int64)             # at most this many rows came to the driver
    out[words["word"].to_numpy()] = words["bytes"].to_numpy()
    return texts.sparkSession.sparkContext.broadcast(out.astype("<i8").tobytes())


def parities(tokens: np.ndarray) -> bytes:
    """Whether an odd number of words falls on each bit; an edit changes two bits at most. More words have more bits."""
    bits = min(BITS, max(64, 1 << (4 * len(tokens) - 1).bit_length()))
    return np.packbits(np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1 == 1).tobytes()


def _rarest(tokens: np.ndarray, level: np.ndarray, similarity: float) -> np.ndarray:
    """As many of the rarest words as a similar text must share one of, without those that no other text has."""
    of = level[_bucket(tokens)]
    order = np.lexsort((tokens, of))[:int(allowed(len(tokens), similarity)) + 1]
    return tokens[order[of[order] > 0]].view(np.int64)


PROFILE = "d binary, l1 long, l2 long, words long, bits binary, tokens array<long>"


def _profile(similarity: float, order):
    """Per text its component (both halves of the digest), length, parities and first words by rarity.

    A similar text shares all words but the allowed edits, so one more than these of the rarest are enough to meet it.
    Only texts of a large key have to, and words that stand alone in their bucket meet nothing, so they are not sent.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level = np.frombuffer(order.value, np.uint8)
        for batch, found in _tokens(batches):
            halves = np.frombuffer(b"".join(batch["label"]), np.int64).reshape(-1, 2)
            first = [_rarest(t, level, similarity) if large else np.zeros(0, np.int64) for t, large in zip(found, batch["large"])]
            yield pd.DataFrame({"d": batch["d"], "l1": halves[:, 0], "l2": halves[:, 1], "words": [len(t) for t in found],
                                "bits": [parities(t) for t in found], "tokens": first})
    return run


def _whole_groups(batches: Iterator[pd.DataFrame], *keys: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows again, cut between groups, with the number of each row's group."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        group = _numbered(batch, keys)
        at = int(np.searchsorted(group, group[-1])) if len(group) else 0
        if at:
            yield batch.iloc[:at], group[:at]
        rest = batch.iloc[at:]
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True), _numbered(rest, keys)


def _numbered(rows: pd.DataFrame, keys: tuple[str, ...]) -> np.ndarray:
    new = np.zeros(len(rows), bool)
    for c in keys:
        x = rows[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def _met(similarity: float):
    """The rows (token, words, l1, l2), sorted, that another component's text of a fitting length shares the word with."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, group in _whole_groups(batches, "token"):
            n, words = len(rows), rows["words"].to_numpy()
            end = np.searchsorted(group, group, "right")
            # the next row of another component, and whether it fits; then the same for the one before
            run_of = _numbered(rows.assign(g=group), ("g", "l1", "l2"))
            after = np.searchsorted(run_of, run_of, "right")
            before = np.searchsorted(run_of, run_of) - 1
            begin = np.searchsorted(group, group)
            keep = np.zeros(n, bool)
            for other, inside in ((after, after < end), (before, before >= begin)):
                i, j = np.flatnonzero(inside), other[inside]
                longer = np.maximum(words[i], words[j])
                keep[i] |= np.abs(words[i] - words[j]) <= allowed(longer, similarity)
            yield rows.loc[keep, ["d", "at", "token"]].assign(n=np.bincount(group)[group][keep])
    return run


def _folded(rows: pd.DataFrame, size: np.ndarray, least: int) -> np.ndarray:
    """The parities on ``least`` bytes; rows that have fewer are left out."""
    out = np.zeros((len(rows), least), np.uint8)
    for s in np.unique(size[size >= least]):
        at = np.flatnonzero(size == s)
        m = np.frombuffer(b"".join(rows["bits"].iloc[at]), np.uint8).reshape(len(at), s)
        while m.shape[1] > least:
            half = m.shape[1] // 2
            m = m[:, :half] ^ m[:, half:]
        out[at] = m
    return out.view(np.uint64)


def _fitting(group: np.ndarray, words: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs of a group whose lengths allow the similarity; a group is sorted by length."""
    end = np.searchsorted(group, group, "right")
    i, step, held, size = np.arange(len(group)), 0, [], 0
    while len(i):
        step += 1
        i = i[i + step < end[i]]
        i = i[words[i + step] - words[i] <= allowed(words[i + step], similarity)]    # longer ones do not fit either
        held.append((i, i + step))
        size += len(i)
        if size >= PAIRS or not len(i):
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, size = [], 0


def _compared(similarity: float):
    """Pairs (a, b) of different components that share a token (a word or a key), unless their parities rule them out; ``apart`` counts these.

    A pair comes with the first word that both share, as far as both carry the words before.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, group in _whole_groups(batches, "token", "lo", "hi"):
            words, l1, l2, d = (rows[c].to_numpy() for c in ("words", "l1", "l2", "d"))
            within, side = (rows["lo"] == rows["hi"]).to_numpy(), rows["side"].to_numpy()
            size, earlier, bits, known = rows["bits"].map(len).to_numpy(), rows["earlier"].to_numpy(), {}, {}
            for i, j in _fitting(group, words, similarity):
                other = ((l1[i] != l1[j]) | (l2[i] != l2[j])) & (within[i] | (side[i] != side[j]))
                i, j = i[other], j[other]
                most = 2 * allowed(words[j], similarity) - (words[j] - words[i])
                apart = np.zeros(len(i), np.int64)
                for s in np.unique(size[i]):
                    if s not in bits:
                        bits[s] = _folded(rows, size, s)
                    of = np.flatnonzero(size[i] == s)
                    for at in range(0, len(of), PAIRS):
                        k = of[at:at + PAIRS]
                        apart[k] = np.bitwise_count(bits[s][i[k]] ^ bits[s][j[k]]).sum(axis=1, dtype=np.int64)
                near = apart <= most
                i, j, apart = i[near], j[near], apart[near]
                for k in set(i.tolist()) | set(j.tolist()):
                    if k not in known:
                        known[k] = frozenset(earlier[k].tolist())
                new = np.fromiter((known[x].isdisjoint(known[y]) for x, y in zip(i.tolist(), j.tolist())), bool, len(i))
                yield pd.DataFrame({"a": d[i[new]], "b": d[j[new]], "apart": apart[new]})
    return run


def unconnected(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}")), end, "left")
    return pairs.where(~F.coalesce(F.col("la"), F.col("a")).eqNullSafe(F.coalesce(F.col("lb"), F.col("b")))).drop("la", "lb")


def open_pairs(members: DataFrame, labels: DataFrame, texts: DataFrame, tried: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, apart) of texts that share a key, are in different components, may be similar and are not in ``tried``.

    Members are (key, d). The texts of a small key are all compared; those of large keys meet by their rarest words, and
    those of a frequent word in chunks by many tasks.
    """
    own = members.join(labels.select(F.col("node").alias("d"), "label"), "d", "left").select(
        "key", "d", F.coalesce("label", "d").alias("label"))
    split = saved(own.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
                  .where("lo != hi").select("key", (F.col("n") > SMALL).alias("large")), "split")
    left = saved(own.join(split, "key").select("key", "d", "label", "large"), "left")
    each = left.groupBy("d", "label").agg(F.max("large").alias("large"))
    held = saved(texts.join(each, "d").select("d", "label", "large", "t"), "held")
    profiles = saved(held.mapInPandas(_profile(similarity, levels(held.where("large"))), PROFILE), "profiles")
    cells = ["d", "l1", "l2", "words", "bits"]

    thin = profiles.select("d", "l1", "l2", "words", F.posexplode("tokens").alias("at", "token"))
    by_word = thin.repartition("token").sortWithinPartitions("token", "words", "l1", "l2")
    met = saved(by_word.select("d", "l1", "l2", "words", "at", "token").mapInPandas(
        _met(similarity), "d binary, at int, token long, n long"), "met")
    lists = met.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("at", "token", "n"))).alias("all"))
    rows = profiles.drop("tokens").join(lists, "d").withColumn("before", F.slice(F.col("all.token"), 1, EARLIER))
    rows = rows.select("*", F.posexplode("all").alias("place", "one")).select(
        *cells, F.col("one.token").alias("token"),
        F.slice("before", F.lit(1), F.least("place", F.lit(EARLIER))).alias("earlier"),
        F.ceil(F.col("one.n") / CHUNK).cast("long").alias("chunks"))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("d"), F.col("chunks"))).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")).select(
        "token", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", *cells, "earlier")
    zero = F.lit(0).cast("long")
    small = left.where("not large").join(profiles, "d").select(
        F.col("key").alias("token"), zero.alias("lo"), zero.alias("hi"), zero.alias("side"), *cells, F.array().cast("array<long>").alias("earlier"))
    blocks = rows.unionByName(small).repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "words", "d")
    found = saved(blocks.mapInPandas(_compared(similarity), "a binary, b binary, apart long"), "met-pairs")
    known = tried.select("a", "b").unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    once = found.groupBy("a", "b").agg(F.min("apart").alias("apart"))
    return saved(once.join(known, ["a", "b"], "left_anti"), "open")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``df``: id, ``class_id`` (smallest id of its class) and ``class_size``.

    Equal texts are one class from the start; NULL and empty texts are equal, and texts of blanks only stay apart from
    others. All texts that share a key are compared unless they are connected anyway or cannot be similar. Keys are random: two texts at word
    edit similarity 0.8 with scattered replacements share one with a probability above 0.999 (0.99 at five words), the
    more similar the surer. A NULL id takes part, but is only the class id if the class has no other. Other columns are
    not read.
    """
    placed = _placed(df, id_col, text_col, similarity)
    return placed.select(F.col("i").alias(id_col), "class_id", "class_size")


def _digest(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def _placed(df: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(i, d, class_id, class_size): id and digest of the text of each row, and its class."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("i"), _digest(text_col).alias("d"), text.alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    base = saved(rows.select(F.col("i").cast("string"), "d", "t").mapInPandas(_sketch, "i string, d binary, keys array<long>")
                 .withColumn("i", F.col("i").cast(kind)), "sketches")

    keyed = base.select("d", F.explode("keys").alias("key"))
    # written tables, so the joins have plain shuffles on both sides and a very large key is split
    several = saved(keyed.groupBy("key").agg(F.min("d").alias("b"), F.max("d").alias("z")).where("b < z").select("key"), "several")
    members = saved(saved(keyed.join(several, "key").select("key", "d"), "shared").distinct(), "members")

    # the centre of a key shares keys with most others; of a family of copies it is the original
    sizes = saved(members.groupBy("key").agg(F.count("*").alias("n")), "sizes")
    weights = saved(members.join(sizes, "key").groupBy("d").agg(F.sum("n").alias("w")), "weights")
    heaviest = members.join(weights, "d").groupBy("key").agg(F.max(F.struct("w", "d")).alias("m"))
    centres = saved(heaviest.select("key", F.col("m.d").alias("b")), "centres")
    pairs = saved(members.join(centres, "key").where("d != b").groupBy(F.col("d").alias("a"), "b").agg(F.count("*").alias("n")), "pairs")

    one_row = base.select("i", "d").join(weights.select("d"), "d").groupBy("d").agg(F.min("i").alias("i"))
    same = rows["d"].eqNullSafe(one_row["d"]) & rows["i"].eqNullSafe(one_row["i"])
    texts = saved(rows.join(one_row, same, "left_semi").select("d", "t").dropDuplicates(["d"]), "texts")

    # a text's most frequent partner first; other pairs only if they would still connect two components
    by_count = Window.partitionBy("a").orderBy(F.desc("n"), "b")
    ranked = pairs.withColumn("r", F.row_number().over(by_count))
    sure = saved(linked(ranked.where("r = 1").select("a", "b"), texts, similarity), "links")
    labels = components(sure)
    late = saved(linked(unconnected(ranked.where("r > 1").select("a", "b"), labels), texts, similarity), "links")
    if not late.isEmpty():
        sure = sure.unionByName(late)
        labels = components(sure)
    # then whatever pair is still in two components, a text's nearest first
    last = open_pairs(members, labels, texts, pairs, similarity)
    if not last.isEmpty():
        ends = last.unionByName(last.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
        nearest = ends.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("m")).select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b"))
        sure = sure.unionByName(saved(linked(nearest.distinct(), texts, similarity), "links"))
        labels = components(sure)
        rest = saved(linked(unconnected(last.select("a", "b"), labels), texts, similarity), "links")
        if not rest.isEmpty():
            labels = components(sure.unionByName(rest))

    placed = base.select("i", "d").join(labels.select(F.col("node").alias("d"), "label"), "d", "left").select(
        "i", "d", F.coalesce("label", "d").alias("c"))
    # a written table, so the join with it has plain shuffles on both sides and a very large class is split
    classes = saved(placed.groupBy("c").agg(F.min("i").alias("class_id"), F.count("*").alias("class_size")), "classes")
    return placed.join(classes, "c").select("i", "d", "class_id", "class_size")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` without those whose id is not the smallest of the class of their text.

    Rows with a NULL id stay, and so does a text whose id another, dropped text has too.
    """
    ident, digest = fresh(df, "gone"), fresh(df, "gone_text")
    gone = _placed(df, id_col, text_col, similarity).where(F.col("i") != F.col("class_id")).select(
        F.col("i").alias(ident), F.col("d").alias(digest)).distinct()
    return df.join(gone, (F.col(id_col) == F.col(ident)) & (_digest(text_col) == F.col(digest)), "left_anti")

"""Language identification: averaged embeddings of hashed subwords, a linear softmax, and a calibrated refusal.

A text is its runs of letters, lower-cased and fenced; each run gives its character n-grams, hashed to buckets. The
text's vector is the mean embedding of all its n-grams and a linear softmax over it gives the languages. Both layers
are trained by stochastic gradient descent in numpy. Confidence is scaled by a temperature fitted on documents held
back from training, and the refusal threshold is the confidence that nearly all right answers on them reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from caremeter.llm.common import fresh, without

GRAMS = (2, 3, 4)
BUCKETS = 1 << 16
DIM = 12
RUN = regex.compile(r"\p{L}+")
FNV_START, FNV_PRIME = 1469598103934665603, 1099511628211
FENCE = 0x20                # stands before and after every run
WORDS = 300_000             # entries of a worker's memo of words
SLICE_CHARS = 1_000_000     # text that a task scores at a time
NEW_WORDS = 20_000          # words whose n-grams are held at a time
NONE = "und"
RESULT = "lang_pred string, score double, rejected boolean"


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ``words``, and how many each word has (0 for one without a letter)."""
    runs = [RUN.findall(w.lower()) for w in words]
    flat = [r for own in runs for r in own]
    if not flat:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    text = f" {' '.join(flat)} "
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    fence = points == FENCE
    run_at = np.cumsum(fence) - 1          # a fence opens the run after it
    found, owners = [], []
    for n in GRAMS:
        end = len(points) - n + 1
        hashed, crossing = np.full(end, FNV_START + n, np.uint64), np.zeros(end, bool)
        for k in range(n):
            hashed = (hashed ^ points[k:k + end]) * np.uint64(FNV_PRIME)
            if 0 < k < n - 1:              # an n-gram may begin or end with a fence, but not span one
                crossing |= fence[k:k + end]
        hashed ^= hashed >> np.uint64(29)
        found.append((hashed[~crossing] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(run_at[:end][~crossing])
    buckets, owner = np.concatenate(found), np.concatenate(owners)
    word_of_run = np.repeat(np.arange(len(words)), [len(x) for x in runs])
    word = word_of_run[owner]
    order = np.argsort(word, kind="stable")
    return buckets[order], np.bincount(word, minlength=len(words))


@dataclass
class Model:
    langs: list[str]
    embeddings: np.ndarray      # BUCKETS x DIM
    weights: np.ndarray         # DIM x langs
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self) -> np.ndarray:
        """What one n-gram of each bucket adds to the languages, and a 1 that counts it."""
        return np.hstack([self.embeddings @ self.weights, np.ones((len(self.embeddings), 1), np.float32)]).astype(np.float32)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Scorer(dict):
    """Sums of a text's words; the dict is a memo from word to a row of ``sums``."""

    def __init__(self, model: Model):
        self.model, self.of_bucket = model, model.scores()
        self.sums = np.zeros((1024, self.of_bucket.shape[1]), np.float32)

    def learn(self, words: list[str]) -> None:
        buckets, counts = gram_buckets(words)
        begin = len(self)
        while begin + len(words) > len(self.sums):
            self.sums = np.vstack([self.sums, np.zeros_like(self.sums)])
        if len(buckets):
            has = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[has]
            self.sums[begin:begin + len(words)] = 0
            self.sums[begin + has] = np.add.reduceat(self.of_bucket[buckets], starts, axis=0)
        else:
            self.sums[begin:begin + len(words)] = 0
        self.update(zip(words, range(begin, begin + len(words))))

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean score of each text and its number of n-grams."""
        words = [t.split() for t in texts]
        if len(self) > WORDS:
            self.clear()
        new = {w for own in words for w in own if w not in self}
        fresh_words = sorted(new)
        for a in range(0, len(fresh_words), NEW_WORDS):
            self.learn(fresh_words[a:a + NEW_WORDS])
        sums = np.zeros((len(texts), self.sums.shape[1]))
        for i, own in enumerate(words):
            if own:
                rows = np.fromiter(map(self.__getitem__, own), np.int64, len(own))
                sums[i] = self.sums[rows].sum(axis=0, dtype=np.float64)
        grams = sums[:, -1]
        return sums[:, :-1] / np.maximum(grams, 1)[:, None], grams

    def predict(self, texts: list[str]) -> pd.DataFrame:
        logits, grams = self.logits(texts)
        chances = softmax(logits / self.model.temperature)
        best = chances.argmax(axis=1)
        known = grams > 0
        score = np.where(known, chances[np.arange(len(texts)), best], 0.0)
        return pd.DataFrame({"lang_pred": np.where(known, np.array(self.model.langs, object)[best], NONE), "score": score,
                             "rejected": ~known | (score < self.model.threshold)})


def _snippets(text: str, rng: np.random.Generator) -> list[str]:
    """The text and two short stretches of it, so that short texts are learned too."""
    words = text.split()
    out = [text]
    for n in (5, 25):
        if len(words) > n:
            at = rng.integers(0, len(words) - n + 1)
            out.append(" ".join(words[at:at + n]))
    return out


def train(texts: list[str], labels: list[str], seed: int = 11, epochs: int = 5, least_steps: int = 400, rate: float = 8.0,
          batch: int = 64) -> Model:
    """Stochastic gradient descent on mini-batches of snippets; a tenth of the texts calibrates and is not trained on.

    Small samples are gone through more often, until ``least_steps`` batches were seen.
    """
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    # embeddings start at zero, so n-grams never met say nothing, and a text of an unknown script is refused
    model = Model(langs, np.zeros((BUCKETS, DIM), np.float32), rng.normal(0, 1, (DIM, max(1, len(langs)))).astype(np.float32))
    if len(langs) < 2:
        model.langs = langs or [NONE]
        return model
    index = {lang: i for i, lang in enumerate(langs)}
    order = rng.permutation(len(texts))
    held = order[:max(1, len(texts) // 10)]
    trained = order[len(held):]
    bags, targets = [], []
    for d in trained:
        for snippet in _snippets(texts[d], rng):
            buckets, _ = gram_buckets([snippet])
            if len(buckets):
                bags.append(np.unique(buckets, return_counts=True))
                targets.append(index[labels[d]])
    targets = np.array(targets, np.int64)
    weight = len(targets) / (len(langs) * np.maximum(np.bincount(targets, minlength=len(langs)), 1))
    per_epoch = max(1, -(-len(bags) // batch))
    epochs = max(epochs, -(-least_steps // per_epoch))
    steps, step = epochs * per_epoch, 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(bags))
        for begin in range(0, len(bags), batch):
            part = shuffled[begin:begin + batch]
            now = rate * (1 - step / steps)
            _step(model, [bags[i] for i in part], targets[part], weight, now)
            step += 1
    _calibrate(model, [texts[d] for d in held], np.array([index[labels[d]] for d in held]), rng)
    return model


def _step(model: Model, bags, targets, weight, rate) -> None:
    buckets = np.concatenate([b for b, _ in bags])
    share = np.concatenate([c / c.sum() for _, c in bags]).astype(np.float32)
    sizes = np.array([len(b) for b, _ in bags])
    starts = np.cumsum(sizes) - sizes
    means = np.add.reduceat(model.embeddings[buckets] * share[:, None], starts, axis=0)
    error = softmax(means @ model.weights)
    error[np.arange(len(targets)), targets] -= 1
    error *= (weight[targets] / len(targets))[:, None]
    back = error @ model.weights.T
    model.weights -= (rate * means.T @ error).astype(np.float32)
    met, at = np.unique(buckets, return_inverse=True)
    pull = np.repeat(back, sizes, axis=0) * share[:, None]
    for d in range(pull.shape[1]):
        model.embeddings[met, d] -= (rate * np.bincount(at, pull[:, d], len(met))).astype(np.float32)


def _calibrate(model: Model, texts, targets, rng, quantile: float = 0.0005, most: float = 0.4) -> None:
    """Temperature of least log loss on held-back snippets; a threshold that all but ``quantile`` of right answers reach."""
    scorer = Scorer(model)
    snippets = [(s, y) for t, y in zip(texts, targets) for s in _snippets(t, rng)]
    logits, grams = scorer.logits([s for s, _ in snippets])
    goal = np.array([y for _, y in snippets])
    ok = grams > 0
    logits, goal = logits[ok], goal[ok]
    if not len(goal):
        return

    def loss(t):
        return -np.log(np.maximum(softmax(logits / t)[np.arange(len(goal)), goal], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.1, 10, 81), key=loss))
    whole, grams = scorer.logits(list(texts))
    chances = softmax(whole / model.temperature)
    right = chances.max(axis=1)[(chances.argmax(axis=1) == targets) & (grams > 0)]
    if len(right):
        model.threshold = float(min(most, np.quantile(right, quantile)))


def learning_sample(df: DataFrame, text: Column, lang: Column, key: Column, per_lang: int, max_chars: int,
                    most_langs: int) -> pd.DataFrame:
    """About ``per_lang`` labelled rows of each language, and of each at most ``max_chars`` characters around a hashed place.

    Rows are chosen by a hash of their key, at a rate that one count per language sets, so the sample has the same size
    and is the same rows whatever the partitioning.
    """
    labelled = df.select(text.alias("t"), lang.alias("y"), key.alias("k")).where("y IS NOT NULL AND t IS NOT NULL AND k IS NOT NULL")
    langs = labelled.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(most_langs)
    rate = langs.select("y", F.least(F.lit(1.0), per_lang / F.col("n")).alias("rate"))
    place = (F.xxhash64("k", F.lit("rate")) % 1_000_000 + 1_000_000) % 1_000_000 / 1_000_000
    chosen = labelled.join(F.broadcast(rate), "y").where(place < F.col("rate"))
    spare = F.greatest(F.length("t") - max_chars, F.lit(0))
    start = F.pmod(F.xxhash64("k", F.lit("start")), spare + 1) + 1
    return chosen.select("y", "k", F.col("t").substr(start.cast("int"), F.lit(max_chars)).alias("t")).orderBy("k", "y", "t").toPandas()


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", where: Column | None = None,
        per_lang: int = 800, max_chars: int = 2_000, most_langs: int = 1_000) -> Model:
    """A model from a bounded sample.

    About ``per_lang`` rows of each of the ``most_langs`` most frequent languages, ``max_chars`` characters of each row.
    """
    rows = df if where is None else df.where(where)
    sample = learning_sample(rows, F.col(text_col), F.col(lang_col), F.col(id_col), per_lang, max_chars, most_langs)
    return train(list(sample["t"]), list(sample["y"]))


def languages(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function from a text column to a struct of ``lang_pred``, ``score`` and ``rejected``."""
    shared = spark.sparkContext.broadcast(model)    # buckets x dim numbers: does not grow with the data

    @pandas_udf(RESULT)
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts, out, begin, chars = [t or "" for t in batch], [], 0, 0
            for i, t in enumerate(texts):
                chars += len(t)
                if chars >= SLICE_CHARS or i == len(texts) - 1:
                    out.append(scorer.predict(texts[begin:i + 1]))
                    begin, chars = i + 1, 0
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["lang_pred", "score", "rejected"])
    return predicted


def detect(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row of ``df`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected``.

    Whole texts are read. NULL texts and texts without a letter are ``und`` with score 0 and rejected. Input columns
    named like an added one are replaced.
    """
    df = without(df, "lang_pred", "score", "rejected")
    found = fresh(df, "found")
    named = [f"`{c}`" for c in df.columns]
    return df.withColumn(found, languages(df.sparkSession, model)(F.col(text_col))).select(*named, f"{found}.*")

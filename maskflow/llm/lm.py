"""Text scoring by a log-bilinear model over word classes, trained in numpy with noise-contrastive estimation."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskflow.llm.common import fold, ship, words_of
from maskflow.session import materialise

ship(__name__)


@dataclass(frozen=True)
class Settings:
    held_out: int = 1  # fold that is not learned from
    own: int = 704  # classes: the end, and the most frequent words, one class for each
    endings: int = 64  # classes of all other words, by their last two bytes
    listed: int = 32768  # at most so many words, the most frequent, are sent to all tasks; the others are joined
    width: int = 24
    noise: int = 64  # noise words, shared by a batch
    batch: int = 2048
    rate: float = 0.1
    warm_docs: int = 1500  # bounded sample that the model starts from before it sees all training texts, at most so many
    warm_chars: int = 4000
    warm_passes: int = 4
    slices: int = 16  # parts of the model that are averaged by different tasks
    fan: int = 64  # models that one task averages at first, as a share of all of them

    @property
    def classes(self) -> int:
        return self.own + self.endings


@dataclass
class Vocabulary:
    place: dict[bytes, int]  # of the listed words
    count: np.ndarray  # of the listed words
    group: np.ndarray  # their classes
    mass: np.ndarray  # of each class of endings: counts + 0.5 each, and 0.5 for words never seen
    total: int
    distinct: int
    ends: int  # training documents

    @property
    def floor(self) -> float:
        return float(np.log10(self.total + 0.5 * (self.distinct + 1)))


def ending(word: bytes, settings: Settings) -> int:
    return settings.own + zlib.crc32(word[-2:]) % settings.endings


class Coder:
    """Texts as classes; class 0 is the end of a text, which also stands before it."""

    def __init__(self, words: Vocabulary, settings: Settings):
        self.words, self.settings, self.by_end = words, settings, {}

    def rare_class(self, word: bytes) -> int:
        tail = word[-2:]
        if tail not in self.by_end:
            self.by_end[tail] = ending(word, self.settings)
        return self.by_end[tail]

    def places(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        """The place of each word in the list of frequent ones or -1, and the words that have none."""
        words = words_of(text)
        look = self.words.place
        found = np.fromiter((look.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        return found, [words[k] for k in np.flatnonzero(found < 0).tolist()]

    def classes(self, places: np.ndarray, rare: list[bytes]) -> np.ndarray:
        """Two ends, the classes of the words, and an end."""
        found = np.zeros(len(places) + 3, dtype=np.int64)
        found[2:-1] = self.words.group[places]
        found[2:-1][places < 0] = [self.rare_class(w) for w in rare]
        return found


class Model:
    """Scores q[w] . (first[w-1] + second[w-2]) + bias[w] of classes, normalised over all classes."""

    def __init__(self, first: np.ndarray, second: np.ndarray, q: np.ndarray, bias: np.ndarray):
        self.parts = [first, second, q, bias]
        self.known: np.ndarray | None = None

    @classmethod
    def start(cls, shares: np.ndarray, width: int) -> Model:
        draw = np.random.default_rng(7)
        k = len(shares)
        tables = [draw.normal(0, 0.1, (k, width)).astype(np.float32) for _ in range(3)]
        return cls(*tables, np.log(shares).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts]).astype(np.float32)

    @classmethod
    def of(cls, values: np.ndarray, classes: int, width: int) -> Model:
        tables = values[: 3 * classes * width].astype(np.float32).reshape(3, classes, width)
        return cls(*[t.copy() for t in tables], values[3 * classes * width :].astype(np.float32).copy())

    def _norms(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Logarithms of the normaliser of each context; each is worked out once, many at a time by matrix products."""
        first, second, q, bias = self.parts
        k = len(bias)
        if self.known is None:
            self.known = np.full(k * k, np.nan, dtype=np.float32)
        keys = before * k + last
        missing = np.unique(keys[np.isnan(self.known[keys])])
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            scores = (first[part % k] + second[part // k]) @ q.T + bias
            top = scores.max(1, keepdims=True)
            self.known[part] = np.log(np.exp(scores - top).sum(1)) + top[:, 0]
        return self.known[keys]

    def log_probability(self, ids: np.ndarray) -> np.ndarray:
        """Natural logarithms for ids[2:], each after the two before it."""
        first, second, q, bias = self.parts
        before, last, word = ids[:-2], ids[1:-1], ids[2:]
        return np.einsum("ij,ij->i", first[last] + second[before], q[word]) + bias[word] - self._norms(before, last)


class Trainer:
    def __init__(self, model: Model, shares: np.ndarray, settings: Settings, seed: int):
        self.model, self.settings = model, settings
        self.log_noise = np.log(settings.noise * shares).astype(np.float32)
        self.sums = np.cumsum(shares)
        self.draw = np.random.default_rng(seed)
        self.squares = [np.full(p.shape, 1e-2, dtype=np.float32) for p in model.parts]

    @staticmethod
    def _gather(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(index, kind="stable")
        sorted_ = index[order]
        starts = np.append(0, np.flatnonzero(np.diff(sorted_)) + 1)
        return sorted_[starts], np.add.reduceat(values[order], starts, axis=0)

    def _move(self, part: int, index: np.ndarray, values: np.ndarray) -> None:
        rows, slope = self._gather(index, values)
        self.squares[part][rows] += slope * slope
        self.model.parts[part][rows] += self.settings.rate * slope / np.sqrt(self.squares[part][rows])

    def learn(self, ids: np.ndarray) -> None:
        """One pass over the contexts of a stretch of classes, in batches of mixed places."""
        places = self.draw.permutation(len(ids) - 2)
        for at in range(0, len(places), self.settings.batch):
            self._batch(ids, places[at : at + self.settings.batch])

    def _batch(self, ids: np.ndarray, at: np.ndarray) -> None:
        first, second, q, bias = self.model.parts
        before, last, word = ids[at], ids[at + 1], ids[at + 2]
        context = first[last] + second[before]
        noise = np.minimum(np.searchsorted(self.sums, self.draw.random(self.settings.noise)), len(bias) - 1)
        true = np.einsum("ij,ij->i", context, q[word]) + bias[word] - self.log_noise[word]
        false = context @ q[noise].T + bias[noise] - self.log_noise[noise]
        up = (1 / (1 + np.exp(np.clip(true, -30, 30)))).astype(np.float32)
        down = (1 / (1 + np.exp(-np.clip(false, -30, 30)))).astype(np.float32)
        size = np.float32(1 / len(at))
        slope = (up[:, None] * q[word] - down @ q[noise]) * size
        both = np.concatenate([word, noise])
        self._move(2, both, np.concatenate([up[:, None] * context, -down.T @ context]) * size)
        self._move(3, both, np.concatenate([up, -down.sum(0)]) * size)
        self._move(0, last, slope)
        self._move(1, before, slope)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of all words of `docs`, counted in each batch before they are shuffled."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                counts: Counter = Counter()
                for text in batch.text.iloc[at : at + 2000]:
                    counts.update(words_of(text))
                if counts:
                    yield pd.DataFrame({"word": [w.decode("utf-8", "surrogatepass") for w in counts], "c": list(counts.values())})

    return docs.select("text").mapInPandas(counted, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, ends: int, settings: Settings) -> Vocabulary:
    """What all tasks need: a list of bounded length, and sums over all other words."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # Counts from 4096 on share steps of an eighth of a doubling, so that this histogram is short at any size.
    step = F.when(F.col("c") < 4096, F.col("c").cast("double")).otherwise(F.pow(F.lit(2.0), F.floor(8 * F.log2("c")) / 8))
    above, least = 0, float("inf")
    for row in sorted(counts.groupBy(step.alias("from")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["from"]):
        above += row.n
        if above > settings.listed:
            break
        least = row["from"]
    listed = counts.where(F.col("c") >= least).toPandas().sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    words = [w.encode("utf-8", "surrogatepass") for w in listed.word]
    own = words[: settings.own - 1]
    group = np.array([k + 1 for k in range(len(own))] + [ending(w, settings) for w in words[len(own) :]], dtype=np.int64)
    tail = F.crc32(F.substring(F.col("word").cast("binary"), -2, 2)) % settings.endings
    sums = counts.groupBy(tail.alias("g")).agg(F.sum(F.col("c") + 0.5).alias("m")).collect()
    mass = np.full(settings.endings, 0.5)
    for row in sums:
        mass[row.g] += row.m
    for word, c in zip(own, listed.c, strict=False):
        mass[ending(word, settings) - settings.own] -= c + 0.5
    return Vocabulary(
        {w: k for k, w in enumerate(words)}, listed.c.to_numpy(np.int64), group, mass, int(total) + ends, int(distinct) + (ends > 0), ends
    )


def class_shares(words: Vocabulary, settings: Settings) -> np.ndarray:
    shares = np.full(settings.classes, 0.5)
    shares[0] += words.ends
    own = words.count[: settings.own - 1]
    shares[1 : 1 + len(own)] += own
    shares[settings.own :] += words.mass
    return shares / shares.sum()


def warm_sample(docs: DataFrame, settings: Settings, rows: int) -> list[str]:
    """Openings of the `warm_docs` rows with the smallest hashes, of which about twice as many pass a bound first.

    The bound follows from the number of `rows`, so that what leaves the tasks does not grow with their number; rows
    that are equal count once.
    """
    pick = F.xxhash64(F.col("doc_id").cast("string"), "text")
    kept = docs.select(pick.alias("h"), F.substring("text", 1, settings.warm_chars).alias("text"))
    if rows > 2 * settings.warm_docs:
        kept = kept.where(F.col("h") < int(-(1 << 63) + (1 << 64) * 2 * settings.warm_docs // rows))
    few = kept.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(settings.warm_docs)
    return [r.text for r in few.collect()]


def train(docs: DataFrame, words: Vocabulary, settings: Settings) -> Model:
    """A start on a bounded sample, then one pass over all training texts, every task for itself; models are averaged."""
    shares = class_shares(words, settings)
    model = Model.start(shares, settings.width)
    k, width = settings.classes, settings.width
    coder = Coder(words, settings)
    if sample := warm_sample(docs, settings, words.ends):
        ids = np.concatenate([coder.classes(*coder.places(t)) for t in sample])
        trainer = Trainer(model, shares, settings, 1)
        for _ in range(settings.warm_passes):
            trainer.learn(ids)
    start = model.flat()

    def learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, seen, stretch, held = Model.of(start, k, width), 0, [], 0
        code, teacher = Coder(words, settings), None
        for batch in batches:
            for text in batch.text:
                stretch.append(code.classes(*code.places(text)))
                held += len(stretch[-1])
                if held >= 1 << 18:
                    teacher = teacher or Trainer(own, shares, settings, seen + held)
                    teacher.learn(np.concatenate(stretch))
                    seen, stretch, held = seen + held, [], 0
        if held:
            teacher = teacher or Trainer(own, shares, settings, held)
            teacher.learn(np.concatenate(stretch))
            seen += held
        if seen:
            parts = np.array_split(own.flat() * np.float64(seen), settings.slices)
            yield pd.DataFrame({"slice": range(len(parts)), "task": seen % settings.fan, "n": float(seen), "sums": [p.tolist() for p in parts]})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack([np.asarray(x) for x in rows["sums"]]), axis=0)
        return pd.DataFrame({"slice": [rows["slice"].iloc[0]], "task": [0], "n": [rows.n.sum()], "sums": [total.tolist()]})

    schema = "slice int, task int, n double, sums array<double>"
    models = docs.select("text").mapInPandas(learned, schema)
    models = models.groupBy("slice", "task").applyInPandas(added, schema).groupBy("slice").applyInPandas(added, schema)
    rows = models.orderBy("slice").collect()  # one model
    return Model.of(np.concatenate([np.array(r.sums) / r.n for r in rows]), k, width) if rows else model


def score(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of `docs`.

    Scores are log10 probabilities of the whole text and its end; a word's is that of its class and of the word in it.
    Null and empty texts are an end alone. Null ids belong to fold 0, repeated rows are scored alike, an empty table
    gives no rows; without training rows all counts are 0.
    """
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = whole.where(fold("doc_id") != settings.held_out)
    counts = materialise(word_counts(known), "counts")
    words = vocabulary(counts, known.count(), settings)
    model = train(known, words, settings)
    values = model.flat()

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm, code = Model.of(values, settings.classes, settings.width), Coder(words, settings)
        logs, mass = np.log10(words.count + 0.5), np.log10(words.mass)
        end = np.log10(words.ends + 0.5)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                rows = []
                for text in part.text:
                    places, rare = code.places(text)
                    ids = code.classes(places, rare)
                    listed = places[places >= 0]
                    grouped = ids[2:] >= settings.own
                    within = -mass[ids[2:][grouped] - settings.own].sum() + logs[listed[words.group[listed] >= settings.own]].sum()
                    base = logs[listed].sum() + end - (len(places) + 1) * words.floor
                    tally = Counter(rare)
                    rows.append(
                        (
                            len(places) + 1,
                            len(listed) + (words.ends > 0),
                            base,
                            lm.log_probability(ids).sum(dtype=np.float64) / np.log(10) + within,
                            [w.decode("utf-8", "surrogatepass") for w in tally],
                            list(tally.values()),
                        )
                    )
                found = pd.DataFrame(rows, columns=["n_tokens", "n_known", "base_score", "score", "rare", "times"])
                found.insert(0, "doc_id", part.doc_id.to_numpy())
                found.insert(0, "row", part.row.to_numpy())
                yield found

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = "row long, doc_id string, n_tokens long, n_known long, base_score double, score double, rare array<string>, times array<long>"
    sent = whole.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    first = materialise(sent.mapInPandas(scored, schema), "scores")
    rare = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = rare.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("seen")
    )
    joined = first.drop("rare", "times").join(sums, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return joined.select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        (fold(F.col("doc_id").cast(kind)) == settings.held_out).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + logs).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )

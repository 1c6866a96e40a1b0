"""Quality classifier by compression: dictionaries of good and of bad text, and what each saves on a document."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskflow.llm.common import fold, ship
from maskflow.session import materialise

ship(__name__)


@dataclass(frozen=True)
class Settings:
    """Bounds of the labelled sample the model is fitted on; documents are scored whole."""

    per_class: int = 3000  # labelled documents of each class, the first in the order of a hash of their id
    sample_chars: int = 6000  # of each of them, from the start
    dict_bytes: int = 262_144  # each dictionary
    chunk: int = 1024  # bytes that are compressed at once, so that a long text does not become its own dictionary
    level: int = 5
    segment: int = 64  # bytes of the segments that a dictionary is put together from


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]  # bias, of the difference, of the compressed share
    settings: Settings

    @property
    def learned(self) -> bool:
        return self.weights[1:] != (0.0, 0.0)


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    if not content:
        return zstandard.ZstdCompressor(level=level)
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False)


class Scorer:
    def __init__(self, good: bytes, bad: bytes, settings: Settings):
        self.good, self.bad = _compressor(good, settings.level), _compressor(bad, settings.level)
        self.chunk = settings.chunk

    def features(self, text: str | None) -> tuple[float, float]:
        """The normalised difference of compressed sizes, (bad - good) / (bad + good), and their mean share of the text.

        Above 0 the text is nearer to good ones; the share tells repetition from text that neither dictionary knows.
        """
        data = (text or "").encode("utf-8", "surrogatepass")
        good = bad = 0
        for at in range(0, len(data), self.chunk):
            piece = data[at : at + self.chunk]
            good += len(self.good.compress(piece))
            bad += len(self.bad.compress(piece))
        return ((bad - good) / (bad + good), (bad + good) / 2 / len(data)) if data else (0.0, 1.0)

    def table(self, texts) -> np.ndarray:
        return np.array([self.features(t) for t in texts], dtype=float).reshape(-1, 2)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 1e-3) -> tuple[float, float, float]:
    """Weights of a logistic curve over (1, difference, share) by Newton steps; `w` restores the shares of the classes."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    design = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], 1)
    beta = np.zeros(3)
    for _ in range(60):
        p = _sigmoid(design @ beta)
        gradient = design.T @ (w * (y - p)) - penalty * beta
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + penalty * np.eye(3)
        step = np.clip(np.linalg.solve(hessian, gradient), -5, 5)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = beta[1:] / scale
    return float(beta[0] - slopes @ mean), float(slopes[0]), float(slopes[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[DataFrame, dict[int, int]]:
    """At most `per_class` labelled training documents of each class (place, quality, text), written once, and how many
    labels of each there are."""
    usable = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)").where(fold("doc_id") != 0)
    usable = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    totals = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = None
    for label in (0, 1):
        part = usable.where(F.col("quality") == label).orderBy(order, "doc_id").limit(settings.per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, settings.sample_chars).alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id")  # 2 x per_class rows at most
    joined = joined.orderBy(order, "doc_id", "text").limit(2 * settings.per_class)
    placed = joined.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, "doc_id", "text")) - 1)
    return materialise(placed.select("place", "quality", "text"), "labelled-sample"), totals


def dictionary(texts: list[bytes], size: int, settings: Settings) -> bytes:
    """At most `size` bytes for texts: all of them, or the segments of them that hold most of what recurs, the best last.

    Every run of 8 bytes anywhere in the texts counts as often as it occurs; a segment is worth the counts of the runs
    that no chosen segment has. The best segment is taken each time; without recurrence they come from all over.
    """
    whole = b"\n".join(texts)
    length, step = len(whole), settings.segment
    if length <= size + len(texts):
        return whole[:size]
    # Numbered by the low bits they begin with, so that what sorting takes is a part of the text's size only.
    padded, runs = whole + bytes(8), np.empty(length, dtype=np.uint64)
    for k in range(8):
        runs[k::8] = np.frombuffer(padded, dtype="<u8", count=-(-(length - k) // 8), offset=k)
    known, numbered, parts = np.empty(length, dtype=np.int32), 0, []
    low = np.frombuffer(whole, dtype=np.uint8) & 15
    for part in range(16):
        at = np.flatnonzero(low == part)
        _, own, counts = np.unique(runs[at], return_inverse=True, return_counts=True)
        known[at] = own + numbered
        numbered += len(counts)
        parts.append((counts - 1).astype(np.int32))
    worth = np.concatenate(parts)
    del padded, runs, low, parts

    def value(number: int) -> int:
        return int(worth[np.unique(known[number * step : (number + 1) * step])].sum())

    numbers = np.random.default_rng(0).permutation(-(-length // step)).tolist()
    queue = [(-value(n), place, n) for place, n in enumerate(numbers)]
    heapq.heapify(queue)
    chosen, held = [], 0
    while queue and held < size:
        old, place, n = heapq.heappop(queue)
        now = -value(n)
        if now > old:  # others have taken runs of it since; worth only falls
            heapq.heappush(queue, (now, place, n))
            continue
        worth[known[n * step : (n + 1) * step]] = 0
        chosen.append(whole[n * step : (n + 1) * step])
        held += len(chosen[-1])
    return b"".join(reversed(chosen))[-size:]


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Dictionaries from half of the labelled sample, the logistic curve from the other half.

    Only rows of folds 1 to 4 are learned from. Without labels, or with one class only, the model has no
    dictionaries and gives every text the share of good labels (0.5 without any). Texts stay with the tasks: the driver
    gets the dictionaries and two numbers of each text of the other half.
    """
    sample, totals = labelled_sample(docs, labels, settings)
    share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    prior = float(np.log(share / (1 - share)))
    sample = sample.withColumn("half", F.col("place") % 2)
    sizes = sample.groupBy("half", "quality").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    sizes = {(r["half"], r["quality"]): r["n"] for r in sizes}
    if len(sizes) < 4:  # a class is missing in one of the halves
        return Model(b"", b"", (prior, 0.0, 0.0), settings)

    size = min(settings.dict_bytes, sizes[0, 0], sizes[0, 1])  # a larger dictionary would win by its size

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        texts = [t.encode("utf-8", "surrogatepass") for t in rows.sort_values("place").text if t]
        return pd.DataFrame({"quality": rows.quality.iloc[:1], "content": [dictionary(texts, size, settings)]})

    learned = sample.where("half = 0").groupBy("quality").applyInPandas(learn, "quality int, content binary").collect()
    contents = {r["quality"]: bytes(r["content"]) for r in learned}
    size = min(map(len, contents.values()))
    good, bad = (contents[q][len(contents[q]) - size :] for q in (1, 0))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(good, bad, settings)
        for rows in batches:
            x = scorer.table(rows.text)
            yield pd.DataFrame({"place": rows.place, "quality": rows.quality, "difference": x[:, 0], "share": x[:, 1]})

    rest = sample.where("half = 1").mapInPandas(measure, "place int, quality int, difference double, share double")
    rest = rest.toPandas().sort_values("place", ignore_index=True)
    x = np.ascontiguousarray(rest[["difference", "share"]].to_numpy(float))
    y = rest.quality.to_numpy(float)
    per_row = {q: totals[q] / max(1, int((y == q).sum())) for q in (0, 1)}
    w = np.where(y == 1, per_row[1], per_row[0])
    return Model(good, bad, calibrate(x, y, w / w.mean()), settings)


def score(text: str | Column, model: Model) -> Column:
    """Probability that a whole text is good; null and empty texts count as difference 0 and share 1."""
    sent = model

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.good, sent.bad, sent.settings)
        for texts in batches:
            x = scorer.table(texts) if sent.learned else np.zeros((len(texts), 2))
            yield pd.Series(_sigmoid(sent.weights[0] + x @ np.array(sent.weights[1:])), dtype=float)

    return scored(F.col(text) if isinstance(text, str) else text)


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """`docs` with held_out, score (0 to 1) and predicted, one row for each row.

    Null ids belong to fold 0, rows without a label are scored as well, columns named like the new ones are replaced.
    """
    model = fit(docs, labels, settings)
    scored = docs.withColumns({"held_out": fold("doc_id") == 0, "score": score("text", model)})
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""Toxic documents by multiple-instance learning.

A document is a bag of sentences and only the bag has a label.  A sentence is
toxic with probability ``sigmoid(bias + sum of the weights of its words)``, and
a document is toxic if any of its sentences is (noisy-or).  Weights are fitted to
the labels of documents through that formula, and the sentence probabilities then
say where the offence is.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import bounded_batches, giving_back, id_and_text, slices_by_bytes

# Bounds of the sample that the model is fitted on, and of the model itself.
SAMPLE_TOXIC = 4_000
SAMPLE_CLEAN = 8_000
FEATURES = 1_000

PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.7
BATCH_BYTES = 4 * 1024 * 1024
CACHE_WORDS = 500_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGES = ".,;:!?\"'()[]{}#$%&*-_/\\<>=+|~^`"


@dataclass(frozen=True)
class Model:
    """Weights of words, and of openings of words (written with a closing dash)."""

    bias: float
    weights: dict[str, float]


def features(word: str) -> list[str]:
    """What a lower-case word without marks at its ends stands for."""
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)] if word else []


def held_out(doc_id) -> F.Column:
    """Documents whose labels are never learned from; a null id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_toxic: int = SAMPLE_TOXIC,
    sample_clean: int = SAMPLE_CLEAN,
) -> Model:
    """Fit the model on a bounded sample of documents with a label.

    At most ``sample_toxic`` and ``sample_clean`` labelled ids that are not held
    out, the smallest by a hash of the id, are joined with their whole texts and
    reach one task, which fits the weights; each class counts by its share of
    all labelled rows.  A document with several labels counts as toxic if one of
    them says so; null labels and labels without a document are left out.
    Without any labelled document the model scores everything next to zero.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    parts = [
        known.where(condition).orderBy(order, "doc_id").limit(limit)
        for condition, limit in (("toxic = 1", sample_toxic), ("toxic = 0", sample_clean))
    ]
    totals = {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().where("toxic in (0, 1)").collect()}
    sample = parts[0].unionByName(parts[1])
    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, targets = Bags(), []
        for batch in batches:
            for start, end in slices_by_bytes(batch.column("text"), BATCH_BYTES):
                for text in batch.column("text").slice(start, end - start).to_pylist():
                    bags.add(text)
            targets += batch.column("toxic").to_pylist()
        model = _fit(bags, np.array(targets, float), totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(["", *model.weights]), pa.array([model.bias, *model.weights.values()], pa.float64())],
            ["feature", "weight"],
        )

    # Bounded by SAMPLE_TOXIC + SAMPLE_CLEAN documents, sorted so that a task
    # that is run again fits the same weights.
    one = texts.repartition(1).sortWithinPartitions("doc_id", "text").select("text", "toxic")
    weights = {row["feature"]: row["weight"] for row in one.mapInArrow(giving_back(train), "feature string, weight double").collect()}
    return Model(weights.pop("", -12.0), weights)


class Bags:
    """Documents as sentences of numbered words; a text without words is one empty sentence."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self._documents: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, text: str) -> None:
        numbers, sizes, known = array("i"), array("i"), self.words
        for sentence in _SENTENCE.findall(text.lower()):
            before = len(numbers)
            for word in sentence.split():
                if word := word.strip(_EDGES):
                    numbers.append(known.setdefault(word, len(known)))
            if len(numbers) > before:
                sizes.append(len(numbers) - before)
        self._documents.append((np.array(numbers, np.int32), np.array(sizes or [0], np.int32)))

    def __len__(self) -> int:
        return len(self._documents)

    def distinct_words(self) -> Iterator[list[int]]:
        for numbers, _ in self._documents:
            yield np.unique(numbers).tolist()

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of all sentences, the sentence of each word and the document of each sentence."""
        words = np.concatenate([d[0] for d in self._documents])
        sizes = np.concatenate([d[1] for d in self._documents])
        sentence_of = np.repeat(np.arange(len(sizes)), sizes)
        return words, sentence_of, np.repeat(np.arange(len(self)), [len(d[1]) for d in self._documents])


def _choose(bags: Bags, targets: np.ndarray, weight: np.ndarray) -> list[str]:
    """The features that tell the classes apart best, by a chi-squared score of documents."""
    of = {0: Counter(), 1: Counter()}
    spelled = list(bags.words)
    for numbers, target in zip(bags.distinct_words(), targets):
        of[int(target)].update({f for n in numbers for f in features(spelled[n])})
    size = {t: float((weight * (targets == t)).sum()) for t in (0, 1)}
    per_doc = {t: size[t] / max(1, (targets == t).sum()) for t in (0, 1)}
    total = sum(size.values())
    scored = []
    for name in of[0].keys() | of[1].keys():
        if of[0][name] + of[1][name] < 3:
            continue
        a, b = of[1][name] * per_doc[1], of[0][name] * per_doc[0]
        c, d = size[1] - a, size[0] - b
        under = (a + b) * (c + d) * (a + c) * (b + d)
        if under > 0:
            scored.append((total * (a * d - b * c) ** 2 / under, name))
    # Ties go by name, so the choice is the same in every run.
    return [name for _, name in sorted(scored, key=lambda x: (-x[0], x[1]))[:FEATURES]]


def _fit(bags: Bags, targets: np.ndarray, totals: dict[int, int], steps: int = 300) -> Model:
    """Maximum likelihood of the documents' labels under noisy-or, with Adam."""
    if not len(bags) or not totals.get(1):
        return Model(-12.0, {})
    have = {t: max(1.0, float((targets == t).sum())) for t in (0, 1)}
    weight = np.where(targets == 1, totals.get(1, 0) / have[1], totals.get(0, 0) / have[0])
    weight /= weight.sum()
    names = _choose(bags, targets, weight * len(bags))
    number = {name: n for n, name in enumerate(names)}
    of_word = [[number[f] for f in features(word) if f in number] for word in bags.words]
    counts = np.array([len(found) for found in of_word], np.int64)
    listed = np.array([f for found in of_word for f in found], np.int64)
    begins = np.cumsum(counts) - counts
    words, sentence_of, doc_of = bags.flat()
    kept = counts[words] > 0
    words, sentence_of = words[kept], sentence_of[kept]
    # The features of each word, one after the other.
    many = counts[words]
    sentence_of = np.repeat(sentence_of, many)
    within = np.arange(len(sentence_of)) - np.repeat(np.cumsum(many) - many, many)
    feature_of = listed[np.repeat(begins[words], many) + within] if len(listed) else np.zeros(0, np.int64)
    params, first, second = np.zeros(len(names) + 1), 0.0, 0.0
    params[-1] = -6.0
    for step in range(1, steps + 1):
        z = params[-1] + np.bincount(sentence_of, params[feature_of], minlength=len(doc_of))
        z = np.clip(z, -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(-np.bincount(doc_of, np.logaddexp(0, z), minlength=len(bags)))
        toxic = np.maximum(1 - clean, 1e-9)
        # Slope of the log likelihood of a document in the score of a sentence.
        slope = np.where(targets == 1, clean / toxic, -1.0) * weight
        slope = slope[doc_of] * p
        gradient = np.append(np.bincount(feature_of, slope[sentence_of], minlength=len(names)), slope.sum())
        gradient[:-1] -= 2e-5 * params[:-1]
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        params += 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(float(params[-1]), {n: float(w) for n, w in zip(names, params) if abs(w) > 1e-3})


class _Weights(dict):
    """Words as they stand in a text to the weight they add; bounded."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self._weights = model.weights

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        look = self._weights.get
        self[word] = value = sum(look(f, 0.0) for f in features(word.strip(_EDGES)))
        return value


def _sentence_scores(text: str, weigh) -> Iterator[tuple[int, int, float]]:
    """``(start, end, added weight)`` of the sentences of a text, one at a time."""
    lowered = text.lower()
    # Lower case may change the length of rare letters; places are then those
    # of the lower-case text, cut to the text.
    for match in _SENTENCE.finditer(lowered):
        words = match.group().split()
        if words:
            yield match.start(), match.end(), sum(map(weigh, words))


def _softplus(z: float) -> float:
    return z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_offending)``, one row per row of ``docs``.

    The whole text counts, null texts are empty, and an empty text is one
    sentence without words.  Rows stay where they were read.  The model, at most
    ``FEATURES`` weights, goes to every task.  ``n_offending`` counts sentences
    that are toxic by themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, bias, plain = _Weights(model).__getitem__, model.bias, _softplus(model.bias)
        limit = math.log(threshold / (1 - threshold)) - bias
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for start, end in slices_by_bytes(texts, BATCH_BYTES):
                scores, counts = [], []
                for text in texts.slice(start, end - start).to_pylist():
                    total, sentences, offending = 0.0, 0, 0
                    for _, _, added in _sentence_scores(text, weigh):
                        sentences += 1
                        if added:
                            total += _softplus(bias + added)
                            offending += added >= limit
                        else:
                            total += plain
                    scores.append(-math.expm1(-(total if sentences else plain)))
                    counts.append(offending)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, end - start), pa.array(scores, pa.float64()), pa.array(counts, pa.int64())],
                    ["doc_id", "score", "n_offending"],
                )

    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = bounded_batches(rows).mapInArrow(giving_back(run), "doc_id long, score double, n_offending long")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "n_offending",
    )


def offending_sentences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, start, end, score)`` of the sentences that are toxic by themselves, in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, bias = _Weights(model).__getitem__, model.bias
        for batch in batches:
            found = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for start, end, added in _sentence_scores(text, weigh):
                    chance = math.exp(-_softplus(-(bias + added)))
                    if chance >= threshold:
                        found.append((doc, min(start, len(text)), min(end, len(text)), chance))
            columns = list(zip(*found)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                ["doc_id", "start", "end", "score"],
            )

    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return bounded_batches(rows).mapInArrow(run, "doc_id long, start long, end long, score double")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more, same columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, bias, plain = _Weights(model).__getitem__, model.bias, _softplus(model.bias)
        limit = -math.log1p(-threshold)
        for batch in batches:
            stays = []
            for text in batch.column(text_col).to_pylist():
                total = [_softplus(bias + added) for _, _, added in _sentence_scores(text or "", weigh)]
                stays.append((sum(total) if total else plain) < limit)
            yield batch.filter(pa.array(stays, pa.bool_()))

    return bounded_batches(docs).mapInArrow(giving_back(keep), docs.schema)

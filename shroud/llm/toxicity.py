"""Toxicity by multiple-instance learning.

A document is a bag of sentences; only documents are labelled. Each sentence has the probability
sigmoid(bias + weights of its distinct words), a word's weight being the sum of the weights of
itself and of its first letters (two lengths, so that inflected forms share); the document is toxic if at least one sentence is (noisy-or:
1 - product of 1 - p). Weights are fitted to document labels by gradient ascent on the noisy-or
likelihood; the same sentence probabilities then say where the offending sentences are.

Training is on a bounded sample: at most `sample_docs` labelled documents of each class (those with
the least hash of their id, none longer than `longest` characters), weighted back to the classes'
shares among all labels. Every text is scored whole, in tasks, with the broadcast weights (at most
`vocabulary` features).

Defined cases: null or empty text has no sentence and scores 0; without positive (or any) labels all
score 0; a document with several labels counts as toxic if one says so, null labels are left out;
repeated rows and null ids are scored like any row; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import each, id_hash_mod, tidy

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 6)


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
           sample_docs: int = 2000, longest: int = 50_000) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """(text, label) of the sample and the number of labels by class."""
    by_doc = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
              .agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("_label")))
    shares = {r["_label"]: r["count"] for r in by_doc.groupBy("_label").count().collect()}
    usable = (docs.where(F.length(text_col) <= longest).select(F.col(id_col).alias("_id")).join(by_doc, "_id", "left_semi").distinct()
              .join(by_doc, "_id"))
    ids = None
    for label in (0, 1):
        part = usable.where(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
        ids = part if ids is None else ids.union(part)
    texts = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
             .where(F.length("_text") <= longest).join(F.broadcast(ids), "_id")  # at most 2 * sample_docs rows
             .groupBy("_id", "_label").agg(F.min("_text").alias("_text")).orderBy("_id"))
    return [(r["_text"], r["_label"]) for r in texts.collect()], shares


def features(word: str) -> list[str]:
    """The word and its first letters, where it has more."""
    return [word, *[f"{k}^{word[:k]}" for k in STEMS if len(word) > k]]


def bag(text: str) -> list[set[str]]:
    """The distinct words of each sentence that has one."""
    return [set(w) for s in SENTENCE.findall(text.lower()) if (w := WORD.findall(s))]


def fit(rows: list[tuple[str, int]], shares: dict[int, int], vocabulary: int = 60_000, least_docs: int = 10,
        decay: float = 2e-5, steps: int = 400, rate: float = 0.3) -> dict:
    """Bias and feature weights that maximise the weighted noisy-or likelihood (Adam steps)."""
    label = np.array([y for _, y in rows], dtype=float)
    if not label.any():
        return {"bias": -math.inf, "weights": {}}
    seen: Counter = Counter()
    for text, _ in rows:
        seen.update({f for s in bag(text) for w in s for f in features(w)})
    names = [f for f, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:vocabulary] if n >= least_docs]
    index = {f: i for i, f in enumerate(names)}
    del seen
    feature_of, sizes, doc_of = array("i"), array("i"), array("i")
    for d, (text, _) in enumerate(rows):
        for s in bag(text):
            ids = [index[f] for w in sorted(s) for f in features(w) if f in index]
            feature_of.extend(ids)
            sizes.append(len(ids))
            doc_of.append(d)
    feature_of, doc_of = np.frombuffer(feature_of, np.int32), np.frombuffer(doc_of, np.int32)
    n_sentences, n_features = len(sizes), len(names)
    sentence_of = np.repeat(np.arange(n_sentences, dtype=np.int32), np.frombuffer(sizes, np.int32))
    have = {y: max(1, int((label == y).sum())) for y in (0, 1)}
    total = sum(shares.values())
    weight = np.where(label == 1, shares.get(1, 0) / have[1], shares.get(0, 0) / have[0]) / total
    params = np.zeros(n_features + 1)
    params[-1] = -4.0
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        z = params[-1] + np.bincount(sentence_of, weights=params[feature_of], minlength=n_sentences)
        p = 1 / (1 + np.exp(-z))
        log_clean = np.bincount(doc_of, weights=-np.logaddexp(0, z), minlength=len(rows))  # of the product of 1 - p
        clean = np.exp(log_clean)
        pull = np.where(label == 1, clean / np.maximum(1 - clean, 1e-9), -1.0) * weight
        by_sentence = pull[doc_of] * p
        grad = np.append(np.bincount(feature_of, weights=by_sentence[sentence_of], minlength=n_features) - decay * params[:-1], by_sentence.sum())
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad ** 2
        params += rate * (1 - step / (steps + 1)) * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return {"bias": float(params[-1]), "weights": {f: float(x) for f, x in zip(names, params) if abs(x) > 1e-3}}


class Scorer:
    def __init__(self, model: dict, remember: int = 100_000):
        self.bias, self.features, self.remember = model["bias"], model["weights"], remember
        self.words: dict[str, float] = {}

    def _weight(self, word: str) -> float:
        if len(self.words) >= self.remember:
            self.words.clear()
        x = self.words[word] = sum([self.features.get(f, 0.0) for f in features(word)])
        return x

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of each sentence with a word."""
        known, out, lower = self.words, [], text.lower()
        if len(lower) != len(text):  # letters whose lower case is longer would shift the places
            lower = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
        for m in SENTENCE.finditer(lower):
            if words := set(WORD.findall(m[0])):
                z = self.bias + math.fsum([x if (x := known.get(w)) is not None else self._weight(w) for w in words])
                out.append((m.start(), m.end(), 1 / (1 + math.exp(-z)) if z > -700 else 0.0))
        return out


def noisy_or(parts: list[float]) -> float:
    return -math.expm1(sum(math.log1p(-min(p, 1 - 1e-15)) for p in parts))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", offending_at: float = 0.5) -> DataFrame:
    """One row per input row: id, score, offending (array<struct<start,end,p>> of sentences)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(id_col, text_col)
    kind = kept.schema[0].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            scores, places = [], []
            for text in each(batch.column(1)):
                found = scorer.sentences(text) if text else []
                scores.append(noisy_or([p for *_, p in found]))
                places.append([{"start": a, "end": b, "p": p} for a, b, p in found if p >= offending_at])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(places, spans)], names=[id_col, "score", "offending"])

    return kept.mapInArrow(tidy(run), f"`{id_col}` {kind}, score double, offending array<struct<start:bigint,end:bigint,p:double>>")


def keep_clean(docs: DataFrame, model: dict, text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """The input rows, all of their columns, whose score is under `reject_at`; no shuffle: rows are
    filtered where they are scored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            clean = [not t or noisy_or([p for *_, p in scorer.sentences(t)]) < reject_at for t in each(batch.column(at))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def learned(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> dict:
    """The model, from labelled documents outside the held-out fifth."""
    return fit(*sample(docs, labels.where(id_hash_mod(id_col, 5) != 0), id_col, **options))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = learned(spark, docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (id_hash_mod("doc_id", 5) == 0).alias("held_out"), "score",
                                     F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("offending").alias("n_offending"))

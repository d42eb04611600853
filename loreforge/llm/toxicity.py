"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learn from document labels.

A document is toxic if one of its sentences is: p(document) = 1 - prod(1 - p(sentence)). p(sentence) is a
logistic score of its words and their beginnings, hashed. Only documents have labels; the noisy-or passes each one's error to the
sentences that are to blame, so the model can name the offending sentences afterwards.

The model is fitted on at most ``rows`` labelled documents that are not held out, chosen by a hash of their ids;
every whole text of the table is scored. Only the text is an input of the score.

Null and blank texts count as one sentence without words, whose score is the sentences' prior. Rows that repeat an id
are each scored. Without labelled rows all scores are the prior of a model that has seen nothing. An empty table gives
an empty result; :func:`drop_toxic` passes other columns through.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, in_arrow, slices
from .learning import MEMORY, SIZE, Adam, Hashed, held_out, sample, sigmoid, sums

#: Labelled documents that the model is fitted on at most.
ROWS = 4000
#: Features that a step of the fit looks up at once, about.
PART = 1 << 19
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W_]+")


#: A word's beginnings of these lengths are features too: inflected and compound forms share them.
_STEMS = (4, 5, 6)


def features(word: str) -> tuple[str, ...]:
    return (word, *(f"^{word[:n]}" for n in _STEMS if len(word) >= n))


class _Weights(dict):
    """word -> the sum of its features' weights. Forgets all when it is full."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights, self.places = weights, Hashed()

    def __missing__(self, word):
        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = float(sum(self.weights[self.places[f]] for f in features(word)))
        return value


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.of_word = weights, bias, _Weights(weights)

    def sentences(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray]:
        """Each text's sentences, and the scores of all in a row."""
        parts = split(texts)
        get = self.of_word.__getitem__
        z = [sum(map(get, _WORD.findall(s.lower()))) for p in parts for s in p]
        return parts, sigmoid(np.array(z, float) + self.bias)


def split(texts: list[str]) -> list[list[str]]:
    return [_SENTENCE.findall(t) or [""] for t in texts]


def noisy_or(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.clip(-np.expm1(sums(np.log1p(-np.minimum(p, 1 - 1e-12)), counts)), 0, 1)


def fit(texts: list[str], labels: np.ndarray, steps: int = 200, rate: float = 0.2, decay: float = 1e-5, least: int = 3) -> Model:
    """Maximum likelihood of the document labels under the noisy-or, with decay on the squared weights.

    least: documents that a feature must be in."""
    bias = -6.0
    if not len(texts) or labels.min() == labels.max():
        return Model(np.zeros(SIZE, np.float32), bias)
    memo, rows = Hashed(), []  # rows: a sentence's features
    n, of_doc, docs = 0, [], np.zeros(SIZE, np.int32)
    for i, text in enumerate(texts):
        there: set[int] = set()
        for s in split([text])[0]:
            own = {memo[f] for w in _WORD.findall(s.lower()) for f in features(w)}
            rows.append(np.fromiter(own, np.int32, len(own)))
            there |= own
            of_doc.append(i)
            n += 1
        docs[np.fromiter(there, np.int32, len(there))] += 1
    often = docs >= least
    used = np.flatnonzero(often)
    at = np.cumsum(often, dtype=np.int32) - 1
    for i, r in enumerate(rows):
        rows[i] = at[r[often[r]]]
    lengths, places = np.fromiter(map(len, rows), np.int64, n), np.concatenate(rows)
    of_doc, starts = np.array(of_doc, np.int32), np.cumsum(lengths) - lengths
    del rows, memo
    cuts = np.append(np.flatnonzero(np.diff(starts // PART, prepend=-1)), n)  # whole sentences of about PART features at once
    parts = [(slice(a, b), places[starts[a] : starts[b] if b < n else None], lengths[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    w, moves = np.zeros(len(used) + 1), Adam(len(used) + 1, rate)
    w[-1] = bias
    for _ in range(steps):
        z = np.concatenate([np.bincount(np.repeat(np.arange(len(k)), k), weights=w[p], minlength=len(k)) for _, p, k in parts]) + w[-1]
        p = sigmoid(z)
        clean = np.bincount(of_doc, weights=-np.logaddexp(0, z), minlength=len(texts))
        # d loss / d log p(clean): -1 where the label is clean, else the odds of a miss
        blame = np.where(labels > 0, np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9), -1.0)
        error = -p * blame[of_doc]
        g = np.append(sum(np.bincount(p, weights=np.repeat(error[s], k), minlength=len(used)) for s, p, k in parts), error.sum()) / len(texts)
        g[:-1] += decay * w[:-1]
        w -= moves.step(g)
    weights = np.zeros(SIZE, np.float32)
    weights[used] = w[:-1]
    return Model(weights, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, fold: int = 0, rows: int = ROWS) -> Model:
    found = sample(docs, labels, label_col, id_col, text_col, folds, fold, rows).toArrow()
    order = np.argsort(found.column("text").to_numpy(), kind="stable") if found.num_rows else np.zeros(0, int)  # the same sums in every run
    texts, labels = found.column("text").take(pa.array(order)).to_pylist(), found.column("label").to_numpy()[order]
    del found
    model = fit(texts, labels)
    del texts
    give_back()  # this is the driver
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, score, n_sentences, worst (the sentence that scores highest) and worst_score."""
    weights, bias = model.weights, model.bias

    def each(batches):
        own = Model(weights, bias)
        for batch in slices(batches):
            parts, p = own.sentences(batch.column(1).to_pylist())
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            starts = np.cumsum(counts) - counts
            best = [int(p[a : a + n].argmax()) for a, n in zip(starts.tolist(), counts.tolist(), strict=True)]
            columns = [pa.array(noisy_or(p, counts)), pa.array(counts), pa.array([x[b].strip() for x, b in zip(parts, best, strict=True)], pa.string()), pa.array(p[starts + np.array(best, int)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "score", "n_sentences", "worst", "worst_score"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(text_col, F.lit("")).alias("text"))
    return in_arrow(rows, each, f"{id_col} long, score double, n_sentences long, worst string, worst_score double")


def locate(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The offending sentences: <id_col>, place (from 0), sentence, score."""
    weights, bias = model.weights, model.bias

    def each(batches):
        own = Model(weights, bias)
        for batch in slices(batches):
            parts, p = own.sentences(batch.column(1).to_pylist())
            flat, base = [(i, k, s.strip()) for i, x in enumerate(parts) for k, s in enumerate(x)], np.flatnonzero(p >= threshold)
            hits = [flat[k] for k in base.tolist()]
            ids = batch.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([h[1] for h in hits], pa.int32()), pa.array([h[2] for h in hits], pa.string()), pa.array(p[base])], names=[id_col, "place", "sentence", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(text_col, F.lit("")).alias("text"))
    return in_arrow(rows, each, f"{id_col} long, place int, sentence string, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> DataFrame:
    """<id_col>, held_out, score, predicted and what :func:`score` tells beside."""
    scored = score(docs, train(docs, labels, id_col, text_col, rows=rows), id_col, text_col)
    return scored.select(id_col, held_out(id_col, 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "worst", "worst_score")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> DataFrame:
    """The rows of docs whose score is below threshold, with all their columns, judged row by row in one pass."""
    model = train(docs, labels, id_col, text_col, rows=rows)
    weights, bias, at = model.weights, model.bias, docs.columns.index(text_col)

    def each(batches):
        own = Model(weights, bias)
        for batch in slices(batches):
            parts, p = own.sentences([t or "" for t in batch.column(at).to_pylist()])
            keep = noisy_or(p, np.fromiter(map(len, parts), np.int64, len(parts))) < threshold
            yield batch.filter(pa.array(keep))

    return in_arrow(docs, each, docs.schema)

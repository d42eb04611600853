"""Document quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x): all grades share the weights w of hashed words and marks, and the
thresholds rise with k. The features are the shares that tokens and their shapes have of a text, so that length alone says
nothing. The model gives the expected grade (as a rank from 0) and the tail probability P(grade >= least), by
which documents are selected.

Grades are the distinct labels in rising order, however many there are; two grades give one threshold. The
model is fitted on at most ``rows`` labelled documents that are not held out; every whole text is scored.

Null texts count as empty, which have no features. Rows that repeat an id are each scored. With fewer than two
grades the tail probability is 1 for the lowest grade and 0 else. An empty table gives an empty result.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .learning import MEMORY, SIZE, Adam, Hashed, held_out, sample, sigmoid

#: Labelled documents that the model is fitted on at most.
ROWS = 4000
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+|\n+")
_DIGITS, _UPPER, _LOWER = re.compile(r"\d"), re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[a-zß-öø-ÿ]")


def shape(token: str) -> str:
    """A token's kind, beside the token itself: marks as they are, words by case, digits and length."""
    if not token[0].isalnum():
        return token[:4]
    if _DIGITS.search(token):
        return "#d"
    case = "U" if _UPPER.search(token) and not _LOWER.search(token) else "T" if _UPPER.match(token) else "l"
    return f"#{case}{min(len(token), 12)}"


@dataclass
class Model:
    weights: np.ndarray
    cuts: np.ndarray

    def latent(self, texts: list[str], memo: dict) -> np.ndarray:
        tokens = [_TOKEN.findall(t) for t in texts]
        return np.array([sum(map(memo.__getitem__, x)) / max(1, len(x)) for x in tokens], float)

    def memo(self) -> dict:
        weights, places = self.weights, Hashed()

        class Weights(dict):
            def __missing__(self, token):
                if len(self) > MEMORY:
                    self.clear()
                value = self[token] = SCALE * float(sum(weights[places[f]] for f in features(token)))
                return value

        return Weights()

    def above(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return sigmoid(latent[:, None] - self.cuts)


#: Shares are small numbers; they enter multiplied by this.
SCALE = 10.0


def features(token: str) -> tuple[str, str]:
    return token.lower(), f"~{shape(token)}"


def fit(texts: list[str], grades: np.ndarray, steps: int = 200, rate: float = 0.1, decay: float = 1e-4, least: int = 3) -> Model:
    """Maximum likelihood. grades: ranks from 0. least: documents that a feature must be in."""
    top = int(grades.max()) if len(grades) else 0
    if not top:
        return Model(np.zeros(SIZE, np.float32), np.full(0, 0.0))
    memo, rows, values = Hashed(), [], []
    for text in texts:
        tokens = _TOKEN.findall(text)
        own, n = np.unique(np.fromiter((memo[f] for t in tokens for f in features(t)), np.int64, 2 * len(tokens)), return_counts=True)
        rows.append(own)
        values.append(SCALE * n / max(1, len(tokens)))
    doc, place, value = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows), np.concatenate(values)
    keep = (np.bincount(place, minlength=SIZE) >= least)[place]
    used, place = np.unique(place[keep], return_inverse=True)
    doc, value = doc[keep], value[keep]
    n, share = len(texts), np.array([(grades >= k).mean() for k in range(1, top + 1)])
    cuts = -np.log(share / np.maximum(1 - share, 1e-6))
    raw = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])  # the first threshold and the gaps' logarithms
    w, moves = np.concatenate([np.zeros(len(used)), raw]), Adam(len(used) + top, rate)
    for _ in range(steps):
        gaps = np.exp(w[len(used) + 1 :])
        cuts = w[len(used)] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(doc, weights=w[place] * value, minlength=n)
        edges = np.concatenate([np.ones((n, 1)), sigmoid(z[:, None] - cuts), np.zeros((n, 1))], axis=1)  # P(grade >= k), k = 0 .. top + 1
        at = np.arange(n)
        low, high = edges[at, grades], edges[at, grades + 1]
        p = np.maximum(low - high, 1e-9)
        d_low, d_high = low * (1 - low) / p, high * (1 - high) / p
        dz = -(d_low - d_high) / n
        d_cut = np.bincount(grades, weights=d_low, minlength=top + 1)[1:] - np.bincount(grades + 1, weights=d_high, minlength=top + 2)[1:-1]
        d_cut /= n
        tail = np.cumsum(d_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(place, weights=dz[doc] * value, minlength=len(used)) + decay * w[: len(used)], [tail[0]], gaps * tail[1:]])
        w -= moves.step(g)
    weights = np.zeros(SIZE, np.float32)
    weights[used] = w[: len(used)]
    return Model(weights, w[len(used)] + np.concatenate([[0], np.cumsum(np.exp(w[len(used) + 1 :]))]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, fold: int = 0, rows: int = ROWS) -> Model:
    found = sample(docs, labels, label_col, id_col, text_col, folds, fold, rows).toArrow()
    order = np.argsort(found.column("text").to_numpy(), kind="stable") if found.num_rows else np.zeros(0, int)  # the same sums in every run
    ranks = np.unique(found.column("label").to_numpy()[order], return_inverse=True)[1] if len(order) else np.zeros(0, int)
    return fit(found.column("text").take(pa.array(order)).to_pylist(), ranks)


def rate(docs: DataFrame, model: Model, least: int = 1, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, held_out, expected_grade, tail_probability of grade >= least, and kept: whether that reaches threshold."""

    def each(batches):
        memo = model.memo()
        for batch in slices(batches):
            above = model.above(model.latent(batch.column(1).to_pylist(), memo))
            tail = np.ones(len(above)) if least <= 0 else above[:, least - 1] if least <= above.shape[1] else np.zeros(len(above))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(1)), pa.array(tail)], names=[id_col, "expected_grade", "tail_probability"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(text_col, F.lit("")).alias("text"))
    found = rows.mapInArrow(each, f"{id_col} long, expected_grade double, tail_probability double")
    return found.select(id_col, held_out(id_col, 5, 0).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= threshold).alias("kept"))

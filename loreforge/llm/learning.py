"""What the two learned classifiers share: hashed tokens, the bounded sample of labelled rows and Adam's steps."""

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed features, and tokens that a worker remembers at most.
SIZE, MEMORY = 1 << 18, 300_000


class Hashed(dict):
    """token -> place. Forgets all when it is full."""

    def __missing__(self, token):
        if len(self) >= MEMORY:
            self.clear()
        place = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass")) % SIZE
        return place


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of runs of values; runs may be empty."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def held_out(id_col: str, folds: int, fold: int):
    """crc32 of the id as text, mod folds, is fold. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, folds: int, fold: int, rows: int) -> DataFrame:
    """text, label of at most rows labelled documents that are not held out: those whose ids' hashes are smallest.

    Null labels are left out; of labels that repeat an id the largest counts. The choice is made on ids alone, so that
    texts are read for the chosen rows only.
    """
    of = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    there = docs.select(F.col(id_col).alias("id")).distinct()
    chosen = of.where(~held_out("id", folds, fold)).join(there, "id", "left_semi")
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return texts.join(chosen, "id").select("text", F.col("label").cast("double").alias("label"))


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient**2 - self.v)
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-9)


def sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))

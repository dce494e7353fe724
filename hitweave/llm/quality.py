"""Text quality by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled
texts. A text is cut into blocks, each block is compressed with either
dictionary, and the summed sizes give the normalised difference
``(size with good - size with bad) / bytes``. A logistic curve fitted on the labelled texts turns it, with
the normalised size itself (text that repeats is short under any dictionary), into the probability of good quality.

Defined results: a null or empty text has no bytes and gets the share of good
among the training labels (one half without labels of both kinds); very long texts are read to their
end, block by block; equal texts get equal scores and repeated rows each a row; null ids
pass through; an empty table gives no rows; columns named in ``keep`` pass unchanged, others are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, labelled_texts, table, with_score

BLOCK = 2048
LEVEL = 3
THRESHOLD = 0.3


def dictionary(texts: list[str], size: int) -> bytes:
    """A zstandard dictionary of the blocks of ``texts``; raw content where there is too little to train on."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    samples = [r[at : at + BLOCK] for r in raw for at in range(0, len(r), BLOCK)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:] or b"\n"


class Scales:
    """Compressors with the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        made = [zstandard.ZstdCompressionDict(d) for d in (good, bad)]
        for d in made:
            d.precompute_compress(level=LEVEL)
        quiet = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.by = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, **quiet) for d in made]

    def weigh(self, text: str | None) -> tuple[float, float, float]:
        """Normalised difference, normalised size with the better dictionary, and 1 for text with bytes."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0, 0.0, 0.0
        good = bad = 0
        for at in range(0, len(raw), BLOCK):
            piece = raw[at : at + BLOCK]
            good += len(self.by[0].compress(piece))
            bad += len(self.by[1].compress(piece))
        return (good - bad) / len(raw), min(good, bad) / len(raw), 1.0


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    prior: float

    def score(self, weighed: np.ndarray) -> np.ndarray:
        x = np.clip((weighed[:, :2] - self.centre) / self.spread, -8, 8)
        x = np.column_stack([x, x**2, np.ones(len(x))])
        return np.where(weighed[:, 2] > 0, 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))), self.prior)


def train(texts: list[str], good: list[int], dictionary_bytes: int = 48 << 10, steps: int = 60) -> QualityModel | None:
    """Dictionaries from one half of the texts, calibration by Newton's steps on the other half."""
    label = np.array(good, float)
    if len(set(good)) < 2:
        return None
    halves = [[t for i, t in enumerate(texts) if good[i] == k and (i % 2 == 0 or len(texts) < 40)] for k in (1, 0)]
    made = [dictionary(t, dictionary_bytes) for t in halves]
    scales = Scales(*made)
    rest = [i for i in range(len(texts)) if i % 2 or len(texts) < 40]
    weighed, target = np.array([scales.weigh(texts[i]) for i in rest]), label[rest]
    centre, spread = weighed[:, :2].mean(axis=0), weighed[:, :2].std(axis=0) + 1e-6
    x = np.clip((weighed[:, :2] - centre) / spread, -8, 8)
    x = np.column_stack([x, x**2, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), 0.02 * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 0.5 * np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - target) + ridge @ w)
    return QualityModel(*made, w, centre, spread, float(label.mean()))


def fit(docs: DataFrame, labels: DataFrame, train_rows, per_class: int = 1200, max_chars: int = 20_000) -> QualityModel | None:
    """Train on a sample bounded by ``per_class`` rows a label (twice that at most) and ``max_chars`` a text."""
    return train(*labelled_texts(docs, labels, "quality", train_rows, per_class, max_chars))


def score_quality(docs: DataFrame, model: QualityModel | None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``score`` and ``predicted`` for every row of ``docs``."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scales = Scales(model.good, model.bad) if model else None
        for texts in batches:
            if model is None or not len(texts):
                yield pd.Series(np.full(len(texts), 0.5))
                continue
            yield pd.Series(model.score(np.array([scales.weigh(t) for t in texts])))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return with_score(docs, F.pandas_udf(run, "double")(F.col("text")), ["doc_id"] if keep is None else keep, THRESHOLD)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text; trained on labels of rows whose id fold is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, fold("doc_id", 5) != 0)
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return score_quality(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


QUERIES = {"op7_quality": op7_quality}
ORACLE_SQL: dict[str, str] = {}

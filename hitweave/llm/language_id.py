"""Language identification with error-correcting output codes.

Every language owns a codeword of +1/-1 bits. One linear classifier per bit,
over hashed character n-grams (as UTF-8 bytes of the lower-cased text),
predicts that bit. Decoding weighs each bit's logistic loss by how reliable the
bit proved on the training rows, and takes the codeword with the least loss;
a small lead over the runner-up flags the answer as ambiguous. A text whose bits are hardly better than
coin tosses (its least loss above ``COIN`` of theirs) and ambiguous besides is flagged as undecided: no learned language fits.

Defined results: a null text, or one without a letter, is ``und`` with score 0.
Without any labelled row every text is ``und``. Of languages whose codewords are equally near, the first by name is
taken and the answer is ambiguous. Very long texts are counted whole, piece by piece. Repeated rows each get a
row; null ids pass through; an empty table gives no rows; columns named in ``keep`` pass unchanged (but for those that are
made), others are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import class_sample, fold, table

BUCKETS = 1 << 13
PIECE = 1 << 20
COIN = 0.75 * float(np.log(2))


def codewords(n_classes: int, seed: int = 7) -> np.ndarray:
    """Rows of +1/-1: the exhaustive code up to five classes, else the best-spread of random codes."""
    if n_classes <= 1:
        return np.ones((n_classes, 1), np.float32)
    if n_classes <= 5:
        columns = [bits for bits in product((1, -1), repeat=n_classes) if bits[0] == 1 and -1 in bits]
        return np.array(columns, np.float32).T
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n_classes)))
    best, spread = None, -1
    for _ in range(200 if n_classes <= 256 else 2):
        code = rng.choice(np.array([-1, 1], np.float32), size=(n_classes, width))
        distance = (width - code @ code.T) / 2
        np.fill_diagonal(distance, width)
        if distance.min() > spread:
            best, spread = code, distance.min()
    return best


def ngram_counts(texts: list[str]) -> np.ndarray:
    """Unit-length rows of square-rooted counts of byte 2- and 3-grams."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    pieces: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        data = np.frombuffer(b"\n\n".join(pieces) + b"\n\n", np.uint8).astype(np.int32)
        lengths = np.array([len(p) + 2 for p in pieces])
        row = np.repeat(np.array(owner, np.int64) * BUCKETS, lengths)
        pair = data[:-2] * 257 + data[1:-1] * 31
        triple = data[:-2] * 7919 + data[1:-1] * 6151 + data[2:] * 433 + 77
        last, top = int(max(owner)) + 1, int(min(owner))
        base = row[:-2] - top * BUCKETS
        for grams in (pair, triple):
            counted = np.bincount(base + (grams & (BUCKETS - 1)), minlength=(last - top) * BUCKETS)
            out[top:last] += counted.reshape(last - top, BUCKETS)

    for i, text in enumerate(texts):
        raw = text.lower().encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(raw)), PIECE):
            pieces.append(raw[at : at + PIECE + 2])
            owner.append(i)
            size += len(pieces[-1])
            if size >= PIECE or len(pieces) >= 64:
                flush()
                pieces, owner, size = [], [], 0
    if pieces:
        flush()
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@dataclass
class EcocModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, features: np.ndarray) -> np.ndarray:
        margin = features @ self.weights + self.bias
        bit_loss = np.logaddexp(0, -margin[:, None, :] * self.code[None])
        return (bit_loss * self.trust).sum(axis=2) / self.trust.sum(axis=1)

    def decode(self, features: np.ndarray, slack: float) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, and whether the answer is ambiguous and undecided, for each row."""
        loss = self.losses(features)
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        likely = np.exp(-4.0 * (loss - loss.min(axis=1, keepdims=True)))
        score = likely[np.arange(len(loss)), best] / likely.sum(axis=1)
        if loss.shape[1] == 1:
            return [self.languages[0]] * len(loss), np.ones(len(loss)), *np.zeros((2, len(loss)), bool)
        lead = loss[np.arange(len(loss)), order[:, 1]] - loss[np.arange(len(loss)), best]
        return [self.languages[k] for k in best], score, lead < slack, (lead < 2 * slack) & (loss.min(axis=1) > COIN)


def train(texts: list[str], langs: list[str], steps: int = 120, rate: float = 30.0) -> EcocModel | None:
    """Fit one logistic regression per code bit by full-batch gradient descent."""
    languages = sorted(set(langs))
    if not languages:
        return None
    code = codewords(len(languages))
    at = np.array([languages.index(x) for x in langs])
    target, x = code[at], ngram_counts(texts)
    share = 1.0 / np.bincount(at, minlength=len(languages))[at]
    share = (share / share.sum())[:, None].astype(np.float32)
    weights, bias = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    for _ in range(steps):
        pull = share * target / (1 + np.exp(target * (x @ weights + bias)))
        weights += rate * (x.T @ pull - 1e-4 * weights)
        bias += pull.sum(axis=0)
    right = (np.sign(x @ weights + bias) == target).astype(np.float32)
    trust = np.stack([right[at == k].mean(axis=0) for k in range(len(languages))]) + 1e-3
    return EcocModel(languages, code, weights, bias, trust.astype(np.float32))


def fit(docs: DataFrame, per_language: int = 300, max_chars: int = 20_000) -> EcocModel | None:
    """Train on about ``per_language`` rows a language with non-null ``lang`` and ``text``.

    The sample is bounded by ``per_language`` rows, ``max_chars`` a text and 2^16 rows of all languages together (twice that at most).
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sized = known.select("doc_id", "lang", "text").filter(F.char_length("text") <= max_chars)
    picked = class_sample(sized, "lang", per_language).collect()
    picked.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    return train([r["text"] for r in picked], [r["lang"] for r in picked])


def identify(
    docs: DataFrame, model: EcocModel | None, keep: list[str] | None = None, slack: float = 0.05
) -> DataFrame:
    """``keep`` columns and ``lang_pred, score, ambiguous, undecided`` for every row of ``docs``."""
    made = ("lang_pred", "score", "ambiguous", "undecided")
    kept = [c for c in (["doc_id"] if keep is None else keep) if c not in made]
    kind = F.pandas_udf(_identifier(model, slack), "lang_pred string, score double, ambiguous boolean, undecided boolean")
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), kind(F.col("text")).alias("found"))
    return found.select(*[F.col(f"row.`{c}`") for c in kept], *[F.col(f"found.{c}") for c in made])


def _identifier(model: EcocModel | None, slack: float):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n = len(texts)
            lang, score = np.full(n, "und", object), np.zeros(n)
            unsure, lost = np.ones((2, n), bool)
            step = max(1, min(256, (1 << 22) // model.code.size)) if model else 1
            worth = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
            for at in range(0, len(worth) if model else 0, step):
                part = worth[at : at + step]
                names, scores, ambiguous, undecided = model.decode(ngram_counts([texts.iloc[i] for i in part]), slack)
                lang[part], score[part], unsure[part], lost[part] = names, scores, ambiguous, undecided
            yield pd.DataFrame({"lang_pred": lang, "score": score, "ambiguous": unsure, "undecided": lost})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return run


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; trained on rows whose id fold is not 0."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = fit(docs.filter(~held_out))
    return identify(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


QUERIES = {"op1_language_id": op1_language_id}
ORACLE_SQL: dict[str, str] = {}

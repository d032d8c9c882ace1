"""Quality classifier learned from trusted positives and unlabelled texts.

Positive-unlabelled learning: the risk of the unseen negatives is what the unlabelled
texts cost as negatives, less the share that positives among them cause. That difference
estimates a risk and cannot be negative, so training minimises the risk with it held at
zero or above (non-negative risk). The share of positives among unlabelled texts, the
class prior, is estimated first from a plain positive-against-unlabelled score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import result_texts
from .words import blocks

# Rows of each kind a classifier is fitted on, at most about; bounds of ``learn_quality``.
POSITIVE_ROWS, UNLABELLED_ROWS = 6_000, 12_000
BINS = 12
STEPS, RATE, DECAY = 800, 0.05, 1e-5

FEATURES = (
    "words", "word_bytes", "word_spread", "capitals", "digits", "symbols", "exclaims", "bars", "stops", "commas", "other_marks",
    "non_ascii", "lines_per_word", "distinct", "commonest", "adjacent_repeats", "short_words", "long_words", "capital_words",
    "letters", "repeated_lines",
)


def _byte_classes() -> dict[str, np.ndarray]:
    def table(chars: bytes) -> np.ndarray:
        out = np.zeros(256, np.int32)
        out[list(chars)] = 1
        return out

    lower, upper = bytes(range(97, 123)), bytes(range(65, 91))
    marks = bytes(c for c in range(33, 127) if not chr(c).isalnum())
    high = table(bytes(range(128, 256)))
    return {
        "capitals": table(upper), "digits": table(b"0123456789"), "symbols": table(b"#*$%&<>@^~_=+"), "exclaims": table(b"!"),
        "bars": table(b"|"), "stops": table(b"."), "commas": table(b","), "other_marks": table(marks), "non_ascii": high,
        "letters": table(lower + upper) + high, "lines": table(b"\n"),
    }


def text_features(texts: list[str | None]) -> np.ndarray:
    """``FEATURES`` of each text; an empty text has zeros throughout."""
    classes = _byte_classes()
    out = []
    for block in blocks(texts):
        n = block.size
        x = dict.fromkeys(FEATURES)
        words = (block.word_ends - block.word_starts).astype(float)
        per = np.maximum(words, 1)
        text = block.text_of_word()
        size = (block.ends - block.starts).astype(float)
        by_text = lambda values: np.bincount(text, weights=values, minlength=n)
        bytes_ = by_text(size)
        for name, table in classes.items():
            x[name] = np.add.reduceat(table[block.bytes], block.text_starts) / np.maximum(bytes_, 1)
        lines = x.pop("lines") * np.maximum(bytes_, 1)
        x["words"] = np.log1p(words)
        x["word_bytes"] = bytes_ / per
        x["word_spread"] = np.sqrt(np.maximum(by_text(size**2) / per - x["word_bytes"] ** 2, 0))
        x["lines_per_word"] = lines / per
        x["short_words"], x["long_words"] = by_text(size <= 3) / per, by_text(size >= 14) / per
        first = block.bytes[block.starts] if len(block.starts) else np.zeros(0, np.uint8)
        x["capital_words"] = by_text(classes["capitals"][first]) / per
        hashes = block.word_hashes()
        order = np.lexsort((hashes, text))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
        x["distinct"] = np.bincount(text[order][new], minlength=n) / per
        runs = np.diff(np.append(np.flatnonzero(new), len(order)))
        most = np.zeros(n)
        np.maximum.at(most, text[order][new], runs)
        x["commonest"] = most / per
        again = np.zeros(len(hashes))
        again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
        x["adjacent_repeats"] = by_text(again) / per
        x["repeated_lines"] = np.zeros(n)
        for k, content in enumerate(texts[block.first : block.first + n]):
            if content and "\n" in content:
                parts = content.split("\n")
                x["repeated_lines"][k] = 1 - len(set(parts)) / len(parts)
        features = np.stack([x[name] for name in FEATURES], axis=1)
        features[words == 0] = 0
        out.append(features)
    return np.concatenate(out).astype(np.float32) if out else np.zeros((0, len(FEATURES)), np.float32)


@dataclass(frozen=True)
class QualityModel:
    """A linear score over binned features; ``prior`` is the estimated share of positives."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, features: np.ndarray) -> np.ndarray:
        total = np.full(len(features), self.bias)
        for j, edges in enumerate(self.edges):
            total += self.weights[j, np.searchsorted(edges, features[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _one_hot(features: np.ndarray, edges: np.ndarray) -> np.ndarray:
    bins = edges.shape[1] + 1
    out = np.zeros((len(features), len(edges) * bins), np.float32)
    for j, own in enumerate(edges):
        out[np.arange(len(features)), j * bins + np.searchsorted(own, features[:, j], side="right")] = 1
    return out


def _fit(positive: np.ndarray, unlabelled: np.ndarray, gradient) -> np.ndarray:
    """Adam on the linear score; ``gradient`` gives the risk's slope at each row's score."""
    both = np.concatenate([positive, unlabelled])
    both = np.concatenate([both, np.ones((len(both), 1), np.float32)], axis=1)
    w = np.zeros(both.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        slope = gradient(both @ w, len(positive)).astype(np.float32)
        g = slope @ both + np.append(DECAY * w[:-1], 0).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _plain_slope(z: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([-_sigmoid(-z[:n]) / n, _sigmoid(z[n:]) / (len(z) - n)])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled rows, from held-out scores of both.

    Above any score lie at least the positives of the unlabelled rows, so the ratio of the
    two shares above it bounds the prior. The bound with the least slack for chance is taken.
    """
    cuts = np.quantile(positive, np.linspace(0, 0.98, 200))
    above = lambda rows: 1 - np.searchsorted(np.sort(rows), cuts, side="left") / len(rows)
    p, u = above(positive), above(unlabelled)
    slack = np.sqrt(np.log(40) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)
    best = np.argmin((u + slack) / np.maximum(p, 1e-9))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.02, 0.98))


def learn_quality(
    results: DataFrame, trusted: DataFrame, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS
) -> QualityModel | None:
    """A classifier from the ``result_text`` of semantic results and the ids that are trusted.

    Results whose object_id is in ``trusted`` are positives; all of them, whatever they are,
    are the unlabelled texts. Of more than the given numbers of rows a random share of about
    that many is taken; so the ids that are broadcast and the features that reach the driver
    are bounded, and no text is shuffled. Without positives or texts there is nothing to learn
    and the model is None.
    """
    rows = results.select("object_id", F.col("result_text").cast("string").alias("result_text"))
    ids = trusted.select("object_id").filter("object_id IS NOT NULL").distinct()
    counts = {"p": ids.count(), "u": rows.count()}
    if not counts["p"] or not counts["u"]:
        return None
    # Chosen by hash, so that the choice does not depend on the order of rows.
    chosen = ids.filter(F.pmod(F.xxhash64(F.lit(3), "object_id"), F.lit(1 << 30)) < int(min(1.0, positive_rows / counts["p"]) * (1 << 30)))

    def measured(part: DataFrame, have: int, want: int, seed: int) -> np.ndarray:
        part = part.sample(min(1.0, want / have), seed=seed) if have > want else part

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = text_features(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32()))], ["x"])

        found = part.select("result_text").mapInArrow(run, "x array<float>").toPandas()["x"]
        return np.stack(found.to_numpy()) if len(found) else np.zeros((0, len(FEATURES)), np.float32)

    positive = measured(rows.join(F.broadcast(chosen), "object_id", "left_semi"), 0, positive_rows, 1)
    unlabelled = measured(rows, counts["u"], unlabelled_rows, 2)
    if not len(positive) or not len(unlabelled):
        return None
    edges = np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    # Outer bins, where junk is, are cut finer.
    outer = np.quantile(unlabelled, [0.01, 0.03, 0.97, 0.99], axis=0).T
    edges = np.sort(np.concatenate([edges, outer], axis=1), axis=1)
    shuffled = lambda rows: _one_hot(rows, edges)[np.random.default_rng(1).permutation(len(rows))]
    p, u = shuffled(positive), shuffled(unlabelled)

    half_p, half_u = len(p) // 2, len(u) // 2
    if half_p and half_u:
        plain = _fit(p[:half_p], u[:half_u], _plain_slope)
        prior = estimate_prior(p[half_p:] @ plain[:-1], u[half_u:] @ plain[:-1])
    else:
        prior = 0.5

    def non_negative(z: np.ndarray, n: int) -> np.ndarray:
        """Slope of prior·R(p,+) + max(0, R(u,−) − prior·R(p,−)), logistic loss."""
        zp, zu = z[:n], z[n:]
        loss_negative = lambda s: np.logaddexp(0, s)
        rest = loss_negative(zu).mean() - prior * loss_negative(zp).mean()
        if rest >= 0:
            return np.concatenate([(-prior * _sigmoid(-zp) - prior * _sigmoid(zp)) / n, _sigmoid(zu) / len(zu)])
        # Below zero the excess is taken back before anything else.
        return np.concatenate([prior * _sigmoid(zp) / n, -_sigmoid(zu) / len(zu)])

    w = _fit(p, u, non_negative)
    return QualityModel(edges, w[:-1].reshape(len(edges), -1).astype(float), float(w[-1]), prior)


def score_quality(results: DataFrame, model: QualityModel | None) -> DataFrame:
    """Quality score of the text of every semantic result.

    Reads ``object_id, result_text`` and returns per input row object_id and ``confidence`` (0
    to 1, higher: more like the trusted texts). One pass, no shuffle.

    Null and empty texts are scored by their features, all zero. Without a model every
    confidence is 0.5. Repeated rows are scored each for itself, a null object_id is carried
    through, an empty table gives no rows, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                scores = np.full(part.num_rows, 0.5) if model is None else model.score(text_features(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], ["object_id", "confidence"])

    texts = result_texts(results)
    return texts.mapInArrow(run, T.StructType([texts.schema["object_id"], T.StructField("confidence", T.DoubleType())]))

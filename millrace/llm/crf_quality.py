"""Document quality by a linear-chain conditional random field over lines.

Every line with a word gets features of its own and of its two neighbours; a chain with the labels bad
and good runs over a document's lines. Forward and backward messages give each line's probability of
being good; the document's score is their mean, weighted by the lines' numbers of characters.

The chain learns from documents with a label of their own: all lines of a document carry its label.
Training takes at most ``max_documents`` of them (those with the smallest hash of doc_id, and of a
document with more than ``max_lines`` lines so many neighbouring ones), on the driver, from features that
the executors compute; scoring reads every whole text.
"""

from __future__ import annotations

import operator
import re
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import fresh, slices, text_column, written

_SYMBOLS, _DIGITS, _ENDS = b"#*$%&|<>{}[]\\^~@=+_", b"0123456789", b".!?:;\"')"
_NOT_UPPER = re.compile(r"[a-zß-öø-ÿ]")
OWN = 14
#: Features of a line: its own, the previous line's, the next line's, whether it is first or last, one.
WIDTH = 3 * OWN + 3
#: Lines whose features are turned into an array at once.
BLOCK = 1 << 14


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) of the lines with a word; a text without any is one line of no length. Rows become
    arrays by blocks, so that a text of very many lines costs numbers and not objects."""
    blocks, rows, seen = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        n, data = len(words), line.encode()
        size = len(data)
        lower = line.lower()
        distinct = len(set(words))
        same = sum(map(operator.eq, words, words[1:]))
        capital = sum(map(str.isupper, words))
        rows.append((
            min(n, 200) / 50, min(size / n, 30) / 10, distinct / n, same / n, capital / n,
            (size - len(data.translate(None, _SYMBOLS))) / n, (size - len(data.translate(None, _DIGITS))) / size,
            line.count("!") / n, line.count("|") / n, (line.count(".") + line.count(",")) / n,
            float(data[-1] in _ENDS), float(lower in seen), float(n < 5), sum(map(str.isalpha, words)) / n,
            len(line),
        ))
        seen.add(lower)
        if len(rows) == BLOCK:
            blocks.append(np.array(rows, np.float32))
            rows = []
    if not rows and not blocks:
        return np.concatenate([np.zeros((1, 3 * OWN)), [[1.0, 1.0, 1.0]]], 1).astype(np.float32), np.ones(1, np.float32)
    own = np.concatenate([*blocks, np.array(rows, np.float32).reshape(-1, OWN + 1)])
    out = np.zeros((len(own), WIDTH), np.float32)
    out[:, :OWN] = own[:, :OWN]
    out[1:, OWN : 2 * OWN] = own[:-1, :OWN]
    out[:-1, 2 * OWN : 3 * OWN] = own[1:, :OWN]
    out[0, 3 * OWN], out[-1, 3 * OWN + 1], out[:, 3 * OWN + 2] = 1, 1, 1
    return out, own[:, OWN]


def _lse(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(unary: np.ndarray, lengths: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once.

    unary: for all lines, one document after another, the score of good (bad scores 0); links: 2 x 2
    scores of (label, next label). Returns (log partition of each chain, probability of good of each
    line, expected 2 x 2 counts of links over all chains).
    """
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
    size, steps = lengths[order], int(lengths.max())
    live = np.searchsorted(-size, -np.arange(1, steps + 1), "right")  # chains with a line at each step
    fwd = np.zeros((len(unary), 2))
    fwd[starts, 1] = unary[starts]
    for t in range(1, steps):
        at = starts[: live[t]] + t
        p = fwd[at - 1]
        fwd[at, 0] = _lse(p[:, 0] + links[0, 0], p[:, 1] + links[1, 0])
        fwd[at, 1] = _lse(p[:, 0] + links[0, 1], p[:, 1] + links[1, 1]) + unary[at]
    ends = starts + size - 1
    log_z = np.zeros(len(lengths))
    log_z[order] = _lse(fwd[ends, 0], fwd[ends, 1])
    bwd, pair, z_sorted = np.zeros((len(unary), 2)), np.zeros((2, 2)), log_z[order]
    for t in range(steps - 1, 0, -1):
        at, z = starts[: live[t]] + t, z_sorted[: live[t]]
        ahead = bwd[at].copy()
        ahead[:, 1] += unary[at]
        for i in (0, 1):
            joint = [links[i, j] + ahead[:, j] for j in (0, 1)]
            bwd[at - 1, i] = _lse(*joint)
            for j in (0, 1):
                pair[i, j] += np.exp(fwd[at - 1, i] + joint[j] - z).sum()
    good = np.exp(fwd[:, 1] + bwd[:, 1] - np.repeat(log_z, lengths))
    return log_z, good, pair


@dataclass
class LineCrf:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    links: np.ndarray

    @classmethod
    def fit(cls, features: list[np.ndarray], labels: np.ndarray, steps: int = 150, penalty: float = 1e-3) -> LineCrf:
        """Maximise the penalised likelihood of the label chains with Adam. Without documents, or with
        one label alone, the model gives that label's share (0.5 without any) to every line."""
        if not features or len(set(labels.tolist())) < 2:
            share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
            w = np.zeros(WIDTH)
            w[-1] = np.log(share / (1 - share))
            return cls(np.zeros(WIDTH), np.ones(WIDTH), w, np.zeros((2, 2)))
        x, lengths = np.concatenate(features).astype(np.float64), np.array([len(f) for f in features])
        mean, scale = x.mean(0), x.std(0) + 1e-6
        mean[-1], scale[-1] = 0, 1
        x = (x - mean) / scale
        y = np.repeat(labels, lengths).astype(np.float64)
        seen = np.zeros((2, 2))
        for label in (0, 1):
            seen[label, label] = (lengths[labels == label] - 1).sum()
        w, links = np.zeros(WIDTH), np.zeros((2, 2))
        theta, m, v = np.zeros(WIDTH + 4), 0.0, 0.0
        for step in range(1, steps + 1):
            w, links = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
            _, good, pair = marginals(x @ w, lengths, links)
            grad = np.concatenate([x.T @ (y - good), (seen - pair).ravel()]) / len(lengths) - penalty * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(mean, scale, theta[:WIDTH].copy(), theta[WIDTH:].reshape(2, 2).copy())

    def lines(self, features: list[np.ndarray]) -> np.ndarray:
        """Probability of good of every line."""
        x = (np.concatenate(features) - self.mean) / self.scale
        return marginals(x @ self.weights, np.array([len(f) for f in features]), self.links)[1]

    def scores(self, texts: list[str]) -> np.ndarray:
        pairs = [line_features(t) for t in texts]
        good = self.lines([f for f, _ in pairs])
        weight = np.concatenate([w for _, w in pairs]).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum([len(f) for f, _ in pairs])[:-1]])
        return np.clip(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 0, 1)


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 3; 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fit_quality(documents: DataFrame, labels: DataFrame, max_documents: int = 3000, max_lines: int = 400) -> LineCrf:
    """Learn from at most ``max_documents`` labelled rows whose fold isn't 1.

    A doc_id with several labels has the greatest, and one with several texts that of the least hash; null
    labels and doc_ids are left out, and labels of documents that aren't there don't count. Of a text with
    more than ``max_lines`` lines, so many neighbouring ones from a place that its hash gives are learnt
    from. Only the chosen ids (a bounded number) are broadcast. Without labelled documents of both kinds
    there is nothing to learn: a warning says so, and the model is a constant.
    """
    doc = F.col("doc_id").cast("long")
    usable = labels.select(doc.alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label is not null").where(fold(F.col("doc_id")) != 1)
    there = documents.select(doc.alias("doc_id"))
    present = usable.groupBy("doc_id").agg(F.max("label").alias("label")).join(there, "doc_id", "left_semi")
    chosen = written(present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents), "labelled")

    def run(batches):
        for batch in slices(batches):
            rows = []
            for doc_id, text_hash, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                features = line_features(text)[0]
                if len(features) > max_lines:
                    at = text_hash % (len(features) - max_lines + 1)
                    features = features[at : at + max_lines]
                rows.append((doc_id, text_hash, label, features.tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "text_hash", "label", "features"])

    texts = documents.select(doc.alias("doc_id"), text_column().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", F.xxhash64("text"), "label", "text")
    found = texts.mapInArrow(run, "doc_id long, text_hash long, label int, features binary")
    got = found.groupBy("doc_id").agg(F.min(F.struct("text_hash", "label", "features")).alias("row")).select("row.*").collect()
    got = sorted(got, key=lambda r: bytes(r["features"]))  # the fit doesn't depend on the order of tasks
    kinds = {r["label"] for r in got}
    if len(kinds) < 2:
        warnings.warn(f"quality: {len(got)} labelled documents, of labels {sorted(kinds)}: nothing is learnt", RuntimeWarning, stacklevel=2)
    return LineCrf.fit([np.frombuffer(r["features"], np.float32).reshape(-1, WIDTH) for r in got], np.array([r["label"] for r in got]))


def score_quality(documents: DataFrame, model: LineCrf) -> DataFrame:
    """All columns of ``documents`` and score double, predicted int. Map-only.

    A null or empty text, or one without words, is a chain of one empty line. Columns named score or
    predicted are replaced.
    """
    kept = documents.drop("score", "predicted")

    def run(batches):
        for part in slices(batches, 512):
            score = model.scores(part.column(part.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=[*part.schema.names[:-1], "score", "predicted"])

    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return kept.select("*", text_column().alias(fresh(kept, "text")[0])).mapInArrow(run, schema)

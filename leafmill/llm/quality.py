"""Text quality by histogram gradient-boosted trees over document statistics.

Trees are grown on quantile-binned features, depth by depth, with logistic loss, and kept
as flat arrays of a perfect binary tree each, so that prediction is ``depth`` vectorised
index steps per tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import chunks, column, tidy, utf8

BINS, DEPTH, TREES, RATE = 64, 4, 80, 0.15

_SETS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256),
    "space": [9, 10, 11, 12, 13, 32], "stop": b".", "comma": b",;:", "loud": b"!?", "bar": b"|",
    "symbol": b"#$%&*@^~`\\", "bracket": b"<>[]{}()", "mark": b"\"'-_/+=", "control": [*range(9), *range(14, 32), 127],
}
_CLASSES = np.zeros((256, len(_SETS)))
for _k, _members in enumerate(_SETS.values()):
    _CLASSES[list(_members), _k] = 1
FEATURES = len(_SETS) + 15


def statistics(texts: list[bytes]) -> np.ndarray:
    """Features (texts x FEATURES) of whole texts: byte classes, words, lines and repetition."""
    out = np.zeros((len(texts), FEATURES))
    if not texts:
        return out
    size = np.array([len(t) for t in texts])
    doc = np.repeat(np.arange(len(texts)), size)
    counts = np.bincount(doc * 256 + np.frombuffer(b"".join(texts), np.uint8), minlength=256 * len(texts)).reshape(-1, 256)
    n = np.maximum(size, 1)
    k = len(_SETS)
    out[:, :k] = counts @ _CLASSES / n[:, None]
    share = counts / n[:, None]
    out[:, k] = -(share * np.log(np.maximum(share, 1e-12))).sum(1)
    out[:, k + 1] = np.log1p(size)
    for i, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        distinct = set(words)
        lines = text.split(b"\n")
        long = [x for x in lines if x.strip()]
        many = len(words)
        row = out[i]
        row[k + 2] = np.log1p(many)
        row[k + 3] = size[i] / many
        row[k + 4] = len(distinct) / many
        row[k + 5] = np.log(len(distinct) + 1) / np.log(many + 1)
        row[k + 6] = 1 - len(set(long)) / len(long)
        row[k + 7] = np.log(many / len(long))
        row[k + 8] = (text.count(b". ") + text.count(b".\n") + text.endswith(b".")) / many
        row[k + 9] = sum(map(_short, words)) / many
        row[k + 10] = sum(map(bytes.isalpha, words)) / many
        row[k + 11] = sum(map(bytes.isupper, words)) / many
        row[k + 12] = sum(map(bytes.istitle, words)) / many
        row[k + 13] = max(map(len, words))
        row[k + 14] = max(map(len, lines)) / size[i]
    return out


def _short(word: bytes) -> bool:
    return len(word) < 4


@dataclass(frozen=True)
class Trees:
    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes: values above go right
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosts TREES trees; without rows, or with one label only, the score is constant."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    feature, cut, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    if len(np.unique(y)) < 2:
        return Trees(base, feature[:0], cut[:0], leaf[:0])
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
    columns = np.arange(x.shape[1]) * BINS
    total = np.full(len(y), base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            flat = ((node - first)[:, None] * (x.shape[1] * BINS) + columns + binned).ravel()
            shape = (width, x.shape[1], BINS)
            g = np.bincount(flat, np.repeat(grad, x.shape[1]), np.prod(shape)).reshape(shape).cumsum(2)
            h = np.bincount(flat, np.repeat(hess, x.shape[1]), np.prod(shape)).reshape(shape).cumsum(2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
            gain[(h < 1) | (ht - h < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[t, first + k], cut[t, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        at = node - inner
        leaf[t] = -RATE * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + 1)
        total += leaf[t][at]
    return Trees(base, feature, cut, leaf)


def learn_quality(docs: DataFrame, labels: DataFrame, training: Column, fit_rows: int = 12000) -> Trees:
    """Fits on the statistics of at most fit_rows labelled documents, chosen by a hash of doc_id.

    Labels that are null or have no document are not learned from; with one kind of label or
    none the score is constant.
    """
    spark = docs.sparkSession
    chosen = labels.where(training & F.col("quality").isNotNull()).select("doc_id", "quality")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(fit_rows).collect()
    ids = spark.createDataFrame([(r[0], int(r[1])) for r in chosen], "doc_id long, quality int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 1 << 20):
            x = statistics([t or b"" for t in utf8(column(part, "text"))])
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "quality"), rows], ["doc_id", "quality", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").mapInArrow(tidy(run), "doc_id long, quality int, x array<double>").toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES) if rows.num_rows else np.zeros((0, FEATURES))
    return fit_trees(x[order], rows["quality"].to_numpy()[order].astype(float))


def predict_quality(docs: DataFrame, trees: Trees, threshold: float = 0.7) -> DataFrame:
    """docs with score and predicted; only the column text is looked at.

    A null text counts as an empty one, which is scored like any other.  Existing columns of
    the two names are replaced.  Every row gives one row.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(trees)  # bounded: TREES perfect trees of DEPTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 1 << 20):
            score = sent.value.score(statistics([t or b"" for t in utf8(column(part, "text"))]))
            yield pa.RecordBatch.from_arrays(
                [*(column(part, c) for c in kept), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                [*kept, "score", "predicted"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema)
    return docs.select(kept).mapInArrow(tidy(run), f"{fields}, score double, predicted int")

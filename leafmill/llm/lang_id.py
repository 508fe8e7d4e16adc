"""Language identification by error-correcting output codes over hashed byte n-grams.

Every language gets a codeword; for each bit of the codewords one binary logistic
classifier is fitted over hashed byte trigrams of the lower-cased text (two spaces at the
end and one in front).  A text's margins are the means of its trigrams' weights; decoding
takes the codeword of least summed logistic loss, and flags a text whose second-best
codeword is within ``AMBIGUOUS`` of the best.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from leafmill.llm.common import chunks, column, tidy, utf8, written

BUCKETS = 1 << 15
SCALE = 40.0
#: Loss difference between the two best codewords under which a text is ambiguous.
AMBIGUOUS = 0.35
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_ASCII = re.compile(rb"[A-Za-z]")


def code_book(k: int) -> np.ndarray:
    """Codewords (k x bits, +1/-1): all splits of up to 7 classes, else random ones far apart."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 7:
        bits = [b for b in itertools.product((1, -1), repeat=k) if b[0] == 1 and -1 in b]
        return np.array(bits, np.int8).T
    rng, width, best, apart = np.random.default_rng(17), 8 * int(np.ceil(np.log2(k))), None, -1
    for _ in range(200):
        book = rng.choice(np.array([1, -1], np.int8), (k, width))
        gap = int(((width - book.astype(int) @ book.T.astype(int)) // 2 + width * np.eye(k, dtype=int)).min())
        if gap > apart and (abs(book.sum(0)) < k).all():
            best, apart = book, gap
    return best


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    book: np.ndarray
    weights: np.ndarray  # BUCKETS x bits, float32
    bias: np.ndarray


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of the padded texts, and each text's number of them (1 at least)."""
    joined = b"".join(b" " + t + b"  " for t in texts)
    low = _LOWER[np.frombuffer(joined, np.uint8)]
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    code *= np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    code >>= np.uint32(17)
    size = np.array([len(t) + 3 for t in texts], dtype=np.int64)
    keep = np.ones(len(low), dtype=bool)
    ends = np.cumsum(size)
    keep[ends - 1] = False
    keep[ends - 2] = False
    return code[keep[:-2]], size - 2


def _margins(model: LanguageModel, texts: list[bytes]) -> np.ndarray:
    grams, n = _trigrams(texts)
    starts = np.cumsum(n) - n
    total = np.add.reduceat(model.weights[grams], starts, axis=0, dtype=np.float32)
    return total * (SCALE / n)[:, None] + model.bias


def fit_language_model(texts: list[bytes], languages: list[str], epochs: int = 14) -> LanguageModel:
    """Fits the bit classifiers by mini-batch AdaGrad; no rows give a model without languages."""
    names = tuple(sorted(set(languages)))
    book = code_book(len(names))
    if not names:
        return LanguageModel(names, book, np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    y = book[np.searchsorted(np.array(names), np.array(languages))].astype(np.float64)
    grams, n = _trigrams(texts)
    doc = np.repeat(np.arange(len(texts)), n)
    key, times = np.unique(doc * BUCKETS + grams, return_counts=True)
    doc, gram = key // BUCKETS, key % BUCKETS
    value = times * SCALE / n[doc]
    begin = np.searchsorted(doc, np.arange(len(texts) + 1))
    bits = book.shape[1]
    w, seen, bias = np.zeros((BUCKETS, bits)), np.full((BUCKETS, bits), 1e-6), np.zeros(bits)
    share = np.bincount(np.searchsorted(np.array(names), np.array(languages)))
    weight = (len(texts) / len(names) / share)[np.searchsorted(np.array(names), np.array(languages))]
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 128)):
            rows = np.sort(rows)
            at = np.concatenate([np.arange(begin[r], begin[r + 1]) for r in rows])
            local = np.repeat(np.arange(len(rows)), begin[rows + 1] - begin[rows])
            g, v = gram[at], value[at]
            f = np.stack([np.bincount(local, v * w[g, b], len(rows)) for b in range(bits)], 1) + bias
            slope = -y[rows] / (1 + np.exp(np.clip(y[rows] * f, -30, 30))) * weight[rows, None] / len(rows)
            for b in range(bits):
                step = np.bincount(g, v * slope[local, b], BUCKETS)
                seen[:, b] += step * step
                w[:, b] -= 0.2 * step / np.sqrt(seen[:, b])
            bias -= 0.05 * slope.sum(0)
    return LanguageModel(names, book, w.astype(np.float32), bias)


def _smallest_hashes(ids: DataFrame, wanted: int) -> DataFrame:
    """Of ids(doc_id, lang) a few times wanted of each language, with all of its wanted smallest hashes among them.

    A language's share of the hashes is set by its rows, and doubled until it holds enough; so
    no language, however common, is sorted in one task.
    """
    counts = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    share = {k: min(1.0, 3 * wanted / n) for k, n in counts.items()}
    place = F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5
    while True:
        limits = ids.sparkSession.createDataFrame(list(share.items()), "lang string, most double")
        near = ids.join(F.broadcast(limits), "lang").where(place <= F.col("most")).drop("most")
        held = {r["lang"]: r["n"] for r in near.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        short = [k for k, n in counts.items() if share[k] < 1 and held.get(k, 0) < min(wanted, n)]
        if not short:
            return near
        share |= {k: min(1.0, 2 * share[k]) for k in short}


def learn_languages(docs: DataFrame, training: Column, rows_per_language: int = 500) -> LanguageModel:
    """Fits on at most rows_per_language labelled rows of each language, chosen by a hash of doc_id.

    Rows without text, lang or doc_id are not learned from; without any, every text is ``und``.
    What is gathered is rows_per_language times the number of languages.
    """
    ids = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    ids = written(ids, "ids")  # texts are read once for it
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    near = _smallest_hashes(ids, rows_per_language)
    chosen = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= rows_per_language).select("doc_id").distinct().collect()
    ids = docs.sparkSession.createDataFrame([(r[0],) for r in chosen], "doc_id long")
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    return fit_language_model([r["text"].encode() for r in rows], [r["lang"] for r in rows])


def decode(model: LanguageModel, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text."""
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    f = _margins(model, [t or b"" for t in texts])
    loss = np.logaddexp(0, -f[:, None, :] * model.book[None, :, :]).sum(2)
    order = np.sort(loss, axis=1)
    p = np.exp(order[:, :1] - loss)
    score = 1 / p.sum(1)
    unclear = (order[:, 1] - order[:, 0] < AMBIGUOUS) if len(model.languages) > 1 else np.zeros(len(texts), bool)
    best = loss.argmin(1)
    names = [model.languages[b] for b in best]
    for i, t in enumerate(texts):
        if not t or not _has_letter(t):
            names[i], score[i], unclear[i] = "und", 0.0, True
    return names, score, unclear


def _has_letter(text: bytes) -> bool:
    return bool(_ASCII.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred, score and ambiguous; only the column text is looked at.

    Null, empty and letterless texts are ``und`` with score 0.  Existing columns of the three
    names are replaced.  Every row gives one row.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS x bits weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 1 << 20):
            names, score, unclear = decode(sent.value, utf8(column(part, "text")))
            yield pa.RecordBatch.from_arrays(
                [*(column(part, c) for c in kept), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(unclear)],
                [*kept, "lang_pred", "score", "ambiguous"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema)
    return docs.select(kept).mapInArrow(tidy(run), f"{fields}, lang_pred string, score double, ambiguous boolean")

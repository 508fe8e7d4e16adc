"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation.

Outputs are the document end, the most frequent training words, and classes of all other
words by their endings, within which a word has its smoothed share of the training counts.
Both kinds of classes grow with the number of distinct training words, by its cube root: the
normalisers of all pairs of contexts grow with the square of the classes, and so with less
than the words.
The two preceding classes predict the next through class vectors: the score of class w
after (c1, c2) is r_w . (q_c1 C1 + q_c2 C2) + b_w.  Since it is a sum of one term per
context place, the normalisers of all contexts are one matrix product of exponentials.

Training sees all training documents, twice: every task follows noise-contrastive gradients
from the same start over its documents, in single precision, and the parameters are averaged by words seen.

Counts are exact over all training documents.  Documents are cut into blocks of bounded
size; a block sends each of its distinct words once with its count, gets back the corpus
count of each, and is scored with those alone, so no task or broadcast holds the corpus's
words and a frequent word costs one row a block.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import chunks, column, tidy, utf8, written

BLOCK_BYTES = 12 << 20
DIM, BATCH, NOISE, ROUNDS, RATE = 24, 2048, 96, 2, 0.05
#: Noise words to each word, in expectation; a batch's are drawn once for all its positions.
_RATIO = 8.0
#: Classes by ending to the cube root of the distinct training words.
ENDINGS = 4
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


@dataclass
class Shape:
    """The classes: 0 the end, 1..n the frequent words, then those by ending, and the start (context only)."""

    words: dict[bytes, int]
    share: np.ndarray  # unigram probability of each output class

    @property
    def outputs(self) -> int:
        return len(self.share)

    @property
    def endings(self) -> int:
        return len(self.share) - len(self.words) - 1


class LogBilinear:
    """Parameters as one flat vector: q (contexts x DIM), r (outputs x DIM), C1, C2, b."""

    def __init__(self, share: np.ndarray, flat: np.ndarray | None = None):
        n = len(share)
        sizes = [(n + 1, DIM), (n, DIM), (DIM, DIM), (DIM, DIM), (n,)]
        if flat is None:
            rng = np.random.default_rng(11)
            parts = [rng.normal(0, 0.1, s) for s in sizes[:2]] + [np.eye(DIM), np.eye(DIM) * 0.5, np.log(share)]
            flat = np.concatenate([p.ravel() for p in parts])
        self.flat, self.noise = flat.astype(np.float32), share
        self.log_noise = np.log(_RATIO * share).astype(np.float32)
        self.sums = np.cumsum(share)
        at, views = 0, []
        for s in sizes:
            k = int(np.prod(s))
            views.append(self.flat[at : at + k].reshape(s))
            at += k
        self.q, self.r, self.c1, self.c2, self.b = views
        #: Sums of squared gradients: a number for each vector and bias, one for each matrix.
        self.seen = {"q": np.full(n + 1, 1e-6, np.float32), "r": np.full(n, 1e-6, np.float32), "b": np.full(n, 1e-6, np.float32), "c1": np.float32(1e-6), "c2": np.float32(1e-6)}

    def train(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        """One noise-contrastive gradient step over the positions of a batch, each row by its own AdaGrad rate."""
        drawn = np.searchsorted(self.sums, rng.random(NOISE)).clip(0, len(self.b) - 1)
        q1, q2 = self.q.take(c1, 0), self.q.take(c2, 0)
        h = q1 @ self.c1 + q2 @ self.c2
        rw, rn = self.r.take(w, 0), self.r.take(drawn, 0)
        good = np.einsum("ij,ij->i", h, rw) + self.b[w] - self.log_noise[w]
        bad = h @ rn.T + self.b[drawn] - self.log_noise[drawn]
        with np.errstate(over="ignore"):  # infinity is right there
            up = 1 / (1 + np.exp(good))
            np.exp(np.negative(bad, out=bad), out=bad)
            bad += 1
            down = np.divide(np.float32(-_RATIO / NOISE), bad, out=bad)
        gh = up[:, None] * rw + down @ rn
        rate = np.float32(rate)
        gc1, gc2, gq1, gq2 = q1.T @ gh, q2.T @ gh, gh @ self.c1.T, gh @ self.c2.T
        self._rows(self.r, "r", np.concatenate([w, drawn]), np.concatenate([up[:, None] * h, down.T @ h]), rate)
        # The second context is nearly always the first one of the place before: add those up, sort the others.
        same = c2[1:] == c1[:-1]
        gq1[:-1] += gq2[1:] * same[:, None]
        other = np.flatnonzero(np.append(True, ~same))
        self._rows(self.q, "q", np.concatenate([c1, c2[other]]), np.concatenate([gq1, gq2[other]]), rate)
        gb = (np.bincount(w, up, len(self.b)) + np.bincount(drawn, down.sum(0), len(self.b))).astype(np.float32)
        self.seen["b"] += gb * gb
        self.b += rate * gb / np.sqrt(self.seen["b"])
        for name, into, g in (("c1", self.c1, gc1), ("c2", self.c2, gc2)):
            self.seen[name] += (g * g).mean()
            into += rate * g / np.sqrt(self.seen[name])

    def _rows(self, into: np.ndarray, name: str, rows: np.ndarray, values: np.ndarray, rate: np.float32) -> None:
        """A step for the given rows, which may repeat, by their summed gradients over the root of what each has seen."""
        # Small numbers are sorted by radix, several times as fast.
        order = np.argsort(rows.astype(np.uint16) if len(into) <= 1 << 16 else rows, kind="stable")
        own = rows[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        at, g = own[first], np.add.reduceat(values.take(order, 0), first, axis=0)
        self.seen[name][at] += (g * g).mean(1)
        into[at] += rate * g / np.sqrt(self.seen[name][at])[:, None]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by last class, by the one before, and log-normalisers of each pair of contexts."""
        q, r, c1, c2, b = (x.astype(np.float64) for x in (self.q, self.r, self.c1, self.c2, self.b))
        first = q @ c1 @ r.T
        second = q @ c2 @ r.T + b
        t1, t2 = first.max(1, keepdims=True), second.max(1, keepdims=True)
        norm, right = np.empty((len(q), len(q))), np.exp(second - t2).T
        for s in range(0, len(q), 512):
            norm[s : s + 512] = np.log(np.exp(first[s : s + 512] - t1[s : s + 512]) @ right) + t1[s : s + 512] + t2.T
        return first, second, norm


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text: runs without ASCII white space, A-Z lower-cased."""
    return (text or b"").lower().split()


def coded_tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The tokens of all texts, one after the other, as a dictionary of distinct ones, and how many each text has."""
    plain = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), "[\t-\r]", " ")
    lists = pc.split_pattern(plain, " ")
    words = lists.flatten()
    full = pc.not_equal(words, "")
    ends = np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return words.filter(full).dictionary_encode(), np.diff(before[ends], prepend=0)


def contexts(w: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two places before each position; first marks the documents' beginnings."""
    c1, c2 = np.roll(w, 1), np.roll(w, 2)
    c1[first] = start
    c2[first] = start
    second = first + 1
    c2[second[second < len(w)]] = start
    return c1, c2


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its word numbers within the block, and per block its words with their training counts."""
    block, name = 0, TaskContext.get().partitionId() << 32
    fields = ["block", "doc_id", "train", "ids", "word", "place", "n"]
    index, held, size = defaultdict(count().__next__), [], 0

    def docs_of():
        for s in range(0, len(held), 500):
            part = held[s : s + 500]
            m = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name + block] * m), pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.bool_()), pa.array([x[2].tobytes() for x in part], pa.binary()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())],
                fields,
            )

    def words_of():
        own = np.zeros(len(index), np.int64)
        learnt = [ids for _, train, ids in held if train]
        if learnt:
            own += np.bincount(np.concatenate(learnt), minlength=len(own))
        words = list(index)
        for s in range(0, len(words), 50_000):
            part = words[s : s + 50_000]
            m = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name + block] * m), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.binary()), pa.array(part, pa.binary()), pa.array(np.arange(s, s + m, dtype=np.int32)), pa.array(own[s : s + m])],
                fields,
            )

    for part in chunks(batches, "text", 1 << 22):
        texts = column(part, "text")
        n_bytes = pc.sum(pc.binary_length(texts)).as_py() or 0
        if held and size + n_bytes > BLOCK_BYTES:
            yield from docs_of()
            yield from words_of()
            block, index, held, size = block + 1, defaultdict(count().__next__), [], 0
        each, many = coded_tokens(texts)
        # Each distinct word is looked up once; its occurrences follow by numpy.
        ids = np.fromiter(map(index.__getitem__, utf8(each.dictionary)), np.uint32, len(each.dictionary))[each.indices.to_numpy()]
        ends = np.cumsum(many)
        held += zip(column(part, "doc_id").to_pylist(), column(part, "train").to_pylist(), np.split(ids, ends[:-1]))
        size += n_bytes
    if held:
        yield from docs_of()
        yield from words_of()


class _Classes(dict):
    """Classes of words, by ending for all that are missing."""

    def __init__(self, shape: Shape):
        super().__init__(shape.words)
        self.first, self.endings, self.marks = len(shape.words) + 1, shape.endings, _MARKS.encode()

    def __missing__(self, word: bytes) -> int:
        return self.first + crc32(word.rstrip(self.marks)[-3:]) % self.endings


def _crc_steps() -> np.ndarray:
    """What CRC-32 makes of each byte."""
    rows = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rows = np.where(rows & 1, (rows >> 1) ^ np.uint32(0xEDB88320), rows >> 1)
    return rows


_STEPS = _crc_steps()


def classes_of(words: pa.Array, shape: Shape, frequent: pa.Array) -> np.ndarray:
    """What _Classes says of each of words (strings); frequent holds shape.words in order."""
    kind = pc.index_in(pc.cast(words, pa.binary()), frequent).fill_null(-1).to_numpy().astype(np.int32) + 1
    stems = pc.cast(pc.ascii_rtrim(words, characters=_MARKS), pa.large_binary())
    ends = np.frombuffer(stems.buffers()[1], np.int64)[stems.offset : stems.offset + len(stems) + 1]
    data = np.frombuffer(stems.buffers()[2] or b"", np.uint8)
    length = np.diff(ends)
    crc = np.full(len(stems), 0xFFFFFFFF, np.uint32)
    for back in (3, 2, 1):
        has = np.flatnonzero(length >= back)
        crc[has] = _STEPS[(crc[has] ^ data[ends[has + 1] - back]) & 255] ^ (crc[has] >> 8)
    return np.where(kind > 0, kind, len(shape.words) + 1 + (~crc % np.uint32(shape.endings)).astype(np.int32)).astype(np.int32)


def ending_class(word: Column, endings: int) -> Column:
    """The number of a word's class by ending: as _Classes, of the last three bytes before marks."""
    stem = F.rtrim(word.cast("string"), F.lit(_MARKS)).cast("binary")
    return (F.crc32(F.substring(stem, -3, 3)) % endings).cast("int")


def _fit(shape: Shape, flat: np.ndarray | None, seed: int, rate: float):
    """Follows the gradients over one task's documents; emits its parameters with the words seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rng, seen = LogBilinear(shape.share, flat), np.random.default_rng(seed), 0
        start = shape.outputs
        frequent = pa.array(list(shape.words), pa.binary())
        for part in chunks(batches, "text", 1 << 20):
            each, many = coded_tokens(column(part, "text"))
            size = many + 1
            first = np.cumsum(size) - size
            w = np.zeros(size.sum(), np.int32)  # the last of each stays 0, the end
            own = np.ones(len(w), bool)
            own[first + size - 1] = False
            w[own] = classes_of(each.dictionary, shape, frequent)[each.indices.to_numpy()]
            c1, c2 = contexts(w, first, start)
            for s in range(0, len(w), BATCH):
                model.train(c1[s : s + BATCH], c2[s : s + BATCH], w[s : s + BATCH], rng, rate)
            seen += len(w)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([model.flat], pa.list_(pa.float32()))], ["seen", "flat"])

    return run


def fit(train: DataFrame, shape: Shape, rounds: int = ROUNDS) -> LogBilinear:
    """Trains over all of train(text): tasks from a common start, parameters averaged, rounds times."""
    model = LogBilinear(shape.share)
    for r in range(rounds):
        parts = train.select("text").mapInArrow(tidy(_fit(shape, model.flat, r, RATE / (r + 1))), "seen double, flat array<float>")
        sums = parts.select("seen", F.posexplode("flat").alias("i", "v")).groupBy("i").agg((F.sum(F.col("seen") * F.col("v")) / F.sum("seen")).alias("v"))
        rows = sums.orderBy("i").toArrow()
        if rows.num_rows:
            model = LogBilinear(shape.share, rows["v"].to_numpy())
    return model


_tables: dict[bytes, tuple] = {}
SCORED = [("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def _score(shape: Shape, flat: np.ndarray, known: dict):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        key = hashlib.blake2b(flat.tobytes() + shape.share.tobytes(), digest_size=16).digest()
        if key not in _tables:
            _tables.clear()
            _tables[key] = tuple(x.astype(np.float32) for x in LogBilinear(shape.share, flat).tables())
        first_scores, second_scores, norm = _tables[key]
        if not docs.num_rows:
            return pa.table({n: pa.array([], t) for n, t in SCORED})
        place = words["place"].to_numpy()
        total, kind = np.zeros(len(place) + 1, np.int64), np.zeros(len(place) + 1, np.int32)
        total[place], kind[place] = words["total"].to_numpy(), words["class"].to_numpy()
        total[-1], kind[-1] = known["docs"], 0
        ids = [np.frombuffer(x, np.uint32) for x in docs["ids"].to_pylist()]
        size = np.array([len(x) + 1 for x in ids])
        ends = np.cumsum(size)
        first = ends - size
        every = np.concatenate([y for x in ids for y in (x.astype(np.int32), np.array([len(place)], np.int32))])
        base = np.log10((total + 0.1) / (known["tokens"] + 0.1 * (known["distinct"] + 1)))
        by_ending = kind - (len(shape.words) + 1)
        mass = known["rare_tokens"] + 0.1 * (known["rare_distinct"] + 1)
        rare = np.where(by_ending >= 0, np.log((total + 0.1) / mass[np.maximum(by_ending, 0)]), 0.0)
        w = kind[every]
        c1, c2 = contexts(w, first, shape.outputs)
        model = first_scores[c1, w]
        model += second_scores[c2, w]
        model -= norm[c1, c2]
        model = model + rare[every]
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "train": docs["train"],
                "n_tokens": size,
                "n_known": np.add.reduceat((total[every] > 0).astype(np.int64), first),
                "train_tokens": np.full(len(size), known["tokens"], np.int64),
                "base_score": np.add.reduceat(base[every], first),
                "score": np.add.reduceat(model, first) / np.log(10),
            }
        )

    return run


def score_documents(docs: DataFrame, classes: int = 1024) -> DataFrame:
    """One row per document: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    docs needs doc_id, text and the boolean train, which says what to learn from (null: not).
    A null or empty text is an end alone.  With no training documents all counts are 0, base
    and model are uniform.  classes is the least number of words, if there are so many, with
    a class each.  Repeated rows and rows without doc_id give one row each; other columns are ignored; an
    empty table gives no rows.  Scores are log10 probabilities.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("train", F.lit(False)).alias("train"), "text")
    both = written(docs.mapInArrow(tidy(_tokenise), "block long, doc_id long, train boolean, ids binary, word binary, place int, n long"), "tokens")
    local = both.where("place is not null").select("block", "word", "place", "n")
    totals = written(local.groupBy("word").agg(F.sum("n").alias("total")), "totals")
    n_docs = both.where("place is null and train").count()
    n_words, n_distinct = totals.where("total > 0").agg(F.coalesce(F.sum("total"), F.lit(0)), F.count("*")).first()
    root = math.ceil(n_distinct ** (1 / 3))
    top = totals.where("total > 0").orderBy(F.desc("total"), "word").limit(classes + root).collect()
    endings = max(1, ENDINGS * root)
    rare = np.zeros((2, endings), np.int64)
    by_ending = totals.where("total > 0").groupBy(ending_class(F.col("word"), endings).alias("e")).agg(F.sum("total").alias("t"), F.count("*").alias("n"))
    for r in by_ending.collect():
        rare[:, r["e"]] = r["t"], r["n"]
    words = {bytes(r["word"]): k + 1 for k, r in enumerate(top)}
    own = _Classes(Shape({}, np.zeros(endings + 1)))
    for r in top:
        rare[:, own[bytes(r["word"])] - 1] -= r["total"], 1
    frequency = np.array([n_docs, *(r["total"] for r in top), *rare[0]], float) + 0.5
    shape = Shape(words, frequency / frequency.sum())
    known = {
        "docs": n_docs, "tokens": n_words + n_docs, "distinct": n_distinct + (n_docs > 0),
        "rare_tokens": rare[0], "rare_distinct": rare[1],
    }
    model = fit(docs.where("train"), shape)
    spark = docs.sparkSession
    named = spark.createDataFrame([(w, k) for w, k in shape.words.items()], "word binary, class int")
    counts = local.select("block", "word", "place").join(totals, "word")
    counts = counts.join(F.broadcast(named), "word", "left").select(F.col("block").alias("b"), "place", "total", F.coalesce("class", len(words) + 1 + ending_class(F.col("word"), endings)).alias("class"))
    rows = both.where("place is null").select("block", "doc_id", "train", "ids")
    # A block without any word has no dictionary rows; cogrouping keeps it.
    scored = rows.groupBy("block").cogroup(counts.groupBy("b")).applyInArrow(
        _score(shape, model.flat, known),
        "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return scored

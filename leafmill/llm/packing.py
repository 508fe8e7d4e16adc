"""Best-fit packing of token sequences through the configuration linear program.

Texts become pieces of at most ``capacity`` tokens.  Only the histogram of piece lengths
(at most ``capacity`` numbers) goes to the driver.  There the configuration LP -- cover
every length's demand by as few multisets of lengths that fit a sequence as possible -- is
solved by multiplicative weights: each round prices lengths by weights that fall as they
are covered, values every amount of room by a knapsack dynamic program, and uses
configurations about as dear as the dearest one until each length has its step.  All
lengths are covered in the end, and the prices give a lower bound to compare with.  The
solution is rounded, what it leaves is solved and rounded again, and best-fit decreasing
puts the few pieces left over into the room that is left, then into sequences of their own.

The plan is run-length encoded (configuration, multiplicity), so its size does not depend
on the number of pieces.  Pieces find their places by their rank among those of their
length: offsets per written partition plus a row number within it, so no length, however
common, is gathered in one task.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import chunks, column, release_memory, tidy, written

#: Bytes of text encoded at a time, and pre-tokens whose ids a task keeps.
CHUNK, KEPT = 2 << 20, 300_000
#: Pre-tokens that are encoded in one call.
TOGETHER = 2048
#: The pre-tokens of the vocabulary, and how it treats texts before.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
#: ASCII that is seen, and the letters below U+0250 whose lower case is one character.
PLAIN = "^[!-~À-ÖØ-öø-įı-ɏ]*$"


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each of several runs, one after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


class WordEncoder:
    """Token ids of texts, each distinct pre-token encoded once.

    A text is cut at ASCII white space, which a tokenizer that normalises and splits as the
    vocabulary of the queries does drops in any case.  Distinct words of plain characters
    (lower-casing keeps their classes, and composition leaves them alone) are cut on into
    pre-tokens by the classes of their bytes; the distinct pre-tokens go through the
    vocabulary's merges many at a time, told apart by the tokens that end a word.  Other
    words are encoded whole.  With a tokenizer of another make texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path = path
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.by_words = _as_expected(made)
        if self.by_words:
            steps = [{"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}, made["pre_tokenizer"]["pretokenizers"][1]]
            ends = [i for token, i in made["model"]["vocab"].items() if token.endswith("</w>")]
            self.last = np.zeros(max(made["model"]["vocab"].values()) + 1, bool)
            self.last[ends] = True
            bare = made | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}}
            self.merges = Tokenizer.from_str(json.dumps(bare))
        self.pieces = regex.compile(PRE_TOKENS)
        self.forget()
        del made
        release_memory()  # what reading the vocabulary took

    @functools.cached_property
    def whole(self):
        """The tokenizer as it is; most texts need it for no word."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def forget(self) -> None:
        self.known, self.ends, self.ids = pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, names: pa.Array) -> None:
        """Appends the ids of new distinct pre-tokens."""
        found, ends = [self.ids], [self.ends]
        for s in range(0, len(names), TOGETHER):
            part = names.slice(s, TOGETHER)
            ids = np.array(self.merges.encode_batch_fast([" ".join(part.to_pylist())], add_special_tokens=False)[0].ids, np.uint32)
            stop = np.flatnonzero(self.last[ids]) + 1
            if len(stop) != len(part):
                raise ValueError("the vocabulary does not mark the last token of every pre-token")
            ends.append(stop + ends[-1][-1])
            found.append(ids)
        self.known = pa.concat_arrays([self.known, names])
        self.ends, self.ids = np.concatenate(ends), np.concatenate(found)

    def _plain_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, one after the other, and how many each has."""
        words = pc.utf8_lower(words)
        odd = np.flatnonzero(pc.match_substring(words, "'").to_numpy(zero_copy_only=False))
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1]
        base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
        raw = np.frombuffer(words.buffers()[2], np.uint8)[base : base + size] if size else np.zeros(0, np.uint8)
        at = offsets.astype(np.int64) - base
        kind = _KIND[raw]
        new = np.ones(size, bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        new[at[:-1][at[:-1] < at[1:]]] = True
        start = np.flatnonzero(new)
        pre = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(np.append(start, size).astype(np.int32)), pa.py_buffer(raw.tobytes())])
        per_word = np.searchsorted(start, at[1:]) - np.searchsorted(start, at[:-1])
        if len(odd):  # an apostrophe may begin a contraction
            cut = [self.pieces.findall(w) for w in words.take(pa.array(odd)).to_pylist()]
            begin = np.cumsum(per_word) - per_word
            rest = pa.array([p for c in cut for p in c], pa.string())
            own, many = begin.copy(), per_word.copy()
            many[odd] = [len(c) for c in cut]
            own[odd] = len(pre) + np.cumsum(many[odd]) - many[odd]
            pre = pa.concat_arrays([pre, rest]).take(pa.array(spread(own, many)))
            per_word = many
        coded = pre.dictionary_encode()
        names = coded.dictionary
        if len(self.known) > KEPT:
            self.forget()
        place = pc.index_in(names, value_set=self.known)
        missing = names.filter(place.is_null())
        if len(missing):
            self._learn(missing)
            place = pc.index_in(names, value_set=self.known)
        code = place.to_numpy(zero_copy_only=False)[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.int64)
        lengths = np.diff(self.ends)[code]
        total = np.concatenate([[0], np.cumsum(lengths)])
        edge = np.concatenate([[0], np.cumsum(per_word)])
        return self.ids[spread(self.ends[code], lengths)], np.diff(total[edge])

    def _others(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        found = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        ids, ends = self.flat(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip([0, *ends], ends)]

    def flat(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (strings, no nulls), one text after the other, and where each ends."""
        last = [] if end_id is None else [end_id]
        if not self.by_words:
            ids, size = self._others(texts.to_pylist())
            ends = np.cumsum(size)
            return np.insert(ids, np.repeat(ends, len(last)), np.tile(last, len(texts)).astype(np.uint32)), ends + len(last) * np.arange(1, len(texts) + 1)
        lists = pc.split_pattern(pc.replace_substring_regex(texts, "[\t-\r]", " "), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        plain = pc.and_(pc.match_substring_regex(words, PLAIN), pc.invert(pc.match_substring(words, "<|")))
        is_plain = plain.to_numpy(zero_copy_only=False)
        ids, size = self._plain_words(words.filter(plain))
        more, more_size = self._others(words.filter(pc.invert(plain)).to_pylist())
        # The table of words: plain ones first, then the others, then the end.
        table = np.concatenate([ids, more, np.array(last, np.uint32)])
        length = np.concatenate([size, more_size, np.ones(len(last), np.int64)])
        row = np.empty(len(words), np.int64)
        row[is_plain], row[~is_plain] = np.arange(len(size)), len(size) + np.arange(len(more_size))
        begin = np.cumsum(length) - length
        many = lists.value_lengths().to_numpy().astype(np.int64)
        stop = np.cumsum(many)
        code = np.insert(row[coded.indices.to_numpy()], np.repeat(stop, len(last)), len(length) - 1)
        total = np.concatenate([[0], np.cumsum(length[code])])
        return table[spread(begin[code], length[code])], total[stop + len(last) * np.arange(1, len(texts) + 1)]


#: Letters 0, digits 1, all else 2; bytes beyond ASCII belong to letters in plain words.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_KIND[48:58] = 1


def _as_expected(made: dict) -> bool:
    """Whether texts are normalised, split and merged as WordEncoder takes for granted."""
    steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    return (
        (made.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and len(steps) == 2
        and (steps[0].get("type"), steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == ("Split", {"Regex": PRE_TOKENS}, "Removed", True)
        and (steps[1].get("type"), steps[1].get("use_regex"), steps[1].get("add_prefix_space")) == ("ByteLevel", False, False)
        and made["model"].get("end_of_word_suffix") == "</w>"
        and all(t["content"].startswith("<|") for t in made["added_tokens"])
    )


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of the tokens of docs(doc_id, text): doc_id, piece, start, length, ids_crc32[, ids].

    A text's ids are followed by end_id; a null text has that alone.  Only longer ones are cut.
    Rows without doc_id or with one that others have too are packed like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = WordEncoder(tokenizer)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for part in chunks(batches, "text", CHUNK):
            ids, ends = own.flat(pc.fill_null(column(part, "text"), "").cast(pa.string()), end_id)
            size = np.diff(ends, prepend=0)
            pieces = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), pieces)
            nth = spread(np.zeros(len(size), np.int64), pieces)
            start = nth * capacity
            length = np.minimum(size[doc] - start, capacity)
            raw, at = memoryview(ids.astype("<u4", copy=False)).cast("B"), 4 * ((ends - size)[doc] + start)
            crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(at.tolist(), length.tolist())]
            out = [column(part, "doc_id").take(pa.array(doc)), pa.array(nth, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), schema)


@dataclass
class Run:
    """times sequences that each hold counts[l] pieces of length l; by_lp: as the linear program says."""

    counts: dict[int, int]
    times: int
    by_lp: bool = False


def best_fit_decreasing(demand: dict[int, int], capacity: int, into: list[Run] | None = None) -> list[Run]:
    """Best-fit decreasing on a histogram, equal bins handled together: all runs, those of into with what now fills their room."""
    by_room: dict[int, list[Run]] = {}
    for g in into or []:
        by_room.setdefault(capacity - sum(k * n for k, n in g.counts.items()), []).append(g)

    def put(g: Run, length: int, n: int, times: int) -> Run:
        return Run(g.counts | {length: g.counts.get(length, 0) + n}, times, g.by_lp)

    for length in sorted(demand, reverse=True):
        left = demand[length]
        for room in sorted(r for r in by_room if r >= length):
            if not left:
                break
            groups, fit, keep = by_room.pop(room), room // length, []
            for g in groups:
                full = min(g.times, left // fit)
                if full:
                    by_room.setdefault(room - fit * length, []).append(put(g, length, fit, full))
                    g, left = Run(g.counts, g.times - full, g.by_lp), left - full * fit
                if g.times and 0 < left < fit:
                    by_room.setdefault(room - left * length, []).append(put(g, length, left, 1))
                    g, left = Run(g.counts, g.times - 1, g.by_lp), 0
                if g.times:
                    keep.append(g)
            if keep:
                by_room.setdefault(room, []).extend(keep)
        if left:
            fit = capacity // length
            if left // fit:
                by_room.setdefault(capacity - fit * length, []).append(Run({length: fit}, left // fit))
            if left % fit:
                by_room.setdefault(capacity - (left % fit) * length, []).append(Run({length: left % fit}, 1))
    return [g for groups in by_room.values() for g in groups]


#: Ways to run the multiplicative weights, the next where the gap to the lower bound stays over GAP: rounds in
#: which every length may be covered once, the weights' fall over a full cover, and how far a configuration's
#: price may lie under the dearest one's.  The first suits lengths that fill sequences, the others few lengths.
WAYS, GAP, TIE = [(3, 0.05, 0.02), (8, 0.02, 0.01), (32, 10.0, 0.05)], 0.01, 1e-3
#: What rounding left is solved, by the first way, and rounded in turn, so often in all.
SOLVES = 3
#: Shares of the rounded configurations, the fullest first, that are tried at the end; all of them stay on ties.
KEPT_SHARES = (1, 0.95, 0.9, 0.8, 0.7, 0.5, 0.3, 0.1, 0)


def room_values(price: np.ndarray) -> np.ndarray:
    """The highest price of a multiset of lengths for each amount of room (unbounded knapsack)."""
    best = np.zeros(len(price))
    best[1] = max(price[1], 0.0)
    for c in range(2, len(price)):
        best[c] = max(best[c - 1], (price[1 : c + 1] + best[c - 1 :: -1]).max())
    return best


def configuration_lp(demand: dict[int, int], capacity: int, ways: list[tuple] | None = None) -> tuple[dict[tuple, float], float]:
    """Amounts of configurations that cover the demand, and a lower bound of their sum.

    A configuration is a tuple of (length, pieces), and holds no more of a length than there are.
    """
    best, bound = None, 0.0
    for way in ways or WAYS:
        amounts, low = _weighted(demand, capacity, *way)
        bound = max(bound, low)
        if best is None or sum(amounts.values()) < sum(best.values()):
            best = amounts
        if sum(best.values()) <= (1 + GAP) * bound:
            break
    return best, bound


def _weighted(demand: dict[int, int], capacity: int, rounds: int, fall: float, slack: float) -> tuple[dict[tuple, float], float]:
    """Multiplicative weights."""
    lengths = np.array(sorted(demand))
    need = np.array([demand[k] for k in lengths], float)
    at = np.zeros(capacity + 1, np.int64)
    at[lengths] = np.arange(len(lengths))
    weight, cover = lengths / capacity, np.zeros(len(lengths))
    amounts: dict[tuple, float] = {}
    bound = float(need @ weight)  # full sequences
    for r in range(4 * rounds):
        live = cover < 1 - 1e-9
        if not live.any():
            break
        price = np.full(capacity + 1, -np.inf)
        price[lengths[live]] = weight[live]
        best = room_values(price)
        # Weights over the dearest configuration's price are a solution of the dual program.
        bound = max(bound, float(need[live] @ weight[live]) / best[capacity])
        before = cover.copy()
        room = np.minimum(1 / rounds, 1 - cover) * need
        allowed = price.copy()
        for i in np.flatnonzero(live)[::-1]:
            own = int(lengths[i])
            while room[i] > 1e-9 * need[i]:
                counts, hidden, value, left = {i: 1}, [own] if need[i] <= 1 else [], weight[i], capacity - own
                allowed[hidden] = -np.inf
                while left:
                    gain = allowed[1 : left + 1] + best[left - 1 :: -1] if left > 1 else allowed[1:2] + best[:1]
                    # The longest of those about as good: short pieces fill what is left later.
                    k = int(np.flatnonzero(gain >= gain.max() - TIE * best[capacity])[-1]) + 1
                    if allowed[k] == -np.inf:
                        break
                    j = int(at[k])
                    counts[j] = counts.get(j, 0) + 1
                    value += weight[j]
                    left -= k
                    if counts[j] >= need[j]:
                        hidden.append(k)
                        allowed[k] = -np.inf
                for k in hidden:
                    allowed[k] = price[k] if room[at[k]] > 1e-9 * need[at[k]] else -np.inf
                if value < (1 - slack) * best[capacity] and r < 3 * rounds:
                    break  # other weights, in a later round, may do better
                rows, many = np.fromiter(counts, np.int64), np.fromiter(counts.values(), float)
                amount = float((room[rows] / many).min())
                cover[rows] += amount * many / need[rows]
                room[rows] -= amount * many
                allowed[lengths[rows[room[rows] <= 1e-9 * need[rows]]]] = -np.inf
                key = tuple(sorted((int(lengths[j]), n) for j, n in counts.items()))
                amounts[key] = amounts.get(key, 0.0) + amount
        weight = weight * np.exp(-fall * (cover - before))
    return amounts, bound


def _rounded(amounts: dict[tuple, float], left: dict[int, int]) -> list[Run]:
    """Whole numbers of configurations, the fullest first, within left, which is lowered."""
    runs = []
    for key, amount in sorted(amounts.items(), key=lambda x: (-sum(k * n for k, n in x[0]), -x[1], x[0])):
        times = min(max(1, int(amount + 1e-9)), *(left[k] // n for k, n in key))
        if times > 0:
            runs.append(Run(dict(key), times, True))
            for k, n in key:
                left[k] -= n * times
    return runs


def _room(run: Run, capacity: int) -> int:
    return capacity - sum(k * n for k, n in run.counts.items())


def plan(demand: dict[int, int], capacity: int) -> list[Run]:
    """Runs that hold exactly the demand.

    The linear program is rounded, then again for what that left.  Configurations stay if no
    length of the table would fit into their room; of those the fullest, as large a share as
    needs fewest sequences in the end.  Best-fit decreasing puts the pieces left over into what
    room there is and, last, into sequences of their own.
    """
    whole = [Run({k: 1}, n, True) for k, n in demand.items() if k == capacity and n > 0]
    left = {k: n for k, n in demand.items() if k < capacity and n > 0}
    least, runs = min(left, default=0), []
    for k in range(SOLVES):
        if not left:
            break
        found = _rounded(configuration_lp(left, capacity, WAYS if not k else WAYS[:1])[0], left)
        _put_back([g for g in found if _room(g, capacity) >= least], left)
        runs += [g for g in found if _room(g, capacity) < least]
        left = {k: n for k, n in left.items() if n}
    best = None
    runs.sort(key=lambda g: (_room(g, capacity), -g.times))
    for share in KEPT_SHARES:
        n = round(len(runs) * share)
        rest = dict(left)
        _put_back(runs[n:], rest)
        made = best_fit_decreasing(rest, capacity, runs[:n])
        if best is None or sum(g.times for g in made) < sum(g.times for g in best):
            best = made
    return whole + best


def _put_back(runs: list[Run], left: dict[int, int]) -> None:
    for g in runs:
        for k, n in g.counts.items():
            left[k] = left.get(k, 0) + n * g.times


def _slots(runs: list[Run]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, pieces a sequence, first sequence, offset), by first rank."""
    rows: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for run in runs:
        offset = 0
        for length, n in sorted(run.counts.items(), reverse=True):
            rows.setdefault(length, []).append((taken.get(length, 0), n, sequence, offset))
            taken[length] = taken.get(length, 0) + n * run.times
            offset += n * length
        sequence += run.times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def packed(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (doc_id, piece, length and others) with sequence_id and offset.

    Sequences hold at most capacity tokens without gaps.  Repeated rows are pieces of their
    own.  An empty table gives no rows; columns named sequence_id and offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    kept = pieces.columns
    pieces = written(pieces.withColumn("__part", F.spark_partition_id()), "pieces")
    counts = written(pieces.groupBy("__part", "length").agg(F.count("*").alias("n")), "counts")
    demand = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(plan(demand, capacity)))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("__part", "length").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("own", F.row_number().over(own)).join(starts, ["__part", "length"])
    ranked = ranked.select(*kept, (F.col("first") + F.col("own") - 1).alias("__rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = column(batch, "length").to_numpy(), column(batch, "__rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                table = slots.value[int(k)]
                row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
                nth = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + nth // row[:, 1]
                offset[at] = row[:, 3] + nth % row[:, 1] * k
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(kept).schema)
    return ranked.mapInArrow(tidy(run), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenizes docs(doc_id, text) and packs the pieces; see token_pieces and packed."""
    return packed(token_pieces(docs, tokenizer, capacity, end_id, with_ids), capacity)

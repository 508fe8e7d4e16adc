"""Proofreading: findings, guarded edits, proof state."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import pytext
from leafmill.functions.text import chapter_hash, squash, strip
from leafmill.operators.queue import with_next
from leafmill.operators.sequence import is_body
from leafmill.sources.shared import kept


def doubled_words(texts: DataFrame) -> DataFrame:
    """doc_id, pos, word: words of three or more letters that repeat the word before them."""
    w = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    rows = texts.select("doc_id", w.alias("w"))
    at = F.filter(F.sequence(F.lit(2), F.greatest(F.size("w"), F.lit(2))), lambda i: (i <= F.size("w")) & (F.length(F.get("w", i - 1)) >= 3) & (F.lower(F.get("w", i - 1)) == F.lower(F.get("w", i - 2))))
    return rows.select("doc_id", "w", F.explode(at).alias("pos")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.get("w", F.col("pos") - 1).alias("word"))


def duplicate_paragraphs(texts: DataFrame, least: int = 80) -> DataFrame:
    """doc_id, n, quote: paragraphs of over least characters equal to the one before among such."""
    p = F.filter(F.transform(F.split("text", "\n\n"), strip), lambda x: F.length(x) > least)
    rows = texts.select("doc_id", p.alias("p"))
    at = F.filter(F.sequence(F.lit(2), F.greatest(F.size("p"), F.lit(2))), lambda i: (i <= F.size("p")) & (F.get("p", i - 1) == F.get("p", i - 2)))
    return rows.select("doc_id", "p", F.explode(at).alias("n")).select("doc_id", "n", F.substring(F.get("p", F.col("n") - 1), 1, 120).alias("quote"))


def damage(texts: DataFrame) -> DataFrame:
    """doc_id, type, severity, quote: unresolved placeholders, and words with U+FFFD, eight and one for the rest."""
    marks = texts.select("doc_id", F.lit("formatting").alias("type"), F.lit("high").alias("severity"), F.explode(F.regexp_extract_all("text", F.lit(r"\[\[region-\d+\]\]"), F.lit(0))).alias("quote"))
    bad = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[^\\s�]*�[^\\s]*"), F.lit(0))))
    words = texts.select("doc_id", F.lit("ocr").alias("type"), F.lit("medium").alias("severity"), F.explode(F.slice(bad, 1, 9)).alias("quote"))
    return marks.unionByName(words)


def danger(quote: Column, new: Column) -> Column:
    """Why an edit is unsafe by the rules that need no similarity: image, loss or note; else null."""
    images = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"!\[[^\]]*\]\([^)]*\)"), F.lit(0)))
    digits = lambda c: F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))
    noted = F.concat(quote, F.lit(" "), new).rlike("<sup|[¹²³⁴⁵⁶⁷⁸⁹⁰ⁱ]")
    return (
        F.when(images(new) < images(quote), "image")
        .when((F.length(quote) > 40) & (F.length(new) < F.length(quote) * 0.6), "loss")
        .when(noted & (digits(quote) != digits(new)), "note")
    )


def apply_edits(chapters: DataFrame, edits: DataFrame) -> DataFrame:
    """chapters(book_id, ch_idx, text) with the safe ones of edits applied in order of f_idx.

    Adds applied and results, an array of (f_idx, applied, skip_reason).  One chapter's edits
    change its text one after the other, so a chapter is one row here; chapters are spread.
    """
    fields = ["f_idx", "quote", "replacement", "apply_all", "reference", "user_edit"]
    listed = edits.groupBy("book_id", "ch_idx").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("edits"))
    rows = chapters.join(listed, ["book_id", "ch_idx"], "left")

    @F.udf("struct<text:string,applied:int,results:array<struct<f_idx:int,applied:boolean,skip_reason:string>>>")
    def run(text, listed):
        listed = [e.asDict() for e in listed or []]
        new, results = pytext.apply_edits(text, listed)
        return new, sum(r[0] for r in results), [(e["f_idx"], *r) for e, r in zip(listed, results)]

    return rows.withColumn("done", run("text", "edits")).select("book_id", "ch_idx", "done.text", "done.applied", "done.results")


def status(chapters: DataFrame, proofs: DataFrame) -> DataFrame:
    """book_id, ch_idx, hash, status: unproofed, stale, or what the proof says."""
    rows = chapters.withColumn("hash", chapter_hash(F.col("text"))).join(proofs.withColumnRenamed("status", "said"), ["book_id", "ch_idx"], "left")
    state = F.when(F.col("base_hash").isNull() & F.col("said").isNull(), "unproofed").when(~F.col("hash").eqNullSafe(F.col("base_hash")), "stale").otherwise(F.coalesce("said", F.lit("review")))
    return rows.withColumn("status", state).select("book_id", "ch_idx", "hash", "status")


def substituted(chapters: DataFrame, proofs: DataFrame) -> DataFrame:
    """chapters with the accepted proof's text where that was made from this very text."""
    good = proofs.where("status = 'accepted' and proofed <> ''").select("book_id", "ch_idx", "base_hash", "proofed")
    rows = chapters.join(good, ["book_id", "ch_idx"], "left")
    fits = F.col("base_hash") == chapter_hash(F.col("text"))
    return rows.select("book_id", "ch_idx", F.when(fits, F.col("proofed")).otherwise(F.col("text")).alias("text"))


def stuck() -> Column:
    """Findings worth reading the page again: anchored, undecided, and a note, unsafe or not found."""
    open_ = ~F.col("applied") & ~F.col("rejected") & ~F.col("reference") & F.col("page").isNotNull()
    why = F.coalesce("skip_reason", F.lit(""))
    return open_ & (F.col("replacement").isNull() | why.startswith("unsafe") | (why == "not_found"))


#: Names as alike as that are spellings of one; lengths differ by REACH at most.
ALIKE, REACH = 0.84, 2
#: Subsequences of one length that a name is looked up by at most; pairs of longer names meet by initial and lengths.
SUBSEQUENCES = 600


def _letters_shared(length: int, other: int) -> int:
    """Letters that names of these lengths have in common, in order, if they are alike."""
    total = length + other
    return next(m for m in itertools.count(int(ALIKE * total / 2) - 1) if 2.0 * m / total >= ALIKE)


def name_keys(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in words, key): names alike, of one initial, have a key in common.

    Their matching letters are a subsequence of both, so both have one of just the least length that
    makes them alike.  Keys are hashes of those; equal hashes of different ones only cost a comparison.
    """
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for length, listed in by_length.items():
        for other in range(max(1, length - REACH), length + REACH + 1):
            least = _letters_shared(length, other)
            if least > min(length, other):
                continue
            rows = np.array(listed)
            few = max(math.comb(length, least), math.comb(other, least)) <= SUBSEQUENCES
            chosen = np.array(list(itertools.combinations(range(length), least))) if few else np.zeros((1, 1), int)
            for s in range(0, len(rows), max(1, 200_000 // len(chosen))):
                part = rows[s : s + max(1, 200_000 // len(chosen))]
                codes = np.array([list(map(ord, words[i][: length if few else 1])) for i in part], dtype=np.uint64)
                key = (np.uint64((length + other) * 1000 + min(length, other)) * np.uint64(0x9E3779B97F4A7C15) + codes[:, :1]) * np.ones((1, len(chosen)), np.uint64)
                for k in range(chosen.shape[1]):
                    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[:, chosen[:, k]]
                yield np.repeat(part, len(chosen)), key.ravel().view(np.int64)


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0)
        for at, key in name_keys(words.to_pylist()):
            yield pa.RecordBatch.from_arrays([words.take(pa.array(at)), pa.array(key)], ["word", "key"])


def alike_names(rare: DataFrame, often: DataFrame) -> DataFrame:
    """quote, replacement: words of rare and of often that are alike, of one initial; each word is looked at once."""
    tasks = int(rare.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # words are few beside their keys
    keyed = lambda words, name: words.select("word").distinct().repartition(tasks, "word").mapInArrow(_key_batches, "word string, key long").select(F.col("word").alias(name), "key")
    near = keyed(rare, "quote").join(keyed(often, "replacement").hint("shuffle_hash"), "key").select("quote", "replacement")
    near = near.where((F.substring("quote", 1, 1) == F.substring("replacement", 1, 1)) & (F.abs(F.length("quote") - F.length("replacement")) <= REACH))
    plural = lambda a, b: (F.col(a) == F.concat(b, F.lit("s"))) | (F.col(a) == F.concat(b, F.lit("es")))
    near = near.where((F.col("quote") != F.col("replacement")) & ~plural("quote", "replacement") & ~plural("replacement", "quote")).distinct()

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([pytext.similarity(x, y) for x, y in zip(a, b)], dtype="float64")

    return near.where(ratio("quote", "replacement") >= ALIKE)


def name_variants(chapters: DataFrame) -> DataFrame:
    """book_id, ch_idx, quote, replacement: rare spellings of a name that the book mostly spells otherwise.

    Words that begin with a capital and have four letters or more; at most twice against at
    least four times, same initial, lengths within two, no plural, similarity 0.84.  Ten a chapter.
    Words that look alike are found once for all books, then each book's are taken.
    """
    name = r"(?U)\b[A-Z][a-zA-ZÀ-ÖØ-öø-ÿ]{3,}\b"
    found = chapters.select("book_id", "ch_idx", F.explode(F.regexp_extract_all("text", F.lit(name), F.lit(0))).alias("word"))
    per = kept(found.groupBy("book_id", "ch_idx", "word").agg(F.count("*").alias("here")))
    counts = kept(per.groupBy("book_id", "word").agg(F.sum("here").alias("n"), F.min("ch_idx").alias("first_ch")))
    rare, often = counts.where("n <= 2"), counts.where("n >= 4")
    pairs = kept(alike_names(rare, often))
    near = rare.select("book_id", F.col("word").alias("quote")).join(pairs, "quote")
    near = near.join(often.select("book_id", F.col("word").alias("replacement"), "n", "first_ch"), ["book_id", "replacement"])
    best = near.groupBy("book_id", "quote").agg(F.min_by("replacement", F.struct(-F.col("n"), "first_ch", "replacement")).alias("replacement"))
    # A word that the book has over twice in small letters is no name.
    lower = chapters.select("book_id", F.explode(F.regexp_extract_all("text", F.lit(r"[a-zà-öø-ÿ]{4,}"), F.lit(0))).alias("w")).groupBy("book_id", "w").agg(F.count("*").alias("low")).where("low > 2")
    best = best.withColumn("w", F.lower("quote")).join(lower, ["book_id", "w"], "left_anti").drop("w")
    rows = per.select("book_id", "ch_idx", F.col("word").alias("quote")).join(best, ["book_id", "quote"])
    # What begins a longer word of the chapter is none; such begin at a capital.
    capitals = F.array_join(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Z][a-zA-ZÀ-ÖØ-öø-ÿ]*"), F.lit(0))), " ")
    listed = rows.groupBy("book_id", "ch_idx").agg(F.collect_list(F.struct("quote", "replacement")).alias("names"))
    listed = listed.join(chapters.select("book_id", "ch_idx", capitals.alias("capitals")), ["book_id", "ch_idx"])
    alone = F.slice(F.array_sort(F.filter("names", lambda x: ~F.rlike(F.col("capitals"), F.concat(x["quote"], F.lit("[a-z]"))))), 1, 10)
    return listed.select("book_id", "ch_idx", F.explode(alone).alias("x")).select("book_id", "ch_idx", "x.quote", "x.replacement")


def dedupe_by_content(pages: DataFrame, least: float = 0.92) -> DataFrame:
    """pages with status: of two neighbours that read nearly alike the worse capture is a duplicate, the earlier on ties.

    Whole texts are compared.  Neighbours are those of the body before any decision; scores are computed in parallel,
    however few the books, and decisions taken from left to right, skipping pairs of which one is decided.
    """
    key = squash(F.coalesce("text", F.lit("")))
    confidence = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
    rank = F.struct(F.col("patched_source").isNotNull().alias("p"), confidence.alias("c"), F.coalesce("composite", F.lit(0.0)).alias("s"))
    body = kept(pages.where(is_body()).select("book_id", "page_ord", key.alias("key"), rank.alias("rank"), (F.col("dedupe_exempt") | F.col("manual_duplicate")).alias("fixed"), F.monotonically_increasing_id().alias("id")))
    # Texts stay behind while neighbours are found; only pairs of a fitting length get theirs.
    places = with_next(body.select("book_id", "page_ord", F.length("key").alias("chars"), "rank", "fixed", "id"), ["book_id"], "page_ord")
    ok = (F.col("chars") >= 300) & (F.col("chars2") >= 300) & ~F.col("fixed") & ~F.col("fixed2")

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([pytext.alike(x, y, least) for x, y in zip(a, b)], dtype="bool")

    near = places.where(ok & (F.lit(2.0) * F.least("chars", "chars2") >= (F.col("chars") + F.col("chars2")) * least))
    near = near.select("book_id", "page_ord", "page_ord2", (F.col("rank") <= F.col("rank2")).alias("first_loses"), "id", "id2")
    texts = lambda id_, name: body.select(F.col("id").alias(id_), F.col("key").alias(name))
    near = near.join(texts("id", "key"), "id").join(texts("id2", "key2"), "id2")
    # Comparing takes time out of proportion to the rows' size, so they are dealt to as many tasks as there may be;
    # a deterministic function would be pushed down below that.
    near = near.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "book_id", "page_ord")
    # Kept, as batches of whole texts are small while a table is.
    pairs = kept(near.where(alike.asNondeterministic()("key", "key2")).select("book_id", "page_ord", "page_ord2", "first_loses"))

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        lost = set()
        for r in group.sort_values("page_ord").itertuples():
            if r.page_ord not in lost and r.page_ord2 not in lost:
                lost.add(r.page_ord if r.first_loses else r.page_ord2)
        return pd.DataFrame({"book_id": [group.book_id.iloc[0]] * len(lost), "page_ord": sorted(lost)})

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("book_id", "page_ord")}
    lost = pairs.groupBy("book_id").applyInPandas(decide, f"book_id {kinds['book_id']}, page_ord {kinds['page_ord']}").withColumn("lost", F.lit(True))
    rows = pages.join(lost, ["book_id", "page_ord"], "left")
    return rows.withColumn("status", F.when(F.col("lost"), "duplicate").otherwise(F.col("status"))).drop("lost")

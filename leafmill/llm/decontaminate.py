"""Benchmark decontamination with a distributed positional inverted index.

Only DataFrame operations.  The index holds one posting for every occurrence of a benchmark
term in the documents: the document's row, the word position, the term.  It is cut by
documents, as large text indexes are: a task writes the postings of the documents it reads,
so building shuffles nothing and no frequent term gathers in one place.

Counting the postings gives each phrase (a window of benchmark words) its terms from the
rarest on.  The list of the rarest, moved back by that word's place in the phrase, is the
first list of starts; it is intersected with the moved list of the second rarest, and what
remains with those of all others.  Starts in every list are exact matches.  Proximity matches
intersect the same lists within a span of words instead of at offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import ascii_lower, written
from leafmill.llm.wordcols import BREAK, fits_broadcast, word_count, word_slots, words


def phrase_windows(items: DataFrame, width: int = 13) -> DataFrame:
    """(item_id, phrase) of every window of the items' texts; shorter items are one window."""
    rows = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("phrase")).distinct()


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df as a written table with a number of its own for each row in the column name."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), name)


def _small(df: DataFrame, column: str) -> DataFrame:
    """df for a join: sent to all executors if its size is proven, else shuffled."""
    return F.broadcast(df) if fits_broadcast(df, column) else df


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of terms(term, term_id): doc_id, row (the document's, since doc_id may repeat), pos from 0, term_id."""
    text = F.coalesce("text", F.lit(""))
    # BREAK holds the capitals, since words are lower-cased before.
    lead = ascii_lower(F.substring(text, 1, 1)).rlike(BREAK).cast("int").alias("lead")
    slots = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), lead, word_slots(text).alias("w"))
    each = slots.select("doc_id", "row", "lead", F.posexplode("w").alias("slot", "term"))
    found = each.join(_small(terms, "term"), "term")
    return written(found.select("doc_id", "row", (F.col("slot") - F.col("lead")).alias("pos"), "term_id"), "postings")


def rarest_first(phrases: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """(phrase_id, size, places): of phrases(phrase_id, phrase) whose words all occur, the (n, at, term_id) from the rarest on."""
    counts = index.groupBy("term_id").agg(F.count("*").alias("n"))
    each = phrases.select("phrase_id", F.size("phrase").alias("size"), F.posexplode("phrase").alias("at", "term"))
    places = F.array_sort(F.collect_list(F.struct("n", "at", "term_id"))).alias("places")
    each = each.join(terms, "term").join(counts, "term_id")
    return written(each.groupBy("phrase_id", "size").agg(places).where(F.size("places") == F.col("size")), "lists")


def _intersected(index: DataFrame, starts: DataFrame, lists: DataFrame, first: int, n: int) -> DataFrame:
    """starts (phrase_id, doc_id, row, start) at which the lists of n terms from rank first on have postings as well.

    The postings asked for are looked up once each, whatever number of phrases asks.
    """
    ranks = lists.select("phrase_id", F.slice("places", first + 1, n).alias("ranks"))
    each = starts.join(_small(ranks, "phrase_id"), "phrase_id")
    asked = each.where(F.size("ranks") > 0).select(*starts.columns, F.size("ranks").alias("need"), F.explode("ranks").alias("r"))
    asked = asked.select(*starts.columns, "need", (F.col("start") + F.col("r.at")).alias("pos"), F.col("r.term_id").alias("term_id"))
    key = ["row", "pos", "term_id"]
    keys = written(asked.select(key).distinct(), "asked")
    if fits_broadcast(keys, "row"):
        held = index.join(F.broadcast(keys), key, "left_semi")
    else:
        held = index.join(_small(keys.select("term_id").distinct(), "term_id"), "term_id", "left_semi").join(keys, key, "left_semi")
    both = asked.join(held.select(key), key).groupBy(*starts.columns, "need").count().where("count = need").select(starts.columns)
    return written(both.unionByName(each.where(F.size("ranks") == 0).select(starts.columns)), "starts")


def phrase_matches(index: DataFrame, lists: DataFrame) -> DataFrame:
    """(phrase_id, doc_id, row, start) where the words of the phrases of lists stand in order."""
    heads = lists.select("phrase_id", F.col("places")[0]["at"].alias("at"), F.col("places")[0]["term_id"].alias("term_id"))
    starts = index.join(_small(heads, "phrase_id"), "term_id").select("phrase_id", "doc_id", "row", (F.col("pos") - F.col("at")).alias("start"))
    starts = written(starts.where("start >= 0"), "starts")
    longest = lists.agg(F.max("size")).first()[0] or 0
    for first, n in [(1, 1), (2, longest)]:
        starts = _intersected(index, starts, lists, first, n)
    return starts


def proximity_matches(index: DataFrame, lists: DataFrame, slop: int) -> DataFrame:
    """(phrase_id, doc_id, row, pos): postings of a phrase's rarest term within a run of size + slop words that has all its words.

    The words may stand in any order, and one that the phrase repeats need not be repeated.
    Postings meet by blocks of as many words as the longest run, a block and its neighbours,
    first those of the second rarest term, then all.  Only postings of terms that are the second
    rarest of some phrase, then only those of blocks that are left, are shuffled.
    """
    block = (lists.agg(F.max("size")).first()[0] or 0) + slop
    span = (F.col("size") + slop).alias("span")
    ids = F.array_distinct(F.transform("places", lambda p: p["term_id"]))
    runs = lists.select("phrase_id", span, ids.alias("ids"))
    heads = runs.select("phrase_id", "span", "ids", F.col("ids")[0].alias("term_id"))
    found = index.join(_small(heads, "phrase_id"), "term_id").select("phrase_id", "span", "ids", "doc_id", "row", "pos")
    blocked = index.select("row", F.col("pos").alias("other"), "term_id", F.floor(F.col("pos") / block).alias("block"))
    anchor = ["phrase_id", "doc_id", "row", "pos"]
    near = F.abs(F.col("other") - F.col("pos")) < F.col("span")

    at = F.floor(F.col("pos") / block)
    neighbours = F.explode(F.array(at - 1, at, at + 1)).alias("block")
    seconds = found.where(F.size("ids") > 1).select(*anchor, "span", "ids", F.col("ids")[1].alias("term_id"), neighbours)
    wanted = runs.where(F.size("ids") > 1).select(F.col("ids")[1].alias("term_id")).distinct()
    others = blocked.join(_small(wanted, "term_id"), "term_id", "left_semi")
    near_second = written(seconds.join(others, ["row", "block", "term_id"]).where(near).select(*anchor, "span", "ids").distinct(), "near")
    asked = near_second.select("*", neighbours)
    keys = written(asked.select("row", "block").distinct(), "asked")
    held = blocked.join(F.broadcast(keys), ["row", "block"], "left_semi") if fits_broadcast(keys, "row") else blocked
    # An anchor is three rows here, so its file's size would pass for a small one.
    asked = F.broadcast(asked) if fits_broadcast(asked, "ids") else asked.hint("merge")
    around = held.join(asked, ["row", "block"]).where(near & F.array_contains("ids", F.col("term_id")))
    around = around.groupBy(*anchor, "span", F.size("ids").alias("n")).agg(F.collect_set(F.struct("other", "term_id")).alias("held"))
    terms = lambda s: F.array_distinct(
        F.transform(F.filter("held", lambda h: (h["other"] >= s) & (h["other"] < s + F.col("span"))), lambda h: h["term_id"])
    )
    whole = F.exists("held", lambda h: (h["other"] <= F.col("pos")) & (F.size(terms(h["other"])) == F.col("n")))
    return found.where(F.size("ids") == 1).select(anchor).unionByName(around.where(whole).select(anchor))


def indexed(docs: DataFrame, items: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index, the phrases' lists, and (item_id, phrase_id) of the items' windows."""
    windows = written(phrase_windows(items.where("item_id is not null").select("item_id", "text"), width), "windows")
    phrases = numbered(windows.select("phrase").distinct(), "phrase_id")
    terms = numbered(phrases.select(F.explode("phrase").alias("term")).distinct(), "term_id")
    index = build_index(docs, terms)
    named = windows.join(phrases, "phrase").select("item_id", "phrase_id")
    return index, rarest_first(phrases, terms, index), named


def near_phrases(docs: DataFrame, items: DataFrame, slop: int = 3, width: int = 13) -> DataFrame:
    """(doc_id, n_items, n_places): of documents with proximity matches, the items that have one and the places of their rarest terms.

    Null and empty texts have none, as have rows without doc_id and items without words or
    item_id; the rows of a repeated doc_id count together, places of equal position once;
    other columns are ignored.
    """
    index, lists, named = indexed(docs.where("doc_id is not null").select("doc_id", "text"), items, width)
    found = written(proximity_matches(index, lists, slop), "proximity")
    items_found = found.select("doc_id", "phrase_id").distinct().join(named, "phrase_id").groupBy("doc_id").agg(F.count_distinct("item_id").alias("n_items"))
    places = found.select("doc_id", "pos").distinct().groupBy("doc_id").agg(F.count("*").alias("n_places"))
    return items_found.join(places, "doc_id")


def contamination(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    docs needs doc_id and text, items item_id and text.  A word inside an occurrence of an
    item's window is hit; a document with share * n_hit >= n_words > 0 hits is contaminated.
    Null and empty texts have no words and no hits; items without words or item_id have no
    windows; repeated items count once by item_id.  Repeated rows of a doc_id give one row each
    with the hits of all.  Rows without doc_id are left out; other columns are ignored.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    index, lists, named = indexed(docs, items, width)
    matches = phrase_matches(index, lists).join(_small(lists.select("phrase_id", F.col("size").cast("long").alias("length")), "phrase_id"), "phrase_id")
    order = Window.partitionBy("doc_id").orderBy("start", "length")
    stop = F.col("start") + F.col("length")
    reached = F.coalesce(F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = matches.select("doc_id", "start", "length").distinct()
    hits = spans.withColumn("new", F.greatest(stop - F.greatest("start", reached), F.lit(0))).groupBy("doc_id").agg(F.sum("new").alias("n_hit"))
    found = matches.select("doc_id", "phrase_id").distinct().join(named, "phrase_id").select("doc_id", F.col("item_id").cast("string").alias("item")).distinct()
    found = found.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_set("item"))), 256).alias("items_sha256"))
    rows = docs.select("doc_id", word_count(F.col("text")).alias("n_words"))
    rows = rows.join(hits.join(found, "doc_id"), "doc_id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )

"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, met by a scan over every document's words.

Words are runs of ASCII letters, digits and characters beyond ASCII, after lower-casing A-Z.  A window is ten consecutive words of an item, or all
words of a shorter one.  Each window has an anchor, its longest word.  The scan looks up every document word among the anchors; only around
those found are windows verified word by word, so texts never leave their rows and no pairs of documents and items are formed.  All of it is
column expressions: no Python runs in tasks.

The anchors go to tasks as a set within the plan and the windows as a broadcast side, each only up to a bound that is checked; beyond, both
are ordinary joins with the same results.

Defined results: null and empty texts have no words and no hits; items without words have no windows; equal windows of several items count for
each item; repeated rows each get their own result; an empty table gives an empty one, an empty benchmark no hits; other columns pass through
``clean`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import settle

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Anchors put into the plan, and windows broadcast, at most.
MAX_ANCHORS, MAX_WINDOWS = 20_000, 200_000
#: Contaminated documents' keys broadcast at most.
MAX_KEYS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, -1), "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(anchor, offset, size, words, items)``: each distinct window, where its anchor stands in it, and the items that hold it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - size, F.lit(0)))
    cut = items.select("item", "_w", F.explode(starts).alias("_s")).select("item", F.slice("_w", F.col("_s") + 1, F.lit(size)).alias("words"))
    distinct = cut.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.octet_length(w).alias("n"), w.alias("w"))))["w"]
    found = distinct.withColumn("anchor", longest)
    return found.select("anchor", (F.array_position("words", F.col("anchor")) - 1).cast("int").alias("offset"), F.size("words").alias("size"), "words", "items")


def _candidates(docs: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """``docs`` with ``n_words`` and a row for each place of an anchor (``pos``, ``anchor``, ``around``: the words near it, ``left``: how many before it)."""
    rows = docs.withColumn("_words", words(F.col("text")))

    def place(w: Column, i: Column) -> Column:
        left = F.least(i, F.lit(size - 1))
        around = F.slice(F.col("_words"), i - left + 1, F.lit(2 * size - 1))
        return F.struct(i.alias("pos"), w.alias("anchor"), around.alias("around"), left.alias("left"))

    anchors = found.select("anchor").distinct()
    known = [r[0] for r in anchors.limit(MAX_ANCHORS + 1).collect()]
    names = [c for c in docs.columns if c != "text"]
    if len(known) <= MAX_ANCHORS:
        # A place is -1 where the word is no anchor; only the others get their surroundings.
        hit = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(known), i).otherwise(-1)), lambda i: i >= 0) if known else F.array().cast("array<int>")
        placed = rows.withColumn("_at", hit).withColumn("_at", F.transform("_at", lambda i: place(F.get("_words", i), i)))
        return placed.select(*names, F.size("_words").alias("n_words"), F.explode_outer("_at").alias("_c")).select(*names, "n_words", "_c.*")
    every = rows.select(*names, F.size("_words").alias("n_words"), F.explode_outer(F.transform("_words", place)).alias("_c")).select(*names, "n_words", "_c.*")
    met = every.join(anchors.withColumn("_known", F.lit(True)), "anchor", "left")
    kept = met.where(F.col("_known") | (F.col("pos").isNull()) | (F.col("pos") == 0))
    return kept.select(*names, "n_words", "pos", "anchor", "around", "left")


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items, spans)``; ``spans``: hit word ranges (start, end), end exclusive, sorted, possibly overlapping.

    One pass over the documents.  The row number only has to tell rows apart within this pass.
    """
    found = settle(windows(benchmark, size), "windows")
    side = F.broadcast(found) if found.limit(MAX_WINDOWS + 1).count() <= MAX_WINDOWS else found
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("_hash"))
    placed = _candidates(rows, found, size)
    begins = F.col("left") - F.col("offset")
    same = (F.col("anchor") == F.col("_anchor")) & (begins >= 0) & (F.slice("around", F.greatest(begins + 1, F.lit(1)), F.col("size")) == F.col("words"))
    met = placed.join(side.withColumnRenamed("anchor", "_anchor"), same, "left")
    start = (F.col("pos") - F.col("offset")).cast("long")
    span = F.when(F.col("_anchor").isNotNull(), F.struct(start.alias("start"), (start + F.col("size")).alias("end")))
    summed = met.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("_hash").alias("_hash"), F.first("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set(span)).alias("spans"),
        F.collect_set("items").alias("_items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], x["end"]).alias("upto")),
        lambda a: a["n"],
    )
    items = F.array_sort(F.array_distinct(F.flatten("_items")))
    return summed.select("doc_id", "_hash", "n_words", covered.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), "spans")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``scan`` with the items as a digest and the verdict."""
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return scan(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a window.  Rows are known by id and text."""
    hit = settle(scan(docs, benchmark).where(F.col("n_hit") > 0).select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h")).distinct(), "contaminated")
    side = F.broadcast(hit) if hit.limit(MAX_KEYS + 1).count() <= MAX_KEYS else hit
    return docs.join(side, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_h")), "left_anti")


def cut(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of every document, its hit words removed; what stood around a word that stays is kept before it."""
    found = scan(docs, benchmark).where(F.col("n_hit") > 0).groupBy("doc_id", "_hash").agg(F.first("spans").alias("_spans"))
    found = found.withColumnsRenamed({"doc_id": "_id", "_hash": "_h"})
    both = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_h")), "left")
    # Each piece is a word with the separators before it; the separators at the end belong to no word.
    pieces = F.regexp_extract_all("text", F.lit(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    out = F.transform(pieces, lambda w, i: F.when(F.exists("_spans", lambda s: (s["start"] <= i) & (i < s["end"])), F.lit("")).otherwise(w))
    return both.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.array_join(out, "")).alias("text"))

"""Headings, anchors and links in the lines of emitted documents, and the links that lead nowhere.

Lines are ``(model_id, doc, section, key1, key2, line)`` as the Markdown sink takes them.  What is looked for is what a renderer would make of them: lines inside
code fences are text, a heading's fragment is its slug, and a slug that comes again in a document gets the suffixes -1, -2 and so on in
document order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions import text
from estatelens.operators.numbering import number_rows, running_count

DOC = ["model_id", "doc"]
FENCE, HEADING = "^```", r"^#{1,6}\s+(.+)$"
ANCHOR, LINK = r'<a\s+id="([^"]+)"\s*>', r"\[[^\]]*\]\(([^)\s]*#[^)\s]*)\)"


def document_order() -> list[Column]:
    return [F.col(c).asc() for c in ("section", "key1", "key2", "line")]


def unfenced(lines: DataFrame) -> DataFrame:
    """The lines outside code fences.  Only documents that hold a fence are numbered."""
    fence = F.col("line").rlike(FENCE)
    docs = lines.where(fence).select(*DOC).distinct()
    counted = running_count(lines.join(docs, DOC, "left_semi"), DOC, document_order(), fence, "_fences")
    outside = counted.where((F.col("_fences") % 2 == 0) & ~fence).select(*lines.columns)
    return lines.join(docs, DOC, "left_anti").select(*lines.columns).unionByName(outside)


def targets(lines: DataFrame) -> DataFrame:
    """``(model_id, doc, fragment, kind)`` of every heading and explicit anchor; an anchor declared twice comes twice."""
    headings = lines.select(*lines.columns, F.regexp_extract("line", HEADING, 1).alias("_title")).where(F.col("_title") != "")
    slugs = headings.withColumn("_slug", text.wiki_slug(text.trimmed(F.col("_title"))))
    numbered = number_rows(slugs, [*DOC, "_slug"], document_order(), "_n")
    suffix = F.when(F.col("_n") == 1, F.lit("")).otherwise(F.concat(F.lit("-"), (F.col("_n") - 1).cast("string")))
    found = numbered.select(*DOC, F.concat("_slug", suffix).alias("fragment"), F.lit("heading").alias("kind"))
    anchors = lines.select(*DOC, F.explode(F.regexp_extract_all("line", F.lit(ANCHOR), F.lit(1))).alias("fragment"), F.lit("anchor").alias("kind"))
    return found.unionByName(anchors)


def references(lines: DataFrame) -> DataFrame:
    """``(model_id, doc, target, fragment)`` of every link with a fragment; ``target`` is the document it names, else its own."""
    each = lines.select(*DOC, F.explode(F.regexp_extract_all("line", F.lit(LINK), F.lit(1))).alias("_link"))
    named = F.regexp_replace(F.substring_index("_link", "#", 1), r"\.md$", "")
    return each.select(*DOC, F.when(named == "", F.col("doc")).otherwise(named).alias("target"), F.regexp_extract("_link", "#(.*)$", 1).alias("fragment"))


def broken(lines: DataFrame) -> DataFrame:
    """``(model_id, doc, target, fragment, reason, links)``: links to no document, to no anchor or with an empty fragment, and anchors declared more than once."""
    shown = unfenced(lines)
    found = targets(shown)
    known = found.groupBy(*DOC, "fragment").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("kind") == "anchor").alias("_anchors"))
    asked = references(shown).groupBy(*DOC, "target", "fragment").agg(F.count(F.lit(1)).alias("links"))
    docs = lines.select("model_id", F.col("doc").alias("target")).distinct().withColumn("_doc", F.lit(True))
    places = known.select("model_id", F.col("doc").alias("target"), "fragment", F.lit(True).alias("_place"))
    met = asked.join(docs, ["model_id", "target"], "left").join(places, ["model_id", "target", "fragment"], "left")
    reason = F.when(F.col("fragment") == "", "empty fragment").when(F.col("_doc").isNull(), "no such document").when(F.col("_place").isNull(), "no such anchor")
    lost = met.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*DOC, "target", "fragment", "reason", "links")
    twice = known.where((F.col("_n") > 1) & (F.col("_anchors") > 0))
    return lost.unionByName(twice.select(*DOC, F.col("doc").alias("target"), "fragment", F.lit("repeated anchor").alias("reason"), F.col("_n").alias("links")))

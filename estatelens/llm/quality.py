"""Quality classifier: an interpolated modified Kneser-Ney n-gram model over bytes, trained on trusted text.

Training counts the n-grams of all trusted texts; the rest are joins of count tables, sharded by n-gram: continuation counts of
each lower order, totals and discounts of each context, and each order's probabilities joined to those of the next lower one.  A document's
measure is its bits a byte (the logarithm of its perplexity), drawn towards its language's mean by SMOOTH bytes so that short texts
aren't judged by a few letters.  It is rejected outside the band between two quantiles of its language's trusted documents (all of them),
widened by SLACK: above lies what no trusted text looks like, below what repeats itself.

A model of up to MAX_SHARED n-grams goes to every task as a table; beyond, ``bits_by_joins`` looks the corpus's distinct n-grams up in the
sharded tables and joins them to each row's instead, with exactly the same results.

Defined results: null and empty texts have no bits and are rejected (nothing to learn from); null or rare languages use the quantiles of all
trusted documents; without trusted documents nothing is rejected but texts without content; repeated rows get equal results; an empty table
gives an empty one; other columns pass through untouched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import as_bytes, settle, slices
from estatelens.llm.contexts import ContextTable, GramTable, grams, whole

#: Bytes an n-gram has.
ORDER = 5
#: N-grams of a model that goes to every task, and ids that go to where texts lie; beyond, the same steps are plain joins.
MAX_SHARED = 4_000_000
MAX_IDS = 1_000_000
#: Quantiles of trusted documents' measure between which documents stay, and what they are widened by, in bits a byte.
LOWEST, HIGHEST, SLACK = 0.002, 0.998, 0.10
SMOOTH = 800
STEPS = 4096
#: A language with fewer trusted documents uses the quantiles of all.
LEAST_TRUSTED = 200


@dataclass
class Model:
    """``probs (order, gram, bits)``: seen n-grams; ``backoffs (order, context, bits)``: what a context adds for unseen bytes."""

    probs: DataFrame
    backoffs: DataFrame
    rows: int


def _low(column: Column | str, n: int) -> Column:
    """The latest ``n`` bytes of a packed n-gram."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * n) - 1)) if isinstance(column, str) else column.bitwiseAND(F.lit((1 << 8 * n) - 1))


def _stepped(bits: Column) -> Column:
    """Bits in steps of 1/STEPS: sums of such numbers are exact in any order, and so in float32 for one n-gram, so the table and the joins agree bit by bit."""
    return F.round(bits * STEPS) / STEPS


def count_grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``(gram, n)`` of ``texts (text)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            packed, n = grams(as_bytes(part.column("text")), order - 1)
            yield pa.RecordBatch.from_arrays([pa.array(packed), pa.array(n)], ["gram", "n"])

    return texts.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """The model of ``texts (text)``."""
    counts = {order: settle(count_grams(texts, order), "grams")}
    for k in range(order - 1, 0, -1):
        counts[k] = settle(counts[k + 1].groupBy(_low("gram", k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")
    probs, backoffs, below = [], [], None
    for k in range(1, order + 1):
        own = counts[k].withColumn("context", F.shiftright("gram", 8))
        seen = own.agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4))).first()
        d1, d2, d3 = _discounts(*seen)
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        totals = own.groupBy("context").agg(F.sum("n").alias("total"), F.sum(discount).alias("left"))
        share = own.join(totals, "context").withColumn("own", (F.col("n") - discount) / F.col("total")).withColumn("gamma", F.col("left") / F.col("total"))
        if below is None:
            chance = share.select("gram", (F.col("own") + F.col("gamma") / 256).alias("p"))
        else:
            lower = below.withColumnsRenamed({"gram": "suffix", "p": "_p"})
            chance = share.withColumn("suffix", _low("gram", k - 1)).join(lower, "suffix").select("gram", (F.col("own") + F.col("gamma") * F.col("_p")).alias("p"))
        below = settle(chance, "chances")
        probs.append(below.select(F.lit(k).alias("order"), "gram", _stepped(-F.log2("p")).alias("bits")))
        escape = -F.log2(F.greatest(F.col("left") / F.col("total"), F.lit(1e-9)))
        backoffs.append(totals.select(F.lit(k).alias("order"), "context", _stepped(escape).alias("bits")))
    all_probs, all_backoffs = probs[0], backoffs[0]
    for p, b in zip(probs[1:], backoffs[1:], strict=True):
        all_probs, all_backoffs = all_probs.unionByName(p), all_backoffs.unionByName(b)
    all_probs, all_backoffs = settle(all_probs, "probs"), settle(all_backoffs, "backoffs")
    return Model(all_probs, all_backoffs, all_probs.count())


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts of 1, 2 and more from the counts of counts; usual values where a sample is too small to give them."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def as_table(model: Model, order: int = ORDER) -> ContextTable | None:
    """The model as a dense table of contexts and bytes, to compare with; None if nothing was trained."""
    probs, backoffs = ({n: t.column(n).to_numpy() for n in t.column_names} for t in (model.probs.toArrow(), model.backoffs.toArrow()))
    if not len(probs["gram"]):
        return None
    symbols = [int(s) for s in np.unique(probs["gram"] & 255) if s]
    place = np.zeros(256, np.int64)
    place[symbols] = np.arange(1, len(symbols) + 1)
    contexts, costs = [], []
    for k in range(order):
        back = np.flatnonzero(backoffs["order"] == k + 1)
        back = back[np.argsort(backoffs["context"][back])]
        context = backoffs["context"][back]
        inside = np.ones(len(context), bool)
        for b in range(k):
            inside &= ((context >> (8 * b)) & 255) != 0
        context, gamma = context[inside], backoffs["bits"][back[inside], None].astype(np.float32)
        above = np.full((len(context), len(symbols) + 1), 8, np.float32) if k == 0 else costs[k - 1][np.searchsorted(contexts[k - 1], context & ((1 << 8 * (k - 1)) - 1)), :, 0]
        bits = gamma + above
        own = probs["order"] == k + 1
        gram, value = probs["gram"][own], probs["bits"][own]
        at = np.minimum(np.searchsorted(context, gram >> 8), len(context) - 1)
        use = (context[at] == gram >> 8) & ((gram & 255) != 0)
        bits[at[use], place[gram[use] & 255]] = value[use]
        contexts.append(context)
        costs.append(bits[:, :, None])
    return ContextTable.of(symbols, contexts, costs)


def as_grams(model: Model, order: int = ORDER) -> GramTable | None:
    """The model as a table of its own n-grams and contexts for tasks, without a cell for what was not seen; None if nothing was trained."""
    probs, backoffs = ({n: t.column(n).to_numpy() for n in t.column_names} for t in (model.probs.toArrow(), model.backoffs.toArrow()))
    if not len(probs["gram"]):
        return None

    def sorted_part(table: dict, name: str, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        use = np.flatnonzero((table["order"] == k + 1) & whole(table[name], size))
        use = use[np.argsort(table[name][use])]
        return table[name][use], table["bits"][use, None].astype(np.float32)

    seen, costs = zip(*(sorted_part(probs, "gram", k, k + 1) for k in range(order)), strict=True)
    contexts, escapes = zip(*(sorted_part(backoffs, "context", k, k) for k in range(order)), strict=True)
    return GramTable(list(seen), list(costs), list(contexts), list(escapes))


def bits_by_table(docs: DataFrame, table: ContextTable | GramTable, key: list[str]) -> DataFrame:
    """``(*key, bits, size)`` of every whole text of ``docs (*key, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kinds = docs.select(*key).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = as_bytes(part.column("text"))
            bits = shared.value.totals(texts)[:, 0]
            columns = [*(part.column(k) for k in key), pa.array(bits), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*key, "bits", "size"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "bits double", "size long"])
    return docs.select(*key, "text").mapInArrow(run, schema)


def _whole(column: str, size: int) -> Column:
    """Whether none of the latest ``size`` bytes is 0: contexts that reach over a text's start, and bytes of value 0, count as not seen."""
    inside = F.lit(True)
    for b in range(size):
        inside = inside & (F.shiftright(column, 8 * b).bitwiseAND(255) != 0)
    return inside


def gram_bits(asked: DataFrame, model: Model, order: int = ORDER) -> DataFrame:
    """``(gram, bits)`` of distinct n-grams ``asked (gram)``, by joins with the sharded tables from the longest order down."""
    left = asked.select("gram", F.lit(None).cast("double").alias("bits"), F.lit(0.0).alias("added"))
    for k in range(order, 0, -1):
        probs = model.probs.where((F.col("order") == k) & _whole("gram", k)).select(F.col("gram").alias("_g"), F.col("bits").alias("_p"))
        backoffs = model.backoffs.where((F.col("order") == k) & _whole("context", k - 1)).select(F.col("context").alias("_c"), F.col("bits").alias("_b"))
        if k <= 2:  # at most 65,536 rows; few keys would put all that is asked in few tasks
            probs, backoffs = F.broadcast(probs), F.broadcast(backoffs)
        keyed = left.withColumn("_g", _low("gram", k)).withColumn("_c", _low(F.shiftright("gram", 8), k - 1))
        met = keyed.join(probs, "_g", "left").join(backoffs, "_c", "left")
        left = met.select("gram", F.coalesce("bits", F.col("added") + F.col("_p")).alias("bits"), (F.col("added") + F.coalesce("_b", F.lit(0.0))).alias("added"))
    return left.select("gram", F.coalesce("bits", F.col("added") + 8).alias("bits"))


def bits_by_joins(docs: DataFrame, model: Model, key: str | list[str], order: int = ORDER) -> DataFrame:
    """As ``bits_by_table``, one result for each row whatever its key: rows get a number, and their n-grams meet the bits of the distinct ones."""
    key = [key] if isinstance(key, str) else key
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *key, "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_row", *key, "size", "gram", "n"]
        for part in slices(batches, "text"):
            texts, none = as_bytes(part.column("text")), pa.nulls(part.num_rows, pa.int64())
            heads = [part.column("_row"), *(part.column(k) for k in key), pa.array([len(t) for t in texts], pa.int64()), none, none]
            yield pa.RecordBatch.from_arrays(heads, names)
            for number, text in zip(part.column("_row").to_pylist(), texts, strict=True):
                packed, n = grams([text], order - 1)
                blank = [pa.nulls(len(n), part.column(k).type) for k in key]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), number)), *blank, pa.nulls(len(n), pa.int64()), pa.array(packed), pa.array(n)], names)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*key).schema]
    counted = settle(rows.mapInArrow(count, ", ".join(["_row long", *kinds, "size long", "gram long", "n long"])), "document-grams")
    own = counted.where(F.col("gram").isNotNull()).select("_row", "gram", "n")
    summed = own.join(gram_bits(own.select("gram").distinct(), model, order), "gram").groupBy("_row").agg(F.sum(F.col("n") * F.col("bits")).alias("bits"))
    heads = counted.where(F.col("gram").isNull()).select("_row", *key, "size")
    return heads.join(summed, "_row", "left").select(*key, F.coalesce("bits", F.lit(0.0)).alias("bits"), "size")


@dataclass
class Classifier:
    """``bands``: by language (None: all) the mean and the lowest and highest measure that stay."""

    model: Model
    table: GramTable | None
    bands: dict[str | None, tuple[float, float, float]]


def fit(docs: DataFrame, trusted: DataFrame) -> Classifier:
    """Model and bands from ``docs (doc_id, text, lang)`` and the ids of ``trusted (doc_id)``; both come from all trusted documents.

    Up to MAX_IDS ids go to where the texts lie; beyond, the trusted texts are shuffled to them.
    """
    ids = trusted.select("doc_id").distinct()
    own = docs.select("doc_id", "lang", "text").join(F.broadcast(ids) if ids.count() <= MAX_IDS else ids, "doc_id", "left_semi")
    model = train(own)
    if model.rows == 0:
        return Classifier(model, None, {})
    table = as_grams(model) if model.rows <= MAX_SHARED else None
    measured = bits_by_joins(own, model, ["doc_id", "lang"]) if table is None else bits_by_table(own, table, ["doc_id", "lang"])
    known = settle(measured.where(F.col("size") > 0).select("lang", "bits", "size"), "trusted-bits")
    means = known.groupBy("lang").agg((F.sum("bits") / F.sum("size")).alias("mean"), F.count(F.lit(1)).alias("n"))
    overall = known.agg((F.sum("bits") / F.sum("size")).alias("mean"))
    drawn = (F.col("bits") + SMOOTH * F.col("mean")) / (F.col("size") + SMOOTH)
    edges = [F.percentile_approx(drawn, q, 10_000).alias(name) for q, name in ((LOWEST, "low"), (HIGHEST, "high"))]
    own = known.join(means.where((F.col("n") >= LEAST_TRUSTED) & F.col("lang").isNotNull()), "lang").groupBy("lang", "mean").agg(*edges).collect()
    whole = overall.first()["mean"]
    everyone = known.withColumn("mean", F.lit(whole)).agg(*edges).first() if whole is not None else None
    bands = {r["lang"]: (r["mean"], r["low"], r["high"]) for r in own}
    if everyone is not None:
        bands[None] = (whole, everyone["low"], everyone["high"])
    return Classifier(model, table, bands)


def stays(bits: Column, size: Column, lang: Column, bands: dict[str | None, tuple[float, float, float]]) -> Column:
    """Whether a document of these bits, bytes and language is kept."""

    def within(mean: float, low: float, high: float) -> Column:
        return ((bits + SMOOTH * mean) / (size + SMOOTH)).between(low - SLACK, high + SLACK)

    inside = within(*bands[None]) if None in bands else F.lit(True)
    for name, band in bands.items():
        if name is not None:
            inside = F.when(lang == name, within(*band)).otherwise(inside)
    return F.coalesce((size > 0) & inside, F.lit(False))


def classify(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``(doc_id, lang, bits, size, bits_per_byte, keep)`` of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    if classifier.table is not None:
        measured = bits_by_table(rows, classifier.table, ["doc_id", "lang"])
    elif classifier.model.rows:
        measured = bits_by_joins(rows, classifier.model, ["doc_id", "lang"])
    else:
        measured = rows.select("doc_id", "lang", F.lit(0.0).alias("bits"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    return measured.select(
        "*", (F.col("bits") / F.greatest("size", F.lit(1))).alias("bits_per_byte"), stays(F.col("bits"), F.col("size"), F.col("lang"), classifier.bands).alias("keep")
    )


def keep_good(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.  Texts are scored where they lie, none is shuffled."""
    classifier = fit(docs, trusted)
    names = docs.columns
    if classifier.table is None:
        if not classifier.model.rows:
            return docs.where(F.octet_length("text") > 0)
        # What decides is the text and its language: ids may repeat or be null.
        rows = docs.select(F.col("lang").alias("_l"), F.xxhash64("text").alias("_h"), F.hash("text").alias("_i"), "text")
        measured = bits_by_joins(rows, classifier.model, ["_l", "_h", "_i"])
        kept = measured.where(stays(F.col("bits"), F.col("size"), F.col("_l"), classifier.bands)).select("_l", "_h", "_i").distinct()
        same = F.col("lang").eqNullSafe(F.col("_l")) & (F.xxhash64("text") == F.col("_h")) & (F.hash("text") == F.col("_i"))
        return docs.join(kept, same, "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(classifier.table)

    # Rows stay where they are; their texts go out and one number each comes back.
    @F.arrow_udf("double")
    def total_bits(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        return pa.array(np.concatenate([np.zeros(0), *(shared.value.totals(as_bytes(part.column("text")))[:, 0] for part in slices(iter([batch]), "text"))]))

    own = f"_bits_{uuid.uuid4().hex}"  # a name that no column of the input has
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    return docs.withColumn(own, total_bits("text")).where(stays(F.col(own), size, F.col("lang"), classifier.bands)).select(*names)

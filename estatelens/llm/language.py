"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts with counts from a bounded sample of labelled texts; the statistics are then frozen, every
context that was learned among them.  A
byte's code length in a context is that of its share of the counts, or of an escape (distinct bytes seen, as method C) followed by its
code in the next shorter context, bytes already ruled out being excluded; below the empty context all 256 bytes are equal.  A text's
language is the one with the smallest exact code length over all its bytes.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text if nothing could be learned; ties go to the
alphabetically first language; repeated rows get equal results; null labels teach nothing; an empty table gives an empty one; columns other than
those named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.llm.common import as_bytes, slices
from estatelens.llm.contexts import GramTable, grams, whole

#: Bytes of context at most.
DEPTH = 4
#: Labelled documents a language that the trees are learned from, those of smallest hashed id.
LEARN_DOCS = 1_500
#: N-grams whose costs are worked out together; bounds working memory, not what is kept.
BLOCK_GRAMS = 65_536
UNKNOWN = "und"
LEADING_BITS = 12


class LanguageModel:
    def __init__(self, names: list[str], table: GramTable | None):
        self.names, self.table = names, table

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, its share of the probability, bits a byte) of each text."""
        bits = self.table.totals(texts)
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(np.minimum(bits.min(axis=1, keepdims=True) - bits, 0)).sum(axis=1)
        return [self.names[i] for i in best], share, bits.min(axis=1) / np.maximum([len(t) for t in texts], 1)


def learn(labelled: DataFrame, depth: int = DEPTH, docs: int = LEARN_DOCS) -> LanguageModel:
    """Trees of every language of ``labelled (doc_id, text, lang)``.

    The sample's ids are chosen first, without texts; their number is bounded by ``docs`` for each language, so joining them back broadcasts little.
    Counting runs in tasks; what is collected are the sample's distinct contexts.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rank = F.xxhash64(F.col("doc_id").cast("string"))
    ids = known.select("doc_id", "lang", rank.alias("_h"))
    # Counts by language and leading bits of the hash tell up to which bits it takes; only those few rows are ranked, also of a language with a third of all.
    bits = F.shiftright("_h", 64 - LEADING_BITS)
    sizes = ids.groupBy("lang", bits.alias("_bits")).agg(F.count(F.lit(1)).alias("_n"))
    upto = sizes.withColumn("_upto", F.sum("_n").over(Window.partitionBy("lang").orderBy("_bits")))
    edge = upto.where(F.col("_upto") >= docs).groupBy("lang").agg(F.min("_bits").alias("_edge"))
    some = ids.join(edge, "lang", "left").where(F.col("_edge").isNull() | (bits <= F.col("_edge")))
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    chosen = some.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= docs).select("doc_id").distinct()
    sample = known.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            langs, texts = part.column("lang").to_pylist(), as_bytes(part.column("text"))
            for lang in sorted(set(langs)):
                packed, n = grams([t for t, x in zip(texts, langs, strict=True) if x == lang], depth)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(packed), pa.array(n)], ["lang", "gram", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    return freeze(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow(), depth)


def freeze(counts: pa.Table, depth: int, block: int = BLOCK_GRAMS) -> LanguageModel:
    """The code lengths of counts ``(lang, gram, n)``: of every n-gram that a language has seen, and of the escape from every context.

    Orders are worked out from the shortest up, ``block`` n-grams of an order at a time (never a part of a context's).
    """
    if not counts.num_rows:
        return LanguageModel([], None)
    coded = counts.column("lang").combine_chunks().dictionary_encode()
    names = sorted(coded.dictionary.to_pylist())
    lang = np.array([names.index(x) for x in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
    gram, n = counts.column("gram").to_numpy(), counts.column("n").to_numpy()
    seen, costs, contexts, escapes = [], [], [], []
    for k in range(depth + 1):
        inside = whole(gram, k + 1)
        kinds, at = np.unique(gram[inside] & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        context, first = np.unique(kinds >> 8, return_index=True)
        order = np.argsort(at, kind="stable")
        at, own_lang, own_n = at[order], lang[inside][order], n[inside][order]
        cost, escape = np.zeros((len(kinds), len(names)), np.float32), np.zeros((len(context), len(names)), np.float32)
        ends = np.append(first[1:], len(kinds))
        low = 0
        while low < len(context):
            high = max(int(np.searchsorted(ends, first[low] + block, "right")), low + 1)
            a, b = first[low], ends[high - 1]
            rows = slice(*np.searchsorted(at, [a, b]))
            numbers = np.zeros((b - a, len(names)))
            np.add.at(numbers, (at[rows] - a, own_lang[rows]), own_n[rows])
            above = np.full((b - a, len(names)), 1 / 256)
            if k:
                above = np.exp2(-costs[k - 1][np.searchsorted(seen[k - 1], kinds[a:b] & ((1 << 8 * k) - 1))].astype(np.float64))
            starts, of = first[low:high] - a, np.searchsorted(first[low:high], np.arange(a, b), "right") - 1
            total, every = np.add.reduceat(numbers, starts), np.add.reduceat((numbers > 0).astype(float), starts)
            ruled_out = np.add.reduceat(np.where(numbers > 0, above, 0), starts)
            out = np.where(total == 0, 1, every / np.maximum(total + every, 1) / np.maximum(1 - ruled_out, 1e-9))
            share = numbers / np.maximum(total + every, 1)[of]
            cost[a:b] = -np.log2(np.where(numbers > 0, share, out[of] * above))
            escape[low:high] = -np.log2(out)
            low = high
        seen.append(kinds)
        costs.append(cost)
        contexts.append(context)
        escapes.append(escape)
    return LanguageModel(names, GramTable(seen, costs, contexts, escapes))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, bits_per_byte)`` of every whole text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), has_letter(F.col(text_col)).alias("_letter"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = shared.value
        for part in slices(batches, "text"):
            texts = as_bytes(part.column("text"))
            names, share, bits = frozen.predict(texts) if frozen.names else ([UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)))
            letter = np.array(part.column("_letter").to_pylist(), bool) & bool(frozen.names)
            names = [x if ok else UNKNOWN for x, ok in zip(names, letter, strict=True)]
            columns = [part.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(letter, share, 0.0)), pa.array(np.where(letter, bits, 0.0))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, bits_per_byte)``: learned from the labelled rows that aren't held out, applied to all."""
    model = learn(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")

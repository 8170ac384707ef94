"""The operators' registered queries over whole tables, and the DuckDB text of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm import bpe, chat, decontamination, html, jaccard, language, licenses, neighbours, periods, pii, quality, stages, token_files, whitening
from estatelens.llm.common import small_batches, table
from estatelens.session import tune

ROOT = str(Path(__file__).resolve().parents[2])
#: A conversation that says the usual control strings.
EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
NEAREST, QUERY_STEP = 5, 50


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0, NEAREST)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.render(chat.fold(chat.as_events(rows))))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels").where("quality = 1")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_files(spark, token_files.write_files(table(spark, sf_dir, "documents")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.collapse(periods.plant(table(spark, sf_dir, "documents"))))


def _ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The session's settings, and this package on the path of local workers that were started elsewhere."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(tune(spark))
        paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
        if ROOT not in paths:
            spark.sparkContext.environment["PYTHONPATH"] = ":".join(filter(None, [ROOT, *paths]))
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [
        op1_language_id, op2_nearest_neighbours, op3_bpe_round_trip, op4_chat_format, op5_quality, op6_decontamination, op7_license_scan,
        op8_personal_data, op9_token_files, op10_jaccard_join, op11_embedding_whitening, op12_html_text, op13_periodic_runs,
    ]
    return {f.__name__: _ready(f) for f in every} | {"pipeline": _ready(stages.run)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_CHAT = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), done as (
  select *, length(regexp_replace(regexp_replace(text, '<(\\*)(/?(?:s|SYS)>)', '<\1\\\2', 'g'), '\[(\\*)(/?INST\])', '[\1\\\2', 'g')) as n from rows
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(n + length(role) + 8) as bigint) as formatted_chars
from done group by conv_id
"""

_WINDOWS = rf"""
with words as (
  select doc_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from documents
), items as (
  select cast(item_id as varchar) as item, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from benchmark
), cut as (
  select distinct item, array_to_string(w[s + 1 : s + 10], ' ') as win, least(len(w), 10) as n
  from items, unnest(range(greatest(len(w) - 10, 0) + 1)) as t(s) where len(w) > 0
), sizes as (select distinct n from cut),
spots as (
  select doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') as win
  from words, sizes, unnest(range(greatest(len(w) - n + 1, 0))) as t(s)
), hits as (select distinct doc_id, s, spots.n, item from spots join cut on spots.win = cut.win and spots.n = cut.n),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hits) group by doc_id),
held as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hits group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join places using (doc_id) left join held using (doc_id)
"""

_JACCARD = rf"""
with recursive words as materialized (
  select doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), sets as materialized (
  select distinct doc_id, array_to_string(w[s + 1 : s + 3], ' ') as g from words, unnest(range(greatest(len(w) - 3, 0) + 1)) as t(s) where len(w) > 0
), sizes as materialized (select doc_id, count(*) as n from sets group by doc_id),
common as materialized (select a.doc_id as x, b.doc_id as y, count(*) as c from sets a join sets b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as materialized (
  select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 90 * (p.n + q.n - c)
), edges as materialized (select x, y from links union all select y, x from links),
reached as (select doc_id as a, doc_id as b from documents union select a, y from reached join edges on b = x)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id
from documents d left join sizes using (doc_id) join (select a, min(b) as component_id from reached group by a) r on r.a = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": _CHAT, "op6_decontamination": _WINDOWS, "op10_jaccard_join": _JACCARD}

"""References between expressions: extraction, resolution joins, broken references, function and column uses.

The text is tokenised once per expression; every lookup afterwards is an equi-join on ``(model_id, key)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions import patterns as P
from estatelens.functions import text


def qualified_refs(expressions: DataFrame, body: str = "body") -> DataFrame:
    """One row per distinct ``T[c]`` reference; keeps the other columns."""
    clean = text.strip_comments_and_strings(F.col(body))
    refs = expressions.withColumn("_ref", F.explode(text.qualified_refs(clean)))
    return refs.select(*[c for c in expressions.columns if c != body], "_ref.ref_table", "_ref.ref_column")


def bare_refs(expressions: DataFrame, body: str = "body") -> DataFrame:
    """One row per distinct unqualified ``[x]`` reference; keeps the other columns."""
    clean = text.strip_comments_and_strings(F.col(body))
    refs = expressions.withColumn("ref_name", F.explode(text.bare_refs(clean)))
    return refs.drop(body)


def raw_tokens(expressions: DataFrame, body: str = "body") -> DataFrame:
    """One row per distinct ``[x]`` of the raw text."""
    return expressions.withColumn("ref_name", F.explode(text.bracket_tokens(F.col(body)))).drop(body)


def dependencies(measures: DataFrame, mode: str = "strict") -> DataFrame:
    """Measure-to-measure edges ``(model_id, src, dst)``, names matched without case, self references dropped.

    ``strict`` reads bare references of the stripped body; ``compat`` reads every bracketed token of the raw text.
    """
    source = measures.select("model_id", F.col("name").alias("src"), "body")
    found = bare_refs(source) if mode == "strict" else raw_tokens(source)
    keys = found.select("model_id", "src", F.lower("ref_name").alias("_key")).distinct()
    names = measures.select("model_id", F.col("name").alias("dst"), F.lower("name").alias("_key"))
    return keys.join(names, ["model_id", "_key"]).where(F.col("src") != F.col("dst")).select("model_id", "src", "dst")


def reverse_dependencies(edges: DataFrame) -> DataFrame:
    """Per measure, how many measures refer to it (the members stay rows: swap the edge)."""
    return edges.groupBy("model_id", F.col("dst").alias("name")).agg(F.count(F.lit(1)).alias("depended_on_by"))


def external_proxies(measures: DataFrame, expressions: DataFrame) -> DataFrame:
    """Measures that re-expose a measure of a remote model, with the cluster and database their expression names."""
    body = F.col("body")
    proxies = measures.where(text.is_external(body)).select(
        "model_id", "table_name", "name", text.external_name(body).alias("remote_name"),
        text.external_type(body).alias("remote_type"), text.external_model(body).alias("external_model"),
    )
    value = F.col("value")
    remote = expressions.where(value.rlike(P.REMOTE_CLUSTER)).select(
        "model_id", F.col("name").alias("_expression"), F.regexp_extract(value, P.REMOTE_CLUSTER, 1).alias("cluster"),
        F.nullif(F.regexp_extract(value, P.REMOTE_CLUSTER_AND_DATABASE, 2), F.lit("")).alias("database"),
    )
    key = F.concat(F.lit(P.REMOTE_PREFIX), F.col("external_model"))
    return proxies.withColumn("_expression", key).join(remote, ["model_id", "_expression"], "left").drop("_expression")


def expressions_to_check(measures: DataFrame, calc_items: DataFrame, functions: DataFrame) -> DataFrame:
    """Every expression text with its label; proxies of remote models are left out."""
    local = measures.where(~text.is_external(F.col("body"))).select(
        "model_id", F.concat("table_name", F.lit("["), "name", F.lit("]")).alias("where"), "body"
    )
    items = calc_items.select("model_id", F.concat("group_name", F.lit(" · "), "name").alias("where"), "body")
    udfs = functions.select("model_id", F.concat(F.lit("Function "), F.col("name")).alias("where"), "body")
    return local.unionByName(items).unionByName(udfs)


def table_names(columns: DataFrame, measures: DataFrame, calc_items: DataFrame) -> DataFrame:
    """Tables that exist: those with a column, a measure or calculation items."""
    return (
        columns.select("model_id", "table_name")
        .union(measures.select("model_id", "table_name"))
        .union(calc_items.select("model_id", F.col("group_name").alias("table_name")))
        .distinct()
    )


def broken_references(measures: DataFrame, columns: DataFrame, calc_items: DataFrame, functions: DataFrame) -> DataFrame:
    """``(model_id, where, broken, reason)`` for every reference nothing in its model resolves."""
    checked = expressions_to_check(measures, calc_items, functions)
    measure_keys = measures.select("model_id", F.lower("name").alias("_c")).distinct()

    qualified = (
        qualified_refs(checked)
        .withColumn("_t", F.lower("ref_table")).withColumn("_c", F.lower("ref_column"))
    )
    column_keys = columns.select("model_id", F.lower("table_name").alias("_t"), F.lower("name").alias("_c")).distinct()
    # Nearly every reference resolves here, so the two joins below see only the remainder.
    unresolved = qualified.join(column_keys, ["model_id", "_t", "_c"], "left_anti")
    tables = table_names(columns, measures, calc_items).select("model_id", F.lower("table_name").alias("_t")).distinct()
    judged = (
        unresolved.join(tables.withColumn("_table", F.lit(True)), ["model_id", "_t"], "left")
        .join(measure_keys.withColumn("_measure", F.lit(True)), ["model_id", "_c"], "left")
        .where(F.col("_table").isNull() | F.col("_measure").isNull())
    )
    broken_columns = judged.select(
        "model_id", "where", F.concat("ref_table", F.lit("["), "ref_column", F.lit("]")).alias("broken"),
        F.when(F.col("_table").isNull(), "table not in model").otherwise("column not on table").alias("reason"),
    )

    any_name = measure_keys.union(columns.select("model_id", F.lower("name"))).distinct()
    bare = bare_refs(checked).withColumn("_c", F.lower("ref_name"))
    broken_names = bare.join(any_name, ["model_id", "_c"], "left_anti").select(
        "model_id", "where", F.concat(F.lit("["), "ref_name", F.lit("]")).alias("broken"),
        F.lit("measure/column not found").alias("reason"),
    )
    return broken_columns.unionByName(broken_names)


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")]


def relationship_calls(measures: DataFrame, mode: str = "compat") -> DataFrame:
    """Distinct end pairs, in no order, of the relationship-activating calls in the measures of each model.

    ``compat`` compares column names only, ``strict`` compares table and column.
    """
    calls = measures.select("model_id", F.explode(F.regexp_extract_all("body", F.lit(P.USERELATIONSHIP), F.lit(1))).alias("_args"))
    if mode == "strict":
        ends = F.transform(
            text.qualified_refs(F.col("_args")), lambda r: F.lower(F.concat(r["ref_table"], F.lit("|"), r["ref_column"]))
        )
    else:
        ends = F.transform(F.regexp_extract_all("_args", F.lit(P.BARE), F.lit(1)), F.lower)
    found = calls.withColumn("_ends", ends).where(F.size("_ends") >= 2)
    return found.select("model_id", *_pair(F.get("_ends", F.lit(0)), F.get("_ends", F.lit(1)))).distinct()


def inactive_without_caller(relationships: DataFrame, measures: DataFrame, mode: str = "compat") -> DataFrame:
    """Inactive relationships no measure activates."""
    if mode == "strict":
        a, b = (F.lower(F.concat(f"{end}_table", F.lit("|"), f"{end}_column")) for end in ("from", "to"))
    else:
        a, b = F.lower("from_column"), F.lower("to_column")
    inactive = relationships.where(~F.col("is_active"))
    keyed = inactive.select("*", *_pair(a, b))
    return keyed.join(relationship_calls(measures, mode), ["model_id", "_a", "_b"], "left_anti").drop("_a", "_b")


def without_about(functions: DataFrame) -> DataFrame:
    """Functions a modeller wrote: the generated ``.About`` companions are dropped."""
    return functions.where(~F.col("name").endswith(".About"))


def function_uses(functions: DataFrame, measures: DataFrame) -> DataFrame:
    """``(model_id, function, table_name, measure)``: the body calls ``name(`` or quotes ``'name'``; case matters.

    Whatever stands between two quotes counts, so an apostrophe in a comment hides no name behind it.
    """
    body = F.col("body")
    calls = F.regexp_extract_all(body, F.lit(r"([A-Za-z_][\w.]*)\("), F.lit(1))
    pieces = F.split(body, "'", -1)
    quoted = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))
    tokens = measures.select(
        "model_id", "table_name", F.col("name").alias("measure"), F.explode(F.array_distinct(F.concat(calls, quoted))).alias("function")
    )
    names = functions.select("model_id", F.col("name").alias("function"))
    return tokens.join(names, ["model_id", "function"]).select("model_id", "function", "table_name", "measure")


def column_refs(measures: DataFrame, columns: DataFrame) -> DataFrame:
    """``(model_id, table_name, column, measure_table, measure)``: the measure's text holds ``T[column]``, case kept."""
    source = measures.select("model_id", F.col("table_name").alias("measure_table"), F.col("name").alias("measure"), "body")
    found = qualified_refs(source).withColumnsRenamed({"ref_table": "table_name", "ref_column": "column"})
    named = columns.select("model_id", "table_name", F.col("name").alias("column"))
    return found.join(named, ["model_id", "table_name", "column"]).select("model_id", "table_name", "column", "measure_table", "measure")


def column_mentions(measures: DataFrame, columns: DataFrame) -> DataFrame:
    """Per column the number of measures whose raw text holds ``[column]``, whatever table they mean.

    Counted per name before the join: columns of one name share the count, and no (column, measure) pairs are formed.
    """
    counts = raw_tokens(measures.select("model_id", "body")).groupBy("model_id", F.col("ref_name").alias("column")).agg(
        F.count(F.lit(1)).alias("measures")
    )
    return columns.select("model_id", "table_name", F.col("name").alias("column")).join(counts, ["model_id", "column"])

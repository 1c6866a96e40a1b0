"""Column types and suggested functions, over the test tables as they are and as messy text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskflow.checks.base import quote, register, table
from maskflow.operators.profile import NO_FLOAT, detect_types, is_date, number_bits, word_bit
from maskflow.plans.suggest import SETTINGS, suggest_config, suggest_functions

WORDS = "('true', 'false', '1', '0', 'yes', 'no', 't', 'f', 'y', 'n')"

# Orders as a text file would deliver them.
MESSY = {
    "o_orderkey": "lpad(cast(o_orderkey AS string), 8, '0')",
    "yes_no": "CASE WHEN o_orderkey % 3 = 0 THEN 'Yes' WHEN o_orderkey % 3 = 1 THEN ' no ' END",
    "three_words": "CASE WHEN o_orderkey % 3 = 0 THEN 'yes' WHEN o_orderkey % 3 = 1 THEN 'no' ELSE 'true' END",
    "zero_one": "cast(o_orderkey % 2 AS string)",
    "day_first": "CASE WHEN o_orderkey % 2 = 0 THEN '12/31/2020' ELSE '31/12/2020' END",
    "iso_time": "substr(cast(o_orderdate AS string), 1, 10) || 'T10:15:00'",
    "bad_date": "CASE WHEN o_orderkey = 77 THEN '2020-13-01' ELSE '2020-12-01' END",
    "date_junk": "CASE WHEN o_orderkey = 78 THEN '2020-01-01 junk' ELSE '2020/01/01' END",
    "whole_float": "cast(o_custkey AS string) || '.0'",
    "decimal_text": "cast(o_custkey AS string) || CASE WHEN o_orderkey % 2 = 0 THEN '.5' ELSE 'e1' END",
    "jvm_number": "cast(o_custkey AS string) || 'd'",
    "empty": "nullif(o_orderstatus, o_orderstatus)",
    "name": "o_orderpriority",
    "Vorname": "o_orderstatus",
    "Strasse": "o_orderpriority",
    "s": "o_orderpriority",
    "hausnummer": "cast(o_custkey % 99 AS string)",
}
TYPED = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}
MORE_TYPED = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
}


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", [f"{e} AS {c}" for c, e in MESSY.items()])


def date_sql(v: str) -> str:
    y, a, b = f"substr({v}, 7, 4)", f"substr({v}, 1, 2)", f"substr({v}, 4, 2)"
    time = "([T ]([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.][0-9]+)?)?[ ]*(Z|[+-][0-9]{2}:?[0-9]{2})?)?"
    return (
        f"(CASE WHEN regexp_full_match({v}, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}){time}') "
        f"THEN try_cast(replace(substr({v}, 1, 10), '/', '-') AS date) IS NOT NULL "
        f"WHEN regexp_full_match({v}, '([0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}|[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}){time}') "
        f"THEN try_cast({y} || '-' || {a} || '-' || {b} AS date) IS NOT NULL OR try_cast({y} || '-' || {b} || '-' || {a} AS date) IS NOT NULL "
        f"ELSE false END)"
    )


def column_sql(source: str, position: int, name: str) -> str:
    """The type of one column from the text of its values."""
    v = "trim(v)"
    return (
        f"SELECT {position} AS position, {quote(name)} AS \"column\", CASE WHEN count(v) = 0 THEN 'string' "
        f"WHEN count(*) FILTER (v IS NOT NULL AND lower({v}) NOT IN {WORDS}) = 0 AND count(DISTINCT lower({v})) <= 2 THEN 'boolean' "
        f"WHEN count(*) FILTER (v IS NOT NULL AND NOT {date_sql(v)}) = 0 THEN 'date' "
        f"WHEN count(*) FILTER (v IS NOT NULL AND (try_cast({v} AS double) IS NULL OR try_cast({v} AS double) % 1 <> 0)) = 0 THEN 'integer' "
        f"WHEN count(*) FILTER (v IS NOT NULL AND try_cast({v} AS double) IS NULL) = 0 THEN 'float' ELSE 'string' END AS type, "
        f"count(v) AS filled, count(*) AS rows FROM (SELECT cast({name} AS varchar) AS v FROM ({source}))"
    )


def table_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(column_sql(source, i, c) for i, c in enumerate(columns))


MESSY_SOURCE = f"SELECT {', '.join(f'{e} AS {c}' for c, e in MESSY.items())} FROM orders"
MESSY_SQL = table_sql(MESSY_SOURCE, list(MESSY))


@register("detect_types_text", MESSY_SQL)
def detect_types_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_types(messy(spark, sf_dir))


def tables_sql(tables: dict[str, list[str]]) -> str:
    return " UNION ALL ".join(f"SELECT {quote(t)} AS source, * FROM ({table_sql(t, cs)})" for t, cs in tables.items())


def types_of(spark: SparkSession, sf_dir: str, tables: dict[str, list[str]]) -> DataFrame:
    parts = [detect_types(table(spark, sf_dir, t, cs)).select(F.lit(t).alias("source"), "*") for t, cs in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@register("detect_types_tables", tables_sql(TYPED))
def detect_types_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return types_of(spark, sf_dir, TYPED)


@register("detect_types_more_tables", tables_sql(MORE_TYPED))
def detect_types_more_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other tables, with long texts and vectors."""
    return types_of(spark, sf_dir, MORE_TYPED)


@register(
    "value_tests",
    f"""
WITH p AS (SELECT o_orderkey, CASE o_orderkey % 12 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'n' WHEN 2 THEN '31-12-2020' WHEN 3 THEN '2020/02/30'
  WHEN 4 THEN '1999-01-02 03:04:05.678Z' WHEN 5 THEN '0012' WHEN 6 THEN '1e3' WHEN 7 THEN '-1.50' WHEN 8 THEN 'abc' WHEN 9 THEN '1f' WHEN 10 THEN NULL
  ELSE substr(cast(o_orderdate AS varchar), 1, 10) END AS v FROM orders)
SELECT o_orderkey, v, v IS NOT NULL AND lower(trim(v)) IN {WORDS} AS boolean_word, coalesce({date_sql('trim(v)')}, false) AS date,
  coalesce(try_cast(trim(v) AS double) % 1 = 0, false) AS whole, try_cast(trim(v) AS double) IS NOT NULL AS number FROM p
""",
)
def value_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (
        "CASE o_orderkey % 12 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'n' WHEN 2 THEN '31-12-2020' WHEN 3 THEN '2020/02/30' "
        "WHEN 4 THEN '1999-01-02 03:04:05.678Z' WHEN 5 THEN '0012' WHEN 6 THEN '1e3' WHEN 7 THEN '-1.50' WHEN 8 THEN 'abc' "
        "WHEN 9 THEN '1f' WHEN 10 THEN NULL ELSE substr(cast(o_orderdate AS string), 1, 10) END AS v"
    )
    df = table(spark, sf_dir, "orders", ["o_orderkey", v])
    c = F.trim("v")
    bits = number_bits(c)
    return df.select(
        "o_orderkey",
        "v",
        (c.isNotNull() & (word_bit(c) != 0)).alias("boolean_word"),
        is_date(c).alias("date"),
        F.coalesce(c.isNotNull() & (bits == 0), F.lit(False)).alias("whole"),
        F.coalesce(c.isNotNull() & (bits.bitwiseAND(F.lit(NO_FLOAT)) == 0), F.lit(False)).alias("number"),
    )


FUNCTION_SQL = (
    "CASE WHEN lower(\"column\") IN ('name', 'nachname', 'nach_name', 'last_name') THEN 'last_name' "
    "WHEN lower(\"column\") IN ('vorname', 'vor_name', 'first_name') THEN 'first_name' WHEN lower(\"column\") = 'strasse' THEN 'street_name' "
    "WHEN lower(\"column\") IN ('hnr', 'hausnummer') THEN 'house_number' WHEN type = 'integer' THEN 'random_int' "
    "WHEN type = 'float' THEN 'random_float' WHEN type = 'boolean' THEN 'list_string' END"
)
SETTINGS_SQL = "CASE f" + "".join(f" WHEN {quote(f)} THEN {quote(json.dumps(s))}" for f, s in SETTINGS.items()) + " ELSE '{}' END"


@register(
    "suggest_functions",
    f"""
WITH t AS ({MESSY_SQL}), f AS (SELECT *, {FUNCTION_SQL} AS f FROM t)
SELECT position, "column", type, filled, rows, f AS "function", {SETTINGS_SQL} AS settings FROM f
""",
)
def suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest_functions(messy(spark, sf_dir))


@register(
    "suggest_config",
    f"""
WITH t AS ({MESSY_SQL}), f AS (SELECT *, {FUNCTION_SQL} AS f FROM t)
SELECT 'in_anonymized.csv' AS filename, '.csv' AS format, ';' AS separator, 'utf-8' AS encoding, rows, "column", type AS data_type, f AS "function" FROM f
""",
)
def suggested_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = suggest_config(messy(spark, sf_dir), "in.csv")
    rows = [
        (config["filename"], config["format"], config["separator"], config["encoding"], config["rows"], c, s["data_type"], s["function"])
        for c, s in config["columns"].items()
    ]
    return spark.createDataFrame(
        rows,
        "filename string, format string, separator string, encoding string, rows long, column string, data_type string, function string",
    )

"""Projections of the test tables that stand for personal data; the same text runs in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskflow.checks.base import select, table, values
from maskflow.sources.lookups import FEMALE_NAMES, LAST_NAMES, MALE_NAMES, PLACES, Lookups

PEOPLE = [
    "c_custkey AS id",
    "CASE c_custkey % 9 WHEN 0 THEN 'Andrea' WHEN 1 THEN 'Beat' WHEN 2 THEN 'Zora' WHEN 3 THEN 'Xaver' "
    "WHEN 4 THEN 'Anna' WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN 'Zoë-Ann' ELSE c_name END AS vorname",
    "CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN '' ELSE c_name END AS nachname",
    "CASE WHEN c_custkey % 3 = 0 THEN '1' ELSE '2' END AS geschlecht",
    "CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN '12345' WHEN c_custkey % 10 = 2 THEN '' "
    "WHEN c_custkey % 10 = 3 THEN 'keine' WHEN c_custkey % 10 = 4 THEN '0041 (79) ' || cast(100 + c_custkey % 900 AS string) || '-21-45' "
    "ELSE '+41 79 ' || lpad(cast(c_custkey % 1000 AS string), 3, '0') || ' ' || lpad(cast(c_custkey % 97 AS string), 2, '0') || ' 45' END AS telefon",
    "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN ' ' ELSE 'k' || cast(c_custkey AS string) || '@mail.example' END AS email",
    "CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE cast(1000 + c_nationkey AS string) END AS plz",
    "CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE 'red ring ' || cast(c_custkey % 40 AS string) END AS adresse",
    "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'Hauptgasse' END AS strasse",
    "CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE cast(c_custkey % 50 AS string) END AS hausnummer",
    "CASE WHEN c_custkey % 21 = 0 THEN NULL ELSE c_mktsegment END AS code",
    "CASE WHEN c_custkey % 15 = 0 THEN NULL ELSE c_custkey % 500 END AS nummer",
    "CASE WHEN c_custkey % 16 = 0 THEN NULL ELSE '756.1234.' || lpad(cast(c_custkey % 10000 AS string), 4, '0') || '.08' END AS ahv",
]
PEOPLE_SQL = select("customer", PEOPLE)

ORDERS = [
    "o_orderkey AS id",
    "o_orderdate AS bestellt",
    "CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 9 = 1 THEN 'kein Datum' "
    "WHEN o_orderkey % 9 = 2 THEN substr(cast(o_orderdate AS string), 1, 10) "
    "ELSE substr(cast(o_orderdate AS string), 1, 10) || 'T23:59:0' || cast(o_orderkey % 10 AS string) END AS datum",
    "CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE o_totalprice END AS betrag",
    "CASE WHEN o_orderkey % 10 = 0 THEN 'abc' WHEN o_orderkey % 10 = 1 THEN cast(o_custkey AS string) || '.0' "
    "WHEN o_orderkey % 10 = 2 THEN '1e3' WHEN o_orderkey % 10 = 3 THEN '12.5' WHEN o_orderkey % 10 = 4 THEN NULL "
    "ELSE cast(o_custkey AS string) END AS zahl",
    "o_orderpriority AS prioritaet",
]
ORDERS_SQL = select("orders", ORDERS)

# Parts stand for addresses: a name as the street, a size as the number, 25 postcodes.
ADDRESSES = [
    "p_name AS str_name",
    "p_size AS hausnr",
    "CASE WHEN p_partkey % 5 = 0 THEN 'a' WHEN p_partkey % 5 = 1 THEN '' ELSE NULL END AS hausnr_zus",
    "cast(1000 + p_partkey % 23 AS int) AS plz",
    "p_brand AS ort",
]
ADDRESSES_SQL = select("part", ADDRESSES)

LAST_NAMES_SQL = values([(n, 3 + (13 * i) % 60) for i, n in enumerate(LAST_NAMES)], "nachname, anzahl")
FIRST_NAMES_SQL = values(
    [(n, "M", 5 + (7 * i) % 40) for i, n in enumerate(MALE_NAMES)]
    + [(n, "F", 5 + (11 * i) % 40) for i, n in enumerate(FEMALE_NAMES)],
    "vorname, geschlecht, anzahl",
)
POSTCODES_SQL = values(
    [(*row, i) for i, row in enumerate(PLACES)], "plz_postleitzahl, gemeinde_name, kanton_name, kanton_name_kurz, ord"
)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", PEOPLE)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", ORDERS)


def table_lookups(spark: SparkSession, sf_dir: str) -> Lookups:
    return Lookups(spark, addresses=table(spark, sf_dir, "part", ADDRESSES))

# Suppliers stand for places: several share a postcode, nations are the cantons.
POSTCODES = [
    "cast(1000 + s_suppkey % 60 AS int) AS plz_postleitzahl",
    "s_name AS gemeinde_name",
    "'Kanton ' || cast(s_nationkey AS string) AS kanton_name",
    "'K' || cast(s_nationkey AS string) AS kanton_name_kurz",
    "s_suppkey AS ord",
]
PLACES_SQL = select("supplier", POSTCODES)


def place_lookups(spark: SparkSession, sf_dir: str) -> Lookups:
    return Lookups(
        spark,
        addresses=table(spark, sf_dir, "part", ADDRESSES),
        postcodes=table(spark, sf_dir, "supplier", POSTCODES),
    )

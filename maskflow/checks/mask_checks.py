"""Masks, one query each, and a whole table with all of them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskflow.checks.base import KEY, choice, digest, draw, normal, quote, register, slots, social_security, table, unit
from maskflow.checks.tables import (
    ADDRESSES_SQL,
    FIRST_NAMES_SQL,
    LAST_NAMES_SQL,
    ORDERS_SQL,
    PEOPLE_SQL,
    orders,
    people,
    table_lookups,
)
from maskflow.functions import draws
from maskflow.functions.permute import permute_sql
from maskflow.functions.stage import Stage
from maskflow.functions.text import normalise_name, split_street
from maskflow.operators.masks import HOUSE_LETTERS, MaskContext, blank_to_null, gender_of
from maskflow.plans.mask import mask_table, plan_masks
from maskflow.sources.lookups import FEMALE_NAMES, LAST_NAMES, MALE_NAMES, STREETS, Lookups

LAST_SLOTS = slots(LAST_NAMES_SQL, ["nachname"], "anzahl")
FIRST_SLOTS = slots(FIRST_NAMES_SQL, ["vorname"], "anzahl", "geschlecht")
ADDRESS_COLUMNS = ["str_name", "hausnr", "hausnr_zus", "plz", "ort"]
ADDRESS_SLOTS = slots(ADDRESSES_SQL, ADDRESS_COLUMNS, "1", "plz")
PLACE_SLOTS = slots(ADDRESSES_SQL, ADDRESS_COLUMNS, "1", "ort")


def mask(df: DataFrame, columns: dict, lookups: Lookups | None = None, keep: list[str] | None = None) -> DataFrame:
    """Mask with the check key and put the masked columns beside the inputs."""
    out = mask_table(df, {"columns": columns}, lookups, KEY, ["id"])
    return out.select(*(keep or ["id", *columns]))


# --- names -----------------------------------------------------------------

LAST = {"nachname": {"data_type": "string", "function": "last_name", "source": "ogd-bs"}}
LAST_SQL = f"""
WITH p AS ({PEOPLE_SQL}), s AS ({LAST_SLOTS}),
d AS (SELECT id, nullif(nachname, '') AS v, {draw(digest('nachname', "nullif(nachname, '')"))} AS d FROM p)
SELECT d.id, CASE WHEN d.v IS NOT NULL THEN s.nachname END AS nachname
FROM d JOIN s ON d.d % s.total >= s.lo AND d.d % s.total < s.hi
"""


@register("mask_last_name", LAST_SQL)
def mask_last_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(people(spark, sf_dir), LAST)


@register(
    "mask_last_name_library",
    f"""
WITH p AS ({PEOPLE_SQL})
SELECT id, CASE WHEN nachname <> '' THEN {choice(LAST_NAMES, digest('nachname', "nullif(nachname, '')"))} END AS nachname FROM p
""",
)
def mask_last_name_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(people(spark, sf_dir), {"nachname": {"data_type": "string", "function": "last_name", "source": "faker"}})


GENDERED = "CASE WHEN geschlecht = '1' THEN 'M' ELSE 'F' END"


@register(
    "mask_first_name_by_gender_field",
    f"""
WITH p AS ({PEOPLE_SQL}), s AS ({FIRST_SLOTS}),
d AS (SELECT id, nullif(vorname, '') AS v, {GENDERED} AS g, {draw(digest('vorname', "nullif(vorname, '')", GENDERED))} AS d FROM p)
SELECT d.id, CASE WHEN d.v IS NOT NULL THEN s.vorname END AS vorname
FROM d JOIN s ON s.grp = d.g AND d.d % s.total >= s.lo AND d.d % s.total < s.hi
""",
)
def mask_first_name_by_gender_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"function": "first_name", "source": "ogd-bs", "gender_field": "geschlecht", "gender_field_male_identfier": "1"}
    return mask(people(spark, sf_dir), {"vorname": {"data_type": "string", **settings}})


KNOWN_GENDER_SQL = f"""
SELECT vorname, max_by(geschlecht, n) AS geschlecht FROM
(SELECT vorname, geschlecht, sum(anzahl) AS n FROM ({FIRST_NAMES_SQL}) GROUP BY vorname, geschlecht) GROUP BY vorname
"""
GUESSED = "CASE WHEN p.vorname IS NOT NULL THEN coalesce(k.geschlecht, CASE WHEN ends_with(p.vorname, 'a') THEN 'F' ELSE 'M' END) END"


@register(
    "mask_first_name_detected_gender",
    f"""
WITH p AS ({PEOPLE_SQL}), s AS ({FIRST_SLOTS}), k AS ({KNOWN_GENDER_SQL}),
g AS (SELECT p.id, nullif(p.vorname, '') AS vorname, {GUESSED} AS g FROM p LEFT JOIN k ON k.vorname = p.vorname),
d AS (SELECT *, {draw(digest('vorname', 'vorname', 'g'))} AS d FROM g)
SELECT d.id, CASE WHEN d.vorname IS NOT NULL THEN s.vorname END AS vorname
FROM d LEFT JOIN s ON s.grp = d.g AND d.d % s.total >= s.lo AND d.d % s.total < s.hi
""",
)
def mask_first_name_detected_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(people(spark, sf_dir), {"vorname": {"data_type": "string", "function": "first_name", "source": "ogd-bs"}})


@register(
    "mask_first_name_library",
    f"""
WITH p AS ({PEOPLE_SQL}),
d AS (SELECT *, CASE WHEN geschlecht = 'F' THEN 'F' ELSE 'M' END AS g FROM p),
h AS (SELECT *, {digest('vorname', "nullif(vorname, '')", 'g')} AS h FROM d)
SELECT id, CASE WHEN vorname <> '' THEN CASE WHEN g = 'F' THEN {choice(FEMALE_NAMES, 'h')} ELSE {choice(MALE_NAMES, 'h')} END END AS vorname FROM h
""",
)
def mask_first_name_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"function": "first_name", "source": "faker", "gender_field": "geschlecht"}
    return mask(people(spark, sf_dir), {"vorname": {"data_type": "string", **settings}})


@register(
    "gender_of_first_name",
    f"""
WITH p AS ({PEOPLE_SQL}), k AS ({KNOWN_GENDER_SQL})
SELECT p.id, p.vorname, {GUESSED} AS gender FROM p LEFT JOIN k ON k.vorname = p.vorname
""",
)
def gender_of_first_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = people(spark, sf_dir)
    types = {f.name: f.dataType for f in df.schema.fields}
    ctx = MaskContext(KEY, Lookups(spark), df, Stage(df), types, order=df.columns)
    gender = gender_of("vorname", ctx)
    return ctx.stage.df.select("id", "vorname", gender.alias("gender"))


# --- digits ----------------------------------------------------------------


def relaid(new_digit: str, count: int) -> str:
    """Walk over the characters; the last `count` digits come from `new_digit`, a function of their number."""
    seen = "length(regexp_replace(substr(v, 1, i), '[^0-9]', '', 'g'))"
    place = f"({seen} - (n - least(n, {count})))"
    return (
        "array_to_string(list_transform(range(1, length(v) + 1), lambda i: "
        f"CASE WHEN substr(v, i, 1) BETWEEN '0' AND '9' AND {place} > 0 THEN {new_digit.format(place=place)} "
        "ELSE substr(v, i, 1) END), '')"
    )


@register(
    "mask_phone_nr",
    f"""
WITH p AS (SELECT id, telefon AS v, regexp_replace(telefon, '[^0-9]', '', 'g') AS ds,
  {digest('telefon', 'telefon')} AS h FROM ({PEOPLE_SQL})),
t AS (SELECT *, length(ds) AS n, right(ds, 7) AS tail FROM p),
s AS (SELECT *, list_sort(list_transform(range(0, length(tail)), lambda i: {{'k': substr(h, 1 + 9 * i, 9), 'i': i, 'd': substr(tail, i + 1, 1)}})) AS perm FROM t)
SELECT id, CASE WHEN v IS NOT NULL THEN {relaid('perm[{place}].d', 7)} END AS telefon FROM s
""",
)
def mask_phone_nr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(people(spark, sf_dir), {"telefon": {"data_type": "string", "function": "phone_nr"}})


@register(
    "mask_formatted_numbers",
    f"""
WITH p AS (SELECT id, telefon AS v, length(regexp_replace(telefon, '[^0-9]', '', 'g')) AS n,
  lpad(cast({draw(digest('telefon', 'telefon'))} % 10000 AS varchar), 4, '0') AS fresh FROM ({PEOPLE_SQL}))
SELECT id, CASE WHEN v IS NOT NULL THEN {relaid('substr(fresh, cast({place} AS bigint), 1)', 4)} END AS telefon FROM p
""",
)
def mask_formatted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"data_type": "string", "function": "formatted_numbers", "replace_last_digits": 4}
    return mask(people(spark, sf_dir), {"telefon": settings})


@register(
    "mask_ahv_nr",
    f"""
SELECT id, CASE WHEN ahv IS NOT NULL THEN {social_security(draw(digest('ahv', 'ahv')))} END AS ahv FROM ({PEOPLE_SQL})
""",
)
def mask_ahv_nr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(people(spark, sf_dir), {"ahv": {"data_type": "string", "function": "ahv_nr"}})


# --- text ------------------------------------------------------------------


@register(
    "normalise_name",
    """
SELECT doc_id, lower(regexp_replace(replace(replace(strip_accents(text), ' ', '.'), '-', '.'), '[^a-zA-Z0-9.]', '', 'g')) AS normalised
FROM documents
""",
)
def normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    normalised = normalise_name(stage, F.col("text"))
    return stage.df.select("doc_id", normalised.alias("normalised"))


PROVIDERS = ["post.example.com", "mail.example.org", "inbox.example.net"]
ASCII_LAST = [n for n in LAST_NAMES if n.isascii() and n.isalpha()]


def library_email_sql(h: str) -> str:
    return (
        f"lower({choice(FEMALE_NAMES + MALE_NAMES, h, 1)}) || '.' || lower({choice(ASCII_LAST, h, 2)}) || "
        f"lpad(cast({draw(h, 3)} % 1000 AS varchar), 3, '0') || '@example.org'"
    )


def plain_name_sql(name: str) -> str:
    return f"lower(regexp_replace(replace(replace(strip_accents({name}), ' ', '.'), '-', '.'), '[^a-zA-Z0-9.]', '', 'g'))"


@register(
    "mask_email_from_names",
    f"""
WITH p AS ({PEOPLE_SQL}), s AS ({LAST_SLOTS}),
d AS (SELECT *, nullif(nachname, '') AS v, {draw(digest('nachname', "nullif(nachname, '')"))} AS d, {digest('email', 'id')} AS h FROM p),
n AS (SELECT d.id, d.vorname, d.email, d.h, CASE WHEN d.v IS NOT NULL THEN s.nachname END AS nachname
  FROM d JOIN s ON d.d % s.total >= s.lo AND d.d % s.total < s.hi)
SELECT id, nachname, CASE WHEN trim(email) <> '' THEN
  CASE WHEN trim(vorname) <> '' AND trim(nachname) <> ''
    THEN {plain_name_sql('vorname')} || '.' || {plain_name_sql('nachname')} || '@' || {choice(PROVIDERS, 'h')}
    ELSE {library_email_sql('h')} END ELSE email END AS email FROM n
""",
)
def mask_email_from_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The e-mail column comes first and still reads the masked name.
    settings = {"function": "email", "first_name_field": "vorname", "last_name_field": "nachname", "providers": PROVIDERS}
    df = people(spark, sf_dir).select("id", "email", "vorname", "nachname")
    return mask(df, {"email": {"data_type": "string", **settings}, **LAST}, keep=["id", "nachname", "email"])


@register(
    "mask_email_library",
    f"""
WITH p AS (SELECT id, email, {digest('email', 'email')} AS h FROM ({PEOPLE_SQL}))
SELECT id, CASE WHEN trim(email) <> '' THEN {library_email_sql('h')} ELSE email END AS email FROM p
""",
)
def mask_email_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(people(spark, sf_dir), {"email": {"data_type": "string", "function": "email"}})


@register(
    "mask_hash",
    f"""
WITH p AS ({PEOPLE_SQL}), s AS ({LAST_SLOTS}),
d AS (SELECT *, nullif(nachname, '') AS v, {draw(digest('nachname', "nullif(nachname, '')"))} AS d FROM p)
SELECT d.id, sha256(coalesce(CASE WHEN d.v IS NOT NULL THEN s.nachname END, '') || coalesce(d.ahv, '')) AS code
FROM d JOIN s ON d.d % s.total >= s.lo AND d.d % s.total < s.hi
""",
)
def mask_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    # `nachname` is masked before, `ahv` after the hash column.
    columns = {
        **LAST,
        "code": {"data_type": "string", "function": "hash", "hashed_columns": ["nachname", "ahv"]},
        "ahv": {"data_type": "string", "function": "ahv_nr"},
    }
    return mask(people(spark, sf_dir), columns, keep=["id", "code"])


@register("mask_delete", f"SELECT id, telefon FROM ({PEOPLE_SQL})")
def mask_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = people(spark, sf_dir).select("id", "vorname", "nachname", "telefon")
    columns = {c: {"data_type": "string", "function": "delete"} for c in ("vorname", "nachname")}
    return mask_table(df, {"columns": columns}, key=KEY)


# --- numbers, dates, codes ---------------------------------------------------


@register(
    "mask_random_int",
    f"""
SELECT id, CASE WHEN nummer IS NOT NULL THEN 10000 + {draw(digest('nummer', 'nummer'))} % 10001 END AS nummer FROM ({PEOPLE_SQL})
""",
)
def mask_random_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(people(spark, sf_dir), {"nummer": {"data_type": "integer", "function": "random_int", "min": 10000, "max": 20000}})


@register(
    "mask_random_int_unique",
    f"""
WITH p AS ({ORDERS_SQL}),
r AS (SELECT bestellt, row_number() OVER (ORDER BY {digest('bestellt', 'bestellt')}) - 1 AS r FROM (SELECT DISTINCT bestellt FROM p)),
s AS ({permute_sql('r', 100000, KEY, 'bestellt', 'r', 'bestellt')})
SELECT p.id, 1000 + x AS bestellt FROM p JOIN s ON s.bestellt = p.bestellt
""",
)
def mask_random_int_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"function": "random_int", "min": 1000, "max": 100999, "unique": True}
    return mask(orders(spark, sf_dir), {"bestellt": {"data_type": "string", **settings}})


@register(
    "mask_random_float",
    f"""
SELECT id, CASE WHEN nummer IS NOT NULL THEN round(100 + {unit(digest('nummer', 'nummer'))} * 100, 2) END AS nummer FROM ({PEOPLE_SQL})
""",
)
def mask_random_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"data_type": "float", "function": "random_float", "min": 100, "max": 200, "digits": 2}
    return mask(people(spark, sf_dir), {"nummer": settings})


@register(
    "mask_list_string",
    f"""
SELECT id, CASE WHEN geschlecht <> '' THEN {choice(['j', 'n'], digest('geschlecht', 'geschlecht'))} END AS geschlecht FROM ({PEOPLE_SQL})
""",
)
def mask_list_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(people(spark, sf_dir), {"geschlecht": {"data_type": "boolean", "function": "list_string", "list": ["j", "n"]}})


def days_sql(column: str) -> str:
    return f"to_days(cast(-10 + {draw(digest(column, column))} % 21 AS integer))"


@register(
    "mask_date_text",
    f"""
WITH p AS (SELECT id, datum AS v, {days_sql('datum')} AS days FROM ({ORDERS_SQL}))
SELECT id, CASE WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T.*')
    THEN strftime(try_cast(replace(v, 'T', ' ') AS timestamp) + days, '%Y-%m-%dT%H:%M:%S')
  ELSE strftime(try_cast(v AS date) + days, '%Y-%m-%d') END AS datum FROM p
""",
)
def mask_date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"data_type": "string", "function": "date_add_random_days", "lower": -10, "upper": 10}
    return mask(orders(spark, sf_dir), {"datum": settings})


@register(
    "mask_date_timestamp",
    f"""
SELECT id, strftime(bestellt + {days_sql('bestellt')}, '%Y-%m-%d %H:%M:%S') AS bestellt FROM ({ORDERS_SQL})
""",
)
def mask_date_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"data_type": "date", "function": "date_add_random_days", "lower": -10, "upper": 10}
    out = mask(orders(spark, sf_dir), {"bestellt": settings})
    return out.withColumn("bestellt", F.date_format("bestellt", "yyyy-MM-dd HH:mm:ss"))


def shuffled_sql(column: str) -> str:
    return (
        f"SELECT a.c AS old, b.c AS new FROM "
        f"(SELECT c, row_number() OVER (ORDER BY {digest(column, quote('from'), 'c')}) AS r FROM codes) a JOIN "
        f"(SELECT c, row_number() OVER (ORDER BY {digest(column, quote('to'), 'c')}) AS r FROM codes) b ON a.r = b.r"
    )


@register(
    "mask_shuffle_codes",
    f"""
WITH p AS ({PEOPLE_SQL}), codes AS (SELECT DISTINCT adresse AS c FROM p WHERE adresse IS NOT NULL), m AS ({shuffled_sql('adresse')})
SELECT p.id, m.new AS adresse FROM p LEFT JOIN m ON m.old = p.adresse
""",
)
def mask_shuffle_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(people(spark, sf_dir), {"adresse": {"data_type": "string", "function": "shuffle_codes"}})


@register(
    "mask_random_distribution",
    f"""
WITH p AS ({ORDERS_SQL}), m AS (SELECT avg(betrag) AS m, stddev_samp(betrag) AS s FROM p)
SELECT id, CASE WHEN betrag IS NOT NULL THEN round(m.m + m.s * {normal(digest('betrag', 'id'))}, 1) END AS betrag FROM p, m
""",
)
def mask_random_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"data_type": "float", "function": "fill_with_random_distribution", "decimals": 1}
    return mask(orders(spark, sf_dir), {"betrag": settings})


@register(
    "format_whole_numbers",
    f"""
SELECT id, CASE WHEN zahl IS NOT NULL AND try_cast(zahl AS double) IS NOT NULL AND try_cast(zahl AS double) % 1 = 0
  THEN {draw(digest('zahl', 'cast(try_cast(zahl AS double) AS bigint)'))} % 101 END AS zahl FROM ({ORDERS_SQL})
""",
)
def format_whole_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`12.0`, `1e3` and `12` are whole numbers, `12.5` and `abc` are not."""
    return mask(orders(spark, sf_dir), {"zahl": {"data_type": "int", "function": "random_int"}})


# --- addresses ---------------------------------------------------------------

HOUSE_HASH = digest("hausnummer", "id")


@register(
    "mask_house_number",
    f"""
WITH p AS (SELECT *, {HOUSE_HASH} AS h FROM ({PEOPLE_SQL}))
SELECT id, CASE WHEN hausnummer IS NOT NULL THEN cast(1 + {draw('h', 0)} % 100 AS varchar) ||
  CASE WHEN {unit('h', 1)} < 0.3 THEN {choice(HOUSE_LETTERS, 'h', 2)} ELSE '' END END AS hausnummer FROM p
""",
)
def mask_house_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"data_type": "string", "function": "house_number", "frequency_suffix": 0.3}
    return mask(people(spark, sf_dir), {"hausnummer": settings})


def library_address_sql(h: str) -> str:
    return f"{choice(STREETS, h, 2)} || ' ' || cast(1 + {draw(h, 3)} % 100 AS varchar)"


ADDRESS_TEXT = "s.str_name || ' ' || cast(s.hausnr AS varchar) || coalesce(s.hausnr_zus, '')"


@register(
    "mask_address_by_postcode",
    f"""
WITH p AS (SELECT id, adresse, plz, {digest('adresse', 'adresse', 'plz')} AS h FROM ({PEOPLE_SQL})), s AS ({ADDRESS_SLOTS})
SELECT p.id, p.plz, CASE WHEN p.adresse IS NOT NULL THEN coalesce({ADDRESS_TEXT}, {library_address_sql('p.h')}) END AS adresse
FROM p LEFT JOIN s ON s.grp = p.plz AND {draw('p.h')} % s.total >= s.lo AND {draw('p.h')} % s.total < s.hi
""",
)
def mask_address_by_postcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"data_type": "string", "function": "streetname_housenumber", "source": "ogd-bs", "plz_field": "plz"}
    return mask(people(spark, sf_dir), {"adresse": settings}, table_lookups(spark, sf_dir), ["id", "plz", "adresse"])


@register(
    "mask_address_by_place",
    f"""
WITH p AS (SELECT p_partkey AS id, p_name AS adresse, p_brand AS ort, {digest('adresse', 'p_name', 'p_brand')} AS h FROM part), s AS ({PLACE_SLOTS})
SELECT p.id, p.ort, coalesce({ADDRESS_TEXT}, {library_address_sql('p.h')}) AS adresse
FROM p LEFT JOIN s ON s.grp = p.ort AND {draw('p.h')} % s.total >= s.lo AND {draw('p.h')} % s.total < s.hi
""",
)
def mask_address_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part", ["p_partkey AS id", "p_name AS adresse", "p_brand AS ort"])
    settings = {"data_type": "string", "function": "streetname_housenumber", "source": "ogd-bs", "location_field": "ort"}
    return mask(df, {"adresse": settings}, table_lookups(spark, sf_dir), ["id", "ort", "adresse"])


@register(
    "mask_street",
    f"""
WITH p AS (SELECT id, strasse, plz, {digest('strasse', 'strasse', 'plz')} AS h FROM ({PEOPLE_SQL})), s AS ({ADDRESS_SLOTS})
SELECT p.id, p.plz, CASE WHEN p.strasse IS NOT NULL THEN coalesce(s.str_name, {choice(STREETS, 'p.h')}) END AS strasse
FROM p LEFT JOIN s ON s.grp = p.plz AND {draw('p.h')} % s.total >= s.lo AND {draw('p.h')} % s.total < s.hi
""",
)
def mask_street(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"data_type": "string", "function": "street", "location_code_col": "plz", "location_data_col": "plz"}
    return mask(people(spark, sf_dir), {"strasse": settings}, table_lookups(spark, sf_dir), ["id", "plz", "strasse"])


STREET_SLOTS = slots(
    f"SELECT *, str_name || '|' || cast(plz AS varchar) AS street_key FROM ({ADDRESSES_SQL})", ADDRESS_COLUMNS, "1", "street_key"
)


@register(
    "blur_address",
    f"""
WITH p AS (SELECT id, adresse, plz, {digest('adresse', 'adresse', 'plz')} AS h,
  regexp_extract(trim(adresse), '^(.*)\\s+([0-9]+)$', 1) AS road FROM ({PEOPLE_SQL})),
n AS ({STREET_SLOTS}), a AS ({ADDRESS_SLOTS})
SELECT p.id, p.plz, CASE WHEN p.adresse IS NULL THEN NULL WHEN n.total > 1 THEN {ADDRESS_TEXT.replace('s.', 'n.')}
  ELSE coalesce({ADDRESS_TEXT.replace('s.', 'a.')}, {library_address_sql('p.h')}) END AS adresse
FROM p LEFT JOIN n ON n.grp = p.road || '|' || p.plz AND {draw('p.h')} % n.total >= n.lo AND {draw('p.h')} % n.total < n.hi
LEFT JOIN a ON a.grp = p.plz AND {draw('p.h', 1)} % a.total >= a.lo AND {draw('p.h', 1)} % a.total < a.hi
""",
)
def blurred_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"data_type": "string", "function": "blur_address", "location_code_col": "plz", "location_data_col": "plz"}
    return mask(people(spark, sf_dir), {"adresse": settings}, table_lookups(spark, sf_dir), ["id", "plz", "adresse"])


MIXED = "CASE WHEN c_custkey % 4 = 0 THEN '  Marktgasse  ' || cast(c_custkey AS string) || ' ' WHEN c_custkey % 4 = 1 THEN 'Marktgasse 12a' WHEN c_custkey % 4 = 2 THEN c_name ELSE NULL END AS adresse"


@register(
    "split_street_number",
    f"""
WITH p AS (SELECT c_custkey AS id, {MIXED} FROM customer)
SELECT id, CASE WHEN regexp_matches(trim(adresse), '\\s[0-9]+$') THEN trim(regexp_replace(trim(adresse), '[0-9]+$', '')) ELSE trim(adresse) END AS street,
  CASE WHEN regexp_matches(trim(adresse), '\\s[0-9]+$') THEN regexp_extract(trim(adresse), '([0-9]+)$', 1) END AS number FROM p
""",
)
def split_street_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer", ["c_custkey AS id", MIXED])
    street, number = split_street(F.col("adresse"))
    return df.select("id", street.alias("street"), number.alias("number"))


# --- whole tables --------------------------------------------------------------

BLANKS = [
    "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey END AS id",
    "CASE WHEN c_custkey % 5 < 2 THEN '  ' ELSE ' x ' END AS a",
    "CASE WHEN c_custkey % 5 = 3 THEN '' WHEN c_custkey % 5 = 4 THEN c_name END AS b",
]


@register(
    "blank_rows",
    f"""
WITH p AS (SELECT {', '.join(BLANKS)} FROM customer),
n AS (SELECT id, CASE WHEN trim(a) <> '' THEN a END AS a, CASE WHEN trim(b) <> '' THEN b END AS b FROM p)
SELECT * FROM n WHERE NOT (id IS NULL AND a IS NULL AND b IS NULL)
""",
)
def blank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blank_to_null(table(spark, sf_dir, "customer", BLANKS))


def part_sql(name: str) -> str:
    from maskflow.checks.base import ORACLES

    return ORACLES[name]


STATUS_COLUMNS = {
    "nachname": LAST["nachname"],
    "telefon": {"data_type": "string", "function": "phone_nr"},
    "ahv": {"data_type": "string", "function": "ahv_nr"},
    "code": {"data_type": "string", "function": "no_such_function"},
    "adresse": {"data_type": "string", "function": "delete"},
}


@register(
    "mask_status",
    f"""
WITH p AS ({PEOPLE_SQL}), l AS ({LAST_SQL})
SELECT 'nachname' AS "column", 'last_name' AS "function", true AS ok,
  count(*) FILTER (p.nachname IS DISTINCT FROM l.nachname) AS changed,
  count(*) FILTER (p.nachname IS NOT NULL AND l.nachname IS NULL) AS rejected FROM p JOIN l ON l.id = p.id
UNION ALL SELECT 'ahv', 'ahv_nr', true, count(*) FILTER (ahv IS DISTINCT FROM {social_security(draw(digest('ahv', 'ahv')))} AND ahv IS NOT NULL), 0 FROM p
UNION ALL SELECT 'telefon', 'phone_nr', true, count(*) FILTER (p.telefon IS DISTINCT FROM t.telefon), count(*) FILTER (length(regexp_replace(p.telefon, '[^0-9]', '', 'g')) < 7)
  FROM p JOIN ({part_sql('mask_phone_nr')}) t ON t.id = p.id
UNION ALL SELECT 'code', 'no_such_function', false, NULL, NULL
UNION ALL SELECT 'adresse', 'delete', true, NULL, NULL
""",
)
def mask_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_masks(people(spark, sf_dir), {"columns": STATUS_COLUMNS}, key=KEY, row_key=["id"]).status()


WHOLE = {
    "vorname": {
        "data_type": "string", "function": "first_name", "source": "ogd-bs", "gender_field": "geschlecht",
        "gender_field_male_identfier": "1",
    },
    "nachname": LAST["nachname"],
    "geschlecht": {"data_type": "string", "function": None},
    "telefon": {"data_type": "string", "function": "phone_nr"},
    "email": {"data_type": "string", "function": "email"},
    "plz": {"data_type": "string", "function": None},
    "adresse": {"data_type": "string", "function": "streetname_housenumber", "source": "ogd-bs", "plz_field": "plz"},
    "strasse": {"data_type": "string", "function": "delete"},
    "hausnummer": {"data_type": "string", "function": "house_number", "pct_with_suffix": 30},
    "code": {"data_type": "string", "function": "hash", "hashed_columns": ["nachname", "ahv"]},
    "nummer": {"data_type": "integer", "function": "random_int", "min": 100, "max": 200},
    "ahv": {"data_type": "string", "function": "ahv_nr"},
}


@register(
    "mask_table",
    f"""
WITH base AS ({PEOPLE_SQL}), f AS ({part_sql('mask_first_name_by_gender_field')}), l AS ({LAST_SQL}), t AS ({part_sql('mask_phone_nr')}),
e AS ({part_sql('mask_email_library')}), a AS ({part_sql('mask_address_by_postcode')}), h AS ({part_sql('mask_house_number')}),
c AS ({part_sql('mask_hash')}), v AS ({part_sql('mask_ahv_nr')})
SELECT base.id, f.vorname, l.nachname, base.geschlecht, t.telefon, e.email, base.plz, a.adresse, h.hausnummer, c.code,
  CASE WHEN base.nummer IS NOT NULL THEN 100 + {draw(digest('nummer', 'base.nummer'))} % 101 END AS nummer, v.ahv
FROM base JOIN f USING (id) JOIN l USING (id) JOIN t USING (id) JOIN e USING (id) JOIN a USING (id) JOIN h USING (id)
JOIN c USING (id) JOIN v USING (id)
""",
)
def mask_whole_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_table(people(spark, sf_dir), {"columns": WHOLE}, table_lookups(spark, sf_dir), KEY, ["id"])


def shuffled(lookups: Lookups) -> Lookups:
    """The same lookups, joined as ones that are too large for a broadcast."""
    return replace(lookups, broadcast_bytes=0)


@register("mask_table_shuffled", part_sql("mask_table"))
def mask_whole_table_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_table(people(spark, sf_dir), {"columns": WHOLE}, shuffled(table_lookups(spark, sf_dir)), KEY, ["id"])


@register("blur_address_shuffled", part_sql("blur_address"))
def blurred_address_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"data_type": "string", "function": "blur_address", "location_code_col": "plz", "location_data_col": "plz"}
    return mask(people(spark, sf_dir), {"adresse": settings}, shuffled(table_lookups(spark, sf_dir)), ["id", "plz", "adresse"])


@register(
    "keyed_draws",
    f"""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, {digest('draw', 'l_orderkey', 'l_linenumber', 'l_partkey')} AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, {draw('h', 0)} AS d0, {draw('h', 3)} AS d3, round({unit('h', 1)}, 6) AS u,
  round({normal('h')}, 4) AS z FROM p
""",
)
def keyed_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    stage = Stage(table(spark, sf_dir, "lineitem", keys))
    h = stage.keep(draws.digest(KEY, "draw", *[F.col(k) for k in keys]))
    return stage.df.select(
        *keys,
        draws.draw(h, 0).alias("d0"),
        draws.draw(h, 3).alias("d3"),
        F.round(draws.unit(h, 1), 6).alias("u"),
        F.round(draws.standard_normal(h), 4).alias("z"),
    )

"""Generators, one query each; the order keys of the test tables are the row ids."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from maskflow.checks.base import (
    KEY,
    ORACLES,
    choice,
    digest,
    draw,
    normal,
    register,
    slots,
    social_security,
    table,
    unit,
    weighted,
)
from maskflow.checks.mask_checks import (
    ADDRESS_COLUMNS,
    ADDRESS_SLOTS,
    FIRST_SLOTS,
    LAST_SLOTS,
    STREET_SLOTS,
    library_address_sql,
    library_email_sql,
    plain_name_sql,
)
from maskflow.checks.tables import ADDRESSES_SQL, PLACES_SQL, place_lookups
from maskflow.functions.permute import permute_sql
from maskflow.operators.masks import HOUSE_LETTERS
from maskflow.plans.generate import generate_table
from maskflow.sources.lookups import FEMALE_NAMES, LAST_NAMES, MALE_NAMES, STREETS

IDS = "SELECT o_orderkey AS id, count(*) OVER () AS n FROM orders"


def generate(spark: SparkSession, sf_dir: str, columns: dict, broadcast_bytes: int | None = None) -> DataFrame:
    ids = table(spark, sf_dir, "orders", ["o_orderkey AS id"])
    lookups = replace(place_lookups(spark, sf_dir), broadcast_bytes=broadcast_bytes)
    return generate_table(spark, {"columns": columns}, lookups, KEY, ids)


def simple(name: str, settings: dict, sql: str) -> None:
    """Register a generator of one column `x` whose value is a plain expression of the digest `h`."""

    @register(name, f"WITH r AS (SELECT *, {digest('x', 'id')} AS h FROM ({IDS})) SELECT id, {sql} AS x FROM r")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return generate(spark, sf_dir, {"x": settings})


def keep_exactly(name: str, part: str, count: str) -> str:
    return f"(row_number() OVER (ORDER BY {digest(f'{name}#{part}', 'id')}) <= {count})"


# --- numbers -------------------------------------------------------------------

simple("generate_incremental_int", {"function": "incremental_int", "min": 1000, "step": 5}, "1000 + id * 5")
simple(
    "generate_incremental_int_random",
    {"function": "incremental_int", "min": 10, "max": 30, "sequential": False},
    f"10 + {draw('h')} % 20",
)
simple("generate_random_int", {"function": "random_int", "min": 7, "max": 120}, f"7 + {draw('h')} % 113")
simple(
    "generate_random_float",
    {"function": "random_float", "min": 12, "max": 19, "digits": 2},
    f"round(12 + {unit('h')} * 7, 2)",
)
simple(
    "generate_normal_float",
    {"function": "normal_float", "mean": 5.5, "std": 1.25, "min": 3.0, "max": 8.0, "digits": 2},
    f"round(least(greatest(5.5 + 1.25 * {normal('h')}, 3.0), 8.0), 2)",
)
simple(
    "generate_normal_int",
    {"function": "normal_int", "mean": 50, "std": 20, "min": 0, "max": 100},
    f"cast(round(least(greatest(50 + 20 * {normal('h')}, 0), 100)) AS bigint)",
)
simple("generate_list_int", {"function": "list_int", "list": [10, 20, 30]}, f"cast(([10, 20, 30])[1 + {draw('h')} % 3] AS bigint)")
simple(
    "generate_list_string",
    {"function": "list_string", "list": ["M", "F", "X"], "weights": [5, 4, 1]},
    weighted(["M", "F", "X"], [5, 4, 1], "h"),
)
simple("generate_ahv_nr", {"function": "ahv_nr"}, social_security(draw("h")))
simple(
    "generate_integer_grouped",
    {"function": "integer_grouped", "values": [5, 50, 5], "rows_per_group": "random", "ordered": False},
    f"5 + 5 * ({draw('h')} % 10)",
)
simple(
    "generate_percent_null",
    {"function": "random_int", "min": 0, "max": 100, "percent_null": 30},
    f"CASE WHEN NOT {keep_exactly('x', 'null', 'floor(30 / 100 * n)')} THEN {draw('h')} % 100 END",
)

REDRAWN = [f"(5.5 + 1.25 * {normal(digest('x' if i == 0 else f'x#again{i}', 'id'))})" for i in range(8)]
REDRAW_SQL = "CASE" + "".join(f" WHEN {t} BETWEEN 4.5 AND 6.5 THEN {t}" for t in REDRAWN) + f" ELSE least(greatest({REDRAWN[-1]}, 4.5), 6.5) END"
simple(
    "generate_normal_float_redraw",
    {"function": "normal_float", "mean": 5.5, "std": 1.25, "min": 4.5, "max": 6.5, "digits": 3, "bounds": "redraw"},
    f"round({REDRAW_SQL}, 3)",
)


@register(
    "generate_integer_grouped_ordered",
    f"""
WITH r AS ({IDS}), p AS (SELECT 5 + 5 * ({draw(digest('x', 'id'))} % 10) AS x FROM r)
SELECT row_number() OVER (ORDER BY x) - 1 AS id, x FROM p
""",
)
def integer_grouped_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"function": "integer_grouped", "values": [5, 50, 5], "rows_per_group": "random", "ordered": True}
    return generate(spark, sf_dir, {"x": settings})


UNIQUE_RANGE = 1_000_003


@register("generate_random_int_unique", f"SELECT id, 100 + x AS x FROM ({permute_sql('id', UNIQUE_RANGE, KEY, 'x', IDS, 'id')})")
def random_int_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"function": "random_int", "min": 100, "max": 100 + UNIQUE_RANGE, "unique": True}
    return generate(spark, sf_dir, {"x": settings})


# --- dates ---------------------------------------------------------------------

simple(
    "generate_incremental_date",
    {"function": "incremental_date", "start_date": "2025-01-01", "step_period": "day", "step": 2, "overflow": "null"},
    "CASE WHEN id * 2 <= date_diff('day', date '2025-01-01', date '9999-12-31') THEN strftime(date '2025-01-01' + to_days(cast(id * 2 AS integer)), '%Y-%m-%d') END",
)
simple(
    "generate_incremental_month",
    {"function": "incremental_date", "start_date": "2025-01-31", "step_period": "month", "step": 1, "overflow": "null"},
    "CASE WHEN id <= date_diff('month', date '2025-01-31', date '9999-12-31') THEN strftime(date '2025-01-31' + to_months(cast(id AS integer)), '%Y-%m-%d') END",
)
simple(
    "generate_random_date",
    {"function": "random_date", "start_date": "1962-07-01", "end_date": "2019-03-31"},
    f"strftime(date '1962-07-01' + to_days(cast({draw('h')} % (date_diff('day', date '1962-07-01', date '2019-03-31') + 1) AS integer)), '%Y-%m-%d')",
)
simple(
    "generate_normal_date",
    {"function": "normal_date", "average_date": "2003-05-20", "std_days": 500, "min_date": "2000-01-01", "max_date": "2006-12-31"},
    f"strftime(least(greatest(date '2003-05-20' + to_days(cast(round(500 * {normal('h')}) AS integer)), date '2000-01-01'), date '2006-12-31'), '%Y-%m-%d')",
)

# --- names -----------------------------------------------------------------------


@register(
    "generate_last_name",
    f"""
WITH r AS (SELECT *, {draw(digest('x', 'id'))} AS d FROM ({IDS})), s AS ({LAST_SLOTS})
SELECT id, nachname AS x FROM r JOIN s ON d % total >= lo AND d % total < hi
""",
)
def last_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate(spark, sf_dir, {"x": {"function": "last_name", "source": "ogd-bs"}})


simple("generate_last_name_library", {"function": "last_name", "source": "faker"}, choice(LAST_NAMES, "h"))

GENDER = choice(["M", "F"], digest("g", "id"))
BY_GENDER_SQL = f"""
WITH r AS (SELECT *, {GENDER} AS g, {draw(digest('x', 'id'))} AS d FROM ({IDS})), s AS ({FIRST_SLOTS})
SELECT id, r.g, vorname AS x FROM r JOIN s ON s.grp = r.g AND d % total >= lo AND d % total < hi
"""


@register("generate_first_name_by_gender", BY_GENDER_SQL)
def first_name_by_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate(
        spark,
        sf_dir,
        {
            "g": {"function": "list_string", "list": ["M", "F"]},
            "x": {"function": "first_name", "gender_field": "g", "gender_field_male_identfier": "M"},
        },
    )


@register(
    "generate_first_name_percent_male",
    f"""
WITH r AS (SELECT id, CASE WHEN {keep_exactly('x', 'male', 'floor(30 / 100 * n)')} THEN 'M' ELSE 'F' END AS g, {draw(digest('x', 'id'))} AS d FROM ({IDS})),
s AS ({FIRST_SLOTS})
SELECT id, vorname AS x FROM r JOIN s ON s.grp = r.g AND d % total >= lo AND d % total < hi
""",
)
def first_name_percent_male(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate(spark, sf_dir, {"x": {"function": "first_name", "percent_male": 30}})


@register(
    "generate_first_name_library",
    f"""
WITH r AS (SELECT id, {digest('x', 'id')} AS h, {keep_exactly('x', 'male', 'floor(50 / 100 * n)')} AS male FROM ({IDS}))
SELECT id, CASE WHEN male THEN {choice(MALE_NAMES, 'h')} ELSE {choice(FEMALE_NAMES, 'h')} END AS x FROM r
""",
)
def first_name_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate(spark, sf_dir, {"x": {"function": "first_name", "source": "faker"}})


NAMES = {
    "v": {"function": "list_string", "list": ["Zoë-Ann", "Urs", "Øyvind", ""]},
    "n": {"function": "list_string", "list": ["von Allmen", "Straße", "O'Neil"]},
}
MAIL_SQL = f"""
WITH r AS (SELECT id, {choice(NAMES['v']['list'], digest('v', 'id'))} AS v, {choice(NAMES['n']['list'], digest('n', 'id'))} AS n2,
  {digest('x', 'id')} AS h FROM ({IDS}))
SELECT id, v, n2 AS n, CASE WHEN trim(v) <> '' THEN {plain_name_sql('v')} || '.' || {plain_name_sql('n2')} || '@' || {choice(['a.ch', 'b.ch'], 'h')}
  ELSE {library_email_sql('h')} END AS x FROM r
"""


@register("generate_email_from_names", MAIL_SQL)
def email_from_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"function": "email", "first_name_field": "v", "last_name_field": "n", "providers": ["a.ch", "b.ch"]}
    return generate(spark, sf_dir, {**NAMES, "x": settings})


simple("generate_email_library", {"function": "email"}, library_email_sql("h"))

# --- phones ----------------------------------------------------------------------

FORMATS, FORMAT_WEIGHTS = ["+xx xx xxx xx xx", "xxx xxx xxxx", "xx xxx xx xx"], [1, 4, 5]
TAIL = f"lpad(cast({draw(digest('x#digits', 'id'))} % 100000000000 AS varchar), 11, '0')"
PHONE_SQL = f"""
WITH r AS (SELECT *, {digest('x', 'id')} AS h FROM ({IDS})),
c AS (SELECT id, {choice(['76', '79'], 'h', 2)} AS ndc, {weighted(FORMATS, FORMAT_WEIGHTS, 'h', 3)} AS f, {TAIL} AS tail FROM r),
d AS (SELECT *, CASE WHEN f[1] = '+' THEN '41' || ndc || tail WHEN f = 'xxx xxx xxxx' THEN '0' || ndc || tail ELSE ndc || tail END AS ds FROM c)
SELECT id, CASE WHEN f = 'xx xxx xx xx' THEN '+41 ' ELSE '' END || array_to_string(list_transform(range(1, length(f) + 1), lambda i:
  CASE WHEN substr(f, i, 1) = 'x' THEN substr(ds, cast(length(regexp_replace(substr(f, 1, i), '[^x]', '', 'g')) AS bigint), 1) ELSE substr(f, i, 1) END), '') AS x FROM d
"""


@register("generate_phone_nr", PHONE_SQL)
def phone_nr(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"function": "phone_nr", "cc": ["+41"], "ndc": ["76", "79"], "formats": FORMATS, "format_weights": FORMAT_WEIGHTS}
    return generate(spark, sf_dir, {"x": settings})


# --- places ----------------------------------------------------------------------

PLACE_COLUMNS = ["plz_postleitzahl", "gemeinde_name", "kanton_name", "kanton_name_kurz"]
PLACE_SLOTS = slots(PLACES_SQL, PLACE_COLUMNS)
CANTON_SLOTS = slots(PLACES_SQL, PLACE_COLUMNS, "1", "kanton_name_kurz")


@register(
    "generate_canton",
    f"""
WITH r AS (SELECT *, {draw(digest('x', 'id'))} AS d FROM ({IDS})), s AS ({PLACE_SLOTS})
SELECT id, kanton_name AS x FROM r JOIN s ON d % total >= lo AND d % total < hi
""",
)
def canton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate(spark, sf_dir, {"x": {"function": "canton", "field": "kanton_name"}})


CANTONS = ["K1", "K2", "K3", "K99"]
PLZ_SQL = f"""
WITH r AS (SELECT *, {choice(CANTONS, digest('k', 'id'))} AS k, {draw(digest('x', 'id'))} AS d FROM ({IDS})), s AS ({CANTON_SLOTS})
SELECT id, k, coalesce(plz_postleitzahl, -99) AS x FROM r LEFT JOIN s ON s.grp = r.k AND d % total >= lo AND d % total < hi
"""


@register("generate_plz4_by_canton", PLZ_SQL)
def plz4_by_canton(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"function": "plz4", "canton_field": "k", "canton_field_version": "kanton_name_kurz"}
    return generate(spark, sf_dir, {"k": {"function": "list_string", "list": CANTONS}, "x": settings})


@register(
    "generate_plz4_weighted_cantons",
    f"""
WITH r AS (SELECT id, {digest('x', 'id')} AS h FROM ({IDS})), k AS (SELECT *, {weighted(['K1', 'K2'], [5, 1], 'h', 1)} AS k FROM r), s AS ({CANTON_SLOTS})
SELECT id, coalesce(plz_postleitzahl, -99) AS x FROM k LEFT JOIN s ON s.grp = k.k AND {draw('h')} % total >= lo AND {draw('h')} % total < hi
""",
)
def plz4_weighted_cantons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate(spark, sf_dir, {"x": {"function": "plz4", "cantons": ["k1", "k2"], "weights": [5, 1]}})


@register(
    "generate_plz4_any",
    f"""
WITH r AS (SELECT *, {draw(digest('x', 'id'))} AS d FROM ({IDS})), s AS ({PLACE_SLOTS})
SELECT id, plz_postleitzahl AS x FROM r JOIN s ON d % total >= lo AND d % total < hi
""",
)
def plz4_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate(spark, sf_dir, {"x": {"function": "plz4"}})


@register(
    "generate_location_by_postcode",
    f"""
WITH r AS (SELECT id, 1000 + {draw(digest('p', 'id'))} % 70 AS p FROM ({IDS})),
f AS (SELECT plz_postleitzahl, min_by(gemeinde_name, ord) AS x FROM ({PLACES_SQL}) GROUP BY plz_postleitzahl)
SELECT id, p, x FROM r LEFT JOIN f ON f.plz_postleitzahl = r.p
""",
)
def location_by_postcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate(
        spark,
        sf_dir,
        {"p": {"function": "random_int", "min": 1000, "max": 1070}, "x": {"function": "location", "plz_field": "p"}},
    )


# Without any place in the wanted cantons, every place will do.
KNOWN_OR_ALL = f"SELECT * FROM k UNION ALL SELECT * FROM ({PLACES_SQL}) WHERE NOT EXISTS (SELECT 1 FROM k)"


@register(
    "generate_location_by_canton",
    f"""
WITH r AS (SELECT *, {draw(digest('x', 'id'))} AS d FROM ({IDS})),
k AS (SELECT * FROM ({PLACES_SQL}) WHERE kanton_name_kurz IN ('K1', 'K2')), s AS ({slots(KNOWN_OR_ALL, PLACE_COLUMNS)})
SELECT id, gemeinde_name AS x FROM r JOIN s ON d % total >= lo AND d % total < hi
""",
)
def location_by_canton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate(spark, sf_dir, {"x": {"function": "location", "canton": ["K1", "k2"]}})


STREETS_SQL = f"SELECT DISTINCT str_name, ort, plz FROM ({ADDRESSES_SQL})"


@register(
    "generate_streetname",
    f"""
WITH r AS (SELECT id, 1000 + {draw(digest('p', 'id'))} % 25 AS p, {digest('x', 'id')} AS h FROM ({IDS})),
s AS ({slots(STREETS_SQL, ['str_name', 'ort', 'plz'], '1', 'plz')})
SELECT id, p, coalesce(str_name, {choice(STREETS, 'h')}) AS x FROM r
LEFT JOIN s ON s.grp = cast(r.p AS varchar) AND {draw('h')} % total >= lo AND {draw('h')} % total < hi
""",
)
def streetname(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate(
        spark,
        sf_dir,
        {
            "p": {"function": "random_int", "min": 1000, "max": 1025},
            "x": {"function": "street_name", "source": "ogd-bs", "plz_field": "p"},
        },
    )


ADDRESS_CONTENT = " || '|' || ".join(f"coalesce(cast({c} AS varchar), '')" for c in ADDRESS_COLUMNS)
RANKED_ADDRESSES = f"SELECT *, row_number() OVER (ORDER BY {digest('adr#order', f'sha256({ADDRESS_CONTENT})')}) - 1 AS r, count(*) OVER () AS total FROM ({ADDRESSES_SQL})"


@register(
    "generate_address",
    f"""
WITH i AS ({IDS}), a AS ({RANKED_ADDRESSES})
SELECT id, str_name AS strasse, hausnr AS nummer, plz AS postleitzahl, ort AS stadt FROM i JOIN a ON i.id % a.total = a.r
""",
)
def address(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {
        "function": "address",
        "fields": ["streetname", "housenumber", "plz", "location"],
        "labels": ["strasse", "nummer", "postleitzahl", "stadt"],
    }
    return generate(spark, sf_dir, {"adr": settings})


PLAIN_NUMBER = (
    f"cast(1 + {draw('h', 0)} % 100 AS varchar) || CASE WHEN {unit('h', 1)} < 0.5 THEN {choice(HOUSE_LETTERS, 'h', 2)} ELSE '' END"
)


@register(
    "generate_housenumber",
    f"""
WITH r AS (SELECT id, {choice(['red ring', 'small ring', 'Nirgendweg'], digest('s', 'id'))} AS s, 1000 + {draw(digest('p', 'id'))} % 25 AS p, {digest('x', 'id')} AS h FROM ({IDS})),
n AS ({STREET_SLOTS})
SELECT id, r.s, r.p, coalesce(cast(n.hausnr AS varchar) || coalesce(n.hausnr_zus, ''), {PLAIN_NUMBER}) AS x FROM r
LEFT JOIN n ON n.grp = r.s || '|' || cast(r.p AS varchar) AND {draw('h', 3)} % n.total >= n.lo AND {draw('h', 3)} % n.total < n.hi
""",
)
def housenumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate(
        spark,
        sf_dir,
        {
            "s": {"function": "list_string", "list": ["red ring", "small ring", "Nirgendweg"]},
            "p": {"function": "random_int", "min": 1000, "max": 1025},
            "x": {"function": "housenumber", "plz_field": "p", "streetname_field": "s", "frequency_suffix": 0.5},
        },
    )


PAIR_SQL = f"""
WITH r AS (SELECT id, 1000 + {draw(digest('p', 'id'))} % 25 AS p, {digest('x', 'id')} AS h FROM ({IDS})), s AS ({ADDRESS_SLOTS})
SELECT id, p, coalesce(s.str_name || ' ' || cast(s.hausnr AS varchar) || coalesce(s.hausnr_zus, ''), {library_address_sql('h')}) AS x FROM r
LEFT JOIN s ON s.grp = cast(r.p AS varchar) AND {draw('h')} % s.total >= s.lo AND {draw('h')} % s.total < s.hi
"""


@register("generate_streetname_housenumber", PAIR_SQL)
def streetname_housenumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate(
        spark,
        sf_dir,
        {
            "p": {"function": "random_int", "min": 1000, "max": 1025},
            "x": {"function": "streetname_housenumber", "plz_field": "p"},
        },
    )


# --- a whole table ------------------------------------------------------------------

# Members of an athletics club.
WHOLE = {
    "team": {"data_type": "string", "function": "list_string", "list": ["F", "M"], "weights": [3, 2]},
    "given_name": {
        "data_type": "string", "function": "first_name", "gender_field": "team", "gender_field_male_identfier": "M", "percent_null": 8,
    },
    "family_name": {"data_type": "string", "function": "last_name"},
    "area": {"data_type": "string", "function": "list_string", "list": ["K2"]},
    "postcode": {"data_type": "int", "function": "plz4", "canton_field": "area", "canton_field_version": "kanton_name_kurz"},
    "laps": {"data_type": "integer", "function": "random_int", "min": 3, "max": 40, "percent_null": 12},
    "throw": {"data_type": "float", "function": "normal_float", "digits": 1, "min": 20, "max": 65, "mean": 42.5, "std": 6},
    "fee": {"data_type": "float", "function": "random_float", "digits": 2, "min": 20, "max": 90},
    "joined": {"data_type": "date", "function": "random_date", "start_date": "1996-04-01", "end_date": "2021-09-30"},
    "first_meet": {"data_type": "date", "function": "normal_date", "average_date": "2008-06-15", "std_days": 400},
    "training": {
        "data_type": "date", "function": "incremental_date", "start_date": "2018-09-03", "step_period": "day", "step": 1, "overflow": "null",
    },
}


def _h(name: str) -> str:
    return digest(name, "id")


@register(
    "generate_table",
    f"""
WITH r AS (SELECT id, n, {weighted(['F', 'M'], [3, 2], _h('team'))} AS team,
  {draw(_h('family_name'))} AS df, {draw(_h('given_name'))} AS dg, {draw(_h('postcode'))} AS dp FROM ({IDS})),
l AS ({LAST_SLOTS}), f AS ({FIRST_SLOTS}), k AS ({CANTON_SLOTS})
SELECT r.id, team, l.nachname AS family_name, 'K2' AS area, coalesce(k.plz_postleitzahl, -99) AS postcode,
  CASE WHEN NOT {keep_exactly('given_name', 'null', 'floor(8 / 100 * n)')} THEN f.vorname END AS given_name,
  CASE WHEN NOT {keep_exactly('laps', 'null', 'floor(12 / 100 * n)')} THEN 3 + {draw(_h('laps'))} % 37 END AS laps,
  round(least(greatest(42.5 + 6 * {normal(_h('throw'))}, 20), 65), 1) AS throw,
  round(20 + {unit(_h('fee'))} * 70, 2) AS fee,
  strftime(date '1996-04-01' + to_days(cast({draw(_h('joined'))} % (date_diff('day', date '1996-04-01', date '2021-09-30') + 1) AS integer)), '%Y-%m-%d') AS joined,
  strftime(date '2008-06-15' + to_days(cast(round(400 * {normal(_h('first_meet'))}) AS integer)), '%Y-%m-%d') AS first_meet,
  CASE WHEN id <= date_diff('day', date '2018-09-03', date '9999-12-31') THEN strftime(date '2018-09-03' + to_days(cast(id AS integer)), '%Y-%m-%d') END AS training
FROM r JOIN l ON df % l.total >= l.lo AND df % l.total < l.hi
JOIN f ON f.grp = r.team AND dg % f.total >= f.lo AND dg % f.total < f.hi
LEFT JOIN k ON k.grp = 'K2' AND dp % k.total >= k.lo AND dp % k.total < k.hi
""",
)
def whole_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate(spark, sf_dir, WHOLE)


@register("generate_table_shuffled", ORACLES["generate_table"])
def whole_table_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With lookups joined as ones that are too large for a broadcast."""
    return generate(spark, sf_dir, WHOLE, broadcast_bytes=0)

"""Registry of queries, and the SQL building blocks their checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

KEY = "check-key"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str, expressions: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.selectExpr(*expressions) if expressions else df


def select(name: str, expressions: list[str]) -> str:
    return f"SELECT {', '.join(expressions)} FROM {name}"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    def shown(v: object) -> str:
        if v is None:
            return "NULL"
        return quote(v) if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(shown(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({columns})"


def digest(scope: str, *parts: str, key: str = KEY) -> str:
    shown = " || '|' || ".join(f"coalesce(cast({p} AS varchar), '')" for p in parts)
    return f"sha256({quote(f'{key}|{scope}|')} || {shown})"


def draw(dg: str, index: int = 0) -> str:
    return f"cast('0x' || substr({dg}, {1 + 15 * index}, 15) AS bigint)"


def unit(dg: str, index: int = 0) -> str:
    return f"((cast({draw(dg, index)} AS double) + 0.5) / cast(1152921504606846976 AS double))"


def normal(dg: str) -> str:
    return f"(sqrt(-2 * ln({unit(dg, 0)})) * cos(2 * pi() * {unit(dg, 1)}))"


def choice(items: list[str], dg: str, index: int = 0) -> str:
    listed = ", ".join(quote(i) for i in items)
    return f"([{listed}])[1 + {draw(dg, index)} % {len(items)}]"


def weighted(items: list[str], weights: list[float], dg: str, index: int = 0) -> str:
    total, reached, arms = float(sum(weights)), 0.0, ""
    for item, weight in list(zip(items, weights))[:-1]:
        reached += weight
        arms += f" WHEN {unit(dg, index)} < cast({reached / total!r} AS double) THEN {quote(item)}"
    return f"CASE{arms} ELSE {quote(items[-1])} END" if arms else quote(items[-1])


def slots(source: str, columns: list[str], weight: str = "1", group: str | None = None) -> str:
    """Lookup rows with the interval of integers they own, in the order of the hash of their content."""
    content = " || '|' || ".join(f"coalesce(cast({c} AS varchar), '')" for c in columns)
    part = f"PARTITION BY {group} " if group else ""
    running = f"sum({weight}) OVER ({part}ORDER BY sha256({content}) ROWS UNBOUNDED PRECEDING)"
    grouped = f"cast({group} AS varchar) AS grp, " if group else ""
    return (
        f"SELECT {grouped}{', '.join(columns)}, cast({running} - {weight} AS bigint) AS lo, "
        f"cast({running} AS bigint) AS hi, cast(sum({weight}) OVER ({part.strip()}) AS bigint) AS total FROM ({source})"
    )


def social_security(number: str) -> str:
    """Digits by text position, weighed 3 and 1 in turn after the fixed 756."""
    uid = f"lpad(cast({number} % 100000000 AS varchar), 8, '0')"
    terms = " + ".join(f"cast(substr({uid}, {i}, 1) AS integer) * {3 if i % 2 else 1}" for i in range(1, 9))
    rest = f"((28 + {terms}) % 11)"
    check = f"CASE WHEN {rest} = 0 OR 11 - {rest} >= 10 THEN 0 ELSE 11 - {rest} END"
    return f"'756.' || substr({uid}, 1, 4) || '.' || substr({uid}, 5, 4) || '.' || lpad(cast({check} AS varchar), 2, '0')"

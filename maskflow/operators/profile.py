"""Column types from the data, in one pass over all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskflow.functions.names import column as named
from maskflow.functions.numbers import NUMBER_SHAPE

# Spellings of a truth value, the order of the types, the shapes of a date.
BOOLEAN_WORDS = ["true", "false", "1", "0", "yes", "no", "t", "f", "y", "n"]
TYPES = ["string", "integer", "float", "boolean", "date"]
YEAR_FIRST = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}|^[0-9]{4}/[0-9]{2}/[0-9]{2}"
YEAR_LAST = r"^[0-9]{2}/[0-9]{2}/[0-9]{4}|^[0-9]{2}-[0-9]{2}-[0-9]{4}"
# What may follow the ten characters of a date: nothing, or a time of day with an optional zone.
TIME_PART = r"^.{10}([T ]([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.][0-9]+)?)?[ ]*(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"


INTEGER_SHAPE = "^[+-]?[0-9]+$"

# Bits of a value: ten for the truth words, then one for each type it does not fit.
NO_BOOLEAN, NO_DATE, NO_INTEGER, NO_FLOAT = 1 << 10, 1 << 11, 1 << 12, 1 << 13
WORD_BITS = NO_BOOLEAN - 1
NOTHING = NO_BOOLEAN | NO_DATE | NO_INTEGER | NO_FLOAT

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONS = (T.DoubleType, T.FloatType, T.DecimalType)
DAYS = (T.DateType, T.TimestampType, T.TimestampNTZType)
TEXTS = (T.StringType, T.CharType, T.VarcharType)


def word_bit(text: Column) -> Column:
    """One bit per truth word, so that a bitwise or counts the distinct words; 0 for other values."""
    word = F.lower(text)
    bits = F.when(word == BOOLEAN_WORDS[0], F.lit(1))
    for i, w in enumerate(BOOLEAN_WORDS[1:], start=1):
        bits = bits.when(word == w, F.lit(1 << i))
    return bits.otherwise(F.lit(0))


def is_date(text: Column) -> Column:
    """A calendar day in one of four shapes, day and month in either order where the year comes last.

    This and the other tests take text without blanks around it.
    """
    def at(start: int, length: int) -> Column:
        return F.substring(text, start, length)

    def day(year: Column, month: Column, date: Column) -> Column:
        return F.concat(year, F.lit("-"), month, F.lit("-"), date).try_cast("date").isNotNull()

    # Looking at two characters spares most values the patterns.
    first = at(5, 1).isin("-", "/") & text.rlike(YEAR_FIRST)
    last = at(3, 1).isin("-", "/") & text.rlike(YEAR_LAST)
    real = F.when(first, day(at(1, 4), at(6, 2), at(9, 2))).when(
        last, day(at(7, 4), at(1, 2), at(4, 2)) | day(at(7, 4), at(4, 2), at(1, 2))
    )
    plain = (F.length(text) == 10) | text.rlike(TIME_PART)
    return F.coalesce(real & plain, F.lit(False))


def number_bits(text: Column) -> Column:
    """0 for a whole number, else what the value does not fit."""
    number = text.try_cast("double")
    whole = F.coalesce((number == F.floor(number)) & (F.abs(number) < F.lit(1e300)), F.lit(False))
    # Numbers begin with one of the characters from `+` to `9`.
    starts = F.substring(text, 1, 1).between("+", "9")
    return (
        F.when(~starts, F.lit(NO_INTEGER | NO_FLOAT))
        .when(text.rlike(INTEGER_SHAPE), F.lit(0))
        .when(text.rlike(NUMBER_SHAPE), F.when(whole, F.lit(0)).otherwise(F.lit(NO_INTEGER)))
        .otherwise(F.lit(NO_INTEGER | NO_FLOAT))
    )


def _bit(fits: Column, bit: int) -> Column:
    return F.when(fits, F.lit(0)).otherwise(F.lit(bit))


def text_bits(text: Column) -> Column:
    """The bits of a text value."""
    # No truth word is longer than five letters, no date shorter than ten characters.
    words = F.when(F.length(text) <= 5, word_bit(text)).otherwise(F.lit(0))
    words = F.when(words == 0, F.lit(NO_BOOLEAN)).otherwise(words)
    date = F.when(F.length(text) >= 10, _bit(is_date(text), NO_DATE)).otherwise(F.lit(NO_DATE))
    return words.bitwiseOR(date).bitwiseOR(number_bits(text))


def _typed_bits(c: Column, kind: T.DataType) -> Column:
    """The bits that a declared type leaves open; null for missing values."""
    if isinstance(kind, INTEGERS):
        small = F.when(c == 1, F.lit(1 << BOOLEAN_WORDS.index("1"))).when(c == 0, F.lit(1 << BOOLEAN_WORDS.index("0")))
        bits = small.otherwise(F.lit(NO_BOOLEAN)).bitwiseOR(F.lit(NO_DATE))
    elif isinstance(kind, FRACTIONS):
        whole = F.coalesce((c == F.floor(c)) & (F.abs(c) < F.lit(1e300)), F.lit(False))
        bits = _bit(whole, NO_INTEGER).bitwiseOR(F.lit(NO_BOOLEAN | NO_DATE))
        if not isinstance(kind, T.DecimalType):
            return F.when(c.isNotNull() & ~F.isnan(c), bits)
    elif isinstance(kind, DAYS):
        bits = F.lit(NOTHING & ~NO_DATE)
    elif isinstance(kind, T.BooleanType):
        bits = F.when(c, F.lit(1 << BOOLEAN_WORDS.index("true"))).otherwise(F.lit(1 << BOOLEAN_WORDS.index("false")))
        bits = bits.bitwiseOR(F.lit(NOTHING & ~NO_BOOLEAN))
    else:
        bits = F.lit(NOTHING)
    return F.when(c.isNotNull(), bits)


def detect_types(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, values that are not null, rows.

    The first type that fits every value wins, in the order boolean, date, integer, float, string. Text cells
    become rows of (position, text), so one small expression serves a table of any width, and the aggregation
    keeps one row per column in each task.
    """
    if not df.columns:
        raise ValueError("the table has no columns")
    texts = [(i, f) for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, TEXTS)]
    others = [(i, f) for i, f in enumerate(df.schema.fields) if not isinstance(f.dataType, TEXTS)]
    parts = []
    if texts:
        cells = [F.struct(F.lit(i).alias("position"), F.trim(named(f.name)).alias("text")) for i, f in texts]
        long = df.select(F.inline(F.array(*cells)))
        bits = F.when(F.col("text").isNotNull(), text_bits(F.col("text")))
        parts.append(
            long.select("position", bits.alias("bits")).groupBy("position").agg(
                F.bit_or("bits").alias("bits"), F.count("bits").alias("filled"), F.count("*").alias("rows")
            )
        )
    if others:
        # Declared types leave little to look at; both parts read their own columns only.
        bits_of = df.select(*[_typed_bits(named(f.name), f.dataType).alias(f"b{i}") for i, f in others])
        aggregates = [F.count("*").alias("rows")]
        for i, _ in others:
            aggregates += [F.bit_or(f"b{i}").alias(f"b{i}"), F.count(f"b{i}").alias(f"n{i}")]
        rows = [
            F.struct(F.lit(i).alias("position"), F.col(f"b{i}").alias("bits"), F.col(f"n{i}").alias("filled"), "rows")
            for i, _ in others
        ]
        parts.append(bits_of.agg(*aggregates).select(F.inline(F.array(*rows))))
    seen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    names = F.array(*[F.lit(c) for c in df.columns])
    # A table without rows still has columns.
    blank = df.sparkSession.range(len(df.columns)).select(F.col("id").cast("int").alias("position"))
    found = blank.join(seen, "position", "left")

    def lacks(bit: int) -> Column:
        return F.col("bits").bitwiseAND(F.lit(bit)) == 0

    few_words = F.bit_count(F.col("bits").bitwiseAND(F.lit(WORD_BITS))) <= 2
    kind = (
        F.when(F.col("bits").isNull(), F.lit("string"))
        .when(lacks(NO_BOOLEAN) & few_words, F.lit("boolean"))
        .when(lacks(NO_DATE), F.lit("date"))
        .when(lacks(NO_INTEGER), F.lit("integer"))
        .when(lacks(NO_FLOAT), F.lit("float"))
        .otherwise(F.lit("string"))
    )
    return found.select(
        "position",
        F.element_at(names, F.col("position") + 1).alias("column"),
        kind.alias("type"),
        F.coalesce(F.col("filled"), F.lit(0).cast("bigint")).alias("filled"),
        F.coalesce(F.col("rows"), F.lit(0).cast("bigint")).alias("rows"),
    )

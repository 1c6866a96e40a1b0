"""Masks for the columns of an existing table.

A mask gets the column name, its settings and the shared context, and returns the expression of the masked
column; helper columns and lookup joins go onto the context's stage. Nulls stay null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskflow.functions import draws
from maskflow.functions.dates import add_days
from maskflow.functions.names import column as named
from maskflow.functions.numbers import social_security_number, to_double, to_whole
from maskflow.functions.permute import permute
from maskflow.functions.stage import Stage
from maskflow.functions.text import (
    digits_of,
    is_filled,
    normalise_name,
    replace_last_digits,
    shuffle_last_digits,
    split_street,
)
from maskflow.operators.hotjoin import map_back
from maskflow.operators.ranks import bucket_digits, positions
from maskflow.operators.slots import Slots, pick
from maskflow.session import BROADCAST_BYTES, materialise
from maskflow.sources.lookups import (
    Lookups,
    library_any_first_name,
    library_email,
    library_first_name,
    library_last_name,
    library_street,
    library_street_address,
)

OGD = "ogd-bs"
# Letters a house number may carry.
HOUSE_LETTERS = ["a", "b", "c", "d", "e", "f"]


@dataclass
class MaskContext:
    """What masks share: key, lookups, row key, column types, and the expressions made so far."""

    key: str
    lookups: Lookups
    source: DataFrame
    stage: Stage
    fields: dict[str, T.DataType]
    whole_number: set[str] = field(default_factory=set)
    row_key: list[str] | None = None
    outputs: dict[str, Column] = field(default_factory=dict)
    parsed: dict[str, Column] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)

    def value(self, name: str) -> Column:
        """The input of a mask: as it stands, or as a whole number if the column is declared one."""
        c = named(name)
        if name not in self.whole_number:
            return c
        if name not in self.parsed:
            self.parsed[name] = self.stage.keep(to_whole(c))
        return self.parsed[name]

    def digest(self, name: str, settings: dict, *values: Column) -> Column:
        """Draws are keyed by column; a shared `scope` makes columns and tables agree."""
        return self.stage.keep(draws.digest(self.key, settings.get("scope", name), *values))

    def row_digest(self, name: str, settings: dict) -> Column:
        """Draws per row: keyed by the row key, or by all input columns."""
        columns = self.row_key or self.order
        return self.stage.keep(draws.digest(self.key, settings.get("scope", name), *[named(c) for c in columns]))

    def pick(self, slots: Slots, draw: Column, group: Column | None = None, values: tuple[str, ...] | None = None) -> Column:
        into = self.stage.name()
        self.stage.df = pick(self.stage.df, slots, draw, into, group, values=values)
        return F.col(into)

    def map_back(self, value: Column, mapping: DataFrame, rows: int, small: bool) -> Column:
        into = self.stage.name()
        self.stage.df = map_back(self.stage.df, value, mapping, rows, small, into)
        return F.col(into)

    def source_value(self, name: str) -> Column:
        """The same value as an expression over the source table."""
        return to_whole(named(name)) if name in self.whole_number else named(name)

    def output(self, name: str) -> Column:
        return self.outputs.get(name, named(name))


def _text_or_null(value: Column) -> Column:
    shown = value.cast("string")
    return F.when(shown != "", shown)


def last_name(name: str, p: dict, ctx: MaskContext) -> Column:
    value = _text_or_null(ctx.value(name))
    dg = ctx.digest(name, p, value)
    if p.get("source") != OGD:
        return F.when(value.isNotNull(), draws.one_of(p["names"], dg) if p.get("names") else library_last_name(dg))
    picked = ctx.pick(ctx.lookups.last_name_slots(), draws.draw(dg))
    return F.when(value.isNotNull(), picked["nachname"])


def gender_of(name: str, ctx: MaskContext) -> Column:
    """The usual gender of a first name; unknown names ending in `a` are female, others male."""
    known = ctx.lookups.gender_of_name.select(F.col("vorname").alias("__gender_name"), F.col("geschlecht").alias("__gender"))
    value = ctx.value(name).cast("string")
    ctx.stage.df = ctx.lookups.first_name_slots().join(ctx.stage.df, known, value == F.col("__gender_name"), value.isNull())
    guess = F.when(value.endswith("a"), F.lit("F")).otherwise(F.lit("M"))
    gender = ctx.stage.keep(F.when(value.isNotNull(), F.coalesce(F.col("__gender"), guess)))
    ctx.stage.df = ctx.stage.df.drop("__gender", "__gender_name")
    return gender


def first_name(name: str, p: dict, ctx: MaskContext) -> Column:
    value = _text_or_null(ctx.value(name))
    gender_field = p.get("gender_field")
    if p.get("source") != OGD:
        if not gender_field:
            return F.when(value.isNotNull(), library_any_first_name(ctx.digest(name, p, value)))
        female = F.coalesce(ctx.value(gender_field).cast("string") == "F", F.lit(False))
        dg = ctx.digest(name, p, value, F.when(female, F.lit("F")).otherwise(F.lit("M")))
        return F.when(value.isNotNull(), library_first_name(dg, female))
    if gender_field:
        identifier = str(p.get("gender_field_male_identfier", "M"))
        male = F.coalesce(ctx.value(gender_field).cast("string") == identifier, F.lit(False))
        gender = ctx.stage.keep(F.when(male, F.lit("M")).otherwise(F.lit("F")))
    else:
        gender = gender_of(name, ctx)
    picked = ctx.pick(ctx.lookups.first_name_slots(), draws.draw(ctx.digest(name, p, value, gender)), gender)
    return F.when(value.isNotNull(), picked["vorname"])


def phone_nr(name: str, p: dict, ctx: MaskContext) -> Column:
    value = ctx.value(name).cast("string")
    return shuffle_last_digits(ctx.stage, value, 7, ctx.digest(name, p, value))


def formatted_numbers(name: str, p: dict, ctx: MaskContext) -> Column:
    value = ctx.value(name).cast("string")
    count = int(p["replace_last_digits"])
    drawn = draws.random_digits(ctx.key, p.get("scope", name), count, value)
    return replace_last_digits(ctx.stage, value, count, drawn)


def email(name: str, p: dict, ctx: MaskContext) -> Column:
    value = ctx.value(name)
    providers = p.get("providers") or ["example.com"]
    if not (p.get("first_name_field") and p.get("last_name_field")):
        return F.when(is_filled(value), library_email(ctx.digest(name, p, value))).otherwise(value)
    first, last = ctx.output(p["first_name_field"]), ctx.output(p["last_name_field"])
    dg = ctx.row_digest(name, p)
    address = F.concat(
        normalise_name(ctx.stage, first.cast("string")),
        F.lit("."),
        normalise_name(ctx.stage, last.cast("string")),
        F.lit("@"),
        draws.one_of(providers, dg),
    )
    replaced = F.when(is_filled(first) & is_filled(last), address).otherwise(library_email(dg))
    return F.when(is_filled(value), replaced).otherwise(value)


def random_int(name: str, p: dict, ctx: MaskContext) -> Column:
    value = ctx.value(name)
    low, high = int(p.get("min", 0)), int(p.get("max", 100))
    if high < low:
        raise ValueError(f"{name}: max is below min")
    shown = _text_or_null(value)
    if p.get("unique"):
        return unique_int(name, p, ctx, shown, low, high)
    drawn = F.lit(low).cast("bigint") + draws.below(ctx.digest(name, p, shown), high - low + 1)
    return F.when(shown.isNotNull(), drawn)


def random_float(name: str, p: dict, ctx: MaskContext) -> Column:
    shown = _text_or_null(ctx.value(name))
    low, high = float(p.get("min", 0)), float(p.get("max", 100))
    drawn = F.lit(low) + draws.unit(ctx.digest(name, p, shown)) * F.lit(high - low)
    return F.when(shown.isNotNull(), F.round(drawn, int(p.get("digits", 2))))


def list_string(name: str, p: dict, ctx: MaskContext) -> Column:
    shown = _text_or_null(ctx.value(name))
    chosen = draws.weighted_choice(ctx.stage, [str(v) for v in p["list"]], p.get("weights"), ctx.digest(name, p, shown))
    return F.when(shown.isNotNull(), chosen)


def _counted_values(source: DataFrame, value: Column) -> tuple[DataFrame, int, int, bool]:
    """Distinct values with their counts, written once; number of values, of rows, and whether they fit a broadcast."""
    counted = source.select(value.alias("old")).filter(F.col("old").isNotNull()).groupBy("old").agg(F.count("*").alias("n"))
    stored = materialise(counted, "values")
    size = stored.agg(
        F.count("*").alias("values"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.length(F.col("old").cast("string"))), F.lit(0)).alias("chars"),
    ).first()
    small = int(size["values"]) * 64 + 2 * int(size["chars"]) <= BROADCAST_BYTES
    return stored, int(size["values"]), int(size["rows"]), small


def unique_int(name: str, p: dict, ctx: MaskContext, value: Column, low: int, high: int) -> Column:
    """Distinct values get distinct integers: a random rank, permuted over the whole range; both depend on the key.

    Only digests of the values are written to the shared folder, never the values.
    """
    scope = p.get("scope", name)

    def hidden(shown: Column) -> Column:
        return F.when(shown.isNotNull(), draws.digest(ctx.key, scope, shown))

    stored, count, rows, small = _counted_values(ctx.source, hidden(_text_or_null(ctx.source_value(name))))
    width = high - low + 1
    if count > width:
        raise ValueError(f"{name}: {count} distinct values do not fit into {width} integers")
    stage = Stage(positions(stored, F.col("old"), "r", digits=bucket_digits(count), rows=count))
    placed = permute(stage, F.col("r"), width, ctx.key, scope)
    mapping = stage.df.select("old", (F.lit(low).cast("bigint") + placed).alias("new"), "n")
    return ctx.map_back(ctx.stage.keep(hidden(value)), mapping, rows, small)


def shuffle_codes(name: str, p: dict, ctx: MaskContext) -> Column:
    """A random bijection among the distinct codes: two independent ranks, joined."""
    stored, count, rows, small = _counted_values(ctx.source, ctx.source_value(name))
    size = {"digits": bucket_digits(count), "rows": count}
    scope = p.get("scope", name)
    first = draws.digest(ctx.key, scope, F.lit("from"), F.col("old"))
    second = draws.digest(ctx.key, scope, F.lit("to"), F.col("new"))
    source = positions(stored, first, "r", **size)
    target = positions(stored.select(F.col("old").alias("new")), second, "r", **size)
    mapping = source.join(target, "r").select("old", "new", "n")
    return ctx.map_back(ctx.value(name), mapping, rows, small)


def date_add_random_days(name: str, p: dict, ctx: MaskContext) -> Column:
    value = ctx.value(name)
    low, high = int(p.get("lower", -4)), int(p.get("upper", 4))
    if high < low:
        raise ValueError(f"{name}: upper is below lower")
    days = F.lit(low).cast("bigint") + draws.below(ctx.digest(name, p, value), high - low + 1)
    return add_days(ctx.stage, value, days, ctx.fields[name])


def ahv_nr(name: str, p: dict, ctx: MaskContext) -> Column:
    value = ctx.value(name)
    return F.when(value.isNotNull(), social_security_number(ctx.stage, draws.draw(ctx.digest(name, p, value))))


def house_number_from(dg: Column, p: dict) -> Column:
    if "frequency_suffix" in p:
        share = float(p["frequency_suffix"])
    else:
        share = float(p.get("pct_with_suffix", 0)) / 100.0
    low, high = int(p.get("min", 1)), int(p.get("max", 100))
    number = (F.lit(low).cast("bigint") + draws.below(dg, high - low + 1, 0)).cast("string")
    letter = draws.one_of(p.get("suffixes") or HOUSE_LETTERS, dg, 2)
    return F.when(draws.unit(dg, 1) < share, F.concat(number, letter)).otherwise(number)


def house_number(name: str, p: dict, ctx: MaskContext) -> Column:
    return F.when(ctx.value(name).isNotNull(), house_number_from(ctx.row_digest(name, p), p))


def hash_columns(name: str, p: dict, ctx: MaskContext) -> Column:
    """SHA-256 of the named columns: those before this one as masked, the others as they came in."""
    read_input = p.get("read") == "input"
    place = ctx.order.index(name)
    parts: list[Column] = []
    if p.get("secret"):
        parts.append(F.lit(str(p["secret"])))
    for position, c in enumerate(p["hashed_columns"]):
        if position and p.get("separator"):
            parts.append(F.lit(p["separator"]))
        masked = not read_input and ctx.order.index(c) < place
        parts.append(draws.text(ctx.output(c) if masked else named(c)))
    return F.sha2(F.concat(*parts), 256)


def fill_with_random_distribution(name: str, p: dict, ctx: MaskContext) -> Column:
    """Normal numbers with the column's own mean and standard deviation."""
    number = to_double(ctx.value(name))
    moments = ctx.source.select(to_double(ctx.source_value(name)).alias("x")).agg(F.struct(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).alias("moments"))
    both = moments.scalar()
    dg = ctx.row_digest(name, p)
    drawn = both["m"] + both["s"] * draws.standard_normal(dg)
    return F.when(number.isNotNull(), F.round(drawn, int(p.get("decimals", 2))))


def _area(p: dict, ctx: MaskContext) -> tuple[str | None, Column | None]:
    """Lookup column and data column that tie an address to its area."""
    if p.get("location_code_col"):
        return p["location_code_col"], ctx.value(p["location_data_col"]).cast("string")
    if p.get("plz_field"):
        return "plz", ctx.value(p["plz_field"]).cast("string")
    if p.get("location_field"):
        if p["location_field"].startswith("<"):
            # The placeholder of a suggested configuration.
            return None, None
        return "ort", ctx.value(p["location_field"]).cast("string")
    return None, None


# What `address_text` reads of a lookup row.
ADDRESS_TEXT = ("str_name", "hausnr", "hausnr_zus")


def before_pick(stage: Stage, slots: Slots, value: Column) -> Column:
    """What is taken from a digest after a pick: made before, if the pick shuffles the rows, for a digest is long and does
    not compress."""
    return value if slots.small and slots.few_groups else stage.keep(value)


def address_text(a: Column) -> Column:
    return F.concat(a["str_name"], F.lit(" "), a["hausnr"].cast("string"), F.coalesce(a["hausnr_zus"], F.lit("")))


def streetname_housenumber(name: str, p: dict, ctx: MaskContext) -> Column:
    value = ctx.value(name)
    code, area = _area(p, ctx)
    if p.get("source", OGD) != OGD or code is None:
        return F.when(value.isNotNull(), library_street_address(ctx.digest(name, p, value)))
    dg = ctx.digest(name, p, value, area)
    slots = ctx.lookups.address_slots(code)
    other = before_pick(ctx.stage, slots, library_street_address(dg))
    picked = ctx.pick(slots, draws.draw(dg), group=area, values=ADDRESS_TEXT)
    return F.when(value.isNotNull(), F.coalesce(address_text(picked), other))


def street(name: str, p: dict, ctx: MaskContext) -> Column:
    """Picked from address rows, so streets with many addresses weigh more."""
    value = ctx.value(name)
    code, area = _area(p, ctx)
    if p.get("source", OGD) != OGD or code is None:
        return F.when(value.isNotNull(), library_street(ctx.digest(name, p, value)))
    dg = ctx.digest(name, p, value, area)
    slots = ctx.lookups.address_slots(code)
    other = before_pick(ctx.stage, slots, library_street(dg))
    picked = ctx.pick(slots, draws.draw(dg), group=area, values=("str_name",))
    return F.when(value.isNotNull(), F.coalesce(picked["str_name"], other))


def blur_address(name: str, p: dict, ctx: MaskContext) -> Column:
    """Another number in the same street and area; with one address or none there, another address."""
    value = ctx.value(name).cast("string")
    code, area = _area(p, ctx)
    if code is None:
        raise ValueError(f"{name}: blur_address needs location_code_col and location_data_col")
    road, number = ctx.stage.keep_all(list(split_street(value)))
    dg = ctx.digest(name, p, value, area)
    streets = ctx.lookups.address_slots(code, "str_name")
    key = ctx.stage.keep(F.concat(road, F.lit("|"), area))
    drawn = draws.draw(dg, 0), draws.draw(dg, 1), library_street_address(dg)
    near_draw, far_draw, other = (before_pick(ctx.stage, streets, c) for c in drawn)
    total = ctx.stage.name()
    sizes = streets.totals.select(F.col("__slot_group").alias("__blur_group"), F.col("__slot_total").alias(total))
    ctx.stage.df = streets.join_totals(ctx.stage.df, sizes, key == F.col("__blur_group"), key.isNull()).drop("__blur_group")
    near = ctx.pick(streets, near_draw, key, ADDRESS_TEXT)
    far = ctx.pick(ctx.lookups.address_slots(code), far_draw, area, ADDRESS_TEXT)
    elsewhere = F.coalesce(address_text(far), other)
    moved = F.when(F.col(total) > 1, address_text(near)).otherwise(elsewhere)
    return F.when(number.isNull(), value).otherwise(moved)


Mask = Callable[[str, dict[str, Any], MaskContext], Column]

MASKS: dict[str, Mask] = {
    "first_name": first_name,
    "last_name": last_name,
    "random_int": random_int,
    "random_float": random_float,
    "list_string": list_string,
    "date_add_random_days": date_add_random_days,
    "ahv_nr": ahv_nr,
    "streetname_housenumber": streetname_housenumber,
    "phone_nr": phone_nr,
    "formatted_numbers": formatted_numbers,
    "email": email,
    "street": street,
    "street_name": street,
    "streetname": street,
    "house_number": house_number,
    "housenumber": house_number,
    "hash": hash_columns,
    "shuffle_codes": shuffle_codes,
    "fill_with_random_distribution": fill_with_random_distribution,
    "blur_address": blur_address,
}

# These look at the whole table first and so do not run on a stream.
WHOLE_TABLE = {"shuffle_codes", "fill_with_random_distribution"}


def blank_to_null(df: DataFrame) -> DataFrame:
    """Blank text becomes null; rows without any value go away."""
    columns = []
    for f in df.schema.fields:
        c = named(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(~c.rlike(r"^\s*$"), c)
        columns.append(c.alias(f.name))
    return df.select(*columns).na.drop("all")


def masked_digits(value: Column) -> Column:
    """How many digits a value has: fewer than seven make a phone number a reject."""
    return F.length(digits_of(value.cast("string")))

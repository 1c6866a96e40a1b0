"""Column generators for new tables.

A generator gets the column name, its settings and the shared context, and returns its columns; helper
columns and lookup joins go onto the context's stage. Every draw is keyed by the row id, so a row has the same
values wherever it is computed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.functions import draws
from maskflow.functions.dates import DATE_TEXT, day_text
from maskflow.functions.names import column as named
from maskflow.functions.numbers import social_security_number
from maskflow.functions.permute import permute
from maskflow.functions.stage import Stage
from maskflow.functions.text import fill_format, is_filled, normalise_name
from maskflow.operators.masks import ADDRESS_TEXT, OGD, address_text, before_pick, house_number_from
from maskflow.operators.ranks import bucket_digits, nth_digest, positions
from maskflow.operators.slots import Slots, build_slots, pick, row_digest, slots_in_order
from maskflow.sources.lookups import (
    Lookups,
    library_email,
    library_first_name,
    library_last_name,
    library_street,
    library_street_address,
)

# Address components in output order, and the lookup columns that hold them.
ADDRESS_FIELDS = {
    "streetname": "str_name",
    "housenumber": "hausnr",
    "housenumber_addition": "hausnr_zus",
    "plz": "plz",
    "location": "ort",
}
# Other spellings of these components in configurations.
ADDRESS_SPELLINGS = {"str_name": "streetname", "housnumber": "housenumber", "hausnr": "housenumber", "ort": "location"}
# Fixed value: postcode of a canton that the postcode list does not have.
NO_POSTCODE = -99
REDRAWS = 8

Generated = dict[str, Column]


@dataclass
class GenerateContext:
    """What generators share: key, row ids and their number, lookups."""

    key: str
    rows: int
    ids: DataFrame
    id: str
    lookups: Lookups
    stage: Stage
    last_id: int

    @property
    def row(self) -> Column:
        return F.col(self.id)

    def digest(self, name: str, part: str = "") -> Column:
        return self.stage.keep(self.row_digest(name, part))

    def row_digest(self, name: str, part: str = "") -> Column:
        """The digest as an expression over the row ids."""
        scope = f"{name}#{part}" if part else name
        return draws.digest(self.key, scope, self.row)

    def pick(
        self, slots: Slots, draw: Column, group: Column | None = None, position: bool = False, values: tuple[str, ...] | None = None
    ) -> Column:
        into = self.stage.name()
        self.stage.df = pick(self.stage.df, slots, draw, into, group, position, values, even=not position)
        return F.col(into)

    def exactly(self, name: str, part: str, count: int) -> Column:
        """True for exactly `count` rows, spread at random."""
        if count <= 0:
            return F.lit(False)
        if count >= self.rows:
            return F.lit(True)
        dg = self.row_digest(name, part)
        return dg <= nth_digest(self.ids, dg, count, bucket_digits(self.rows))


def null_count(percent: Any, rows: int) -> int:
    """How many rows a percentage empties; text that is no number empties none."""
    try:
        share = float(percent)
    except (TypeError, ValueError):
        return 0
    if share >= 100:
        return rows
    return max(0, int(share / 100.0 * rows))


def with_nulls(ctx: GenerateContext, name: str, p: dict, value: Column) -> Column:
    """Exactly `int(percent / 100 * rows)` rows become null."""
    count = null_count(p.get("percent_null", 0), ctx.rows)
    if count == 0:
        return value
    return F.when(~ctx.exactly(name, "null", count), value)


def single(name: str, value: Column) -> dict[str, Column]:
    return {name: value}


def incremental_int(name: str, p: dict, ctx: GenerateContext) -> Generated:
    low = int(p.get("min_value", p.get("min", 0)))
    if p.get("sequential") is False:
        high = int(p.get("max_value", p.get("max", low + ctx.rows)))
        return single(name, F.lit(low).cast("bigint") + draws.below(ctx.digest(name), high - low))
    return single(name, F.lit(low).cast("bigint") + ctx.row * F.lit(int(p.get("step", 1))).cast("bigint"))


def random_int(name: str, p: dict, ctx: GenerateContext) -> Generated:
    low, high = int(p.get("min", 0)), int(p.get("max", 1000))
    if high <= low:
        raise ValueError(f"{name}: max must be above min")
    if p.get("unique"):
        if ctx.rows > high - low:
            raise ValueError(f"{name}: {ctx.rows} rows do not fit into {high - low} integers")
        return single(name, F.lit(low).cast("bigint") + permute(ctx.stage, ctx.row, high - low, ctx.key, name))
    return single(name, F.lit(low).cast("bigint") + draws.below(ctx.digest(name), high - low))


def random_float(name: str, p: dict, ctx: GenerateContext) -> Generated:
    low, high = float(p["min"]), float(p["max"])
    value = F.lit(low) + draws.unit(ctx.digest(name)) * F.lit(high - low)
    return single(name, F.round(value, int(p["digits"])) if "digits" in p else value)


def bounded_normal(name: str, p: dict, ctx: GenerateContext) -> Column:
    """Normal numbers, out-of-range ones clipped, or first redrawn up to `REDRAWS` times."""
    low, high = p.get("min"), p.get("max")

    def attempt(i: int) -> Column:
        dg = ctx.row_digest(name, f"again{i}" if i else "")
        return F.lit(float(p["mean"])) + F.lit(float(p["std"])) * draws.standard_normal(dg)

    def fits(x: Column) -> Column:
        ok = F.lit(True)
        if low is not None:
            ok = ok & (x >= F.lit(float(low)))
        if high is not None:
            ok = ok & (x <= F.lit(float(high)))
        return ok

    if p.get("bounds", "clip") == "redraw":
        tries = ctx.stage.keep_all([attempt(i) for i in range(REDRAWS)])
        chosen = F.when(fits(tries[0]), tries[0])
        for t in tries[1:]:
            chosen = chosen.when(fits(t), t)
        value = chosen.otherwise(tries[-1])
    else:
        dg = ctx.digest(name)
        value = F.lit(float(p["mean"])) + F.lit(float(p["std"])) * draws.standard_normal(dg)
    if low is not None:
        value = F.greatest(value, F.lit(float(low)))
    if high is not None:
        value = F.least(value, F.lit(float(high)))
    return value


def normal_float(name: str, p: dict, ctx: GenerateContext) -> Generated:
    value = bounded_normal(name, p, ctx)
    return single(name, F.round(value, int(p["digits"])) if "digits" in p else value)


def normal_int(name: str, p: dict, ctx: GenerateContext) -> Generated:
    return single(name, F.round(bounded_normal(name, p, ctx), 0).cast("bigint"))


def integer_grouped(name: str, p: dict, ctx: GenerateContext) -> Generated:
    """Values of a range, each for a random number of rows; `ordered` lays them out in ascending order."""
    start, stop, step = (int(v) for v in p["values"])
    n = len(range(start, stop + 1, step))
    first, gap = F.lit(start).cast("bigint"), F.lit(step).cast("bigint")
    if p.get("rows_per_group", "random") != "random":
        # Groups of equal size.
        place = F.floor(ctx.row * n / ctx.rows).cast("bigint") if p.get("ordered") else ctx.row % n
        return single(name, first + gap * place)
    drawn = draws.below(ctx.row_digest(name), n)
    if not p.get("ordered"):
        return single(name, first + gap * drawn)
    # Row i gets the i-th smallest value: the values own intervals of row ids as long as they were drawn.
    counts = ctx.ids.groupBy(drawn.alias("place")).agg(F.count("*").alias("n"))
    slots = slots_in_order(counts, "place", "n", n, ctx.rows)
    picked = ctx.pick(slots, ctx.row, position=True)
    return single(name, first + gap * picked["place"])


def list_int(name: str, p: dict, ctx: GenerateContext) -> Generated:
    if "values" in p:
        return integer_grouped(name, p, ctx)
    items = [F.lit(int(v)).cast("bigint") for v in p["list"]]
    return single(name, F.element_at(F.array(*items), (draws.below(ctx.digest(name), len(items)) + 1).cast("int")))


def list_string(name: str, p: dict, ctx: GenerateContext) -> Generated:
    return single(name, draws.weighted_choice(ctx.stage, [str(v) for v in p["list"]], p.get("weights"), ctx.digest(name)))


def last_name(name: str, p: dict, ctx: GenerateContext) -> Generated:
    dg = ctx.digest(name)
    if p.get("source", OGD) != OGD:
        return single(name, library_last_name(dg))
    picked = ctx.pick(ctx.lookups.last_name_slots(), draws.draw(dg))
    return single(name, picked["nachname"])


def first_name(name: str, p: dict, ctx: GenerateContext) -> Generated:
    """Gender from a column, or an exact share of men mixed over the rows."""
    if p.get("gender_field"):
        identifier = str(p.get("gender_field_male_identfier", "M"))
        male = F.coalesce(named(p["gender_field"]).cast("string") == identifier, F.lit(False))
    else:
        share = float(p.get("percent_male", 50))
        male = ctx.exactly(name, "male", int(share / 100 * ctx.rows))
    gender = F.when(male, F.lit("M")).otherwise(F.lit("F"))
    dg = ctx.digest(name)
    if p.get("source", OGD) != OGD:
        return single(name, library_first_name(dg, gender == "F"))
    picked = ctx.pick(ctx.lookups.first_name_slots(), draws.draw(dg), group=gender)
    return single(name, picked["vorname"])


def canton(name: str, p: dict, ctx: GenerateContext) -> Generated:
    """Weighs a canton by its number of postcodes."""
    picked = ctx.pick(ctx.lookups.postcode_slots(None), draws.draw(ctx.digest(name)))
    return single(name, picked[p.get("field", "kanton_name_kurz")])


def plz4(name: str, p: dict, ctx: GenerateContext) -> Generated:
    dg = ctx.digest(name)
    if p.get("canton_field"):
        version = p.get("canton_field_version", "kanton_name_kurz")
        group: Column | None = named(p["canton_field"]).cast("string")
    elif p.get("cantons"):
        version = "kanton_name_kurz"
        group = draws.weighted_choice(ctx.stage, [str(c).upper() for c in p["cantons"]], p.get("weights"), dg, 1)
    else:
        version, group = None, None
    picked = ctx.pick(ctx.lookups.postcode_slots(version), draws.draw(dg), group=group)
    code = picked["plz_postleitzahl"]
    return single(name, code if group is None else F.coalesce(code, F.lit(NO_POSTCODE)))


def location(name: str, p: dict, ctx: GenerateContext) -> Generated:
    """The first place of the row's postcode, or any place of the given cantons."""
    key = p.get("plz_field") or p.get("plz")
    postcodes = ctx.lookups.postcode
    slots = ctx.lookups.postcode_slots(None)
    if key:
        place = postcodes.groupBy(F.col("plz_postleitzahl").cast("string").alias("__plz")).agg(
            F.min_by("gemeinde_name", "ord").alias(f"__place_{name}")
        )
        area = named(key).cast("string")
        joined = slots.join(ctx.stage.df, place, area == F.col("__plz"), area.isNull())
        ctx.stage.df = joined.drop("__plz")
        return single(name, named(f"__place_{name}"))
    wanted = p.get("canton")
    if wanted is None or wanted == []:
        chosen = slots
    else:
        listed = sorted({str(c).upper() for c in ([wanted] if isinstance(wanted, str) else wanted)})
        chosen = build_slots(
            postcodes.filter(F.upper("kanton_name_kurz").isin(listed)),
            ["plz_postleitzahl", "gemeinde_name", "kanton_name", "kanton_name_kurz"],
        )
        if chosen.total == 0:
            chosen = slots
    picked = ctx.pick(chosen, draws.draw(ctx.digest(name)))
    return single(name, picked["gemeinde_name"])


def ahv_nr(name: str, p: dict, ctx: GenerateContext) -> Generated:
    return single(name, social_security_number(ctx.stage, draws.draw(ctx.digest(name))))


def _area(p: dict) -> tuple[str | None, Column | None]:
    if p.get("plz_field"):
        return "plz", named(p["plz_field"]).cast("string")
    if p.get("location_field"):
        return "ort", named(p["location_field"]).cast("string")
    return None, None


def streetname(name: str, p: dict, ctx: GenerateContext) -> Generated:
    dg = ctx.digest(name)
    if p.get("source", OGD) != OGD:
        return single(name, library_street(dg))
    code, area = _area(p)
    slots = ctx.lookups.street_slots(code)
    other = before_pick(ctx.stage, slots, library_street(dg))
    picked = ctx.pick(slots, draws.draw(dg), group=area, values=("str_name",))
    return single(name, F.coalesce(picked["str_name"], other))


def housenumber(name: str, p: dict, ctx: GenerateContext) -> Generated:
    """A number that exists in the row's street, or else in its area; any number without both."""
    dg = ctx.digest(name)
    code, area = _area(p)
    road = p.get("streetname_field")
    plain = house_number_from(dg, p)
    if p.get("source", OGD) != OGD or (code is None and road is None):
        return single(name, plain)
    if road:
        group = named(road).cast("string")
        group = F.concat(group, F.lit("|"), area) if area is not None else group
        slots = ctx.lookups.address_slots(code, "str_name")
    else:
        group, slots = area, ctx.lookups.address_slots(code)
    plain = before_pick(ctx.stage, slots, plain)
    picked = ctx.pick(slots, draws.draw(dg, 3), group=group, values=("hausnr", "hausnr_zus"))
    number = F.concat(picked["hausnr"].cast("string"), F.coalesce(picked["hausnr_zus"], F.lit("")))
    return single(name, F.coalesce(number, plain))


def streetname_housenumber(name: str, p: dict, ctx: GenerateContext) -> Generated:
    dg = ctx.digest(name)
    if p.get("source", OGD) != OGD:
        return single(name, library_street_address(dg))
    code, area = _area(p)
    slots = ctx.lookups.address_slots(code)
    other = before_pick(ctx.stage, slots, library_street_address(dg))
    picked = ctx.pick(slots, draws.draw(dg), group=area, values=ADDRESS_TEXT)
    return single(name, F.coalesce(address_text(picked), other))


def address(name: str, p: dict, ctx: GenerateContext) -> Generated:
    """Address rows without replacement: the address of rank r goes to row r, starting over when they run out."""
    wanted = {ADDRESS_SPELLINGS.get(f, f) for f in p.get("fields", ["streetname", "housenumber"])}
    fields = [c for f, c in ADDRESS_FIELDS.items() if f in wanted]
    labels = p.get("labels") or fields
    if len(labels) != len(fields):
        raise ValueError(f"{name}: {len(fields)} fields but {len(labels)} labels")
    columns = list(ADDRESS_FIELDS.values())
    slots = ctx.lookups.address_slots(None)
    key = draws.digest(ctx.key, f"{name}#order", row_digest(columns))
    ranked = positions(ctx.lookups.address, key, "__address_rank", digits=bucket_digits(slots.total), rows=slots.total)
    kept = ranked.select("__address_rank", *[F.col(c).alias(f"__{name}_{c}") for c in fields])
    joined = slots.join(ctx.stage.df, kept, (ctx.row % slots.total) == F.col("__address_rank"))
    ctx.stage.df = joined.drop("__address_rank")
    return {label: named(f"__{name}_{c}") for label, c in zip(labels, fields)}


def incremental_date(name: str, p: dict, ctx: GenerateContext) -> Generated:
    """A date per row, one step apart. Dates after the year 9999 are refused, or null with `"overflow": "null"`."""
    start = dt.date.fromisoformat(p.get("start_date", "2025-01-01"))
    period, step = p.get("step_period", "day"), int(p.get("delta_days", p.get("step", 1)))
    first = F.lit(start.isoformat()).cast("date")
    apart = step * {"week": 7, "year": 12}.get(period, 1)
    offset = ctx.row * F.lit(apart).cast("bigint")
    if period in ("month", "year"):
        last = (9999 - start.year) * 12 + 12 - start.month
        stepped = F.add_months(first, F.when(offset <= last, offset).cast("int"))
    elif period in ("day", "week"):
        last = (dt.date.max - start).days
        stepped = F.date_add(first, F.when(offset <= last, offset).cast("int"))
    else:
        raise ValueError(f"{name}: unknown step_period {period!r}")
    if ctx.last_id * apart > last and p.get("overflow") != "null":
        raise ValueError(f"{name}: {ctx.last_id + 1} rows pass the year 9999")
    return single(name, F.date_format(stepped, DATE_TEXT))


def random_date(name: str, p: dict, ctx: GenerateContext) -> Generated:
    start, end = p.get("start_date", "2024-01-01"), p.get("end_date", "2025-12-31")
    days = (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days
    return single(name, day_text(start, draws.below(ctx.digest(name), days + 1)))


def _date_or_none(shown: Any) -> dt.date | None:
    try:
        return dt.date.fromisoformat(shown)
    except (TypeError, ValueError):
        return None


def normal_date(name: str, p: dict, ctx: GenerateContext) -> Generated:
    """Days around a centre; a missing centre is today, fixed when the plan is made."""
    centre = _date_or_none(p.get("average_date")) or dt.date.today()
    offset = F.round(F.lit(float(p.get("std_days", 30.0))) * draws.standard_normal(ctx.digest(name)), 0)
    day = F.date_add(F.lit(centre.isoformat()).cast("date"), offset.cast("int"))
    low, high = _date_or_none(p.get("min_date")), _date_or_none(p.get("max_date"))
    if low:
        day = F.greatest(day, F.lit(low.isoformat()).cast("date"))
    if high:
        day = F.least(day, F.lit(high.isoformat()).cast("date"))
    return single(name, F.date_format(day, DATE_TEXT))


def phone_nr(name: str, p: dict, ctx: GenerateContext) -> Generated:
    """Fill the `x` of a format.

    A format with a leading `+` takes country code, network code and random digits; one with ten or more `x`
    takes a zero, the network code and random digits; a shorter one takes network code and random digits and
    is written after the country code.
    """
    codes = [str(c) for c in p.get("cc", ["+41"])]
    networks = [str(n) for n in p.get("ndc", ["61", "77", "78", "79"])]
    formats = [str(f) for f in p.get("formats", ["xx xxx xx xx"])]
    weights = p.get("format_weights") or p.get("formats_weights")
    dg = ctx.digest(name)
    code, network = ctx.stage.keep_all([draws.one_of(codes, dg, 1), draws.one_of(networks, dg, 2)])
    pattern = ctx.stage.keep(draws.weighted_choice(ctx.stage, formats, weights, dg, 3))
    longest = max(f.count("x") for f in formats)
    tail = ctx.stage.keep(draws.random_digits(ctx.key, f"{name}#digits", longest, ctx.row))
    international = pattern.startswith("+")
    national = F.length(pattern) - F.length(F.replace(pattern, F.lit("x"), F.lit(""))) >= 10
    digits = (
        F.when(international, F.concat(F.regexp_replace(code, "[^0-9]", ""), network, tail))
        .when(national, F.concat(F.lit("0"), network, tail))
        .otherwise(F.concat(network, tail))
    )
    filled = fill_format(ctx.stage, pattern, longest, digits)
    return single(name, F.when(international | national, filled).otherwise(F.concat(code, F.lit(" "), filled)))


def email(name: str, p: dict, ctx: GenerateContext) -> Generated:
    dg = ctx.digest(name)
    providers = p.get("providers") or ["gmail.com", "bluewin.ch", "gmx.ch"]
    if not (p.get("first_name_field") and p.get("last_name_field")):
        return single(name, library_email(dg))
    first, last = named(p["first_name_field"]), named(p["last_name_field"])
    built = F.concat(
        normalise_name(ctx.stage, first), F.lit("."), normalise_name(ctx.stage, last), F.lit("@"), draws.one_of(providers, dg)
    )
    return single(name, F.when(is_filled(first) & is_filled(last), built).otherwise(library_email(dg)))


Generator = Callable[[str, dict[str, Any], GenerateContext], Generated]

GENERATORS: dict[str, Generator] = {
    "incremental_int": incremental_int,
    "list_int": list_int,
    "random_int": random_int,
    "random_float": random_float,
    "normal_float": normal_float,
    "normal_int": normal_int,
    "integer_grouped": integer_grouped,
    "last_name": last_name,
    "first_name": first_name,
    "canton": canton,
    "location": location,
    "plz4": plz4,
    "list_string": list_string,
    "streetname": streetname,
    "street_name": streetname,
    "street": streetname,
    "housenumber": housenumber,
    "house_number": housenumber,
    "streetname_housenumber": streetname_housenumber,
    "address": address,
    "ahv_nr": ahv_nr,
    "incremental_date": incremental_date,
    "random_date": random_date,
    "normal_date": normal_date,
    "phone_nr": phone_nr,
    "email": email,
}

"""Weighted picks from lookup tables by equi-join.

Every lookup row owns an interval of integers as long as its weight. A draw modulo the total lands in one
interval, which is found by an equi-join on `(group, block)`. With few integers for the rows there are, and at most
`MAX_BLOCKS`, a block is a single one; above that a block covers several and holds the few intervals that touch it, so
the table stays bounded and the weights stay exact.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.operators.hotjoin import cuts_joins, salted_join
from maskflow.operators.ranks import bucket_digits, positions
from maskflow.session import BROADCAST_BYTES

MAX_BLOCKS = 1 << 20
# Few rows need few blocks whatever their weights: with four a row, a draw looks at a quarter more than one interval.
LEAST_BLOCKS, BLOCKS_PER_ROW = 4096, 4
# A lookup that is not broadcast is copied so often that hot values and areas are dealt over that many tasks. Every copy
# is shuffled, so there are few, and none where Spark itself cuts large partitions of a join.
COPIES = 8
GROUP_BYTES = 64  # of a row of totals, about

_GROUP = "__slot_group"
_LO = "__slot_lo"
_BLOCK = "__slot_block"
_PIECES = "__slot_pieces"
_TOTAL = "__slot_total"


def row_digest(columns: list[str]) -> Column:
    """Sort key of a lookup row; it depends on the row only, not on its place in a file."""
    parts: list[Column] = []
    for c in columns:
        if parts:
            parts.append(F.lit("|"))
        parts.append(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.sha2(F.concat(*parts), 256)


@dataclass(frozen=True)
class Slots:
    """A prepared lookup: interval table, totals per group, whether each of them fits a broadcast, how many copies are
    joined otherwise, and the intervals that the table is made from."""

    table: DataFrame
    totals: DataFrame | None
    total: int
    width: int
    small: bool
    values: tuple[str, ...]
    few_groups: bool = True
    copies: int = COPIES
    placed: DataFrame | None = None

    def join(
        self, df: DataFrame, table: DataFrame, same: Column, alone: Column | None = None, own: tuple[Column, Column] | None = None
    ) -> DataFrame:
        """`df` left joined with a table no larger than this lookup; rows that are `alone` match nothing."""
        if self.small:
            return df.join(F.broadcast(table), same, "left")
        return salted_join(df, table, same, 1, alone) if cuts_joins(df) else salted_join(df, table, same, self.copies, alone, own)

    def join_totals(self, df: DataFrame, totals: DataFrame, same: Column, alone: Column | None = None) -> DataFrame:
        if self.few_groups:
            return df.join(F.broadcast(totals), same, "left")
        return salted_join(df, totals, same, 1 if cuts_joins(df) else self.copies, alone)

    def holding(self, values: tuple[str, ...]) -> "Slots":
        """The same picks; a table that is shuffled holds only these values."""
        if self.small or self.placed is None or set(values) >= set(self.values):
            return self
        return replace(self, table=_table(self.placed, list(values), self.width, self.totals is not None), values=values)

    def copies_for(self, total: str) -> Column:
        """How many copies a group's blocks need if its rows are spread evenly over the group's intervals: rows of a group
        of many blocks are dealt over them already."""
        blocks = f"(({total} + {self.width - 1}) div {self.width})"
        return F.expr(f"({self.copies - 1} + {blocks}) div {blocks}").cast("int")


def build_slots(
    rows: DataFrame,
    values: list[str],
    group: Column | None = None,
    weight: Column | None = None,
    max_blocks: int = MAX_BLOCKS,
    *,
    broadcast_bytes: int | None = None,
) -> Slots:
    """Prepare `values` for picking; one small job over the lookup measures it, against `broadcast_bytes` if given."""
    lookup = rows.select(
        *values,
        (F.lit(None).cast("string") if group is None else group.cast("string")).alias(_GROUP),
        (F.lit(1) if weight is None else weight).cast("bigint").alias("__slot_weight"),
    ).filter(F.col("__slot_weight") > 0)
    if group is not None:
        lookup = lookup.filter(F.col(_GROUP).isNotNull())
    shown = F.lit(0)
    for v in values:
        shown = shown + F.length(F.coalesce(F.col(v).cast("string"), F.lit("")))
    size = lookup.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("__slot_weight"), F.lit(0)).alias("total"),
        F.coalesce(F.avg(shown), F.lit(0.0)).alias("chars"),
        F.approx_count_distinct(_GROUP).alias("groups"),
    ).first()
    count, total = int(size["n"]), int(size["total"])
    groups = (_GROUP,) if group is not None else ()
    placed = positions(
        lookup, row_digest(values), _LO, F.col("__slot_weight"), groups, bucket_digits(count), count, no_nulls=True
    ).withColumn("__slot_hi", F.col(_LO) + F.col("__slot_weight"))
    totals = None if group is None else lookup.groupBy(_GROUP).agg(F.sum("__slot_weight").alias(_TOTAL))
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    slots = _from_intervals(placed, values, totals, count, total, float(size["chars"]), max_blocks, limit)
    # The count of groups is off by a tenth at most, nearly always.
    return replace(slots, few_groups=int(size["groups"]) * GROUP_BYTES * 2 <= limit)


def _from_intervals(
    placed: DataFrame, values: list[str], totals: DataFrame | None, count: int, total: int, chars: float, max_blocks: int, limit: int
) -> Slots:
    most = min(max_blocks, max(LEAST_BLOCKS, BLOCKS_PER_ROW * count))
    width = max(1, -(-total // most))
    table = _table(placed, values, width, totals is not None)
    expected = (min(total, most) + count) * (int(chars) * 2 + 48)
    return Slots(table, totals, total, width, expected <= limit, tuple(values), placed=placed)


def _table(placed: DataFrame, values: list[str], width: int, grouped: bool) -> DataFrame:
    blocks = placed.withColumn(
        _BLOCK,
        F.explode(
            F.sequence(F.expr(f"{_LO} div {width}"), F.expr(f"(__slot_hi - 1) div {width}"))
        ),
    )
    if width == 1:
        table = blocks.select(_GROUP, _BLOCK, F.struct(*values).alias("__slot_value"))
    else:
        # At most `width` intervals touch a block, since every weight is at least one.
        piece = F.struct(F.col(_LO).alias("lo"), F.col("__slot_hi").alias("hi"), F.struct(*values).alias("v"))
        table = blocks.groupBy(_GROUP, _BLOCK).agg(F.collect_list(piece).alias(_PIECES))
    return table if grouped else table.drop(_GROUP)


def slots_in_order(counts: DataFrame, value: str, n: str, values: int, total: int) -> Slots:
    """Intervals as long as `n`, laid out in ascending order of the integers `value` in [0, values)."""
    shown = max(2, len(f"{max(values - 1, 1):x}"))
    order = F.lpad(F.hex(F.col(value)), shown, "0")
    placed = positions(counts, order, _LO, F.col(n), (), min(3, shown), values).select(
        value, F.lit(None).cast("string").alias(_GROUP), _LO, (F.col(_LO) + F.col(n)).alias("__slot_hi")
    )
    return _from_intervals(placed, [value], None, min(values, total), total, 8.0, MAX_BLOCKS, BROADCAST_BYTES)


def pick(
    df: DataFrame,
    slots: Slots,
    draw: Column,
    into: str,
    group: Column | None = None,
    position: bool = False,
    values: tuple[str, ...] | None = None,
    even: bool = False,
) -> DataFrame:
    """Add struct column `into` with the picked lookup values; null where the group is unknown.

    `draw` is a non-negative integer; with `position=True` it is the exact position in the intervals. `values` are those
    that are read afterwards, all by default. `even` says that every row has a draw of its own, so that a hot group is no
    hot block and few copies of a shuffled lookup do.
    """
    d = df
    slots = slots if values is None else slots.holding(values)
    own = None
    if not (slots.small and slots.few_groups):
        # The rows are shuffled: an integer is shorter than the digest that it is taken from.
        d, draw = d.withColumn("__pick_draw", draw), F.col("__pick_draw")
    if group is not None:
        totals = slots.totals.select(F.col(_GROUP).alias("__pick_total_group"), F.col(_TOTAL).alias("__pick_total"))
        # Tied to the draw: a constant group would be folded away and leave a join without a key.
        d = d.withColumn("__pick_group", F.when(draw >= 0, group.cast("string")))
        unknown = F.col("__pick_group").isNull()
        d = slots.join_totals(d, totals, F.col("__pick_group") == F.col("__pick_total_group"), unknown)
        total: Column = F.col("__pick_total")
    else:
        total = F.lit(slots.total if slots.total else None).cast("bigint")
    d = d.withColumn("__pick_at", draw if position else draw % total)
    d = d.withColumn("__pick_block", F.expr(f"__pick_at div {slots.width}"))
    table = slots.table.withColumnRenamed(_BLOCK, "__pick_table_block")
    condition = F.col("__pick_block") == F.col("__pick_table_block")
    if group is not None:
        table = table.withColumnRenamed(_GROUP, "__pick_table_group")
        condition = condition & (F.col("__pick_group") == F.col("__pick_table_group"))
    if even and not slots.small and not cuts_joins(d) and (group is None or slots.few_groups):
        if group is None:
            d, table = d.withColumn("__pick_total", total), table.withColumn("__pick_table_total", total)
        else:
            per_group = totals.toDF("__pick_copied_group", "__pick_table_total")
            table = table.join(F.broadcast(per_group), F.col("__pick_table_group") == F.col("__pick_copied_group"))
        own = slots.copies_for("__pick_total"), slots.copies_for("__pick_table_total")
    d = slots.join(d, table, condition, F.col("__pick_block").isNull(), own)
    if slots.width == 1:
        chosen = F.col("__slot_value")
    else:
        hit = F.filter(F.col(_PIECES), lambda p: (p["lo"] <= F.col("__pick_at")) & (F.col("__pick_at") < p["hi"]))
        chosen = F.try_element_at(hit, F.lit(1))["v"]
    return d.withColumn(into, chosen).drop(
        "__pick_draw", "__pick_group", "__pick_total_group", "__pick_total", "__pick_at", "__pick_block",
        "__pick_table_block", "__pick_table_group", "__pick_copied_group", "__pick_table_total", "__slot_value", _PIECES,
    )

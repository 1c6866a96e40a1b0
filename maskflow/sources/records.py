"""CSV records from lines, split-parallel, though cells in quotes may hold line breaks.

A line turns the state before it (outside quotes or inside) into the state after it. These functions are expressions.
Those of a split's lines are composed in order, for both states a split may begin in, with the pieces of records that
cross its ends; the results of a file's splits, composed in order, tell every split how it begins. Then all splits are
read at once. Only a record that crosses the end of a split leaves its task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskflow.session import BROADCAST_BYTES, materialise

# What a line does to the state, as f(outside) + 2 f(inside) with 1 for inside: always outside, swap, keep, always inside.
ALWAYS_OUT, SWAP, KEEP, ALWAYS_IN = 0, 1, 2, 3
ROW_BYTES = 64  # of a file or split in a broadcast table, about
SPLIT = ["file_key", "block"]
EXAMINED = "file_key long, block long, effect int, head binary, passed boolean, tail_out binary, tail_in binary, first_out boolean, first_in boolean"


def read_lines(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """(file, file_key, block, place, line): lines in the order of their split; lines end as Spark's text source has it."""
    lines = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path)
    file = F.col("_metadata.file_path")
    block = F.col("_metadata.file_block_start").alias("block")
    return lines.select(file.alias("file"), F.xxhash64(file).alias("file_key"), block, F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))


def _step(state: Column, before: Column, opens: Column) -> Column:
    """The state behind a quote, from that before it and the text since the last quote (0: outside, 1: inside, 2: just
    closed, 3: at the start of a line). A quote opens a cell at the start of a line and behind a separator (`opens`),
    closes it when inside, and opens it again right after that, which is an escaped quote; others are plain text."""
    return F.when(state == 1, 2).when((state >= 2) & (before == ""), 1).when(opens, 1).otherwise(0)


def line_effect(line: Column, opens: Callable[[Column], Column]) -> Column:
    """What a line does to the state; `opens` says whether a text ends with a separator."""
    pieces = F.split(line, '"', -1)
    before = F.slice(pieces, 1, F.size(pieces) - 1)

    def end(start: int) -> Column:
        return F.aggregate(before, F.lit(start), lambda s, p: _step(s, p, opens(p)))

    effect = F.when(end(3) == 1, 1).otherwise(0) + F.when(end(1) == 1, 2).otherwise(0)
    return F.when(line.contains('"'), effect).otherwise(KEEP)


def more_cells(record: Column, separator: Column, width: Column) -> Column:
    """Whether a record has more cells than `width`: at least as many separators outside quotes."""

    def count(text: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, separator, F.lit("")))

    def add(state: Column, p: Column) -> Column:
        more = F.when(state["s"] == 1, 0).otherwise(count(p))
        return F.struct(_step(state["s"], p, F.endswith(p, separator)).alias("s"), (state["n"] + more).alias("n"))

    outside = F.aggregate(F.split(record, '"', -1), F.struct(F.lit(3).alias("s"), F.lit(0).alias("n")), add)["n"]
    return F.when(count(record) < width, F.lit(False)).when(record.contains('"'), outside >= width).otherwise(F.lit(True))


def _readers() -> tuple[Callable, Callable]:
    """Two functions that tasks can run without having this package installed; rows come split by split, in order."""

    def after(effects, state):
        """The state after each line."""
        import numpy as np

        at = np.arange(len(effects))
        fixed = np.maximum.accumulate(np.where((effects == 0) | (effects == 3), at, -1))
        swaps = np.cumsum(effects == 1)
        known = np.where(fixed >= 0, effects[fixed] == 3, bool(state))
        return (known + swaps - np.where(fixed >= 0, swaps[fixed], 0)) % 2

    def spans(batch):
        import numpy as np

        key, block = (batch.column(i).to_numpy() for i in range(2))
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(key)]):
            if end > start:
                yield (int(key[start]), int(block[start])), batch.slice(start, end - start)

    class Track:
        """What a split holds if it begins in `state`: the piece of a record that reaches into it (`head`), whether no
        record ends in it (`passed`), and the record that is open (`held`)."""

        def __init__(self, state):
            self.state, self.head, self.passed, self.held, self.records = state, [], bool(state), [], 0

        def read(self, effects, lines):
            """Takes lines; gives where records begin among them and the state after the last one."""
            import numpy as np

            ends = after(effects, self.state)
            starts = np.flatnonzero(np.append(self.state, ends[:-1]) == 0)
            if self.passed:
                inside = starts[0] if len(starts) else len(lines)
                self.head += lines.slice(0, inside).to_pylist()
                self.passed = not len(starts) and bool(ends[-1])
            elif not len(starts):
                self.held += lines.to_pylist()
            if len(starts):
                self.held = lines.slice(starts[-1]).to_pylist()
            self.records += len(starts)
            self.state = int(ends[-1])
            return starts

        def tail(self):
            return b"\n".join(self.held) if self.state and self.held else None

    def examine(batches):
        import pyarrow as pa

        def found():
            out, inside = tracks
            values = [*split, out.state + 2 * inside.state, b"\n".join(inside.head), inside.passed, out.tail(), inside.tail(), out.records == 1, inside.records == 1]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_()]
            names = ["file_key", "block", "effect", "head", "passed", "tail_out", "tail_in", "first_out", "first_in"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        split, tracks = None, ()
        for batch in batches:
            for here, rows in spans(batch):
                if here != split:
                    if split is not None:
                        yield found()
                    split, tracks = here, (Track(0), Track(1))
                effects = rows.column(2).to_numpy()
                for track in tracks:
                    track.read(effects, rows.column(3))
        if split is not None:
            yield found()

    def assemble(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def out(texts):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), split[0], dtype=np.int64)), texts], names=["file_key", "record"])

        def closed(lines):
            """The record that is held, if it ends here and is not the first one of its file."""
            if lines and not (split[1] == 0 and seen == 1):
                yield out(pa.array([b"\n".join(lines)], pa.binary()))

        split, track, seen = None, None, 0
        for batch in batches:
            for here, rows in spans(batch):
                if here != split:
                    if split is not None and not track.state:
                        yield from closed(track.held)
                    split, track, seen = here, Track(int(rows.column(4)[0].as_py())), 0
                lines, held = rows.column(3), track.held
                starts = track.read(rows.column(2).to_numpy(), lines)
                if not len(starts):
                    continue
                yield from closed(held + lines.slice(0, starts[0]).to_pylist() if seen else [])
                if len(starts) > 1:
                    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), lines.slice(0, starts[-1])), b"\n")
                    yield out(whole.slice(1) if split[1] == 0 and seen == 0 else whole)
                seen += len(starts)
        if split is not None and not track.state:
            yield from closed(track.held)

    return examine, assemble


def _beside(rows: DataFrame, table: DataFrame, on: list[str], count: int) -> DataFrame:
    """`rows` with the columns of a table of `count` rows, in order within each split: beyond the size of a broadcast
    the join is a shuffle, after which the lines of a split are dealt and sorted again."""
    if count * ROW_BYTES <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), on)
    return rows.join(table, on).repartition(*SPLIT).sortWithinPartitions(*SPLIT, "place")


def _across(examined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How each split begins (file_key, block, inside), and the records that cross ends of splits (file_key, record)."""
    before = Window.partitionBy("file_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("effect").isin(ALWAYS_OUT, ALWAYS_IN)
    # The last split with a fixed end, and how often the state was swapped since.
    seen = examined.withColumn("swaps", F.coalesce(F.sum((F.col("effect") == SWAP).cast("long")).over(before), F.lit(0)))
    own = F.struct((F.col("effect") == ALWAYS_IN).cast("long").alias("end"), F.col("swaps").alias("swaps"))
    seen = seen.withColumn("last", F.last(F.when(fixed, own), True).over(before))
    inside = (F.coalesce("last.end", F.lit(0)) + F.col("swaps") - F.coalesce("last.swaps", F.lit(0))) % 2 == 1
    states = seen.withColumn("inside", inside)

    tail, first = F.when(F.col("inside"), F.col("tail_in")).otherwise(F.col("tail_out")), F.when(F.col("inside"), F.col("first_in")).otherwise(F.col("first_out"))
    header = (F.col("block") == 0) & first
    head = F.struct(F.lit(0).alias("turn"), F.when(F.col("inside"), F.col("head")).alias("text"), F.lit(False).alias("header"))
    ends = states.select("file_key", "block", F.explode(F.array(head, F.struct(F.lit(1).alias("turn"), tail.alias("text"), header.alias("header")))).alias("p"))
    order = Window.partitionBy("file_key").orderBy("block", "p.turn").rowsBetween(Window.unboundedPreceding, 0)
    pieces = ends.where("p.text is not null").withColumn("number", F.sum("p.turn").over(order))
    listed = pieces.groupBy("file_key", "number").agg(F.sort_array(F.collect_list(F.struct("block", "p.turn", "p.text"))).alias("parts"), F.max("p.header").alias("header"))
    joined = F.array_join(F.transform("parts", lambda p: p["text"].cast("string")), "\n").cast("binary")
    return states.select(*SPLIT, "inside"), listed.where("not header").select("file_key", joined.alias("record"))


def records(lines: DataFrame, facts: DataFrame, files: int, breaks: bool) -> DataFrame:
    """(file_key, record as bytes) of all records but each file's first one; blank lines are no records.

    `facts` has the file_key and separator of each of the `files`. Without `breaks` every line is a record. A record
    that is never closed ends with its file. A record is one cell of a column, so at most 2 GB.
    """
    examine, assemble = _readers()
    known = _beside(lines.select(*SPLIT, "place", "line"), facts.select("file_key", "separator"), ["file_key"], files)
    line = F.col("line").cast("binary").alias("line")
    if not breaks:
        shown = known.select(*SPLIT, F.lit(KEEP).alias("effect"), line, F.lit(0).alias("inside"))
        found = shown.mapInArrow(assemble, "file_key long, record binary")
    else:
        known = known.withColumn("effect", line_effect(F.col("line"), lambda p: F.endswith(p, F.col("separator"))))
        examined = materialise(known.select(*SPLIT, "effect", line).mapInArrow(examine, EXAMINED), "splits")
        states, crossing = _across(examined)
        shown = _beside(known, states, SPLIT, examined.count()).select(*SPLIT, "effect", line, F.col("inside").cast("int").alias("inside"))
        found = shown.mapInArrow(assemble, "file_key long, record binary").unionByName(crossing)
    return found.where(F.length(F.trim(F.col("record").cast("string"))) > 0)

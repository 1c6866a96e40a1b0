"""How the sources of a language diverge in their terms, by exact integer shares.

Arrow kernels count terms inside `mapInArrow`; the partial counts are merged by (lang, term), and only terms that occur
meet again. A pair of sources differs in terms of both, of one and of neither: what needs both shares is summed term by
term, the rest follows from how often each count occurs in a source.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskflow.llm.common import ship
from maskflow.session import materialise

ship(__name__)

BETWEEN_TERMS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 3
TOP = 200
PIECE_BYTES = 8 << 20  # text that is split at once; a longer text is a piece of its own
HELD_ROWS = 400_000  # partial counts held by a task before they are merged, and sent on if that leaves over half
SMALL_GROUPS = 100_000  # (lang, source) groups up to which their table is broadcast, about 10 MB
SALTS = 64


# Counting


def pieces(batch: pa.RecordBatch, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about `most` bytes of text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(upto):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def term_counts(piece: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of some documents, and an empty term without counts for each (lang, source)."""
    texts = pc.split_pattern_regex(pc.ascii_lower(piece["text"]), pattern=BETWEEN_TERMS)
    terms, docs = pc.list_flatten(texts), pc.list_parent_indices(texts)
    some = pc.not_equal(terms, "")
    coded = pc.dictionary_encode(terms.filter(some))
    by_doc = pa.table({"doc": docs.filter(some), "term": coded.indices}).group_by(["doc", "term"]).aggregate([([], "count_all")])
    table = pa.table(
        {
            "lang": piece["lang"].take(by_doc["doc"].combine_chunks()),
            "source": piece["source"].take(by_doc["doc"].combine_chunks()),
            "code": by_doc["term"],
            "n": by_doc["count_all"],
        }
    )
    counted = table.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    groups = pa.table({"lang": piece["lang"], "source": piece["source"]}).group_by(["lang", "source"]).aggregate([])
    none = pa.array(np.zeros(len(groups), dtype=np.int64))
    return pa.concat_tables(
        [
            pa.table({"lang": counted["lang"], "source": counted["source"], "term": coded.dictionary.take(counted["code"].combine_chunks()), "n": counted["n_sum"], "docs": counted["count_all"]}),
            pa.table({"lang": groups["lang"], "source": groups["source"], "term": pa.array([""] * len(groups)), "n": none, "docs": none}),
        ]
    )


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's documents, merged so far as HELD_ROWS allows."""

    def merged() -> pa.Table:
        sums = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return pa.table({"lang": sums["lang"], "source": sums["source"], "term": sums["term"], "n": sums["n_sum"], "docs": sums["docs_sum"]})

    held: list[pa.Table] = []
    for batch in batches:
        for piece in pieces(batch):
            held.append(term_counts(piece))
            if sum(map(len, held)) > HELD_ROWS:
                held = [merged()]
                if 2 * len(held[0]) > HELD_ROWS:
                    yield from held[0].to_batches()
                    held = []
    if held:
        yield from merged().to_batches()


# Shares


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total), by long division of three digits a step; no total gives null."""
    rest, digits = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        digits = digits * 1000 + F.floor(_div(rest, total))
        rest = rest % F.nullif(total, F.lit(0))
    return digits + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)"""
    return _div((p - q) * (p - q), q)


# Pairs


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_sums(term: np.ndarray, group: np.ndarray, p: np.ndarray, none: np.ndarray) -> dict[tuple[int, int], int]:
    """For each pair of groups, summed over the terms of both: how much f differs from f with the share of an absent
    term in place of one, and of the other, share; `none` is that share. Rows of a term are neighbours."""
    sums: dict[tuple[int, int], int] = defaultdict(int)
    at, step = np.arange(len(term)), 1
    while len(at := at[at < len(term) - step]) and len(at := at[term[at] == term[at + step]]):
        for a, b in ((at, at + step), (at + step, at)):
            f = _apart(p[a], p[b]) - _apart(p[a], none[b]) - _apart(none[a], p[b]) + _apart(none[a], none[b])
            pairs, where = np.unique(group[a] * (1 << 31) + group[b], return_inverse=True)
            total = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(total, where, f)
            for pair, value in zip(pairs.tolist(), total.tolist(), strict=True):
                sums[pair >> 31, pair & 0x7FFFFFFF] += value
        step += 1
    return sums


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's terms; rows come by lang and term, and what ends a batch waits for the next one."""
    sums: dict[tuple[str, str, str], int] = defaultdict(int)

    def add(table: pa.Table) -> None:
        langs, terms, sources = (table[c].combine_chunks().dictionary_encode() for c in ("lang", "term", "source"))
        lang = langs.indices.to_numpy().astype(np.int64)
        keys, group = np.unique(lang * (1 << 31) + sources.indices.to_numpy(), return_inverse=True)
        names = [(langs.dictionary[k >> 31].as_py(), sources.dictionary[k & 0x7FFFFFFF].as_py()) for k in keys.tolist()]
        term = lang * (1 << 31) + terms.indices.to_numpy()
        for (a, b), value in pair_sums(term, group.astype(np.int64), table["p"].to_numpy(), table["none"].to_numpy()).items():
            sums[names[a][0], names[a][1], names[b][1]] += value

    def whole_terms(rows: pa.Table) -> int:
        """Rows before those of the last (lang, term)."""
        last = pc.and_(pc.equal(rows["term"], rows["term"][-1]), pc.equal(rows["lang"], rows["lang"][-1]))
        return len(rows) - int(pc.sum(last).as_py())

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(map(len, waiting)) >= 100_000:
            rows = pa.Table.from_batches(waiting)
            whole = whole_terms(rows)
            if whole:
                add(rows.slice(0, whole))
            waiting = rows.slice(whole).combine_chunks().to_batches()
    rows = pa.Table.from_batches(waiting) if waiting else None
    if rows is not None and len(rows):
        add(rows)
    if sums:
        lang, source, item = (pa.array([k[i] for k in sums], pa.string()) for i in range(3))
        yield pa.RecordBatch.from_arrays([lang, source, item, pa.array(list(sums.values()), pa.int64())], names=["lang", "source", "item", "value"])


def with_groups(rows: DataFrame, groups: DataFrame, on: list[str], small: bool) -> DataFrame:
    """`rows` joined with the groups: broadcast if they are few, else dealt over salts, as one group may own most rows."""
    if small:
        return rows.join(F.broadcast(groups), on)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"]).drop("_salt")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of every source, as parts `pair` and `term`.

    Terms are runs of letters A to Z and of characters beyond ASCII, A to Z lower-cased; a lang keeps those in at least
    `least_docs` of its documents. A group's share of a kept term is p = 1 + floor(10^9 (count + 1) / (N + V)), and
    f = floor((p - q)^2 / q). `pair` gives f of p and the other source's share, summed over the lang's V kept terms,
    for every other source; `term` the `top` kept terms that the source has and that its p exceeds the lang's q in.
    Null text, lang and source are empty texts. Repeated rows are documents of their own; other columns are ignored;
    an empty table gives no rows. Ties rank by the item's bytes. Whole texts count, however long.
    """
    counted = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = counted.mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    # One exchange serves the sums by source and the windows by term.
    by_term = Window.partitionBy("lang", "term")
    counts = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = counts.select(
        "lang", "term", "source", "n", F.sum("n").over(by_term).alias("lang_n"), F.sum("docs").over(by_term).alias("docs"),
        (F.min("source").over(by_term) == F.col("source")).alias("first"),
    )
    counts = materialise(counts.where((F.col("docs") >= least_docs) | (F.col("term") == "")), "term-counts")
    real = counts.where("term <> ''")

    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("term") != "").alias("had"), F.count_if((F.col("term") != "") & F.col("first")).alias("firsts"))
    langs = groups.groupBy("lang").agg(F.sum("firsts").alias("terms"), F.sum("total").alias("lang_total"))
    groups = materialise(groups.drop("firsts").join(langs, "lang").withColumn("none", share(F.lit(0), F.col("total") + F.col("terms"))), "term-groups")
    small = groups.count() <= SMALL_GROUPS
    shares = with_groups(real, groups, ["lang", "source"], small).withColumn("p", share(F.col("n"), F.col("total") + F.col("terms")))

    # Terms: the best of each salt first, so that no task ranks all terms of a large source.
    q = share(F.col("lang_n"), F.col("lang_total") + F.col("terms"))
    raised = shares.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    raised = raised.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    for keys in (["lang", "source", "part", "salt"], ["lang", "source", "part"]):
        raised = raised.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)

    # Pairs: f of an absent term for all V, then what differs for the terms of one source, then for those of both.
    other = groups.select("lang", F.col("source").alias("item"), F.col("had").alias("item_had"), F.col("none").alias("item_none"))
    pairs = with_groups(groups, other, ["lang"], small).where("source <> item")
    absent = pairs.select("lang", "source", "item", (apart(F.col("none"), F.col("item_none")) * (F.col("terms") - F.col("had") - F.col("item_had"))).alias("value"))
    often = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("often"))
    one = with_groups(often, other, ["lang"], small).where("source <> item")
    has = one.select("lang", "source", "item", (F.col("often") * apart(F.col("p"), F.col("item_none"))).alias("value"))
    lacks = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("often") * apart(F.col("item_none"), F.col("p"))).alias("value"))
    met = shares.select("lang", "term", "source", "p", "none").repartition("lang", "term").sortWithinPartitions("lang", "term")
    both = met.mapInArrow(_pairs, "lang string, source string, item string, value long")
    summed = absent.unionByName(has).unionByName(lacks).unionByName(both).groupBy("lang", "source", "item").agg(F.coalesce(F.sum(F.col("value").cast("decimal(20,0)")), F.lit(0)).cast("long").alias("value"))
    ranked = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    )
    return ranked.unionByName(raised.drop("salt"))

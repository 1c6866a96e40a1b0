"""Secret scans: plain patterns, and weak candidates that count only beside a complementary part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.functions.running import once, placed, running

# The three plain patterns, the group whose length counts, and the least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # runs are taken whole, so that shorter ones need not be listed
)
# Weak candidates: the role of the part, and a pattern that looks at each run of characters once and takes it whole:
# possessive, so that a run of any length is read in linear time and leaves no tail.
# A text without the literal of a kind cannot match it; finding that out is much cheaper than the pattern.
LITERAL = {"access": "AKIA", "user": "@", "endpoint": "://"}
WEAK = (
    ("user", "id", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("login", "id", r"""(?i)\b(?:user|username|user_?id|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}+"""),
    ("pass", "secret", r"""(?i)\b(?:pass|pwd|pw|passphrase|auth|bearer|credential)["']?\x20*[:=]\x20*["']?[^\s"']{4,}+"""),
    ("opaque", "secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"),
    ("endpoint", "endpoint", r"""(?i)\b(?:https?|ftp|jdbc:[a-z]{2,16}|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{3,}+"""),
    ("host", "endpoint", r"""(?i)\b(?:host|hostname|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}+"""),
)
KINDS = [b[0] for b in BASE] + [w[0] for w in WEAK]
ROLES = {"assign": "secret", "access": "id", "hex": "secret"} | {w[0]: w[1] for w in WEAK}
BREAK = r"\n[ \t\r]*\n"  # an empty line ends a scope
BIN = 4096  # code points of a bin, by which parts meet their scope, and of the pieces that a text is cut from
FAR = (1 << 31) - 1
SPAN = "array<struct<start:int,kind:int,end:int>>"


def holds(text: Column, kind: str, pattern: str) -> Column:
    return text.contains(LITERAL[kind]) & text.rlike(pattern) if kind in LITERAL else text.rlike(pattern)


def matches(text: Column, kind: str, pattern: str, group: int = 0, least: int = 1) -> Column:
    """Spans (start, kind, end) of all matches, in code points."""

    def span(part: Column) -> Column:
        start = part["at"] + F.length(part["before"])
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(part["whole"])).alias("end"))

    kept = F.filter(placed(text, pattern, group), lambda p: p["whole"].isNotNull() & (F.length(p["counted"]) >= least))
    return F.when(holds(text, kind, pattern), F.transform(kept, span)).otherwise(F.array().cast(SPAN))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `base`: the spans of the plain patterns by start, then kind; null texts count as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumns({f"_{kind}": matches(whole, kind, pattern, group, least) for kind, pattern, group, least in BASE})
    listed = F.array_sort(F.concat(*[F.col(f"_{b[0]}") for b in BASE]))
    return found.withColumn("base", listed).drop(*[f"_{b[0]}" for b in BASE])


def _holds(text: Column, role: str) -> Column:
    tests = [holds(text, kind, pattern) for kind, of, pattern in WEAK if of == role]
    return tests[0] | tests[1]


def _of(spans: str, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin([KINDS.index(k) for k in kinds]))


def free_spans(spans: Column) -> Column:
    """The weak ones of `spans` that no plain one overlaps, by one sweep in each direction over the sorted spans."""

    def sweep(listed: Column) -> Column:
        def plain(s: Column) -> Column:
            return s["kind"] < len(BASE)

        ends = running(F.transform(listed, lambda s: F.when(plain(s), s["end"]).otherwise(-1)), F.greatest, F.lit(-1))
        starts = F.transform(F.reverse(listed), lambda s: F.when(plain(s), s["start"]).otherwise(FAR))
        after = F.reverse(running(starts, F.least, F.lit(FAR)))
        both = F.arrays_zip(listed.alias("span"), ends.alias("before"), after.alias("after"))
        clear = F.filter(both, lambda x: ~plain(x["span"]) & (x["before"] <= x["span"]["start"]) & (x["after"] >= x["span"]["end"]))
        return F.transform(clear, lambda x: x["span"])

    return once(F.array_sort(spans), sweep)


def linked_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Weak spans per `key` of `docs` (columns key, base and the text) that have their complement in the same scope.

    Scopes end at empty lines, which no part holds. Scopes and parts are intervals of a text: a part is joined to the
    scope that holds its start, by bins of `BIN` code points. An identifier or endpoint counts beside a secret, a
    secret beside an identifier or endpoint anywhere in the scope: each scope's parts are gathered once, without pairs.
    """
    column = F.col(text)
    found = docs.withColumns({f"_{kind}": matches(column, kind, pattern) for kind, _, pattern in WEAK})
    found = found.withColumn("free", free_spans(F.concat("base", *[F.col(f"_{w[0]}") for w in WEAK])))
    parts = found.select("key", F.explode(F.concat("base", "free")).alias("span"))
    parts = parts.withColumn("bin", F.floor(F.col("span.start") / BIN))
    scopes = docs.select("key", F.explode(placed(column, BREAK)).alias("s"))
    scopes = scopes.select("key", F.col("s.at").alias("from"), (F.col("s.at") + F.length("s.before")).alias("to")).where("from < to")
    scopes = scopes.withColumn("bin", F.explode(F.sequence(F.floor(F.col("from") / BIN), F.floor((F.col("to") - 1) / BIN))))
    held = parts.join(scopes, ["key", "bin"]).where((F.col("span.start") >= F.col("from")) & (F.col("span.start") < F.col("to")))
    secret = F.col("span.kind").isin([KINDS.index(k) for k in KINDS if ROLES[k] == "secret"])
    weak = F.when(F.col("span.kind") >= len(BASE), F.col("span"))
    groups = held.groupBy("key", "from").agg(
        F.bool_or(secret).alias("secret"), F.bool_or(~secret).alias("other"), F.collect_list(weak).alias("weak")
    )
    linked = groups.where("secret and other and size(weak) > 0")
    return linked.groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("weak"))).alias("linked"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `base` and `spans` (base and linked weak spans), arrays of (start, kind, end), ends exclusive.

    Rows need no id: documents that can hold a pair are known by a digest of their text, so that repeated rows, null
    ids and clashing ids all get the spans of their own text. Null texts count as empty.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    marked = base_spans(docs, text)
    has = {r: F.size(_of("base", [b[0] for b in BASE if ROLES[b[0]] == r])) > 0 for r in ("id", "secret")}
    open_ = (has["secret"] | _holds(whole, "secret")) & (has["id"] | _holds(whole, "id") | _holds(whole, "endpoint"))
    # Others never meet a key; a number of their own spreads them over the partitions of the join.
    key = F.when(open_, F.sha2(whole, 256)).otherwise(F.monotonically_increasing_id().cast("string"))
    marked = marked.withColumns({"key": key, "_open": open_})
    asked = marked.where("_open").select("key", "base", whole.alias("body")).groupBy("key").agg(F.first("base").alias("base"), F.first("body").alias("body"))
    linked = linked_spans(asked, "body")
    joined = marked.join(linked, "key", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(SPAN))))
    return joined.withColumn("spans", spans).drop("key", "_open", "linked")


def shown(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the plain kinds, base_sha256 and spans of every row."""
    found = scan(docs.select("doc_id", "text"))
    counts = [F.size(_of("base", [b[0]])).cast("long").alias(f"n_{b[0]}") for b in BASE]
    return found.select("doc_id", *counts, F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))


def masked(text: Column, spans: Column, mark: str) -> Column:
    """The text with `mark` for each run of overlapping spans, which are sorted by start; cut from pieces of `BIN` code points."""

    def rebuilt(pieces: Column) -> Column:
        def between(start: Column, end: Column) -> Column:
            first = F.floor(start / BIN).cast("int")
            held = F.slice(pieces, first + 1, F.greatest(F.ceil(end / BIN).cast("int") - first, F.lit(0)))
            return once(F.array_join(held, ""), lambda t: F.substr(t, start - first * BIN + 1, end - start))

        # Where a span begins before the end of an earlier one, there is nothing between them and no mark of its own.
        reached = running(F.transform(spans, lambda s: s["end"]), F.greatest, F.lit(0))
        parts = F.zip_with(
            spans, reached, lambda s, at: F.when(s["start"] >= at, F.concat(between(at, s["start"]), F.lit(mark))).otherwise("")
        )
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), once(last, lambda at: between(at, F.greatest(at, F.length(text)))))

    return once(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BIN}}}"), F.lit(0)), rebuilt)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span of `scan` replaced by `mark`; overlapping spans become one mark. Null texts stay null."""
    column = F.col(text)
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text))  # no name can clash
    found = scan(kept, text).withColumn(text, F.when(F.size("spans") > 0, masked(column, F.col("spans"), mark)).otherwise(column))
    return found.select(*[column if c == text else F.col("_row")[c].alias(c) for c in docs.columns])


def length_of(text: str, kind) -> Column:
    """Code points of a text, as the type of the column that holds them; null texts stay null."""
    return F.length(F.col(text)).cast(kind)

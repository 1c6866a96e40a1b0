"""Document fingerprints: a homomorphic multiset hash, the sum of wide vectors hashed from paragraphs modulo powers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT = 8  # lanes of 32 bits from the SHA-256 of whole paragraphs: equality
LOOSE = 32  # longs of two 32-bit lanes that count hash bits of a paragraph's pieces: likeness
PAIR = 0x0000000100000001
POWER = 1 << 32
# A piece is up to eight words of one line, counted from its start.
PIECE = r"[^\x20\x09-\x0D]+(?:[\x20\x09]+[^\x20\x09-\x0D]+){0,7}"
MOST_BUCKETS = 4096
BUCKET_ROWS = 8192


def vector(text: Column) -> Column:
    """(e0..e7, l0..l31): the sum over the lines of a text of vectors hashed from each; sums need no order.

    e: the eight 32-bit words of the line's SHA-256, modulo 2^32. l: for every piece of the line the bits of its XXH64,
    two lanes in each long; fewer than 2^31 pieces cannot overflow a lane.
    """
    lines = F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p, 256))

    def add_line(state: Column, digest: Column) -> Column:
        words = [F.conv(F.substr(digest, F.lit(1 + 8 * k), F.lit(8)), 16, 10).cast("long") for k in range(EXACT)]
        return F.struct(*[((state[f"e{k}"] + words[k]) % POWER).alias(f"e{k}") for k in range(EXACT)])

    def add_piece(state: Column, h: Column) -> Column:
        lanes = [F.shiftrightunsigned(h, k).bitwiseAND(F.lit(PAIR)) for k in range(LOOSE)]
        return F.struct(*[(state[f"l{k}"] + lanes[k]).alias(f"l{k}") for k in range(LOOSE)])

    zero = F.lit(0).cast("long")
    exact = F.aggregate(lines, F.struct(*[zero.alias(f"e{k}") for k in range(EXACT)]), add_line)
    pieces = F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p))
    loose = F.aggregate(pieces, F.struct(*[zero.alias(f"l{k}") for k in range(LOOSE)]), add_piece)
    return F.struct(exact.alias("exact"), loose.alias("loose"), F.size(pieces).alias("pieces"))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of the lines of both (sign 1), or of those of `a` without those of `b` (sign -1)."""
    exact = [F.pmod(a["exact"][f"e{k}"] + sign * b["exact"][f"e{k}"], F.lit(POWER)).alias(f"e{k}") for k in range(EXACT)]
    loose = [(a["loose"][f"l{k}"] + sign * b["loose"][f"l{k}"]).alias(f"l{k}") for k in range(LOOSE)]
    return F.struct(F.struct(*exact).alias("exact"), F.struct(*loose).alias("loose"), (a["pieces"] + sign * b["pieces"]).alias("pieces"))


def shown(v: Column) -> Column:
    """A vector as hexadecimal digits."""
    exact = [F.lpad(F.hex(v["exact"][f"e{k}"]), 8, "0") for k in range(EXACT)]
    loose = [F.lpad(F.hex(v["loose"][f"l{k}"]), 16, "0") for k in range(LOOSE)]
    return F.lower(F.concat(*exact, *loose))


def _lanes(v: Column) -> Column:
    """Ones less zeros of each of the 64 loose lanes."""
    halves = []
    for k in range(LOOSE):
        halves += [F.shiftrightunsigned(v["loose"][f"l{k}"], 32), v["loose"][f"l{k}"].bitwiseAND(F.lit(POWER - 1))]
    return F.transform(F.array(*halves), lambda c: (2 * c - v["pieces"]).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: str, b: str) -> Column:
    """Cosine of two vectors' loose lanes, 0 at least: about the share of pieces in common. Equal vectors give 1."""
    x, y = _lanes(F.col(a)), _lanes(F.col(b))
    size = F.sqrt(_dot(x, x) * _dot(y, y))
    cosine = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(x, y) / F.nullif(size, F.lit(0.0))))
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(F.coalesce(cosine, F.lit(0.0)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, v (its vector), next_text and w (its vector): the next in falling order of integer doc_id.

    After the last document comes the first.

    Null ids come last; rows that agree in their id follow each other by a hash of the text. The text is shuffled once,
    by buckets of the id between cut points; the first row of each bucket is also sent to the one before.
    """
    tie = F.xxhash64("text")
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", tie)
    keyed = keyed.withColumn("place", F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit((1 << 63) - 1)))
    rows = docs.select("doc_id").where("doc_id is not null").count()
    buckets = max(1, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))
    shares = [k / buckets for k in range(1, buckets)]
    cuts = []
    if shares:
        found = docs.agg(F.percentile_approx(F.bitwise_not(F.col("doc_id").cast("long")), shares, 10 * buckets)).first()[0]
        cuts = sorted(set(found))
    steps = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    at = F.when(F.col("doc_id").isNull(), len(cuts) + 1 + F.shiftrightunsigned("tie", 56)).otherwise(
        F.size(F.filter(steps, lambda c: c < F.col("place"))).cast("long")
    )
    keyed = keyed.withColumn("bucket", at)
    heads = keyed.groupBy("bucket").agg(F.min(F.struct("place", "tie")).alias("head"))
    # As many rows as buckets.
    listed = sorted((r.bucket, r.head.place, r.head.tie) for r in heads.collect())
    if not listed:
        return keyed.select("doc_id", "text", vector(F.col("text")).alias("v"), "text", vector(F.col("text")).alias("w")).toDF(
            "doc_id", "text", "v", "next_text", "w"
        )
    before = [listed[k - 1][0] for k in range(len(listed))]
    guests = docs.sparkSession.createDataFrame(
        [(place, tie_, to) for (_, place, tie_), to in zip(listed, before, strict=True)], "place long, tie long, to long"
    )
    guests = keyed.join(F.broadcast(guests), ["place", "tie"]).dropDuplicates(["place", "tie"])
    guests = guests.select("doc_id", "text", "tie", "place", F.col("to").alias("bucket"), F.lit(True).alias("guest"))
    both = keyed.select("doc_id", "text", "tie", "place", "bucket", F.lit(False).alias("guest")).unionByName(guests)
    order = Window.partitionBy("bucket").orderBy("guest", "place", "tie")
    both = both.withColumn("v", vector(F.col("text")))
    following = both.withColumns({"next_text": F.lead("text").over(order), "w": F.lead("v").over(order)})
    return following.where("not guest").select("doc_id", "text", "v", "next_text", "w")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: its fingerprint, that of its edited text, and how alike they and the next document's are.

    The edited text ends in the start of the next document in place of the last half. Null texts count as empty;
    empty texts have the fingerprint of one empty line. Repeated rows give repeated rows, an empty table none.
    """
    paired = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next_text", F.lit(1), half))
    paired = paired.withColumn("edited", edited)
    paired = paired.withColumn("u", vector(F.col("edited")))
    return paired.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("v")).alias("fingerprint"),
        shown(F.col("u")).alias("edited_fingerprint"),
        likeness("v", "u").alias("near_edited"),
        likeness("v", "w").alias("near_next"),
    )

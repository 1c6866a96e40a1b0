"""Files written from the test tables to the shared folder and read back, and masks on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskflow.checks.base import KEY, digest, draw, register, social_security, table
from maskflow.checks.mask_checks import LAST_SLOTS
from maskflow.checks.profile_checks import messy
from maskflow.checks.tables import ADDRESSES, PEOPLE_SQL, PLACES_SQL, POSTCODES, people
from maskflow.plans.suggest import suggest_config
from maskflow.session import scratch_path
from maskflow.sources.files import (
    SAMPLE_CHARACTERS,
    decode_text,
    encoding_of,
    file_facts,
    read_csv,
    read_delimited_documents,
    read_text_documents,
    separator_of,
)
from maskflow.sources.lookups import LAST_NAME_SCHEMA, Lookups, drop_rest, read_lookup, read_postcodes
from maskflow.sources.sinks import read_config, write_config, write_table
from maskflow.streaming.stream import mask_stream

PEOPLE_COLUMNS = ["id", "vorname", "nachname", "telefon", "email", "plz"]


def write_people(spark: SparkSession, sf_dir: str) -> str:
    """People in two folders: one `;` separated in latin-1, one comma separated in UTF-8 with other column order."""
    root = scratch_path(spark, "people")
    df = people(spark, sf_dir).select(*PEOPLE_COLUMNS)
    odd, even = df.filter("id % 2 = 1"), df.filter("id % 2 = 0").select(*reversed(PEOPLE_COLUMNS))
    write_table(odd, f"{root}/a", {"format": "csv", "separator": ";", "encoding": "ISO-8859-1"})
    write_table(even, f"{root}/b", {"format": "csv", "separator": ",", "encoding": "UTF-8"})
    return f"{root}/*/*.csv"


@register(
    "source_csv",
    f"""
SELECT cast(id AS varchar) AS id, nullif(vorname, '') AS vorname, nullif(nachname, '') AS nachname, nullif(telefon, '') AS telefon, email, plz
FROM ({PEOPLE_SQL})
""",
)
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_csv(spark, write_people(spark, sf_dir)).select(*PEOPLE_COLUMNS)


@register(
    "source_csv_multiline",
    """
SELECT cast(doc_id AS varchar) AS doc_id, nullif('"' || text || chr(10) || '; , ' || lang, '') AS text, nullif(lang, '') AS lang FROM documents
""",
)
def source_csv_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with quotes, separators and a line break in each, written as CSV and read back cell by cell."""
    path = scratch_path(spark, "letters")
    text = "'\"' || text || '\\n; , ' || lang AS text"
    write_table(table(spark, sf_dir, "documents", ["doc_id", text, "lang"]), path, {"separator": ","})
    return read_csv(spark, f"{path}/*.csv", keep_missing_texts=True)


@register(
    "source_csv_one_file",
    """
SELECT cast(doc_id AS varchar) AS doc_id, '5" ' || source AS source, replace(text, chr(10), '"' || chr(10) || ' ' || chr(10)) || chr(10) AS text FROM documents WHERE text IS NOT NULL
""",
)
def source_csv_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts in one file that is read in splits: lines of one blank, quotes before line breaks, plain quotes in other cells."""
    path = scratch_path(spark, "one-file")
    text = "replace(replace(text, '\"', '\"\"'), '\n', '\"\"\n \n')"
    records = table(spark, sf_dir, "documents", [f"concat(doc_id, ',5\" ', source, ',\"', {text}, '\n\"') AS record"]).where("record IS NOT NULL")
    write_lines(lines_of_one_file(records, "doc_id,source,text"), path, header=True)
    return read_csv(spark, f"{path}/*.csv", keep_missing_texts=True)


def lines_of_one_file(records: DataFrame, header: str) -> DataFrame:
    """The lines of all records, in one partition and named by the header line. Those of a record follow one another as
    they are cut, so that the one task reads its rows as they come and sorts nothing."""
    return records.coalesce(1).select(F.explode(F.split("record", "\n", -1)).alias(header))


def write_lines(df: DataFrame, path: str, *folders: str, encoding: str = "UTF-8", header: bool = False) -> None:
    """The column of lines, which hold no line break, as it is in CSV files; its name may be the first line of each."""
    plain = {"header": header, "encoding": encoding, "emptyValue": "", "sep": "\u0001", "quote": "\u0000", "escape": "\u0000", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.partitionBy(*folders).options(**plain).csv(path)


MIXED = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey"]
LAYOUT = "c_custkey % 60"


@register(
    "source_csv_mixed",
    f"""
SELECT cast(c_custkey AS varchar) AS c_custkey, c_name || ';,' || chr(9) AS c_name, CASE WHEN {LAYOUT} % 4 <> 0 THEN cast(round(c_acctbal * 100) AS bigint)::varchar END AS c_acctbal,
  c_mktsegment, cast(c_nationkey AS varchar) AS c_nationkey FROM customer
""",
)
def source_csv_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty layouts in one folder: columns turned about, one left out in some, three separators."""
    path = scratch_path(spark, "mixed")
    cells = "c_custkey, c_name || ';,\t' AS c_name, cast(round(c_acctbal * 100) AS bigint) AS c_acctbal, c_mktsegment, c_nationkey"
    df = table(spark, sf_dir, "customer").selectExpr(*cells.split(", "), f"{LAYOUT} AS layout")
    separator = F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("\t")), (F.col("layout") % 3 + 1).cast("int"))

    def line(values: list) -> Column:
        kept = F.filter(F.array(*values), lambda v: (F.col("layout") % 4 != 0) | ~v.startswith("acctbal:"))
        turn = (F.col("layout") % F.size(kept)).cast("int")
        turned = F.concat(F.slice(kept, turn + 1, F.size(kept)), F.slice(kept, 1, turn))
        return F.call_function("array_join", F.transform(turned, lambda v: F.regexp_replace(v, "^acctbal:", "")), separator)

    named = [F.lit("acctbal:" * (c == "c_acctbal") + c) for c in MIXED]
    quoted = [F.concat(F.lit("acctbal:" if c == "c_acctbal" else ""), F.lit('"' if c == "c_name" else ""), F.col(c).cast("string"), F.lit('"' if c == "c_name" else "")) for c in MIXED]
    headers = df.select("layout").distinct().select("layout", F.lit(-1).alias("c_custkey"), line(named).alias("line"))
    lines = headers.unionByName(df.select("layout", "c_custkey", line(quoted).alias("line")))
    write_lines(lines.repartition("layout").sortWithinPartitions("layout", "c_custkey").drop("c_custkey"), path, "layout")
    return read_csv(spark, f"{path}/*/*.csv").select(*MIXED)


WIDE_COLUMNS = [f"{i:02d}_" + "a measurement of the part in its long form " * 60 + "end" for i in range(30)]


@register(
    "source_csv_wide",
    "SELECT cast(p_partkey AS varchar) AS p_partkey, nullif(p_name, '') AS p_name, nullif(p_brand, '') AS p_brand, 30 AS filled FROM part",
)
def source_csv_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose headers agree for more than 64 KiB and then list the same columns in another order."""
    root = scratch_path(spark, "wide")
    df = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand"])
    filler = [F.lit("1").alias(c) for c in WIDE_COLUMNS]
    for rest, order in ((0, ["p_partkey", "p_name", "p_brand"]), (1, ["p_brand", "p_partkey", "p_name"])):
        write_table(df.where(F.col("p_partkey") % 2 == rest).select(*filler, *order), f"{root}/{rest}", {"separator": ","})
    filled = F.length(F.concat(*[F.coalesce(F.col(c), F.lit("")) for c in WIDE_COLUMNS]))
    return read_csv(spark, f"{root}/*/*.csv").select("p_partkey", "p_name", "p_brand", filled.alias("filled"))


@register(
    "file_facts",
    """
SELECT DISTINCT '.csv' AS extension, CASE WHEN c_custkey % 2 = 1 THEN 'latin-1' ELSE 'utf-8' END AS encoding,
  CASE WHEN c_custkey % 2 = 1 THEN ';' ELSE ',' END AS separator_name,
  CASE WHEN c_custkey % 2 = 1 THEN 'id;vorname;nachname;telefon;email;plz' ELSE 'plz,email,telefon,nachname,vorname,id' END AS header FROM customer
""",
)
def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = file_facts(spark, write_people(spark, sf_dir))
    return found.select("extension", "encoding", "separator_name", "header").distinct()


SAMPLE = f"substr(text, 1, {SAMPLE_CHARACTERS})"


def count_sql(character: str) -> str:
    return f"(length({SAMPLE}) - length(replace({SAMPLE}, {character}, '')))"


@register(
    "sniff_separator",
    f"""
WITH c AS (SELECT doc_id, {count_sql("','")} AS c, {count_sql("';'")} AS s, {count_sql("chr(9)")} AS t FROM
  (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, ' ', ';') WHEN doc_id % 3 = 1 THEN replace(text, ' ', chr(9)) ELSE text END AS text FROM documents))
SELECT doc_id, CASE WHEN greatest(c, s, t) = 0 OR c = greatest(c, s, t) THEN ',' WHEN s = greatest(c, s, t) THEN ';' ELSE chr(9) END AS separator FROM c
""",
)
def sniff_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "CASE WHEN doc_id % 3 = 0 THEN replace(text, ' ', ';') WHEN doc_id % 3 = 1 THEN replace(text, ' ', '\t') ELSE text END AS text"
    df = table(spark, sf_dir, "documents", ["doc_id", text])
    return df.select("doc_id", separator_of(F.col("text")).alias("separator"))


@register(
    "sniff_encoding",
    f"""
SELECT id, CASE WHEN id % 2 = 1 AND vorname LIKE '%ë%' THEN 'latin-1' WHEN vorname IS NULL THEN NULL ELSE 'utf-8' END AS encoding, vorname AS text FROM ({PEOPLE_SQL})
""",
)
def sniff_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("id") % 2 == 1, F.encode("vorname", "ISO-8859-1")).otherwise(F.encode("vorname", "UTF-8"))
    df = people(spark, sf_dir).withColumn("content", content)
    encoding = F.when(F.col("content").isNotNull(), encoding_of(F.col("content")))
    return df.select("id", encoding.alias("encoding"), decode_text(F.col("content")).alias("text"))


@register(
    "source_lookup",
    "SELECT p_name AS nachname, cast(count(*) AS integer) AS anzahl FROM part WHERE p_partkey % 10 <> 0 GROUP BY p_name",
)
def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name statistic as `;` CSV; its row for all other names is dropped."""
    path = scratch_path(spark, "names") + ".csv"
    df = table(spark, sf_dir, "part", ["CASE WHEN p_partkey % 10 = 0 THEN 'Übrige' ELSE p_name END AS nachname"])
    write_table(df.groupBy("nachname").agg(F.count("*").cast("int").alias("anzahl")), path, {"separator": ";"})
    return drop_rest(read_lookup(spark, path, LAST_NAME_SCHEMA), "nachname")


NAMES_AND_STREETS = """
WITH n AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'Übrige' ELSE p_name END AS name, cast(count(*) AS integer) AS anzahl FROM part GROUP BY 1)
"""


@register(
    "source_lookup_cached",
    f"""{NAMES_AND_STREETS}
SELECT way, name, '' AS place, anzahl FROM n, (VALUES ('made'), ('kept'), ('parquet')) w(way) WHERE name <> 'Übrige'
UNION ALL SELECT 'addresses', p_name, cast(1000 + p_partkey % 23 AS varchar) || ' ' || p_brand, p_size FROM part
""",
)
def source_lookup_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups from CSV, made and then kept; from parquet with a row for each bearer; first names are absent."""
    root = scratch_path(spark, "lookups")
    bearers = table(spark, sf_dir, "part", ["CASE WHEN p_partkey % 10 = 0 THEN 'Übrige' ELSE p_name END AS nachname"])
    write_table(bearers.groupBy("nachname").agg(F.count("*").alias("anzahl")), f"{root}/csv/last_names.csv", {"separator": ";"})
    write_table(table(spark, sf_dir, "part", ADDRESSES), f"{root}/csv/addresses.csv", {"separator": ";"})
    bearers.write.parquet(f"{root}/parquet/last_names.parquet")
    made, kept, whole = (Lookups.from_files(spark, f"{root}/{folder}") for folder in ("csv", "csv", "parquet"))
    if made.first_names is not None or sorted(made.last_names.inputFiles()) != sorted(kept.last_names.inputFiles()):
        raise ValueError("a lookup that is not there, or made twice")
    names = [t.last_names.select(F.lit(way).alias("way"), F.col("nachname").alias("name"), F.lit("").alias("place"), "anzahl") for way, t in (("made", made), ("kept", kept), ("parquet", whole))]
    place = F.concat_ws(" ", "plz", "ort").alias("place")
    streets = made.addresses.select(F.lit("addresses").alias("way"), F.col("str_name").alias("name"), place, F.col("hausnr").alias("anzahl"))
    return names[0].unionByName(names[1]).unionByName(names[2]).unionByName(streets)


@register("source_postcodes", f"SELECT plz_postleitzahl, gemeinde_name, kanton_name, kanton_name_kurz FROM ({PLACES_SQL})")
def source_postcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "postcodes")
    write_table(table(spark, sf_dir, "supplier", POSTCODES).drop("ord"), path, {"separator": "\t"})
    return read_postcodes(spark, path).drop("ord")


QUOTED_LINE = "'> ' || regexp_replace(line, '[^\\x00-\\xFF]', '?'{flags})"


@register(
    "source_text",
    f"""
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM conversations)
SELECT conv_id, string_agg({QUOTED_LINE.format(flags=", 'g'")} || chr(10), '' ORDER BY turn, place) AS text FROM l GROUP BY conv_id
""",
)
def source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a text file, every other one in latin-1, read back whole."""
    path = scratch_path(spark, "texts")
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    lines = lines.select("conv_id", "turn", "place", F.expr(QUOTED_LINE.replace("\\x", "\\\\x").format(flags="")).alias("line"))
    for rest, encoding in ((0, "UTF-8"), (1, "ISO-8859-1")):
        half = lines.where(F.col("conv_id") % 2 == rest).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "place")
        write_lines(half.select("conv_id", "line"), f"{path}/{rest}", "conv_id", encoding=encoding)
    documents = read_text_documents(spark, f"{path}/*/*/*.csv")
    return documents.select(F.regexp_extract("doc_id", "conv_id=([0-9]+)", 1).cast("long").alias("conv_id"), "text")


@register(
    "source_delimited_documents",
    "SELECT cast(c_custkey AS varchar) || ' ' || CASE WHEN c_custkey % 5 = 0 THEN 'NaN' ELSE c_name END || ' ' || c_mktsegment AS text FROM customer",
)
def source_delimited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "delimited")
    columns = ["c_custkey", "CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS c_name", "c_mktsegment"]
    write_table(table(spark, sf_dir, "customer", columns), path, {"separator": "\t"})
    return read_delimited_documents(spark, path, tab=True)


@register(
    "sink_table",
    " UNION ALL ".join(
        f"SELECT '{kind}' AS format, cast(p_partkey AS varchar) AS p_partkey, p_name || ', \"' || p_brand || '\"; ' AS label FROM part"
        for kind in ("csv", "parquet", "json")
    ),
)
def sink_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part", ["cast(p_partkey AS string) AS p_partkey", "p_name || ', \"' || p_brand || '\"; ' AS label"])
    out = None
    for kind in ("csv", "parquet", "json"):
        path = scratch_path(spark, kind)
        write_table(df, path, {"format": kind, "separator": ";"})
        back = read_csv(spark, f"{path}/*.csv") if kind == "csv" else spark.read.format(kind).schema(df.schema).load(path)
        part = back.select(F.lit(kind).alias("format"), "p_partkey", "label")
        out = part if out is None else out.unionByName(part)
    return out


@register("sink_config", "SELECT 'orders_anonymized.csv' AS filename, count(*) AS rows, 17 AS columns FROM orders")
def sink_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orders") + ".json"
    write_config(spark, suggest_config(messy(spark, sf_dir), "orders.csv"), path)
    config = read_config(spark, path)
    return spark.createDataFrame(
        [(config["filename"], config["rows"], len(config["columns"]))], "filename string, rows long, columns int"
    )


STREAM = {
    "event_type": {"data_type": "string", "function": "last_name", "source": "ogd-bs"},
    "props": {"data_type": "string", "function": "ahv_nr"},
    "user_id": {"data_type": "integer", "function": "random_int", "min": 0, "max": 999999},
}


@register(
    "mask_stream",
    f"""
WITH s AS ({LAST_SLOTS}), e AS (SELECT *, {draw(digest('event_type', 'event_type'))} AS d FROM events)
SELECT event_id, s.nachname AS event_type, {social_security(draw(digest('props', 'props')))} AS props,
  {draw(digest('user_id', 'user_id'))} % 1000000 AS user_id FROM e JOIN s ON d % s.total >= s.lo AND d % s.total < s.hi
""",
)
def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream, masked and written once."""
    source = table(spark, sf_dir, "events", ["event_id", "event_type", "props", "user_id"])
    events = (
        spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    masked = mask_stream(events, {"columns": STREAM}, KEY, row_key=["event_id"])
    query = masked.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.parquet(out)

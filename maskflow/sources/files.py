"""CSV, text and delimited documents; separator and encoding are found per file.

One pass over the lines tells the encoding of each file and whether quotes hold line breaks; header and separator come
from its beginning. Cells are decoded one by one, so a byte that does not fit the encoding never loses a whole file.
"""

from __future__ import annotations

import csv
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskflow.functions.names import column as named
from maskflow.session import BROADCAST_BYTES, materialise
from maskflow.sources.records import ROW_BYTES, line_effect, more_cells, read_lines, records

# Separators in order of preference, the characters looked at, the texts that mean missing.
SEPARATORS = [",", ";", "\t"]
SAMPLE_CHARACTERS = 1024
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]
CHUNK_BYTES = 64 * 1024
HEADER_BYTES = 64 * 1024 * 1024
SURPLUS = "_surplus_cells"
BOM = "﻿"


def separator_of(sample: Column) -> Column:
    """The most frequent separator among the first 1024 characters; comma if there is none."""
    head = F.substring(sample, 1, SAMPLE_CHARACTERS)
    counts = [F.length(head) - F.length(F.replace(head, F.lit(s), F.lit(""))) for s in SEPARATORS]
    best = F.greatest(*counts)
    chosen = F.when(best.isNull() | (best == 0), F.lit(SEPARATORS[0]))
    for s, n in zip(SEPARATORS, counts):
        chosen = chosen.when(n == best, F.lit(s))
    return chosen


def encoding_of(content: Column) -> Column:
    """`utf-8` if the bytes are valid UTF-8, else `latin-1`, which decodes anything."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.lit("utf-8")).otherwise(F.lit("latin-1"))


def decode_text(content: Column) -> Column:
    """Bytes as text by the encoding found, without a byte order mark."""
    plain = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.decode(content, "ISO-8859-1")
    )
    return F.regexp_replace(plain, f"^{BOM}", "")


def _head_reader(chunk: int, most: int) -> Callable:
    """A function that tasks can run without having this package installed.

    It adds the header, which ends at the first line end outside quotes, and a sample of at least that.
    """

    def read(batches):
        import re

        from pyarrow import fs

        # A cell in quotes, a character outside them, or the line end looked for.
        header = re.compile(rb'(?:"[^"]*"|[^"\r\n])*')

        for batch in batches:
            headers, heads = [], []
            for uri in batch["path"]:
                store, path = fs.FileSystem.from_uri(uri)
                head, more = b"", True
                with store.open_input_stream(path) as stream:
                    while more:
                        part = stream.read(max(chunk, len(head)))  # twice as much each time
                        head, more = head + part, len(part) > 0
                        end = header.match(head).end()
                        if more and (end < len(head) and head[end : end + 1] != b'"'):
                            break
                        if len(head) > most:
                            raise ValueError(f"no end of the header within {most} bytes: {uri}")
                if head[end : end + 1] == b'"':  # never closed: the first line
                    end = re.match(rb"[^\r\n]*", head).end()
                headers.append(head[:end])
                heads.append(head[: max(end, chunk)])
            yield batch.assign(first=headers, prefix=heads)

    return read


def line_facts(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """One row per file with lines: valid (all of it is UTF-8) and breaks (a cell in quotes, behind any of the separators,
    goes on after the line)."""
    lines = read_lines(spark, path, recursive)
    opened = line_effect(F.col("line"), lambda p: F.substring(p, -1, 1).isin(SEPARATORS)) % 2 == 1
    # No character of UTF-8 contains a line end, so the lines may be looked at one by one, wherever files are split.
    return lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("line")).alias("valid"), F.bool_or(opened).alias("breaks"))


def file_facts(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """One row per file: path, name, extension, size, encoding, separator, header line, and whether lines go on in quotes.

    The encoding is that of the whole file; the header ends at the first line end outside quotes, however long it is.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
        .select("path", "length", "modificationTime", F.col("_metadata.file_path").alias("file"))
    )
    schema = T.StructType([*listed.schema.fields, T.StructField("first", T.BinaryType()), T.StructField("prefix", T.BinaryType())])
    read = listed.mapInPandas(_head_reader(CHUNK_BYTES, HEADER_BYTES), schema)
    read = read.join(line_facts(spark, path, recursive), "file", "left").withColumn("valid", F.coalesce("valid", F.lit(True)))

    def shown(content: Column) -> Column:
        # A sample may end inside a character.
        text = F.when(F.col("valid"), F.make_valid_utf8(content.cast("string"))).otherwise(F.decode(content, "ISO-8859-1"))
        return F.regexp_replace(text, f"^{BOM}", "")

    name = F.element_at(F.split(F.col("path"), "/"), -1)
    extension = F.lower(F.when(name.contains("."), F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1))).otherwise(F.lit("")))
    separator = separator_of(F.col("sample"))
    return read.withColumns({"sample": shown(F.col("prefix")), "header": shown(F.col("first"))}).select(
        "path",
        "file",
        name.alias("name"),
        extension.alias("extension"),
        F.col("length").alias("size"),
        "modificationTime",
        F.when(F.col("valid"), F.lit("utf-8")).otherwise(F.lit("latin-1")).alias("encoding"),
        separator.alias("separator"),
        F.when(separator == "\t", F.lit("tab")).otherwise(separator).alias("separator_name"),
        "header",
        F.coalesce("breaks", F.lit(False)).alias("breaks"),
    )


def repair_cell(value: Column) -> Column:
    """A cell that was read byte by byte as latin-1: UTF-8 where its bytes are that, else as it is."""
    raw = F.encode(value, "ISO-8859-1")
    fixed = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(value)
    return F.when(value.rlike(r"[^\x00-\x7F]"), fixed).otherwise(value)


def missing_to_null(value: Column) -> Column:
    return F.when(~value.isin(MISSING_TEXTS), value)


def _raw_cells(spark: SparkSession, source: str, separator: str) -> DataFrame:
    """Cells read as latin-1, a record a line, and the whole record in `_surplus_cells` where it has more cells than the
    header."""
    reader = (
        spark.read.option("header", True)
        .option("sep", separator)
        .option("encoding", "ISO-8859-1")
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", SURPLUS)
        .option("columnPruning", False)  # the cells of a record are counted only if all are parsed
    )
    cells = reader.csv(source).schema
    raw = reader.schema(T.StructType([*cells.fields, T.StructField(SURPLUS, T.StringType())])).csv(source)
    # Spark marks short records too; separators outside quotes tell which ones are long.
    return raw.withColumn(SURPLUS, F.when(more_cells(F.col(SURPLUS), F.lit(separator), F.lit(len(cells))), F.col(SURPLUS)))


def _no_surplus(raw: DataFrame) -> DataFrame:
    """`raw` without that column; a record with more cells than the header is an error."""
    # The first cell is named so that Spark reads more than the marked record, also for a count.
    said = F.concat(F.lit("more cells than the header: "), F.col(SURPLUS), F.lit(" / "), F.coalesce(named(raw.columns[0]), F.lit("")))
    checked = F.when(F.col(SURPLUS).isNotNull(), F.raise_error(said).cast("boolean")).otherwise(F.lit(True))
    return raw.where(checked).drop(SURPLUS)


def _header_names(cells: list[str | None]) -> list[str]:
    """Column names as Spark's CSV reader gives them: empty ones are numbered, and so are repeated ones."""
    known = [(c or "").lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if known.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def _cells(text: Column, separator: str, width: int) -> Column:
    """The first `width` cells c0, c1, ... of a record, as Spark's CSV reader has them."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    return F.from_csv(text, schema, {"sep": separator, "escape": '"', "maxColumns": str(width + 20_480)})


def _read_layouts(spark: SparkSession, path: str, facts: DataFrame, layouts: list, breaks: bool, keep_missing_texts: bool, surplus: str | None) -> DataFrame:
    """Files of any number of layouts in one plan: records get the number of their file's layout, and each layout says
    where it holds each column. Nothing about single files reaches the driver."""
    headers = spark.createDataFrame([(i, found["header"], found["separator"]) for i, found in enumerate(layouts)], "layout int, header string, separator string")
    separators = sorted({found["separator"] for found in layouts})
    headings = [next(csv.reader([found["header"]], delimiter=found["separator"]), [""]) for found in layouts]
    most = max(map(len, headings))

    def by_separator(text: Column) -> Column:
        chosen = None
        for s in separators:
            arm = (F.col("separator") == s, _cells(text, s, most))
            chosen = F.when(*arm) if chosen is None else chosen.when(*arm)
        return chosen

    columns: dict[str, str] = {}
    places = []
    for i in range(len(layouts)):
        names = _header_names(headings[i])
        for name in names:
            columns.setdefault(name.lower(), name)
        places.append((i, len(names), {name.lower(): at for at, name in enumerate(names)}))
    table = spark.createDataFrame([(i, width, [at.get(c) for c in columns]) for i, width, at in places], "layout int, width int, places array<int>")

    numbered = facts.join(F.broadcast(headers.select("layout", F.col("header").alias("_header"), F.col("separator").alias("_separator"))), F.expr("header = _header and separator = _separator"))
    files = numbered.select(F.xxhash64("file").alias("file_key"), "separator", "layout")
    count = sum(found["files"] for found in layouts)
    found = records(read_lines(spark, path), files, count, breaks)
    small = count * ROW_BYTES <= BROADCAST_BYTES
    rows = found.join(F.broadcast(files) if small else files, "file_key").join(F.broadcast(table), "layout")
    raw = F.col("record").cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode("record", "ISO-8859-1"))
    rows = rows.select("separator", "width", "places", text.alias("text"))
    # A column first: Spark would parse the record anew for each cell that is taken from the expression.
    rows = rows.withColumn("parsed", by_separator(F.col("text")))
    rows = rows.withColumn("cells", F.array(*[F.col(f"parsed.c{i}") for i in range(most)])).drop("parsed")
    rows = rows.withColumn(SURPLUS, F.when(more_cells(F.col("text"), F.col("separator"), F.col("width")), F.col("text")))
    if surplus is None:
        said = F.concat(F.lit("more cells than the header: "), F.col(SURPLUS), F.lit(" / "), F.coalesce(F.col("cells")[0], F.lit("")))
        rows = rows.where(F.when(F.col(SURPLUS).isNotNull(), F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))
    rows = rows.withColumn("cells", F.transform("places", lambda at: F.get("cells", at)))
    shown = []
    for at, name in enumerate(columns.values()):
        cell = repair_cell(F.get("cells", F.lit(at)))
        shown.append((cell if keep_missing_texts else missing_to_null(cell)).alias(name))
    return rows.select(*shown, *([repair_cell(F.col(SURPLUS)).alias(surplus)] if surplus else []))


def read_csv(spark: SparkSession, path: str, keep_missing_texts: bool = False, multi_line: bool | None = None, surplus: str | None = None) -> DataFrame:
    """A CSV file, folder or glob as text columns; files may differ in separator, encoding and column order.

    Every column stays text, so leading zeros of postcodes and phone numbers survive; `detect_types` types it.
    `multi_line` says whether cells in quotes may hold line breaks; by default that is found out. All files are read in
    splits, also such ones and folders of many layouts, in one scan of the lines. A line break in a cell is a line feed,
    whatever it was in the file. A record with more cells than its header is an error, unless `surplus` names a text
    column for such records, which is null for all others; missing cells are null.
    """
    # Written, as the lines are read for them: a row for each file, with its header.
    facts = materialise(file_facts(spark, path).select("path", "file", "extension", "header", "separator", "breaks"), "file-facts")
    layouts = facts.groupBy("extension", "header", "separator").agg(F.min("path").alias("path"), F.bool_or("breaks").alias("breaks"), F.count("*").alias("files")).orderBy("path").collect()
    if not layouts:
        raise FileNotFoundError(path)
    for found in layouts:
        if found["extension"] != ".csv":
            raise ValueError(f"unsupported file extension: {found['path']}")
    breaks = multi_line if multi_line is not None else any(found["breaks"] for found in layouts)
    if len(layouts) > 1 or breaks:
        return _read_layouts(spark, path, facts, layouts, breaks, keep_missing_texts, surplus)
    raw = _raw_cells(spark, path, layouts[0]["separator"])
    raw = raw if surplus else _no_surplus(raw)
    # Cells and names are UTF-8 where their bytes are that, else latin-1, whatever the rest of the file is.
    columns = []
    for name in raw.columns:
        c = repair_cell(named(name))
        if name == SURPLUS:
            columns.append(c.alias(surplus))
            continue
        try:
            shown = name.encode("iso-8859-1").decode("utf-8")
        except UnicodeError:
            shown = name
        columns.append((c if keep_missing_texts else missing_to_null(c)).alias(shown.lstrip(BOM)))
    return raw.select(*columns)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: `doc_id` (its path) and `text`, decoded by its own encoding."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("doc_id"), decode_text(F.col("content")).alias("text"))


def read_delimited_documents(spark: SparkSession, path: str, tab: bool = False) -> DataFrame:
    """One row per table row: `text` holds its cells, joined by a blank; commas separate, or tabs.

    Line breaks in quotes stay; a row with more cells than the header is an error.
    """
    separator = "\t" if tab else ","
    facts = materialise(file_facts(spark, path).select("path", "file", "header", F.lit(separator).alias("separator"), "breaks"), "file-facts")
    layouts = facts.groupBy("header", "separator").agg(F.min("path").alias("path"), F.bool_or("breaks").alias("breaks"), F.count("*").alias("files")).orderBy("path").collect()
    if any(found["breaks"] for found in layouts):
        raw = _read_layouts(spark, path, facts, layouts, True, True, None)
    else:
        raw = _no_surplus(_raw_cells(spark, path, separator))
    cells = [F.coalesce(repair_cell(named(c)), F.lit("NaN")) for c in raw.columns]
    return raw.select(F.concat_ws(" ", *cells).alias("text"))

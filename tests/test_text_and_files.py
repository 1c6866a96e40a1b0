"""Profiling, redaction and files on hand-written input."""

import pytest

from maskflow import redact_table
from maskflow.operators.profile import detect_types
from maskflow.operators.redact import Operator, Redaction, entity_spans
from maskflow.sources.files import file_facts, read_csv, read_delimited_documents, read_text_documents
from maskflow.sources.lookups import read_postcodes
from maskflow.sources.sinks import read_config, write_config, write_table


def types(spark, values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"c {kind}")
    return detect_types(df).first()["type"]


@pytest.mark.parametrize(
    "values,want",
    [
        ([None, None], "string"), (["0", "1"], "boolean"), (["yes", " NO "], "boolean"), (["yes", "no", "true"], "string"),
        (["1", "0", "true"], "string"), (["12.0", "3"], "integer"), (["007", "12"], "integer"), (["1.5", "2"], "float"),
        (["1e400"], "float"), (["1d"], "string"), (["0x1p3"], "string"), (["2020-01-01", "01/31/2020", "31-12-2020"], "date"),
        (["2020-01-01 junk"], "string"), (["12/31/2020"], "date"), (["31/31/2020"], "string"), (["2020-02-30"], "string"),
        (["2020-01-01T10:00:00Z"], "date"), (["85", "92"], "integer"), (["x" * 5000], "string"), (["1", None], "boolean"),
    ],
)
def test_text_types(spark, values, want):
    assert types(spark, values) == want


def test_declared_types(spark):
    assert types(spark, [0, 1, None], "int") == "boolean" and types(spark, [2, 3], "bigint") == "integer"
    assert types(spark, [1.0, float("nan")], "double") == "integer" and types(spark, [1.5, None], "double") == "float"
    assert types(spark, [True, False], "boolean") == "boolean"
    df = spark.sql("select date'2020-01-01' d, timestamp'2020-01-01 00:00:00' t, array(1) a, cast(1.5 as decimal(9,2)) m")
    assert [r["type"] for r in detect_types(df).orderBy("position").collect()] == ["date", "date", "string", "float"]
    assert detect_types(df.limit(0)).filter("type = 'string' and rows = 0").count() == 4


def redacted(spark, text, rule=None):
    return redact_table(spark.createDataFrame([(text,)], "t string"), rule=rule).first()["t"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Anna Meier kommt.", "<PERSON> kommt."), ("Der Kunde", "Der Kunde"), ("Hans von Allmen", "<PERSON>"),
        ("CHF Franken", "CHF Franken"), ("Anna Meier2", "Anna Meier2"), ("Anna", "Anna"), ("", ""), (None, None),
        ("Anna Meier,Max Muster", "<PERSON>,<PERSON>"), ("éAnna Meier", "éAnna Meier"), ("Anna\nMeier", "<PERSON>"),
        ("einText Anna Meier", "einText Anna Meier".replace("Text Anna Meier", "<PERSON>")),
    ],
)
def test_redact_person(spark, text, want):
    assert redacted(spark, text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("+41 79 123 45 67", "+41 79" + "*" * 10), ("0041791234567", "004" + "*" * 10), ("061 267 87 27.", "061" + "*" * 10 + "."),
        ("+1 (743) 555-3824", "+1 (743) 555-3824"), ("061 267 87 27x", "061 267 87 27x"), ("nichts", "nichts"),
    ],
)
def test_mask_phone(spark, text, want):
    assert redacted(spark, text, Redaction(("PHONE_NUMBER",))) == want


def test_operators_and_threshold(spark):
    text = "Anna Meier 061 267 87 27"
    both = Redaction(("PERSON", "PHONE_NUMBER"), {"DEFAULT": Operator()})
    assert redacted(spark, text, both) == "<ANONYMIZED> <ANONYMIZED>"
    front = Operator(kind="mask", masking_char="#", chars_to_mask=4, from_end=False)
    assert redacted(spark, text, Redaction(("PERSON",), {"PERSON": front})) == "#### Meier 061 267 87 27"
    assert redacted(spark, text, Redaction(("PERSON_SIMPLE",))) == text
    assert redacted(spark, text, Redaction(("PERSON_SIMPLE",), threshold=0.4)) == "<PERSON> 061 267 87 27"


def test_redact_table_options(spark):
    df = spark.createDataFrame([("Anna Meier", "Max Muster", 7)], "a string, b string, n int")
    assert tuple(redact_table(df, ["a"]).first()) == ("<PERSON>", "Max Muster", 7)
    assert dict(redact_table(df, keep_types=False).dtypes)["n"] == "string"
    assert redact_table(df, ["a", "zz"]).count() == 1
    with pytest.raises(ValueError):
        redact_table(df, ["zz"], errors="raise")


def test_spans_point_into_the_text(spark):
    df = spark.createDataFrame([(1, "Frau Anna Meier und Max Muster, 061 267 87 27"), (2, "nichts")], "i int, t string")
    found = entity_spans(df, "i", "t", Redaction(("PERSON", "PHONE_NUMBER"))).join(df, "i").collect()
    assert len(found) == 3 and all(r["t"][r["start"] : r["end"]] == r["text"] for r in found)


def test_csv_of_many_shapes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("plz;ort\n0404;Zürich\nNA;\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("﻿ort,plz\n\"Genf, Ost\",1200\n".encode())
    (tmp_path / "c.csv").write_bytes("plz\tort\tx\n8000\tBülach\tö\n".encode())
    got = {(r["plz"], r["ort"], r["x"]) for r in read_csv(spark, str(tmp_path)).collect()}
    assert got == {("0404", "Zürich", None), (None, None, None), ("1200", "Genf, Ost", None), ("8000", "Bülach", "ö")}
    facts = {r["name"]: (r["separator_name"], r["encoding"], r["size"]) for r in file_facts(spark, str(tmp_path)).collect()}
    assert facts["a.csv"][:2] == (";", "latin-1") and facts["b.csv"][:2] == (",", "utf-8") and facts["c.csv"][:2] == ("tab", "utf-8")
    assert facts["a.csv"][2] == (tmp_path / "a.csv").stat().st_size
    (tmp_path / "d.xls").write_bytes(b"x")
    with pytest.raises(ValueError, match="unsupported"):
        read_csv(spark, str(tmp_path))


def test_late_byte_does_not_lose_text(spark, tmp_path):
    # The first 64 KiB are ASCII and end inside a character; a latin-1 byte follows much later.
    body = b"a,b\n" + b"x,y\n" * 16382 + "xxxé,y\n".encode() + b"M\xfcller,y\n"
    (tmp_path / "a.csv").write_bytes(body)
    values = [r["a"] for r in read_csv(spark, str(tmp_path)).filter("a <> 'x'").collect()]
    assert sorted(values) == ["Müller", "xxxé"]


def test_documents(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("﻿Zürich".encode())
    (tmp_path / "l.txt").write_bytes("Zürich".encode("latin-1"))
    assert [r["text"] for r in read_text_documents(spark, f"{tmp_path}/*.txt").collect()] == ["Zürich"] * 2
    (tmp_path / "t.tab").write_text("a\tb\n1\t\n", encoding="utf-8")
    assert [r["text"] for r in read_delimited_documents(spark, f"{tmp_path}/t.tab", tab=True).collect()] == ["1 NaN"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("Zürich ", None, ' "a";b')], "a string, b string, c string")
    write_table(df, f"{tmp_path}/o", {"format": "csv", "separator": ";", "encoding": "ISO-8859-1"})
    assert tuple(read_csv(spark, f"{tmp_path}/o/*.csv").first()) == ("Zürich ", None, ' "a";b')
    with pytest.raises(ValueError):
        write_table(df, f"{tmp_path}/p", {"format": "xlsx"})
    config = {"columns": {"Körper": {"function": None}}}
    write_config(spark, config, f"{tmp_path}/c.json")
    assert read_config(spark, f"{tmp_path}/c.json") == config


def test_lookup_files(spark, tmp_path):
    from maskflow import Lookups, mask_table

    spark.createDataFrame([("Meier", 3), ("Übrige", 9)], "nachname string, anzahl int").write.parquet(f"{tmp_path}/last_names.parquet")
    spark.createDataFrame([("Anna", "W", 3), ("Max", "M", 1)], "vorname string, geschlecht string, anzahl int").write.parquet(f"{tmp_path}/first_names.parquet")
    spark.createDataFrame([("Weg", 1, None, 1, "X")], "str_name string, hausnr int, hausnr_zus string, plz int, ort string").write.parquet(f"{tmp_path}/addresses.parquet")
    (tmp_path / "postcodes.csv").write_text("plz_postleitzahl\tgemeinde_name\tkanton_name\tkanton_name_kurz\n1\tB\tK\tk\n1\tA\tK\tk\n", encoding="utf-8")
    lookups = Lookups.from_files(spark, str(tmp_path))
    df = spark.createDataFrame([("x", "Anna"), ("y", "Max")], "n string, v string")
    columns = {"n": {"data_type": "string", "function": "last_name", "source": "ogd-bs"}, "v": {"data_type": "string", "function": "first_name", "source": "ogd-bs"}}
    assert [tuple(r) for r in mask_table(df, {"columns": columns}, lookups).collect()] == [("Meier", "Anna"), ("Meier", "Max")]
    assert read_postcodes(spark, f"{tmp_path}/postcodes.csv").orderBy("ord").first()["gemeinde_name"] == "B"


def test_spans_of_repeated_ids(spark):
    df = spark.createDataFrame([(1, "Dr Hans Huber ruft an"), (1, "an Hans Huber und Eva Frei")], "i int, t string")
    rows = entity_spans(df, "i", "t", Redaction(("PERSON",)))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.start, r.end, r.text) for r in rows.collect() if r.text != "Dr Hans Huber")[:1] == [(3, 13, "Hans Huber")]


def test_no_name_slips_through(spark):
    cases = [
        ("Der Anna Meier dankt", "Der <PERSON> dankt"), ("mit René Müller und Zoë Öhri", "mit <PERSON> und <PERSON>"),
        ("Anne-Marie Keller ruft an", "<PERSON> ruft an"), ("Anna Meier-Huber, Bern", "<PERSON>, Bern"), ("Die Stadt", "Die Stadt"),
    ]
    rows = redact_table(spark.createDataFrame(cases, "t string, want string"), ["t"]).collect()
    assert [r.t for r in rows] == [want for _, want in cases]


def test_csv_keeps_line_breaks_and_long_headers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.csv").write_text('id,text\n1,"line one\nline ""two"", ü"\n2,plain\n', encoding="utf-8")
    got = {(r["id"], r["text"]) for r in read_csv(spark, f"{tmp_path}/a").collect()}
    assert got == {("1", 'line one\nline "two", ü'), ("2", "plain")}
    (tmp_path / "a/y.tab").write_text('id\ttext\n1\t"one\ntwo"\n', encoding="utf-8")
    assert [r["text"] for r in read_delimited_documents(spark, f"{tmp_path}/a/y.tab", tab=True).collect()] == ["1 one\ntwo"]
    # Headers that differ only beyond 64 KiB are two layouts.
    (tmp_path / "b").mkdir()
    wide = [f"{i:02d}" + "x" * 2500 for i in range(30)]
    cells = ["v"] * len(wide)
    for name, last in (("x", ["first", "last"]), ("y", ["last", "first"])):
        (tmp_path / f"b/{name}.csv").write_text("\n".join(",".join(r) for r in ([*wide, *last], [*cells, *last])) + "\n")
    got = read_csv(spark, f"{tmp_path}/b").select("first", "last").collect()
    assert [tuple(r) for r in got] == [("first", "last")] * 2


def test_csv_encoding_is_that_of_the_whole_file(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"a,b\n" + b"x,y\n" * 30_000 + "Zoë,z\n".encode("latin-1"))
    assert [r["encoding"] for r in file_facts(spark, str(tmp_path)).collect()] == ["latin-1"]
    assert read_csv(spark, str(tmp_path)).where("b = 'z'").first()["a"] == "Zoë"


def test_csv_surplus_cells_are_not_dropped(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,x\n2\n3,y,extra\n4,"p,q"\n5,,,z\n')
    for action in (lambda t: t.count(), lambda t: t.select("a").collect()):
        with pytest.raises(Exception, match="more cells than the header"):
            action(read_csv(spark, str(tmp_path)))
    got = {(r["a"], r["b"], r["rest"]) for r in read_csv(spark, str(tmp_path), surplus="rest").collect()}
    assert got == {("1", "x", None), ("2", None, None), ("3", "y", "3,y,extra"), ("4", "p,q", None), ("5", None, "5,,,z")}

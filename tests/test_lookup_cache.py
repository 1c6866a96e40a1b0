"""Lookups from parquet or CSV, and the cache of cleaned CSV files."""

import pytest

from maskflow import Lookups
from maskflow.sources.cache import cached, published
from maskflow.sources.lookups import ADDRESS_SCHEMA, FIRST_NAME_SCHEMA, LAST_NAME_SCHEMA, lookup_table


def names(df):
    return {tuple(r) for r in df.collect()}


def test_csv_is_cleaned_kept_and_made_anew_when_it_changes(spark, tmp_path):
    path = tmp_path / "first_names.csv"
    path.write_bytes("geschlecht;vorname;jahr;anzahl\nW;Zoë;2020;3\nM;Übrige;2020;99\nW;Zoë;2021;4\nM;Max;2020;x\nM;;2020;5\nM;NA;2020;2\n".encode("latin-1"))
    first = lookup_table(spark, str(tmp_path), "first_names", FIRST_NAME_SCHEMA)
    assert names(first) == {("Zoë", "W", 7), ("NA", "M", 2)} and first.columns == ["vorname", "geschlecht", "anzahl"]
    assert lookup_table(spark, str(tmp_path), "first_names", FIRST_NAME_SCHEMA).inputFiles() == first.inputFiles()
    path.write_text("vorname;geschlecht;anzahl\nEva;W;1\n")
    assert names(lookup_table(spark, str(tmp_path), "first_names", FIRST_NAME_SCHEMA)) == {("Eva", "W", 1)}
    assert len(list((tmp_path / "cache/data").iterdir())) == 2


def test_parquet_comes_first_with_or_without_weights(spark, tmp_path):
    spark.createDataFrame([("Meier",), ("Meier",), ("übrige",)], "nachname string").write.parquet(f"{tmp_path}/last_names.parquet")
    (tmp_path / "last_names.csv").write_text("nachname;anzahl\nHuber;1\n")
    assert names(lookup_table(spark, str(tmp_path), "last_names", LAST_NAME_SCHEMA)) == {("Meier", 2)}
    assert not (tmp_path / "cache").exists()


def test_any_files_may_be_absent(spark, tmp_path):
    (tmp_path / "addresses.csv").write_text("str_name;hausnr;hausnr_zus;plz;ort\nWeg;1;;4051;Basel\n")
    lookups = Lookups.from_files(spark, str(tmp_path), f"{tmp_path}/elsewhere")
    assert lookups.first_names is None and lookups.postcodes is None and lookups.last.count() > 10
    assert lookups.address.first()["ort"] == "Basel" and (tmp_path / "elsewhere/published").exists()
    (tmp_path / "addresses.csv").write_text("str_name;plz\nWeg;4051\n")
    with pytest.raises(ValueError, match="no column hausnr, hausnr_zus, ort"):
        lookup_table(spark, str(tmp_path), "addresses", ADDRESS_SCHEMA)


def test_only_whole_versions_are_read(spark, tmp_path):
    root = str(tmp_path)

    def make(value):
        return lambda: spark.createDataFrame([(value,)], "v int")

    # A writer that was lost: its data is there, it was never published, or its mark is not committed.
    make(1)().write.parquet(f"{root}/data/t-x-0000")
    (tmp_path / "published/t-x-0000/_temporary").mkdir(parents=True)
    (tmp_path / "published/t-x-0000/_temporary/part.parquet").write_bytes(b"")
    assert published(spark, root, "t-x") is None
    assert cached(spark, root, "t", "x", make(2)).first()["v"] == 2
    # Another job made the same version at the same time: both read one of them.
    make(3)().write.parquet(f"{root}/data/t-x-zzzz")
    spark.createDataFrame([(f"{root}/data/t-x-zzzz",)], "path string").write.parquet(f"{root}/published/t-x-zzzz")
    assert [cached(spark, root, "t", "x", make(4)).first()["v"] for _ in range(2)] == [2, 2]
    assert cached(spark, root, "t", "y", make(5)).first()["v"] == 5


def test_a_make_that_fails_publishes_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="no such"):
        cached(spark, str(tmp_path), "t", "x", lambda: spark.range(1).selectExpr("raise_error('no such') AS v"))
    assert published(spark, str(tmp_path), "t-x") is None

"""Jobs from files to a file: names, formats, reports, and nothing personal left behind."""

import os

import pytest

from maskflow import generate_file, mask_file
from maskflow.session import owned_scratch, scratch_path, shared_dir
from maskflow.sources.files import read_csv
from maskflow.sources.sinks import write_config

SECRET = "Geheimnisweg"
COLUMNS = {
    "code": {"data_type": "string", "function": "shuffle_codes"},
    "nr": {"data_type": "string", "function": "random_int", "min": 1, "max": 99, "unique": True},
    "telefon": {"data_type": "string", "function": "phone_nr"},
    "weg": {"data_type": "string", "function": "delete"},
    "x": {"data_type": "string", "function": "unheard_of"},
}


@pytest.fixture
def data(tmp_path):
    rows = [f'{k},"{SECRET} {k}\nhinten",n{k},{"061 267 87 27" if k % 2 else "12"},w,x' for k in range(40)]
    (tmp_path / "in.csv").write_text("\n".join(["id,code,nr,telefon,weg,x", *rows]) + "\n", encoding="utf-8")
    return tmp_path


def everything(folder):
    return {os.path.join(d, f) for d, _, files in os.walk(folder) for f in files}


@pytest.mark.filterwarnings("ignore:.*unheard_of")
def test_masking_leaves_only_the_result(spark, data):
    before = everything(shared_dir(spark))
    write_config(spark, {"filename": "some/where/out.csv", "separator": ";", "columns": COLUMNS}, f"{data}/in.json")
    report = mask_file(spark, f"{data}/in.csv", f"{data}/in.json", f"{data}/out", key="k")
    assert everything(shared_dir(spark)) == before
    assert report.path == f"{data}/out/out.csv" and [p.name for p in (data / "out").iterdir() if p.suffix != ".crc"] == ["out.csv"]
    got = read_csv(spark, f"{report.path}/*.csv")
    assert got.columns == ["id", "code", "nr", "telefon", "x"] and got.count() == 40
    assert {r.code for r in got.collect()} == {f"{SECRET} {k}\nhinten" for k in range(40)}
    status = {r.column: tuple(r)[1:] for r in report.frame(spark).collect()}
    assert status["weg"] == ("delete", True, None, None) and status["x"] == ("unheard_of", False, None, None)
    assert status["nr"] == ("random_int", True, 40, 0) and status["telefon"][3] == 20


def test_names_formats_and_existing_results(spark, data):
    config = {"columns": {"nr": {"data_type": "string", "function": "delete"}}}
    report = mask_file(spark, f"{data}/in.csv", config, str(data), key="k")
    assert report.path == f"{data}/in_anonymized.csv"
    with pytest.raises(FileExistsError):
        mask_file(spark, f"{data}/in.csv", config, str(data), key="k")
    again = mask_file(spark, f"{data}/in.csv", config | {"filename": "in_anonymized.csv", "format": "parquet"}, str(data), key="k", overwrite=True)
    assert "nr" not in spark.read.parquet(again.path).columns
    parquet = mask_file(spark, f"{data}/in.csv", {"columns": {}, "filename": "a.parquet"}, str(data))
    assert mask_file(spark, parquet.path, {"columns": {}}, str(data)).path == f"{data}/a_anonymized.parquet"
    with pytest.raises(ValueError, match="unsupported"):
        mask_file(spark, f"{data}/in.xlsx", config, str(data))


def test_a_failed_job_leaves_nothing(spark, data):
    before = everything(shared_dir(spark))
    small = {"columns": COLUMNS | {"nr": {"data_type": "string", "function": "random_int", "min": 1, "max": 2, "unique": True}}}
    with pytest.raises(ValueError, match="do not fit"):
        mask_file(spark, f"{data}/in.csv", small, f"{data}/out", key="k")
    (data / "in.csv").write_text("id,a\n1,x\n2,y,z,surplus\n")
    with pytest.raises(Exception, match="more cells"):
        mask_file(spark, f"{data}/in.csv", {"columns": {}}, f"{data}/out", key="k")
    assert everything(shared_dir(spark)) == before and not (data / "out/in_anonymized.csv").exists()


def test_generate_file(spark, tmp_path):
    config = {"filename": "t.json", "rows": 7, "columns": {"n": {"function": "incremental_int"}}}
    report = generate_file(spark, config, str(tmp_path), key="k")
    assert sorted(r.n for r in spark.read.json(report.path).collect()) == list(range(7))
    with pytest.raises(ValueError, match="not a known function"):
        generate_file(spark, {"columns": {"n": {"function": "nothing"}}}, str(tmp_path))


def test_scratch_belongs_to_the_innermost_job(spark):
    with owned_scratch(spark) as outer:
        with owned_scratch(spark) as inner:
            assert scratch_path(spark, "x").startswith(inner) and inner != outer
        assert scratch_path(spark, "x").startswith(outer)
    assert not scratch_path(spark, "x").startswith(outer)

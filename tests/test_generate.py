"""Generators: exact counts, bounds, uniqueness, formats, dependence between columns."""

import re

import pytest
from pyspark.sql import functions as F

from maskflow import generate_table
from maskflow.operators.generators import null_count

KEY = "test"


def column(spark, settings, rows=1000, kind="x"):
    return [r["x"] for r in generate_table(spark, {"rows": rows, "columns": {"x": settings}}, key=KEY).collect()]


@pytest.mark.parametrize("percent,want", [(0, 0), (33.3, int(33.3 / 100.0 * 1000)), (100, 1000), (150, 1000), ("x", 0), (-5, 0), (None, 0)])
def test_percent_null_is_exact(spark, percent, want):
    assert null_count(percent, 1000) == want
    got = column(spark, {"function": "random_int", "min": 0, "max": 9, "percent_null": percent})
    assert sum(v is None for v in got) == want


def test_incremental(spark):
    assert column(spark, {"function": "incremental_int", "min": 5, "step": 3}, 4) == [5, 8, 11, 14]
    assert column(spark, {"function": "incremental_date", "start_date": "2025-01-31", "step_period": "month", "step": 1}, 4) == [
        "2025-01-31", "2025-02-28", "2025-03-31", "2025-04-30",
    ]
    assert column(spark, {"function": "incremental_date", "start_date": "2025-12-30", "delta_days": 2}, 3) == ["2025-12-30", "2026-01-01", "2026-01-03"]
    late = {"function": "incremental_date", "start_date": "9999-12-30"}
    assert column(spark, late | {"overflow": "null"}, 3) == ["9999-12-30", "9999-12-31", None]
    with pytest.raises(ValueError, match="9999"):
        column(spark, late, 3)


@pytest.mark.parametrize("width", [1000, 1001, 4096, 999_999_937])
def test_unique_random_int(spark, width):
    got = column(spark, {"function": "random_int", "min": 10, "max": 10 + width, "unique": True})
    assert len(set(got)) == 1000 and min(got) >= 10 and max(got) < 10 + width
    assert got != sorted(got)


def test_unique_needs_room(spark):
    with pytest.raises(ValueError, match="do not fit"):
        column(spark, {"function": "random_int", "min": 0, "max": 999, "unique": True})


def test_normal_bounds(spark):
    p = {"function": "normal_float", "mean": 5.5, "std": 0.2, "min": 5.45, "max": 5.55, "digits": 2}
    clipped, redrawn = column(spark, p), column(spark, p | {"bounds": "redraw"})
    for got in (clipped, redrawn):
        assert min(got) >= 5.45 and max(got) <= 5.55
    assert redrawn.count(5.45) < clipped.count(5.45)
    assert set(column(spark, {"function": "normal_float", "mean": 3, "std": 0, "digits": 1}, 10)) == {3.0}
    assert set(column(spark, {"function": "normal_date", "average_date": "2000-01-01", "std_days": 0}, 10)) == {"2000-01-01"}


def test_moments(spark):
    df = generate_table(spark, {"rows": 100_000, "columns": {"x": {"function": "normal_float", "mean": 50, "std": 10}}}, key=KEY)
    row = df.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).first()
    assert abs(row["m"] - 50) < 5 * 10 / 100_000**0.5 and abs(row["s"] - 10) < 5 * 10 / (2 * 100_000) ** 0.5


def test_ordered_groups(spark):
    for values in ([1, 9, 2], [0, 20_000, 1]):
        got = column(spark, {"function": "list_int", "values": values, "rows_per_group": "random", "ordered": True})
        assert got == sorted(got) and set(got) <= set(range(values[0], values[1] + 1, values[2])) and len(set(got)) > 4


def test_ahv_checksum(spark):
    for number in column(spark, {"function": "ahv_nr"}, 300):
        assert re.fullmatch(r"756\.\d{4}\.\d{4}\.0\d", number)
        digits = number.replace(".", "")[:11]
        rest = sum(int(d) * (1, 3)[i % 2] for i, d in enumerate(digits)) % 11
        check = 0 if rest == 0 else 11 - rest
        assert int(number[-2:]) == (check if check < 10 else 0)


def test_percent_male_is_exact(spark):
    from maskflow.sources.lookups import MALE_NAMES

    for source in ("ogd-bs", "faker"):
        got = column(spark, {"function": "first_name", "source": source, "percent_male": 30})
        assert sum(v in MALE_NAMES for v in got) == 300
        assert any(v in MALE_NAMES for v in got[500:])


def test_addresses_do_not_repeat_until_used_up(spark):
    from maskflow.sources.lookups import sample_addresses

    total = sample_addresses(spark).count()
    config = {"rows": total + 10, "columns": {"a": {"function": "address", "fields": ["str_name", "housnumber", "plz"], "labels": ["s", "h", "p"]}}}
    rows = generate_table(spark, config, key=KEY)
    assert rows.columns == ["s", "h", "p"]
    assert rows.distinct().count() == total and rows.count() == total + 10


def test_dependent_columns_and_placement(spark):
    columns = {
        "k": {"function": "list_string", "list": ["BS", "XX"]},
        "plz": {"function": "plz4", "canton_field": "k"},
        "ort": {"function": "location", "plz_field": "plz"},
        "nr": {"function": "streetname_housenumber", "plz_field": "plz"},
        "tel": {"function": "phone_nr", "formats": ["+xx xx xxx xx xx", "xxx xxx xxxx", "xx xxx xx xx"], "ndc": ["79"]},
    }
    df = generate_table(spark, {"rows": 200, "columns": columns}, key=KEY)
    for r in df.collect():
        if r["k"] == "XX":
            assert r["plz"] == -99 and r["ort"] is None
        else:
            assert 4001 <= r["plz"] <= 4126 and r["ort"] in ("Basel", "Riehen", "Bettingen")
        assert re.fullmatch(r"\+41 79 \d{3} \d\d \d\d|079 \d{3} \d{4}", r["tel"])
    ids = spark.range(200).withColumnRenamed("id", "n")
    placed = [sorted(map(str, generate_table(spark, {"columns": columns}, key=KEY, ids=ids.repartition(n)).collect())) for n in (1, 7)]
    assert placed[0] == placed[1]


def test_names_that_differ_in_case_are_refused(spark):
    with pytest.raises(ValueError, match="same name"):
        generate_table(spark, {"rows": 1, "columns": {"P": {"function": "ahv_nr"}, "p": {"function": "ahv_nr"}}})


def test_unknown_function_is_left_out(spark):
    with pytest.warns(UserWarning):
        df = generate_table(spark, {"rows": 2, "columns": {"a": {"function": "nothing"}, "b": {"function": "ahv_nr"}}})
    assert df.columns == ["b"]


def test_check_config():
    from maskflow import check_config
    from maskflow.checks.generate_checks import WHOLE as GENERATED
    from maskflow.checks.mask_checks import WHOLE as MASKED

    assert check_config({"columns": GENERATED}) == []
    assert check_config({"columns": MASKED}, list(MASKED)) == []
    bad = {
        "a": {"function": "nothing"},
        "b": {"function": "hash"},
        "c": {"function": "first_name", "gender_field": "zz"},
        "d": {"function": "list_string", "list": ["x"], "weights": [1, 2]},
    }
    assert len(check_config({"columns": bad}, ["a", "b", "c"])) == 5
    assert check_config({}) == ["the configuration has no columns"]


def test_unique_needs_dense_ids(spark):
    config = {"columns": {"x": {"function": "random_int", "min": 0, "max": 1000, "unique": True}}}
    sparse = spark.range(0, 4000, 4).withColumnRenamed("id", "i")
    with pytest.raises(ValueError, match="each once"):
        generate_table(spark, config, key=KEY, ids=sparse)
    dense = generate_table(spark, config, key=KEY, ids=spark.range(1000).withColumnRenamed("id", "i"))
    assert dense.select("x").distinct().count() == 1000

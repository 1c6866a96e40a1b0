"""Masks on hand-written rows: nulls, consistency, layout, bijections, placement, skew."""

import re

import pytest
from pyspark.sql import functions as F

from maskflow import Lookups, mask_table, suggest_config
from maskflow.functions.stage import Stage
from maskflow.functions.text import normalise_name, split_street
from maskflow.operators.hotjoin import map_back
from maskflow.operators.masks import blank_to_null
from maskflow.operators.ranks import nth_digest, positions
from maskflow.operators.slots import build_slots, pick
from maskflow.plans.mask import plan_masks
from maskflow.streaming.stream import mask_stream

KEY = "test"


def one(spark, values, settings, kind="string", extra=None):
    """Mask one column `c` of hand-written values; returns input and output in order."""
    rows = [(i, v, *(extra[i] if extra else ())) for i, v in enumerate(values)]
    schema = f"i int, c {kind}" + (", g string" if extra else "")
    df = spark.createDataFrame(rows, schema)
    config = {"columns": {"c": {"data_type": kind, **settings}}}
    out = mask_table(df, config, key=KEY, row_key=["i"]).orderBy("i").collect()
    return [r["c"] for r in out]


PHONES = ["+41 79 174 21 45", "0041 (79) 174-21-45", "061 2674", "12345", "", None, "kein Telefon", "+41 79 174 21 45"]


def test_phone_keeps_layout_prefix_and_digits(spark):
    got = one(spark, PHONES, {"function": "phone_nr"})
    for before, after in zip(PHONES, got):
        if before is None:
            assert after is None
            continue
        assert re.sub(r"\d", "d", after) == re.sub(r"\d", "d", before)
        old, new = re.sub(r"\D", "", before), re.sub(r"\D", "", after)
        assert old[:-7] == new[:-7] and sorted(old[-7:]) == sorted(new[-7:])
    assert got[0] == got[-1]


def test_short_phones_are_counted_as_rejects(spark):
    df = spark.createDataFrame([(v,) for v in PHONES], "c string")
    status = plan_masks(df, {"columns": {"c": {"data_type": "string", "function": "phone_nr"}}}, key=KEY).status().first()
    # Two short numbers, one empty text, one without digits, and `061 2674` holds exactly seven.
    assert status["rejected"] == 3


def test_formatted_numbers_change_only_the_last_digits(spark):
    values = ["061 267 87 27", "12", "", None, "A-1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6-7-8-9"]
    got = one(spark, values, {"function": "formatted_numbers", "replace_last_digits": 4})
    assert got[0].startswith("061 267 ") and len(got[0]) == len(values[0])
    assert re.fullmatch(r"\d\d", got[1]) and got[2] == "" and got[3] is None
    assert got[4].startswith("A-1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-") and len(got[4]) == len(values[4])
    long = one(spark, values, {"function": "formatted_numbers", "replace_last_digits": 17})
    assert len(long[4]) == len(values[4]) and long[4].startswith("A-1-2-")


def test_normalise_name(spark):
    names = {
        "Zoë-Ann": "zoe.ann", "von Allmen": "von.allmen", "Straße": "strae", "Øyvind": "yvind", "O'Neil": "oneil",
        "ǆ½": "dz12", "ﬁn": "fin", "Ａｎｎａ": "anna", "": "", "日本": "", "Ærø": "r", "N°5…": "n5...",
    }
    stage = Stage(spark.createDataFrame([(n,) for n in names], "n string"))
    made = normalise_name(stage, F.col("n"))
    assert {r["n"]: r["m"] for r in stage.df.select("n", made.alias("m")).collect()} == names


def test_email(spark):
    df = spark.createDataFrame(
        [(1, "a@b", "Zoë", "von Allmen"), (2, " ", "A", "B"), (3, None, "A", "B"), (4, "x@y", " ", "B")],
        "i int, mail string, v string, n string",
    )
    settings = {"function": "email", "first_name_field": "v", "last_name_field": "n"}
    got = mask_table(df, {"columns": {"mail": {"data_type": "string", **settings}}}, key=KEY, row_key=["i"])
    mails = [r["mail"] for r in got.orderBy("i").collect()]
    assert mails[:3] == ["zoe.von.allmen@example.com", " ", None]
    assert re.fullmatch(r"[a-z]+\.[a-z]+\d{3}@example\.org", mails[3])


def test_names_keep_nulls_and_agree(spark):
    got = one(spark, ["Meier", "Meier", "", None], {"function": "last_name", "source": "ogd-bs"})
    assert got[0] == got[1] and got[0] and got[2] is None and got[3] is None
    first = {"function": "first_name", "source": "ogd-bs", "gender_field": "g", "gender_field_male_identfier": "1"}
    got = one(spark, ["Andrea", "Andrea", "Andrea", None], first, extra=[("1",), ("2",), ("1",), ("1",)])
    assert got[0] == got[2] != got[1] and got[3] is None


def test_dates(spark):
    values = ["2020-02-29T23:59:59", "2020-02-29", "2020-13-01", "bald", None]
    got = one(spark, values, {"function": "date_add_random_days", "lower": 1, "upper": 1})
    assert got == ["2020-03-01T23:59:59", "2020-03-01", None, None, None]
    df = spark.sql("select date'2020-02-29' as c, timestamp'2020-02-29 10:00:00' as t")
    days = {"data_type": "date", "function": "date_add_random_days", "lower": -3, "upper": -3}
    row = mask_table(df, {"columns": {"c": days, "t": days}}, key=KEY).first()
    assert str(row["c"]) == "2020-02-26" and str(row["t"]) == "2020-02-26 10:00:00"


def test_random_int(spark):
    settings = {"function": "random_int", "min": 5, "max": 7}
    got = one(spark, list(range(-50, 50)) + [None], settings, "int")
    assert set(got[:-1]) == {5, 6, 7} and got[-1] is None
    assert one(spark, ["12.0", "12", "1e3", "1000", "abc", "inf", "12.5", ""], settings | {}, "string")[7] is None
    df = spark.createDataFrame([(v,) for v in ["12.0", "12", "1e3", "1000", "abc", "Infinity", "12.5", ""]], "c string")
    got = mask_table(df, {"columns": {"c": {"data_type": "integer", "function": "random_int", "min": 0, "max": 10**9}}}, key=KEY)
    rows = [r["c"] for r in got.collect()]
    assert rows[0] == rows[1] and rows[2] == rows[3] and rows[4:] == [None] * 4


def test_unique_int_is_one_to_one_and_refuses_small_ranges(spark):
    values = [*range(100), 5, 5, None]
    got = one(spark, values, {"function": "random_int", "min": 1, "max": 100, "unique": True}, "int")
    assert sorted(got[:100]) == list(range(1, 101)) and got[100] == got[5] == got[101] and got[102] is None
    with pytest.raises(ValueError, match="distinct"):
        one(spark, values, {"function": "random_int", "min": 1, "max": 99, "unique": True}, "int")


def test_shuffle_codes_is_a_bijection(spark):
    values = ["a", "b", "c", "d", "a", None]
    got = one(spark, values, {"function": "shuffle_codes"})
    assert sorted(got[:4]) == ["a", "b", "c", "d"] and got[4] == got[0] and got[5] is None
    assert one(spark, ["x", "x"], {"function": "shuffle_codes"}) == ["x", "x"]
    assert one(spark, [None, None], {"function": "shuffle_codes"}) == [None, None]


def test_hash_reads_masked_columns_before_it(spark):
    df = spark.createDataFrame([("Meier", "x", "Meier")], "a string, h string, z string")
    last = {"data_type": "string", "function": "last_name", "source": "ogd-bs"}
    columns = {"a": last, "h": {"data_type": "string", "function": "hash", "hashed_columns": ["a", "z"]}, "z": last}
    row = mask_table(df, {"columns": columns}, key=KEY).select("a", "h", F.sha2(F.concat("a", F.lit("Meier")), 256).alias("want")).first()
    assert row["h"] == row["want"]
    columns["h"] = {"data_type": "string", "function": "hash", "hashed_columns": ["a"], "separator": "|", "secret": "s", "read": "input"}
    row = mask_table(df, {"columns": columns}, key=KEY).select("h", F.sha2(F.lit("sMeier"), 256).alias("want")).first()
    assert row["h"] == row["want"]


def test_random_distribution(spark):
    got = one(spark, [1.0, 2.0, 3.0, None], {"function": "fill_with_random_distribution", "decimals": 2}, "double")
    assert got[3] is None and all(isinstance(v, float) for v in got[:3])
    assert one(spark, ["a", "b"], {"function": "fill_with_random_distribution", "decimals": 2}) == [None, None]


def test_addresses_stay_in_their_area(spark):
    addresses = spark.createDataFrame(
        [("Marktgasse", n, None, 4051, "Basel") for n in range(1, 4)] + [("Einzelweg", 9, "", 4000, "Dorf")],
        "str_name string, hausnr int, hausnr_zus string, plz int, ort string",
    )
    lookups = Lookups(spark, addresses=addresses)
    rows = [("Marktgasse 12", "4051"), ("Einzelweg 9", "4000"), ("Marktgasse 12a", "4051"), ("Marktgasse 12", "9999"), (None, "4051")]
    df = spark.createDataFrame(rows, "a string, plz string")
    pair = {"data_type": "string", "function": "streetname_housenumber", "source": "ogd-bs", "plz_field": "plz"}
    got = [r["a"] for r in mask_table(df, {"columns": {"a": pair}}, lookups, KEY).collect()]
    assert re.fullmatch(r"Marktgasse [123]", got[0]) and got[1] == "Einzelweg 9"
    assert re.fullmatch(r"\w+ \d+", got[3]) and got[4] is None
    blur = {"data_type": "string", "function": "blur_address", "location_code_col": "plz", "location_data_col": "plz"}
    got = [r["a"] for r in mask_table(df, {"columns": {"a": blur}}, lookups, KEY).collect()]
    assert re.fullmatch(r"Marktgasse [123]", got[0]) and got[1] == "Einzelweg 9" and got[2] == "Marktgasse 12a" and got[4] is None


def test_split_street(spark):
    df = spark.createDataFrame([(v,) for v in ["Marktgasse 12", " Am Weg  7 ", "Marktgasse 12a", "Marktgasse", "12", None]], "a string")
    street, number = split_street(F.col("a"))
    got = [tuple(r) for r in df.select(street, number).collect()]
    assert got == [("Marktgasse", "12"), ("Am Weg", "7"), ("Marktgasse 12a", None), ("Marktgasse", None), ("12", None), (None, None)]


def test_blank_rows(spark):
    df = spark.createDataFrame([(" ", "\t", None), (" x ", "", 1), (None, None, None)], "a string, b string, n int")
    assert [tuple(r) for r in blank_to_null(df).collect()] == [(" x ", None, 1)]


def test_unknown_function_and_missing_column(spark):
    df = spark.createDataFrame([("x",)], "a string")
    config = {"columns": {"a": {"data_type": "string", "function": "nothing"}, "b": {"data_type": "string", "function": "delete"}}}
    with pytest.warns(UserWarning):
        plan = plan_masks(df, config, key=KEY)
    assert plan.frame.first()["a"] == "x" and plan.status().first()["ok"] is False


def test_odd_column_names(spark):
    df = spark.createDataFrame([("Meier", 1)], "`Mutter Geburtstag` string, `a.b` int")
    columns = {
        "Mutter Geburtstag": {"data_type": "string", "function": "last_name", "source": "ogd-bs"},
        "a.b": {"data_type": "int", "function": "random_int", "min": 3, "max": 3},
    }
    out = mask_table(df, {"columns": columns}, key=KEY)
    assert out.columns == ["Mutter Geburtstag", "a.b"] and out.first()[1] == 3


def test_result_does_not_depend_on_partitions(spark, sf_dir):
    from maskflow.checks.mask_checks import WHOLE
    from maskflow.checks.tables import people, table_lookups

    df = people(spark, sf_dir)
    lookups = table_lookups(spark, sf_dir)
    config = {"columns": WHOLE | {"code": {"data_type": "string", "function": "shuffle_codes"}}}
    results = [
        sorted(map(str, mask_table(df.repartition(n), config, lookups, KEY).collect())) for n in (1, 17)
    ]
    assert results[0] == results[1]


def test_fresh_keys_differ(spark):
    df = spark.range(200).select(F.concat(F.lit("n"), "id").alias("c"))
    config = {"columns": {"c": {"data_type": "string", "function": "ahv_nr"}}}
    assert mask_table(df, config).collect() != mask_table(df, config).collect()


def test_observed_counts(spark):
    df = spark.createDataFrame([("Meier",), (None,)], "c string")
    plan = plan_masks(df, {"columns": {"c": {"data_type": "string", "function": "last_name", "source": "ogd-bs"}}}, key=KEY)
    frame, observation = plan.observed()
    frame.write.format("noop").mode("overwrite").save()
    assert observation.get == {"c0": 1, "r0": 0}


def test_suggested_config_runs(spark):
    df = spark.createDataFrame([("Meier", "Anna", "Weg", "3", "7", "1.5", "ja", "yes")] * 3, "Name string, Vorname string, Strasse string, hnr string, n string, f string, t string, b string")
    config = suggest_config(df, "in.csv")
    assert config["columns"]["b"]["data_type"] == "boolean" and config["rows"] == 3
    row = mask_table(df, config, key=KEY).first()
    assert row["t"] == "ja" and row["b"] in ("j", "n") and 100 <= row["n"] <= 200


def test_stream_refuses_whole_table_masks(spark):
    df = spark.createDataFrame([("a",)], "c string")
    with pytest.raises(ValueError, match="whole table"):
        mask_stream(df, {"columns": {"c": {"data_type": "string", "function": "shuffle_codes"}}}, KEY)


# --- operators under the masks ------------------------------------------------------


def test_positions_equal_a_global_rank(spark):
    df = spark.range(5000).withColumn("h", F.sha2(F.col("id").cast("string"), 256)).withColumn("g", F.col("id") % 3)
    for rows in (None, 5000):
        ranks = [r["r"] for r in positions(df, F.col("h"), "r", rows=rows).orderBy("h").collect()]
        assert ranks == list(range(5000))
    grouped = positions(df, F.col("h"), "r", F.lit(2), ("g",), 3)
    got = grouped.groupBy("g").agg(F.min("r"), F.max("r"), F.count_distinct("r"), F.count("*").alias("n")).collect()
    assert all(r[1] == 0 and r[2] == 2 * (r["n"] - 1) and r[3] == r["n"] for r in got)


@pytest.mark.parametrize("n", [1, 2, 1234, 4999, 5000])
def test_nth_digest_marks_exactly_n(spark, n):
    ids = spark.range(5000)
    h = F.sha2(F.col("id").cast("string"), 256)
    assert ids.filter(h <= nth_digest(ids, h, n)).count() == n


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("max_blocks", [1 << 20, 7])
def test_pick_follows_the_weights_exactly(spark, monkeypatch, small, max_blocks):
    import dataclasses

    from maskflow.operators import ranks

    lookup = spark.createDataFrame([("a", "x", 1), ("a", "y", 29), ("b", "z", 70), ("b", "w", 0)], "g string, v string, n int")
    monkeypatch.setattr(ranks, "SMALL_ROWS", 100_000 if small else 0)
    slots = dataclasses.replace(build_slots(lookup, ["v"], weight=F.col("n"), max_blocks=max_blocks), small=small)
    assert slots.total == 100 and slots.width == (1 if max_blocks > 100 else 15)
    got = pick(spark.range(300), slots, F.col("id"), "p").groupBy("p.v").count().collect()
    assert {r["v"]: r["count"] for r in got} == {"x": 3, "y": 87, "z": 210}
    grouped = dataclasses.replace(build_slots(lookup, ["v"], F.col("g"), F.col("n"), max_blocks), small=small)
    df = spark.range(300).withColumn("g", F.when(F.col("id") < 60, "a").when(F.col("id") < 200, "b").when(F.col("id") < 250, "c"))
    got = pick(df, grouped, F.col("id"), "p", F.col("g")).groupBy("g", "p.v").count().collect()
    counts = {(r["g"], r["v"]): r["count"] for r in got}
    assert counts == {("a", "x"): 2, ("a", "y"): 58, ("b", "z"): 140, ("c", None): 50, (None, None): 50}


def test_hot_values_are_mapped_without_a_shuffle(spark):
    # A third of all rows holds one value, a third is null, the rest is spread.
    df = spark.range(9000).withColumn(
        "v", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("c"), F.col("id")))
    )
    mapping = df.filter("v is not null").groupBy(F.col("v").alias("old")).agg(F.count("*").alias("n"))
    mapping = mapping.withColumn("new", F.concat(F.lit("new-"), "old"))
    want = {(r["id"], None if r["v"] is None else "new-" + r["v"]) for r in df.collect()}
    for small in (True, False):
        got = map_back(df, F.col("v"), mapping, 6000, small, "m")
        assert got.columns == ["id", "v", "m"]
        assert {(r["id"], r["m"]) for r in got.collect()} == want


def test_large_lookups_and_mappings_give_the_same_rows(spark, sf_dir, monkeypatch):
    """The ways beyond the size limits: shuffle joins, blocks of several integers, ranks by bucket."""
    from maskflow.checks.mask_checks import WHOLE
    from maskflow.checks.tables import people, table_lookups
    from maskflow.operators import masks, ranks, slots

    df = people(spark, sf_dir)
    columns = WHOLE | {
        "code": {"data_type": "string", "function": "shuffle_codes"},
        "nummer": {"data_type": "integer", "function": "random_int", "min": 0, "max": 9999, "unique": True},
    }

    def run():
        return mask_table(df, {"columns": columns}, table_lookups(spark, sf_dir), KEY, ["id"])

    want = sorted(map(str, run().collect()))
    monkeypatch.setattr(slots, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(masks, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(ranks, "SMALL_ROWS", 0)
    monkeypatch.setattr(slots.build_slots, "__defaults__", (None, None, 50))
    assert sorted(map(str, run().collect())) == want


def test_expression_masks_and_redaction_do_not_shuffle(spark, sf_dir):
    from __spark_entry__ import queries

    for name in ("mask_phone_nr", "mask_ahv_nr", "mask_date_text", "mask_email_library", "redact_documents", "mask_phones", "generate_random_int_unique"):
        plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan, name
    plan = queries()["mask_table"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_unique_integers_depend_on_the_key_and_know_no_widest_range(spark):
    df = spark.createDataFrame([(str(i),) for i in range(200)], "c string")
    settings = {"data_type": "string", "function": "random_int", "min": 0, "max": 10**12, "unique": True}
    sets = [{r["c"] for r in mask_table(df, {"columns": {"c": settings}}, key=key).collect()} for key in ("k1", "k2")]
    assert len(sets[0]) == len(sets[1]) == 200 and len(sets[0] & sets[1]) < 5


def test_large_mappings_scan_the_table_once(spark, tmp_path, monkeypatch):
    from maskflow.operators import masks

    monkeypatch.setattr(masks, "BROADCAST_BYTES", -1)
    rows = [(f"v{i % 7}" if i % 3 else "hot", None if i % 2 else f"w{i % 50}", i) for i in range(6000)]
    spark.createDataFrame(rows, "a string, b string, i int").write.parquet(f"{tmp_path}/t")
    codes = {c: {"data_type": "string", "function": "shuffle_codes"} for c in ("a", "b")}
    masked = mask_table(spark.read.parquet(f"{tmp_path}/t"), {"columns": codes}, key=KEY)
    plan = masked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [a#") == 1
    got = {r.i: (r.a, r.b) for r in masked.collect()}
    assert len(got) == 6000
    for place in (0, 1):
        pairs = {(r[place], got[r[2]][place]) for r in rows}
        assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs}) and {p[0] for p in pairs} == {p[1] for p in pairs}


def test_constant_groups_join_by_key(spark):
    config = {"columns": {"area": {"function": "list_string", "list": ["K2"]}, "plz": {"function": "plz4", "canton_field": "area", "canton_field_version": "kanton_name_kurz"}}}
    from maskflow.plans.generate import generate_table

    plan = generate_table(spark, config, key=KEY, rows=50)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hot_values_are_dealt_over_copies_of_a_lookup(spark):
    from maskflow.operators.hotjoin import row_hash, salted_join

    df = spark.range(9000).withColumn("v", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("c"), F.col("id") % 50)))
    table = df.where("v is not null").select(F.col("v").alias("old")).distinct().withColumn("new", F.concat(F.lit("new-"), "old"))
    got = salted_join(df, table, F.col("v") == F.col("old"), 16)
    assert got.columns == ["id", "v", "old", "new"]
    assert {(r.id, r.new) for r in got.collect()} == {(r.id, r.v and f"new-{r.v}") for r in df.collect()}
    most = df.groupBy("v", F.pmod(row_hash(df), F.lit(16))).count().agg(F.max("count")).first()[0]
    assert most < 1.4 * 3000 / 16


def test_few_groups_of_a_large_lookup_are_broadcast(spark):
    lookup = spark.createDataFrame([("M" if k % 2 else "F", f"name {k}", 1 + k % 7) for k in range(3000)], "g string, v string, n int")
    slots = build_slots(lookup, ["v"], F.col("g"), F.col("n"), broadcast_bytes=2000)
    assert not slots.small and slots.few_groups and 8 <= slots.copies <= 64
    df = spark.range(500).withColumn("g", F.when(F.col("id") % 3 > 0, "M"))
    plan = pick(df, slots, F.col("id"), "p", F.col("g"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 1

"""Plans and rows that only larger tables show."""

import shutil
from dataclasses import replace

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from maskflow.checks.source_checks import lines_of_one_file
from maskflow.llm import html, simhash
from maskflow.operators.hotjoin import salted_join
from maskflow.operators.ranks import positions
from maskflow.operators.slots import COPIES, build_slots, pick, slots_in_order
from maskflow.plans.generate import generate_table
from maskflow.plans.mask import mask_table
from maskflow.sources.files import read_csv
from maskflow.sources.lookups import Lookups


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_copies_of_a_lookup_are_never_broadcast(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, v string")
    table = spark.createDataFrame([("a", "x")], "old string, new string")
    got = salted_join(df, table, F.col("v") == F.col("old"), COPIES, F.col("v").isNull())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted((r.id, r.new) for r in got.collect()) == [(1, "x"), (2, None), (3, None)]


def test_copies_do_not_grow_with_the_room_for_them(spark):
    lookup = spark.createDataFrame([(f"name {k}", 1) for k in range(300)], "v string, n int")
    assert build_slots(lookup, ["v"], weight=F.col("n"), broadcast_bytes=0).copies == COPIES == 8


def test_few_rows_of_large_weights_need_few_blocks(spark):
    lookup = spark.createDataFrame([("x", 1), ("y", 1_999_998), ("z", 1)], "v string, n int")
    slots = build_slots(lookup, ["v"], weight=F.col("n"))
    assert slots.small and slots.table.count() <= 4096
    got = pick(spark.range(0, 2_000_000), slots, F.col("id"), "p", position=True).groupBy("p.v").count().collect()
    assert {r["v"]: r["count"] for r in got} == {"x": 1, "y": 1_999_998, "z": 1}


def test_ordered_groups_of_many_rows_need_few_blocks(spark):
    counts = spark.createDataFrame([(k, 900_000) for k in range(10)], "place long, n long")
    slots = slots_in_order(counts, "place", "n", 10, 9_000_000)
    assert slots.small and slots.table.count() <= 4096


def merges(df):
    """Both sides of every merge join with a lookup: the columns that are shuffled, the digests among them, and the types."""
    found, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        below = [node.children().apply(k) for k in range(node.children().size())]
        todo += below
        if node.nodeName() == "Join" and "merge" in node.hint().toString():
            found.append([shuffled(side) for side in below])
    return found


def shuffled(side):
    columns = {c.toString(): c.dataType().simpleString() for c in (side.output().apply(k) for k in range(side.output().size()))}
    todo, digests = [side], set()
    while todo:
        node = todo.pop()
        todo += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Project":
            made = [node.projectList().apply(k).toString() for k in range(node.projectList().size())]
            digests |= {m.rsplit(" AS ", 1)[1] for m in made if m.startswith("sha2(")}
    return sorted(digests & set(columns)), " ".join(columns.values())


def generated_numbers(spark, lookups):
    places = {"function": "random_int", "min": 4051, "max": 4059}
    roads = {"function": "list_string", "list": ["Bachstrasse", "Ahornweg", "Nirgendweg"]}
    number = {"function": "housenumber", "plz_field": "p", "streetname_field": "s"}
    return generate_table(spark, {"columns": {"s": roads, "p": places, "x": number}}, lookups, "key", spark.range(3000))


def masked(spark, lookups, columns):
    people = spark.range(3000).selectExpr(
        "id", "concat('Weg ', id % 7, ' ', id % 5) AS adresse", "IF(id % 6 = 0, NULL, 'Hauptgasse') AS strasse",
        "IF(id % 9 = 0, NULL, cast(4051 + id % 8 AS string)) AS plz", "concat('n', id % 50) AS nachname",
    )
    return mask_table(people, {"columns": columns}, lookups, "key", ["id"])


ADDRESS_MASK = {"function": "streetname_housenumber", "source": "ogd-bs", "plz_field": "plz"}
STREET_MASK = {"function": "street", "plz_field": "plz"}


def moves_little(spark, made, values):
    expected = sorted(map(str, made(spark, Lookups(spark)).collect()))
    for limit in (0, 100_000):  # totals by area are shuffled, or broadcast
        df = made(spark, Lookups(spark, broadcast_bytes=limit))
        sides = merges(df)
        assert sides and all(digests == [] for pair in sides for digests, _ in pair)
        looked_up = [kinds for _, (_, kinds) in sides if "struct<" in kinds]
        assert looked_up and all(values in kinds for kinds in looked_up)
        assert sorted(map(str, df.collect())) == expected


def test_house_numbers_move_no_digest_and_no_other_value(spark):
    moves_little(spark, generated_numbers, "struct<hausnr:int,hausnr_zus:string>")


def test_ranked_rows_of_known_groups_are_not_broadcast(spark):
    df = spark.range(900).selectExpr("sha2(cast(id % 800 AS string), 256) AS h", "concat('g', id % 7) AS g", "id % 3 + 1 AS w")
    kept, old = (positions(df, F.col("h"), "r", F.col("w"), ("g",), no_nulls=n) for n in (True, False))
    assert "strategy=merge" in optimized(kept)
    by_digest = [sorted(map(str, d.groupBy("g", "h").agg(F.sum("w"), F.min("r")).collect())) for d in (kept, old)]
    assert by_digest[0] == by_digest[1] and len(by_digest[0]) > 800


def test_rows_with_draws_of_their_own_need_few_copies(spark):
    lookup = spark.range(0, 64).selectExpr("id AS v", "IF(id < 60, 'many', 'few') AS g")
    slots = build_slots(lookup, ["v"], F.col("g"), broadcast_bytes=0)
    need = slots.totals.select("__slot_group", slots.copies_for("__slot_total")).collect()
    assert dict(map(tuple, need)) == {"many": 1, "few": 2}
    rows = spark.range(600).withColumn("g", F.expr("element_at(array('many', 'few', 'none', NULL), cast(id % 4 + 1 AS int))"))
    kept, copied = (pick(rows, s, F.col("id"), "p", F.col("g"), even=e) for s, e in ((slots, True), (replace(slots, small=True), False)))
    assert sorted(map(str, kept.collect())) == sorted(map(str, copied.collect()))
    assert "sequence(0, 7" not in optimized(kept) and "[0,1,2,3,4,5,6,7]" not in optimized(kept)


def test_masked_addresses_move_no_digest_and_no_other_value(spark):
    moves_little(spark, lambda s, l: masked(s, l, {"adresse": ADDRESS_MASK}), "struct<str_name:string,hausnr:int,hausnr_zus:string>")


def test_ranked_rows_move_no_digest(spark):
    df = spark.range(900).selectExpr("cast(id % 800 AS string) AS v", "concat('g', id % 7) AS g")
    ranked = positions(df, F.sha2(F.col("v"), 256), "r", F.lit(2), ("g",), no_nulls=True)
    todo, dealt = [ranked._jdf.queryExecution().optimizedPlan()], []
    while todo:
        node = todo.pop()
        todo += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "RepartitionByExpression":
            dealt.append(shuffled(node)[0])
    assert dealt == [[]]


def test_a_shuffled_lookup_is_copied_only_where_spark_cuts_no_joins(spark, monkeypatch):
    copies = []
    monkeypatch.setattr("maskflow.operators.slots.salted_join", lambda d, t, same, salts, *a: (copies.append(salts), salted_join(d, t, same, salts, *a))[1])
    rows = spark.range(40_000).selectExpr("id", "IF(id % 10 = 0, id, 7) AS d", "IF(id % 6 = 0, NULL, 'g') AS g")
    lookup = spark.range(30_000).selectExpr("id AS v", "'g' AS g")
    expected = sorted(map(str, pick(rows, build_slots(lookup, ["v"], F.col("g")), F.col("d"), "p", F.col("g")).collect()))
    slots = build_slots(lookup, ["v"], F.col("g"), broadcast_bytes=0)
    settings = {"skewJoin.skewedPartitionThresholdInBytes": "10k", "skewJoin.skewedPartitionFactor": "1", "advisoryPartitionSizeInBytes": "10k", "enabled": "true"}
    try:
        for name, value in settings.items():
            spark.conf.set(f"spark.sql.adaptive.{name}", value)
        for cut in (True, False):
            spark.conf.set("spark.sql.adaptive.skewJoin.enabled", str(cut).lower())
            got = pick(rows.repartition(8), slots, F.col("d"), "p", F.col("g"))
            assert set(copies) == ({1} if cut else {COPIES})
            copies.clear()
            assert sorted(map(str, got.collect())) == expected
            assert ("skew=true" in got._jdf.queryExecution().executedPlan().toString()) == cut
    finally:
        for name in [*settings, "skewJoin.enabled"]:
            spark.conf.unset(f"spark.sql.adaptive.{name}")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_masked_streets_move_no_digest_and_no_other_value(spark):
    moves_little(spark, lambda s, l: masked(s, l, {"strasse": STREET_MASK}), "struct<str_name:string>")


def test_a_masked_table_moves_no_digest(spark):
    columns = {"nachname": {"function": "last_name", "source": "ogd-bs"}, "adresse": ADDRESS_MASK, "strasse": STREET_MASK}
    moves_little(spark, lambda s, l: masked(s, l, columns), "struct<")


def test_blurred_addresses_move_no_digest(spark):
    blur = {"function": "blur_address", "location_code_col": "plz", "location_data_col": "plz"}
    moves_little(spark, lambda s, l: masked(s, l, {"adresse": blur}), "")


@pytest.mark.parametrize("name", ["generate_incremental_date", "generate_table", "generate_table_shuffled"])
def test_dates_past_9999_are_null_as_in_the_sql(spark, sf_dir, tmp_path, name):
    for path in ("part", "supplier"):
        shutil.copy(f"{sf_dir}/{path}.parquet", tmp_path / f"{path}.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").limit(40).withColumn("o_orderkey", F.col("o_orderkey") * 150_000)
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    ids = str(tmp_path / "orders.parquet" / "*.parquet")
    con = connect(sf_dir)
    con.execute(f"CREATE OR REPLACE VIEW orders AS SELECT * FROM '{ids}'")
    assert compare(spark, con, queries()[name], oracle_sql()[name], str(tmp_path)) == ""


def test_records_of_many_layouts_are_parsed_once_a_separator(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,z\n1,2,3\n")
    (tmp_path / "b.csv").write_text("z,x,y\n6,4,5\n")
    df = read_csv(spark, str(tmp_path / "*.csv"))
    assert optimized(df).count("from_csv") <= 2  # for the cells, and for the check of long records
    assert sorted(map(tuple, df.select("x", "y", "z").collect())) == [("1", "2", "3"), ("4", "5", "6")]


def test_the_lines_of_one_file_are_not_sorted(spark):
    records = spark.createDataFrame([("1,a\nb",), ("2,c",)], "record string").repartition(2)
    df = lines_of_one_file(records, "id,text")
    assert "Sort" not in optimized(df) and df.columns == ["id,text"] and df.rdd.getNumPartitions() == 1
    assert [r[0] for r in df.collect()] in (["1,a", "b", "2,c"], ["2,c", "1,a", "b"])


def test_elements_shared_with_the_nearest_page_go(spark):
    def page(title, text, teaser="<article><h2>Read this</h2>now</article>"):
        return f"<main><p>Home</p><article><h1>{title}</h1><p>{text}</p></article>{teaser}</main>"

    rows = [(1, "http://h/a/1", page("Same title", "first")), (2, "http://h/a/2", page("Same title", "second")), (3, "http://g/a", page("t", "copy")), (4, "http://g/b", page("t", "copy"))]
    out = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "Home\nt\ncopy\nRead this\nnow"
    assert out == {1: "Same title\nfirst", 2: "Same title\nsecond", 3: whole, 4: whole}


def test_the_stage_links_what_the_grid_links(spark):
    def text(k):
        return "one two three " * 400 + " ".join(f"w{k}x{n}" for n in range(30))

    docs = spark.createDataFrame([(5, text(1)), (6, text(2)), (7, "something else " + text(3)[-150:])], "doc_id long, text string")
    components = {r.doc_id: r.component_id for r in simhash.label(docs).collect()}
    assert components == {5: 5, 6: 5, 7: 7}
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == [5, 7]

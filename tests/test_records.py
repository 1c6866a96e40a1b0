"""CSV records over splits against Spark's whole-file reader, and folders of many layouts."""

import random

import pytest
from pyspark.sql import functions as F

from maskflow.sources.files import read_csv, read_delimited_documents
from maskflow.sources.records import ALWAYS_IN, ALWAYS_OUT, KEEP, SWAP, line_effect, read_lines


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes, so that records cross them in every way."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionNum") if spark.conf.get(k, None)}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)


def whole(spark, path):
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).collect()
    return sorted((tuple(v or None for v in r) for r in rows), key=str)


def cell(draw, separator):
    kind = draw.random()
    if kind < 0.4:
        return "".join(draw.choice("abc é") for _ in range(draw.randrange(6))).strip(" ")
    if kind < 0.5:
        return f'{draw.randrange(99)}" wide'  # a quote that is plain text
    text = "".join(draw.choice(["x", "\n", "\n\n", '""', separator, "ü", "y" * draw.randrange(40)]) for _ in range(draw.randrange(1, 60 if kind > 0.97 else 7)))
    return f'"{text}"'


@pytest.mark.parametrize(("size", "end", "seed"), [(97, "\n", 1), (250, "\r\n", 2), (600, "\n", 3)])
def test_splits_give_the_same_cells(spark, tmp_path, small_splits, size, end, seed):
    draw = random.Random(seed)
    for name in "abc":
        rows = ["id,one,two"] + [",".join([str(k), cell(draw, ","), cell(draw, ",")]) for k in range(50)]
        if name == "b":
            rows.append('7,"never closed\nat all')
        (tmp_path / f"{name}.csv").write_bytes(end.join(rows).replace("\r\n", end).encode() + end.encode())
    want = whole(spark, str(tmp_path))
    small_splits(size)
    assert read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 6
    got = read_csv(spark, str(tmp_path), keep_missing_texts=True)
    assert got.columns == ["id", "one", "two"]
    rows = sorted((tuple(v or None for v in r) for r in got.collect()), key=str)
    # The cell that is never closed ends at the end of its file; the last line break belongs to it or not.
    strip = lambda found: [tuple(v and v.rstrip("\n") or None for v in r) for r in found]
    assert sorted(strip(rows), key=str) == sorted(strip(want), key=str) and len(rows) == 151


def test_cell_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f"line {k}" for k in range(300))
    (tmp_path / "x.csv").write_text(f'a,b\n1,"{long}"\n2,"{long} ""q"""\n3,plain\n')
    small_splits(300)
    assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path)).collect()) == [("1", long), ("2", f'{long} "q"'), ("3", "plain")]


def test_joins_beyond_the_broadcast(spark, tmp_path, small_splits, monkeypatch):
    from maskflow.sources import records

    draw = random.Random(5)
    (tmp_path / "x.csv").write_text("\n".join(["id,one,two"] + [",".join([str(k), cell(draw, ","), cell(draw, ",")]) for k in range(60)]) + "\n")
    want = whole(spark, str(tmp_path))
    monkeypatch.setattr(records, "BROADCAST_BYTES", 0)
    small_splits(300)
    assert sorted((tuple(v or None for v in r) for r in read_csv(spark, str(tmp_path), keep_missing_texts=True).collect()), key=str) == want


def test_line_effects(spark):
    cases = [
        ("a,b", KEEP), ('"a","b"', ALWAYS_OUT), ('1,"a', ALWAYS_IN), ('end",2', ALWAYS_OUT), ('"', SWAP), ('5" x', ALWAYS_OUT), ('a""b', KEEP), ('""', KEEP),
        ('"a""', ALWAYS_IN), ('x","y', ALWAYS_IN), ("", KEEP), ('say ""hi""', KEEP), ('"say ""hi"""', ALWAYS_OUT), (',"', SWAP), ('x,"",y', ALWAYS_IN),
    ]
    rows = spark.createDataFrame(cases, "line string, want int").withColumn("got", line_effect(F.col("line"), lambda p: F.endswith(p, F.lit(",")))).collect()

    def end(line, inside):
        state, before = ("in" if inside else "start"), ""
        for c in line:
            if c == '"':
                state = {"in": "closed", "closed": "in", "start": "in"}.get(state, "in" if before == "," else "out")
            elif state != "in":
                state = "out"
            before = c
        return state == "in"

    for r in rows:
        assert r.got == end(r.line, False) + 2 * end(r.line, True), r
    assert {r.got for r in rows} == {ALWAYS_OUT, SWAP, KEEP, ALWAYS_IN}


def test_many_layouts_in_one_scan(spark, tmp_path):
    draw, want = random.Random(1), set()
    for k in range(60):
        names = [f"c{i}" for i in range(6)]
        draw.shuffle(names)
        names = names[: 3 + k % 4]
        separator = ",;\t"[k % 3]
        value = {n: f"{n}ö{separator}{k}" for n in names}
        text = separator.join(names) + "\n" + separator.join(f'"{value[n]}"' for n in names) + "\n"
        (tmp_path / f"f{k:03d}.csv").write_bytes(text.encode("latin-1" if k % 2 else "utf-8"))
        want.add(tuple(value.get(f"c{i}") for i in range(6)))
    got = read_csv(spark, str(tmp_path))
    assert {tuple(r) for r in got.select(*[f"c{i}" for i in range(6)]).collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [value") == 1
    assert "Union" not in plan


def test_layouts_may_differ_in_case_and_repeat_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Id,x,x,\n1,a,b,c\n")
    (tmp_path / "b.csv").write_text("ID;y\n2;d\n")
    got = read_csv(spark, str(tmp_path))
    assert got.columns == ["Id", "x1", "x2", "_c3", "y"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == [("1", "a", "b", "c", None), ("2", None, None, None, "d")]


def test_surplus_cells_in_records(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"x\ny"\n2\n3,y,extra\n4,"p,q"\n5,,,z\n\n6,"5"" x\n",,\n')
    with pytest.raises(Exception, match="more cells than the header"):
        read_csv(spark, str(tmp_path)).count()
    got = {(r["a"], r["b"], r["rest"]) for r in read_csv(spark, str(tmp_path), surplus="rest").collect()}
    assert got == {("1", "x\ny", None), ("2", None, None), ("3", "y", "3,y,extra"), ("4", "p,q", None), ("5", None, "5,,,z"), ("6", '5" x\n', '6,"5"" x\n",,')}


def test_breaks_behind_stray_quotes_are_noticed(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,c\n5",6","one\ntwo"\n7,8,9\n')
    assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path)).collect()) == [('5"', '6"', "one\ntwo"), ("7", "8", "9")]


def test_delimited_documents_with_breaks(spark, tmp_path, small_splits):
    (tmp_path / "t.tab").write_text("a\tb\n" + "".join(f'{k}\t"one\ntwo {k}"\n' for k in range(50)))
    small_splits(90)
    assert sorted(r["text"] for r in read_delimited_documents(spark, str(tmp_path), tab=True).collect()) == sorted(f"{k} one\ntwo {k}" for k in range(50))

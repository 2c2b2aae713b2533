import pathlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rollcall.session import scratch_path
from rollcall.sources import delimited, jsonlines, parquet, stored, tables as tb


@pytest.fixture
def folder(tmp_path):
    return lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_delimited(spark, folder):
    path = folder("a.csv", "﻿ a ,b,,c\n1,\"x, \"\"y\"\"\",drop,3\n\n,,,\n4,,gone,NULL\n")
    df = delimited.read_delimited(spark, path)
    assert df.columns == ["a", "b", "c"]
    assert rows(df) == [("1", 'x, "y"', "3"), ("4", None, "NULL")]
    tab = folder("b.txt", "a\tb\n1\t2\n")
    assert rows(delimited.read_delimited(spark, tab)) == [("1", "2")]


def test_bad_lines(spark, folder):
    path = folder("a.csv", "a,b\n1,2\n3\n4,5,6\n")
    with pytest.raises(PySparkException, match="bad line"):
        delimited.read_delimited(spark, path).collect()
    assert rows(delimited.read_delimited(spark, path, skip_bad_lines=True)) == [("1", "2")]
    assert rows(delimited.read_delimited(spark, path, relax=True)) == [("1", "2"), ("3", None), ("4", "5")]


def test_skip(spark, folder):
    path = folder("a.csv", "a report\nof things\na,b\n1,2\n3,4\n")
    df = delimited.read_delimited(spark, path, skip=3)
    assert df.columns == ["a", "b"] and rows(df.where("a > 0")) == [("1", "2"), ("3", "4")]


def test_json5(spark, folder):
    path = folder("a.jsonl", "{a: 'x', \"b\": 1}\n{'a': \"y\", /* note */ b: 2}\n{a:'z'}\n")
    assert rows(jsonlines.read_jsonl(spark, path, "a string, b int")) == [("x", 1), ("y", 2), ("z", None)]


def test_json_header(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text('["a","c"]\n["x",1]\n["y",2]\n')
    (tmp_path / "two.jsonl").write_text('["c","b","a"]\n[3,"B","z"]\n["a","c","names again"]\n')
    df = jsonlines.read_jsonl_header(spark, str(tmp_path))
    assert df.columns == ["a", "c", "b"]
    assert rows(df) == [("names again", "a", "c"), ("x", "1", None), ("y", "2", None), ("z", "3", "B")]


def test_parquet_names(spark):
    path = scratch_path(spark, "p")
    spark.createDataFrame([(1, "x")], "id int, `Upper Case Content` string").write.parquet(path)
    assert parquet.read_parquet(spark, path, ["upper_case_content"]).first().upper_case_content == "x"
    assert parquet.read_parquet(spark, path, ["Upper Case Content", "id"], limit=1).columns == ["Upper Case Content", "id"]
    with pytest.raises(ValueError, match="no column"):
        parquet.read_parquet(spark, path, ["lower"])


def test_paths(spark):
    good = "00000000-0000-4000-8000-000000000001"
    df = spark.createDataFrame(
        [(f"s3://b/{good}/stored/{good}/f.csv",), (f"s3://b/src%3Aremote1/stored/{good}/f.csv",)], "_file string"
    )
    got = stored.input_from_path(df).collect()
    assert got[0].input_id == good and got[0].plugin_id == good
    assert got[1].plugin_id is None and got[1].remote_plugin_id == "remote1"
    with pytest.raises(PySparkException, match="not an input id"):
        stored.input_from_path(spark.createDataFrame([("/a/b/c/d/e",)], "_file string")).collect()


def test_choose_tables():
    names = ["person", "person_email", "temp_x", "input"]
    assert tb.choose_tables(names) == ["person", "person_email", "input"]
    assert tb.choose_tables(names, patterns=["^PERSON"], exclude=["person"]) == ["person_email"]
    assert tb.choose_tables(names, include=["input"]) == ["input"]


def test_sync_refuses_without_a_date(spark):
    with pytest.raises(ValueError, match="no date column"):
        tb.sync_table(spark.range(3), scratch_path(spark, "s"), start="-1d")


def test_append_files(spark):
    path, table = scratch_path(spark, "t"), "t_" + scratch_path(spark, "n").rsplit("-", 1)[1]
    make = lambda n: spark.createDataFrame([(str(k), "x", "2024-01-01") for k in range(n)], "a string, B string, `c d` string")
    tb.create_and_load(make(4), table, path=path)
    for _ in range(2):
        tb.load_table(make(4).withColumnsRenamed({"B": "b", "c d": "c_d"}), table)
    got = spark.table(table)
    assert got.count() == 12 and [f.dataType.simpleString() for f in got.schema.fields] == ["bigint", "string", "date"]


def test_identified(spark):
    df = spark.createDataFrame(
        [("01890000-0000-7000-8000-000000000000", "2024-01-01", 1, 2, 3, "A@X.org", "7", "1.5", "gone")],
        "id string, ts string, entry_type_id int, person_id int, source_code_id int, email string, n string, d string, source_code string",
    )
    path = scratch_path(spark, "i")
    done = parquet.write_identified(df, path)
    got = spark.read.parquet(path)
    kinds = {f.name: f.dataType.simpleString() for f in got.schema.fields}
    assert list(kinds)[:6] == ["id", "ts", "entry_type_id", "person_id", "source_code_id", "email_domain"]
    assert kinds["n"] == "bigint" and kinds["d"] == "double" and "source_code" not in kinds
    assert done.records == 1 and got.first().email_domain == "x.org"


def test_nothing_is_left_in_the_repository():
    root = pathlib.Path(__file__).resolve().parent.parent
    assert not [p for p in root.rglob("*.parquet")]


def test_relaxed_lines_equal_their_strict_twins(spark, tmp_path):
    relaxed = tmp_path / "relaxed.jsonl"
    strict = tmp_path / "strict.jsonl"
    relaxed.write_text(
        "{a: 'x, }', b: +1, c: [1, +2.5,], /* , } */ d: {e: +0.5 , },}\n"
        '{"a": "+1, ] \\" ,}", "b": -2, "c": [], "d": {"e": 1e+3,},  }\n'
        "\n"
        "{'a': 'it\\'s ,]', b: +30 , c: [+7 ,], d: null, } // , }\n"
    )
    strict.write_text(
        '{"a": "x, }", "b": 1, "c": [1, 2.5], "d": {"e": 0.5}}\n'
        '{"a": "+1, ] \\" ,}", "b": -2, "c": [], "d": {"e": 1000}}\n'
        '{"a": "it\'s ,]", "b": 30, "c": [7], "d": null}\n'
    )
    schema = "a string, b int, c array<double>, d struct<e: double>"
    want = rows(jsonlines.read_jsonl(spark, str(strict), schema))
    assert rows(jsonlines.read_jsonl(spark, str(relaxed), schema)) == want and len(want) == 3
    found = jsonlines.read_jsonl(spark, str(relaxed))
    assert found.columns == ["a", "b", "c", "d"] and {r.b for r in found.collect()} == {1, -2, 30}
    header = tmp_path / "header.jsonl"
    header.write_text("['a', 'b',]\n[+1, 'x,]',]\n")
    assert rows(jsonlines.read_jsonl_header(spark, str(header))) == [("1", "x,]")]


def test_compacted_copy_stays_small_and_repeats_write_nothing(spark, tmp_path):
    import os

    path = str(tmp_path / "copy")
    state = {k: (k, f"v{k}", 0) for k in range(60)}

    def copy(changes):
        table = spark.createDataFrame(list(changes), "k long, v string, n int")
        return tb.sync_compacted(table, path, ["k"], ["n"], buckets=2)

    def files():
        return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))

    copy(state.values())
    for n in range(1, 7):
        changed = {k: (k, f"v{k}-{n}", n) for k in range(n, 60, 6)} | {100 + n: (100 + n, "new", n)}
        state |= changed
        copy(changed.values())
    assert sorted(map(tuple, tb.current_compacted(spark, path, ["k"], ["n"]).collect())) == sorted(state.values())
    base, changes = tb._layers(spark, path)
    assert changes.count() <= tb.MOST_CHANGED * base.count() + 1  # reading is bounded by the base
    assert base.count() > 60  # merges took place
    before = files()
    copy(list(state.values())[:20])
    copy([(1, "old", -5)])  # an older version does not come back
    assert files() == before
    copy([])
    assert sorted(map(tuple, tb.current_compacted(spark, path, ["k"], ["n"]).collect())) == sorted(state.values())
    with pytest.raises(Exception, match="without a key"):
        copy([(None, "x", 1)])

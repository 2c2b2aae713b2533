import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rollcall.operators import chain, clean, merge, profile as pr, resources, segments, timeline as tl
from rollcall.session import scratch_path


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# --- merge ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "id int, name string, size int")


@pytest.mark.parametrize("few", [False, True])
def test_upsert(spark, target, few):
    incoming = spark.createDataFrame([(2, "old", 1), (2, None, 2), (4, "d", 1)], "id int, name string, seq int")
    got = rows(merge.upsert(target, incoming, ["id"], ["seq"], few))
    # The last row wins even where it says null; size is not supplied and stays.
    assert got == [(1, "a", 10), (2, None, 20), (3, "c", 30), (4, "d", None)]


@pytest.mark.parametrize("few", [False, True])
def test_upsert_stamps(spark, few):
    old = dt.datetime(2020, 1, 1)
    target = spark.createDataFrame([(1, 1, old, old), (2, 2, old, old)], "id int, v int, created_at timestamp, modified_at timestamp")
    incoming = spark.createDataFrame([(2, 9, old), (3, 3, old)], "id int, v int, modified_at timestamp")
    got = {r.id: r for r in merge.upsert(target, incoming, ["id"], [], few).collect()}
    assert (got[1].created_at, got[1].modified_at) == (old, old)
    assert got[2].v == 9 and got[2].created_at == old and got[2].modified_at > old
    assert got[3].created_at > old and got[3].modified_at > old


def test_insert_ignore(spark, target):
    incoming = spark.createDataFrame([(2, "x"), (5, "y"), (5, "y")], "id int, name string")
    assert rows(merge.insert_ignore(target, incoming, ["id"]), "id", "name") == [(1, "a"), (2, "b"), (3, "c"), (5, "y")]
    pairs = spark.createDataFrame([("s", 1)], "segment_id string, person_id int")
    more = spark.createDataFrame([("s", 1), ("s", 2), ("s", 2)], "segment_id string, person_id int")
    assert rows(merge.insert_ignore(pairs, more, ["segment_id", "person_id"])) == [("s", 1), ("s", 2)]


def test_upsert_files_rewrites_only_what_it_touches(spark):
    path = scratch_path(spark, "t")
    part = F.concat(F.lit("p"), (F.col("id") % 3).cast("string"))
    schema = "id int, v string"
    merge.upsert_files(path, spark.createDataFrame([(k, "old") for k in range(9)], schema), ["id"], part)
    before = {r.f for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}
    for _ in range(2):
        merge.upsert_files(path, spark.createDataFrame([(1, "new"), (10, "new")], schema), ["id"], part)
    stored = spark.read.parquet(path)
    assert rows(stored.where("v = 'new'"), "id") == [(1,), (10,)] and stored.count() == 10
    after = {r.f for r in stored.select(F.input_file_name().alias("f")).distinct().collect()}
    assert {f for f in before if "part=p-p1" not in f} == {f for f in after if "part=p-p1" not in f}


def test_new_rows(spark):
    old = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    new = spark.createDataFrame([(1, None), (1, "x"), (1, "x"), (3, "c")], "a int, b string")
    assert rows(merge.new_rows(new, old)) == [(1, "x"), (3, "c")]
    assert rows(merge.new_rows(new, old, ["a"])) == [(3, "c")]


# --- clean ----------------------------------------------------------------------------


def test_coerce(spark):
    df = spark.createDataFrame(
        [("$1,200", "12.345", "yes", "1/2/2024", "abcdef", "red"), ("NULL", "junk", "2", "NULL", "", "mauve"), ("", "", "no", "soon", None, None)],
        "n string, d string, b string, t string, s string, e string",
    )
    schema = {
        "n": {"type": "int", "nullable": False}, "d": "currency", "b": "boolean", "t": "date",
        "s": {"type": "text", "length": 3}, "e": {"type": "enum", "values": ["red"]},
    }
    got = [tuple(r) for r in clean.coerce(df, schema, "cut").collect()]
    assert got[0][0] == 1200 and str(got[0][1]) == "12.35" and got[0][2:] == (True, dt.date(2024, 1, 2), "abc", "red")
    assert got[1][0] == 0 and got[1][1] == 0 and got[1][2:] == (True, None, None, None)
    assert got[2] == (0, None, False, None, None, None)


def test_coerce_nested_and_tiny(spark):
    df = spark.sql("select named_struct('a', 1, 'b', null) as j, 'True' as t, '5' as u")
    got = clean.coerce(df, {"j": "json", "t": "tinyint", "u": "tinyint"}).first()
    assert (got.j, got.t, got.u) == ('{"a":1}', 1, 5)


def test_over_length(spark):
    df = spark.createDataFrame([("abcdef",)], "s string")
    assert clean.coerce(df, {"s": {"type": "text", "length": 3}}, "keep").first().s == "abcdef"
    with pytest.raises(PySparkException, match="longer than 3"):
        clean.coerce(df, {"s": {"type": "text", "length": 3}}, "fail").collect()


def test_conform_and_declarations(spark):
    df = spark.createDataFrame([("7", "x")], "person_id string, extra string")
    got = clean.conform(df, {"person_id": "person_id", "id": "id_string", "n": {"type": "int", "default": 3}}).first()
    assert tuple(got) == (7, "", 3)
    with pytest.raises(ValueError, match="unknown type"):
        clean.declare({"a": "wide"})
    with pytest.raises(ValueError, match="needs values"):
        clean.declare({"a": "enum"})


def test_require_timeline(spark):
    good = ("01890000-0000-7000-8000-000000000000", 1, 2, 3, 4)
    schema = "id string, ts int, person_id int, entry_type_id int, source_code_id int"
    assert clean.require_timeline(spark.createDataFrame([good], schema)).count() == 1
    for bad in ((*good[:2], None, *good[3:]), ("x", *good[1:])):
        with pytest.raises(PySparkException, match="timeline row"):
            clean.require_timeline(spark.createDataFrame([bad], schema)).collect()
    with pytest.raises(ValueError, match="source_code_id"):
        clean.require_timeline(spark.createDataFrame([good[:4]], schema.rsplit(",", 1)[0]))


# --- profile --------------------------------------------------------------------------


def test_profile_of_three_rows(spark):
    df = spark.createDataFrame([("foo", 1), ("bar", 2), ("test", 3)], "a string, b int")
    a, b = pr.profile(df).orderBy("position").collect()
    assert (a.type, a.records, a.empty, a["min"], a["max"], a.min_length, a.max_length, a.distinct) == ("string", 3, 0, "bar", "test", 3, 4, 3)
    assert sorted(a.sample) == ["bar", "foo", "test"]
    assert (b.type, b["min"], b["max"], b.min_length, b.distinct, b.sample) == ("int", "1", "3", None, 3, ["1", "2", "3"])


def test_inferred_types(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "2024-01-01", "2024-01-01T10:00:00Z", "9", None, "01890000-0000-7000-8000-000000000000", "1"),
         ("-2", "3", "2024-02", "2024-01-02 00:00:00", "10", None, "01890000-0000-7000-8000-00000000000A", "x"),
         (None, "1e3", None, None, "100", None, None, None)],
        "i string, d string, day string, ts string, n string, nothing string, u string, mixed string",
    )
    got = {r.name: r.type for r in pr.infer_types(df).collect()}
    assert got == {"i": "int", "d": "double", "day": "date", "ts": "datetime", "n": "int", "nothing": "string", "u": "uuid", "mixed": "string"}
    low, high = pr.profile(df).where("name = 'n'").select("min", "max").first()
    assert (low, high) == ("9", "100")


def test_whole_cast(spark):
    df = spark.createDataFrame([("5.0", "2024-01-02T10:00:00,5"), ("1e3", "2024-01-02"), (" 7 ", None)], "n string, t string")
    got = df.select(clean.whole_cast(F.col("n"), "bigint").alias("n"), clean.whole_cast(F.col("t"), "timestamp").alias("t")).collect()
    assert [r.n for r in got] == [5, 1000, 7] and got[0].t == dt.datetime(2024, 1, 2, 10, 0, 0, 500000) and got[2].t is None
    with pytest.raises(PySparkException, match="not a bigint: x"):
        spark.createDataFrame([("x",)], "n string").select(clean.whole_cast(F.col("n"), "bigint")).collect()


def test_numbers_too_large_for_an_integer_are_doubles(spark):
    df = spark.createDataFrame([("123456789012345678901234",), ("5",)], "n string")
    assert pr.infer_types(df).first().type == "double"


def test_profile_keeps_32_values(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("v"))
    only = pr.profile(df).first()
    assert len(only.sample) == 32 and only.sample[0] == "hot" and only.distinct == 1001


def test_storage(spark):
    df = spark.createDataFrame([(-5, 70000, 300, "x", "5.00", "a")], "a int, b int, c int, s string, amount string, given_name string")
    got = {r.name: (r.storage, r.spark_type) for r in pr.suggest_storage(pr.profile(df)).collect()}
    assert got["a"] == ("Int8", "tinyint") and got["b"] == ("UInt32", "bigint") and got["c"] == ("UInt16", "int")
    assert got["s"][0] == "LowCardinality(String)" and got["amount"][0] == "Decimal(19,2)" and got["given_name"][0] == "String"
    assert pr.narrow(df, pr.suggest_storage(pr.profile(df))).schema["a"].dataType.simpleString() == "tinyint"


def test_profile_table_looks_at_all_rows(spark):
    # The only text, null and fraction stand in the middle of 60,001 rows; one row comes twice.
    middle = F.col("id") == 30_000
    df = spark.range(60_000).select("id", F.when(middle, "x").otherwise(F.col("id").cast("string")).alias("v"), F.when(~middle, F.col("id") / 2).alias("d"))
    got = {r.name: r for r in pr.profile_table(df.union(df.where("id = 7"))).collect()}
    assert [(got[c].type, got[c].records, got[c].empty, got[c].distinct) for c in ("id", "v", "d")] == [
        ("int", 60_001, 0, 60_000), ("string", 60_001, 0, 60_000), ("double", 60_001, 1, 59_999)
    ]
    assert got["id"].sample[0] == "7"


# --- timeline -------------------------------------------------------------------------


def test_dictionary_ids(spark):
    codes = spark.createDataFrame([(5, "Known")], "source_code_id long, source_code string")
    df = spark.createDataFrame([(1, " known "), (2, "NEW"), (3, "new"), (4, ""), (5, None), (6, "Other")], "n int, source_code string")
    got, added = tl.append_source_code_id(df, codes, ["n"])
    ids = {r.n: r.source_code_id for r in got.collect()}
    assert ids[1] == 5 and ids[2] == ids[3] and ids[4] == ids[5] == 0
    assert sorted({ids[2], ids[6]}) == [6, 7]
    assert sorted(r.source_code for r in added.collect()) == ["NEW", "Other"]
    again, none = tl.append_source_code_id(df, codes.unionByName(added), ["n"])
    assert {r.n: r.source_code_id for r in again.collect()} == ids and none.count() == 0


def test_entry_types_and_ids(spark):
    df = spark.createDataFrame([("TRANSACTION", None), ("SOURCE_CODE_OVERRIDE", None)], "entry_type string, ts timestamp")
    got = {r.entry_type: r for r in tl.append_entry_type_id(df).collect()}
    assert got["SOURCE_CODE_OVERRIDE"].ts == dt.datetime(1970, 1, 1) and got["TRANSACTION"].ts is None
    with pytest.raises(PySparkException, match="invalid entry_type: NOPE"):
        tl.append_entry_type_id(df.withColumn("entry_type", F.lit("NOPE"))).collect()
    with pytest.raises(PySparkException, match="no entry_type"):
        tl.append_entry_type_id(df.drop("entry_type")).collect()
    with pytest.raises(PySparkException, match="no ts"):
        tl.append_entry_id(tl.append_entry_type_id(df), "in").collect()
    once, twice = (tl.append_entry_id(tl.append_entry_type_id(df), "in", "2024-01-02").orderBy("id").collect() for _ in range(2))
    assert once == twice
    assert all(len(r.id) == 36 and r.id[14] == "7" and r.id[19] in "89ab" for r in once)
    days = tl.append_entry_id(tl.append_entry_type_id(df), "in", "2024-01-02").select(tl.entry_day("id").alias("d"))
    assert sorted(r.d for r in days.collect()) == ["1970-01-01", "2024-01-02"]
    given = df.withColumn("id", F.lit("01890000-0000-4000-8000-000000000000"))
    ids = tl.append_entry_id(tl.append_entry_type_id(given), "in")
    assert {r.id for r in ids.collect()} == {"01890000-0000-4000-8000-000000000000"}
    assert ids.select(tl.entry_day("id")).first()[0].startswith("h-")


def test_statistics(spark):
    data = [("a", "i1", 1, "x", "m.org", 1), ("a", "i1", 1, "x", "m.org", 1), ("a", "i2", 1, "y", "m.org", 2), ("b", "i1", 2, "x", "n.org", 1)]
    df = spark.createDataFrame(data, "source string, id string, person_id int, entry_type_id string, email_domain string, day int")
    df = df.withColumn("ts", F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)))
    stats = tl.input_statistics(df, ["ts"])
    assert rows(stats["total"], "source", "records", "distinct_people") == [("a", 2, 1), ("b", 1, 1)]
    assert rows(stats["by_type_by_date"], "source", "date", "entry_type_id", "records") == [
        ("a", "2024-01-01", "x", 1), ("a", "2024-01-02", "y", 1), ("b", "2024-01-01", "x", 1),
    ]
    folder = scratch_path(spark, "stats")
    tl.write_statistics(stats, folder)
    assert spark.read.json(f"{folder}/by_email_domain").count() == 3


def test_reload_and_new_file(spark):
    def file(n):
        df = spark.createDataFrame([(f"r{k}", dt.datetime(2024, 1, 1 + k % 5), k, 0) for k in range(n)], "remote_entry_id string, ts timestamp, person_id long, source_code_id long")
        return tl.append_entry_id(tl.append_entry_type_id(df, "FORM_SUBMIT"), "in")

    path = scratch_path(spark, "timeline")
    for n, expected in ((3, 3), (3, 3), (8, 8)):
        tl.load_timeline_files(file(n), path, ["ts"], "in")
        assert spark.read.parquet(path).count() == expected
    details = tl.load_details(file(3).withColumn("note", F.lit("x")))
    assert "ts" not in details.columns and tl.load_details(file(8).withColumn("note", F.lit("y")), details).count() == 8


# --- segments and resources -----------------------------------------------------------


def test_anti_join_with_null(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    excluded = spark.createDataFrame([(2,), (None,)], "person_id long")
    assert rows(segments.segment_people(people, [], [excluded])) == [(1,), (3,)]
    with pytest.raises(ValueError, match="person_id"):
        segments.segment_people(people, [people])


@pytest.mark.parametrize("chunk_rows", [1, 2, 7, 1000])
def test_export_in_parts_is_whole(spark, chunk_rows):
    members = spark.createDataFrame([(1,), (2,), (3,)], "person_id long")
    # Person 1 has many rows, most of them copies of one another; person 4 is not a member.
    data = [(1, "same")] * 9 + [(1, f"x{k}") for k in range(5)] + [(2, "only"), (4, "not in")]
    remote = spark.createDataFrame(data, "person_id long, remote_id string")
    out = segments.export_people(members, {"remote_ids": remote}, chunk_rows=chunk_rows)
    back = out.select("person_id", F.explode("remote_ids.remote_id").alias("r"))
    assert rows(back) == sorted(((p, r) for p, r in data if p != 4), key=str)
    assert out.where("person_id = 3").first().remote_ids is None
    assert out.select("person_id", "part").distinct().count() == out.count()
    if chunk_rows == 1000:
        assert out.count() == 3 and out.agg(F.max("part")).first()[0] == 0
    else:
        assert out.where("person_id = 1").count() > 1


def test_export_delta_and_lines(spark):
    members = spark.createDataFrame([(1,), (2,)], "person_id long")
    first = segments.export_people(members, {"ids": spark.createDataFrame([(1, "a")], "person_id long, r string")})
    second = segments.export_people(members, {"ids": spark.createDataFrame([(1, "a"), (1, "b")], "person_id long, r string")})
    assert rows(segments.export_delta(second, first), "person_id") == [(1,)]
    assert segments.export_delta(second, first, by_person=True).count() == 0
    path = scratch_path(spark, "export")
    segments.write_export(second, path, gzip=True)
    lines = sorted(r.value for r in spark.read.text(path).collect())
    assert lines == ['{"person_id":1,"ids":[{"r":"a"},{"r":"b"}]}', '{"person_id":2}']


def test_attach_children_parts(spark):
    parents = spark.createDataFrame([(1, "p"), (2, "q")], "id long, name string")
    kids = spark.createDataFrame([(1, k) for k in range(10)] + [(9, 99)], "parent long, id long")
    out = resources.attach_children(parents, "id", {"kids": {"children": kids, "foreign_key": "parent", "id": "id"}}, chunk_rows=3)
    assert rows(out.select("id", F.explode("kids.id").alias("k"))) == [(1, k) for k in range(10)]
    assert rows(out.where("part = 0"), "id", "name") == [(1, "p"), (2, "q")]


# --- chains ---------------------------------------------------------------------------


def test_chain(spark):
    df = spark.createDataFrame([("A@X.org", "1/2/2024")], "`E mail` string, `When` string")
    steps = ["clean_columns", {"transform": "clean_date", "options": {"field": "when"}}, lambda d: d.withColumn("n", F.lit(1))]
    got = chain.run_chain(df, steps)
    assert got.rows.first().when == "2024-01-02T00:00:00.000Z" and len(got.planning_seconds) == 3
    with pytest.raises(ValueError, match="unknown transform"):
        chain.run_chain(df, ["shine"])

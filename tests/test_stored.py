"""Stored timelines and statistics: which folders are read, written and kept when a write fails."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from rollcall.operators import timeline as tl
from rollcall.operators.merge import folder_bounds, upsert_files
from rollcall.session import scratch_path
from rollcall.streaming import timeline as st

ENTRY = "id string, ts timestamp, person_id long, entry_type_id int, source_code_id long, input_id string"


def entry(n, ts, person=1, kind=1, code=0):
    """An entry whose id tells its day."""
    return (n, ts, person, kind, code)


def entries(spark, rows):
    own = spark.createDataFrame(rows, "n long, ts string, person_id long, entry_type_id int, source_code_id long")
    own = own.withColumns({"ts": F.col("ts").cast("timestamp"), "remote_entry_id": F.col("n"), "input_id": F.lit("i")})
    return tl.append_entry_id(own.drop("n")).select("id", "ts", "person_id", "entry_type_id", "source_code_id", "input_id")


def stamps(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/p-*/*.parquet")}


def test_range_opens_only_folders_in_it(spark):
    path = scratch_path(spark, "timeline")
    rows = entries(spark, [entry(k, f"2024-03-{d:02d} 10:00:00") for k, d in enumerate(range(1, 21))])
    odd = spark.createDataFrame(
        [("7b1c2d3e-0000-4000-8000-000000000001", "2024-03-05 01:00:00"), ("018d0000-0000-7000-8000-000000000002", "2024-03-06 01:00:00")], "id string, ts string"
    ).selectExpr("id", "cast(ts as timestamp) ts", "2L person_id", "1 entry_type_id", "0L source_code_id", "'i' input_id")
    tl.load_timeline_files(rows.unionByName(odd), path, ["source_code_id"])
    found = tl.stored_range(spark, path, "2024-03-05", "2024-03-07")
    assert found.count() == 4  # one by a hash group, one in the folder of another day
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "dynamicpruning" in plan
    # A folder outside of the range is not opened: what lies there does not matter.
    (broken,) = glob.glob(f"{path}/part=p-2024-03-15/*.parquet")
    with open(broken, "wb") as out:
        out.write(b"not parquet")
    assert tl.stored_range(spark, path, "2024-03-05", "2024-03-07").count() == 4
    assert tl.stored_range(spark, path, None, "2024-03-03").count() == 2
    with pytest.raises(Exception):
        tl.stored_range(spark, path, "2024-03-14", "2024-03-16").count()


def test_bounds_are_made_for_tables_without_and_never_shrink(spark):
    path = scratch_path(spark, "timeline")
    old = entries(spark, [entry(1, "2024-03-01 10:00:00"), entry(2, "2024-03-02 10:00:00")])
    upsert_files(path, old, ["id"], tl.entry_day("id"))
    assert folder_bounds(spark, path) is None and tl.stored_range(spark, path, "2024-03-02", None).count() == 1
    tl.load_timeline_files(entries(spark, [entry(3, "2024-03-02 12:00:00")]), path, ["source_code_id"])
    assert {r.part for r in folder_bounds(spark, path).collect()} == {"p-2024-03-01", "p-2024-03-02"}
    assert tl.stored_range(spark, path, "2024-03-02", None).count() == 2
    assert tl.stored_range(spark, path, "2024-03-01", "2024-03-02").count() == 1


def deliver(spark, folder, name, rows):
    rows.write.parquet(f"{folder}/{name}")


def counted(spark, path):
    return {(r.date, r.entry_type_id): (r.records, r.distinct_people) for r in st.read_statistics(spark, path, ["date", "entry_type_id"]).collect()}


def test_failed_batch_is_repeated_without_loss(spark, monkeypatch):
    folder, timeline, out, marks = (scratch_path(spark, n) for n in ("arrivals", "timeline", "statistics", "marks"))

    def run():
        rows = st.stream_inputs(spark, f"{folder}/*", ENTRY, from_path=False, file_time="file_time")
        st.stream_statistics(rows, timeline, out, marks, ["file_time"]).awaitTermination()

    first = [entry(k, f"2024-03-{1 + k % 3:02d} 10:00:00", person=k % 4, kind=1 + k % 2) for k in range(24)]
    deliver(spark, folder, "a", entries(spark, first))
    run()
    before = counted(spark, out)
    assert sum(n for n, _ in before.values()) == 24
    kept = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{out}/day=d-2024-03-0[12]/*.parquet")}

    more = [entry(100 + k, "2024-03-03 11:00:00", person=50 + k) for k in range(5)]
    deliver(spark, folder, "b", entries(spark, more + first[2:3]))
    whole = st.recount_days

    def fails(*args):
        raise RuntimeError("lost on the way")

    monkeypatch.setattr(st, "recount_days", fails)
    with pytest.raises(Exception, match="lost on the way"):
        run()
    assert counted(spark, out) == before  # no other day is gone
    monkeypatch.setattr(st, "recount_days", whole)
    run()
    after = counted(spark, out)
    assert after["2024-03-03", 1] == (before["2024-03-03", 1][0] + 5, before["2024-03-03", 1][1] + 5)
    assert {k: v for k, v in after.items() if k != ("2024-03-03", 1)} == {k: v for k, v in before.items() if k != ("2024-03-03", 1)}
    assert kept == {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{out}/day=d-2024-03-0[12]/*.parquet")}
    run()  # nothing new
    assert counted(spark, out) == after


def test_entry_that_moves_to_another_day_is_counted_there_only(spark):
    folder, timeline, out, marks = (scratch_path(spark, n) for n in ("arrivals", "timeline", "statistics", "marks"))

    def run(name, day):
        rows = [("7b1c2d3e-0000-4000-8000-000000000001", f"2024-03-{day} 01:00:00")]
        own = spark.createDataFrame(rows, "id string, ts string")
        deliver(spark, folder, name, own.selectExpr("id", "cast(ts as timestamp) ts", "2L person_id", "1 entry_type_id", "0L source_code_id", "'i' input_id"))
        arrived = st.stream_inputs(spark, f"{folder}/*", ENTRY, from_path=False, file_time="file_time")
        st.stream_statistics(arrived, timeline, out, marks, ["file_time"]).awaitTermination()

    run("a", "05")
    assert counted(spark, out) == {("2024-03-05", 1): (1, 1)}
    run("b", "07")
    assert counted(spark, out) == {("2024-03-07", 1): (1, 1)}
    assert st.read_statistics(spark, out, []).collect()[0].distinct_people == 1


def test_bitmaps_merge_to_exact_people(spark):
    rows = spark.range(60_000).selectExpr("cast(id % 40 as string) as day", "if(id % 1000 = 0, null, id * 3 % 70001 - 5) as person_id")
    rolled = tl.roll_up(tl.people_bitmaps(rows, ["day"]), [])
    want = rows.agg(F.count("*"), F.count_distinct("person_id")).first()
    assert tuple(rolled.first()) == tuple(want)
    by_day = {r.day: (r.records, r.distinct_people) for r in tl.roll_up(tl.people_bitmaps(rows, ["day"]), ["day"]).collect()}
    assert by_day == {r[0]: (r[1], r[2]) for r in rows.groupBy("day").agg(F.count("*"), F.count_distinct("person_id")).collect()}


def people_files(path):
    return {f.removeprefix(path): os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/part=*/*.parquet")}


def test_second_load_rewrites_only_touched_folders(spark):
    from rollcall.operators import identity

    path = scratch_path(spark, "people")
    first = spark.createDataFrame([(k, k, f"u{k // 2}@a.org", f"555000{k:04d}", f"Name{k}") for k in range(40)], "n long, remote_person_id long, email string, phone string, given_name string")
    found = {r.n: r.person_id for r in identity.load_people_files(first, path, "shop", "in", "n", digits=1).collect()}
    assert len(set(found.values())) == 20 and found[0] == found[1]
    before = people_files(path)
    assert len({f.split("/")[2] for f in before if f.startswith("/person/")}) > 8
    # One new row of a person on file: a new phone and remote id, a new name.
    more = spark.createDataFrame([(100, 100, "u3@a.org", "5559990000", "Other")], first.schema)
    again = identity.load_people_files(more, path, "shop", "in", "n", digits=1).collect()
    assert again[0].person_id == found[6]
    after = people_files(path)
    changed = {f for f in before if after.get(f) != before[f]}
    folders = lambda files, table: {f.split("/")[2] for f in files if f.startswith(f"/{table}/")}
    own = identity.folder_of(F.lit(found[6]).cast("bigint"), 1)
    folder = spark.range(1).select(F.concat(F.lit("part=p-"), own)).first()[0]
    assert folders(changed, "person") == folders(changed, "person_phone") == {folder}
    assert not folders(changed, "person_email")  # the address was known
    assert len(folders(set(after) - set(before), "person_identifier")) <= 2
    state = {k: v.count() for k, v in identity.stored_people(spark, path).items()}
    assert state == {"person": 20, "person_identifier": 40 + 20 + 40 + 2, "person_email": 20, "person_phone": 41}
    # The same load again changes no file at all.
    identity.load_people_files(more, path, "shop", "in", "n", digits=1)
    assert people_files(path) == after
    assert identity.stored_people(spark, path)["person"].where(F.col("id") == found[6]).first().given_name == "Other"


def test_new_rows_by_stored_hashes(spark):
    from rollcall.operators.merge import new_rows, new_rows_since, remember_rows

    path = scratch_path(spark, "hashes")
    schema = "k long, v string, n double"
    history = [(k, f"v{k % 7}" if k % 5 else None, float(k)) for k in range(200)]
    df = spark.createDataFrame(history, schema)
    assert new_rows_since(df, path).count() == 200  # nothing is remembered yet
    remember_rows(df, path)
    delta = spark.createDataFrame([*history[:3], (3, "other", 3.0), (None, None, None), (None, None, None), (500, "x", 0.0)], schema)
    want = sorted(map(repr, new_rows(delta, df).collect()))
    found = new_rows_since(delta, path)
    assert sorted(map(repr, found.collect())) == want and len(want) == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<hash:binary>" in plan and "dynamicpruning" in plan
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}
    remember_rows(df, path)
    assert before == {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}
    by_key = spark.createDataFrame([(7, "b", 1.0), (7, "a", 2.0), (900, "b", 1.0), (900, "c", 0.5)], schema)
    keys = scratch_path(spark, "hashes")
    remember_rows(df.select("k"), keys, ["k"])
    assert [tuple(r) for r in new_rows_since(by_key, keys, ["k"], ["n"]).collect()] == [(900, "c", 0.5)]

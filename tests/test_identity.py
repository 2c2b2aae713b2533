"""Identity resolution: the small fixtures, and brute force on random links."""

import random

import pytest
from pyspark.sql import functions as F

from rollcall.functions.text import hash_v1
from rollcall.operators import identity as i
from rollcall.plans.skew import dense_ids, join_weighted


def load(spark, state, data, schema, plugin="p", source="input-1", **more):
    return i.load_people(spark.createDataFrame(data, schema), state, plugin, source, **more)


def test_repeat_load_finds_the_same_people(spark):
    state = i.empty_state(spark)
    data = [(n, f"test{n % 250}@x.org") for n in range(500)]
    for _ in range(2):
        _, state = load(spark, state, data, "row int, email string", row_id="row")
        assert state["person"].count() == 250
        assert state["person_email"].count() == 250
        assert state["person_identifier"].count() == 250


def test_people_across_plugins(spark):
    state = i.empty_state(spark)
    first = [(k, f"{k}@foo.com") for k in (1, 2, 3, 4, 10)]
    _, state = load(spark, state, first, "remote_person_id int, email string", "a", "in-a", row_id="remote_person_id")
    second = [(k * 111, f"{k}@foo.com") for k in (2, 3, 4, 5)]
    _, state = load(spark, state, second, "remote_person_id int, email string", "b", "in-b", row_id="remote_person_id")
    assert state["person"].count() == 6
    assert state["person_email"].count() == 6
    rows, state = load(spark, state, [(333,), (444,), (555,)], "remote_person_id int", "b", "in-b2", row_id="remote_person_id")
    assert state["person"].count() == 6
    by_plugin = {
        r.source_input_id: r.n
        for r in state["person_identifier"].groupBy("source_input_id").agg(F.count_distinct("person_id").alias("n")).collect()
    }
    assert by_plugin == {"in-a": 5, "in-b": 4}
    ids = state["person_identifier"]
    of = lambda source: ids.where(F.col("source_input_id") == source).select("person_id").distinct()
    both = of("in-a").join(of("in-b"), "person_id", "left_semi").join(rows.select("person_id"), "person_id", "left_semi")
    assert both.count() == 2


def test_names_update_and_emails_dedupe(spark):
    state = i.empty_state(spark)
    schema = "n int, given_name string, family_name string, email string"
    _, state = load(spark, state, [(1, "Bob", "Smith", "bob@x.org"), (2, "Bobby", "Smith", "BOB@x.org "), (3, "Jo", "Li", "jo@x.org")], schema, row_id="n", order="n")
    assert sorted((r.given_name, r.family_name) for r in state["person"].collect()) == [("Bobby", "Smith"), ("Jo", "Li")]
    _, state = load(spark, state, [(9, "Robert", "Smith", "bob@x.org")], schema, row_id="n", order="n")
    assert sorted(r.given_name for r in state["person"].collect()) == ["Jo", "Robert"]
    assert state["person_email"].count() == 2


def test_phones(spark):
    state = i.empty_state(spark)
    data = [(1, "1", "(555) 555-0001"), (2, "2", "+15555550001"), (3, "3", "555-555-0002"), (4, "3", "bad"), (5, "5", None)]
    rows, state = load(spark, state, data, "n int, remote_person_id string, phone string", row_id="n")
    assert rows.select("person_id").distinct().count() == 3
    assert state["person_phone"].count() == 2
    assert {r.id_type for r in state["person_identifier"].collect()} == {i.REMOTE, i.PHONE}


def test_remote_id_beats_email(spark):
    known = spark.createDataFrame(
        [("p.7", i.REMOTE, 70), (i_hash(spark, "a@x.org"), i.EMAIL, 5)], "id_value string, id_type string, person_id long"
    )
    rows = i.extract_identifiers(spark.createDataFrame([(1, "7", "a@x.org"), (2, None, "a@x.org"), (3, "8", None)], "n int, remote_person_id string, email string"), "p")
    got = {r.n: r.person_id for r in i.match_known(rows, "n", known).collect()}
    assert got == {1: 70, 2: 5}
    full = {r.n: r.person_id for r in i.assign_person_ids(rows, "n", known, 100).select("n", "person_id").collect()}
    assert full == {1: 70, 2: 5, 3: 101}


def i_hash(spark, value):
    return spark.range(1).select(hash_v1(F.lit(value))).first()[0]


def test_order_does_not_matter(spark):
    """A{e}, B{e,p}, C{p}: one person, whichever comes first."""
    for order in ([1, 2, 3], [3, 1, 2], [1, 3, 2]):
        data = {1: ("e@x.org", None), 2: ("e@x.org", "5555550001"), 3: (None, "5555550001")}
        df = spark.createDataFrame([(k, *data[k]) for k in order], "n int, email string, phone string")
        rows = i.assign_person_ids(i.extract_identifiers(df), "n")
        assert rows.select("person_id").distinct().count() == 1


def test_rows_without_identifiers_are_people_of_their_own(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a@x.org")], "n int, email string")
    got = i.assign_person_ids(i.extract_identifiers(df), "n", None, 10).select("n", "person_id").collect()
    assert sorted(r.person_id for r in got) == [11, 12, 13]


def brute(rows):
    """Components by union-find; value: smallest value of the component."""
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for values in rows.values():
        for v in values:
            a, b = find(values[0]), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {k: find(values[0]) for k, values in rows.items() if values}


@pytest.mark.parametrize("hot_rows", [1, 3, 10**9])
@pytest.mark.parametrize("shape", ["random", "chain", "star", "two stars"])
def test_components_against_brute_force(spark, shape, hot_rows):
    draw = random.Random(shape)
    name = lambda n: f"v{n:04d}"
    if shape == "random":
        rows = {k: [name(draw.randrange(60)) for _ in range(draw.randrange(4))] for k in range(70)}
    elif shape == "chain":
        order = list(range(60))
        draw.shuffle(order)
        rows = {k: [name(order[k]), name(order[k + 1])] for k in range(59)}
    elif shape == "star":
        rows = {k: [name(50), name(k)] for k in range(100)}
    else:
        rows = {k: [name(90 + k % 2), name(k)] for k in range(80)}
        rows[80] = [name(90), name(91)]
    df = spark.createDataFrame(list(rows.items()), "n int, values array<string>")
    got = {r.n: r.component for r in i.link_within(df, "n", "values", hot_rows).collect()}
    expected = brute(rows)
    assert got.keys() == expected.keys()
    assert len(set(got.values())) == len(set(expected.values())) == len({(got[k], expected[k]) for k in got})


def test_join_weighted_is_a_join(spark):
    facts = spark.range(1000).select((F.sqrt("id")).cast("int").alias("k"), "id")
    keyed = facts.groupBy("k").agg(F.count(F.lit(1)).alias("weight"), F.max("id").alias("top")).where("k % 3 > 0")
    plain = facts.join(keyed.drop("weight"), "k")
    for hot in (0, 5, 30, 10**6):
        got = join_weighted(facts, keyed, "k", hot)
        assert got.select(*plain.columns).exceptAll(plain).count() == 0 and got.count() == plain.count()


def test_dense_ids(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    for digits in (1, 4):
        got = dense_ids(keys, "k", "n", 100, digits).collect()
        assert sorted(r.n for r in got) == list(range(101, 5101))
    again = dense_ids(keys.repartition(7), "k", "n", 100).collect()
    assert {r.k: r.n for r in again} == {r.k: r.n for r in got}


def test_new_identifiers(spark):
    rows = spark.createDataFrame(
        [(1, "in", [("email_hash_v1", "x"), ("phone_hash_v1", "y")]), (1, "in", [("email_hash_v1", "x")]), (2, "in", [("email_hash_v1", "z")])],
        f"person_id long, input_id string, identifiers {i.IDENTIFIERS}",
    )
    known = spark.createDataFrame([("z",)], "id_value string")
    got = sorted(tuple(r) for r in i.new_identifiers(rows, known).collect())
    assert got == [(1, "in", "email_hash_v1", "x"), (1, "in", "phone_hash_v1", "y")]


def test_custom_fields(spark):
    state = i.empty_state(spark)
    data = [(1, "a@x.org", "blue", 3, None), (2, "b@x.org", None, None, "kept")]
    schema = "n int, email string, `custom.color` string, `custom.size` int, `other.note` string"
    _, state = load(spark, state, data, schema, row_id="n", custom_tables={"custom": [], "other": []})
    assert [(r.color, r["size"]) for r in state["custom"].collect()] == [("blue", 3)]
    assert [r.note for r in state["other"].collect()] == ["kept"]


def test_transactions(spark):
    base = "remote_transaction_id string, ts timestamp, amount double"
    df = spark.createDataFrame([("t1", None, 5.0), ("t2", None, 6.0)], base)
    assert {r.entry_type for r in i.transactions_from_table(df, "p").collect()} == {"TRANSACTION"}
    recurs = df.withColumn("recurs", F.when(F.col("amount") > 5, "monthly").otherwise(""))
    got = {r.remote_entry_id: r.entry_type for r in i.transactions_from_table(recurs, "p").collect()}
    assert got == {"t1": "TRANSACTION_ONE_TIME", "t2": "TRANSACTION_RECURRING"}
    own = df.withColumn("entry_type", F.lit("TRANSACTION_REFUND"))
    assert {r.entry_type for r in i.transactions_from_table(own, "p").collect()} == {"TRANSACTION_REFUND"}


def test_people_from_table_needs_a_date(spark):
    with pytest.raises(ValueError, match="no date column"):
        i.people_from_table(spark.range(1), "p", start="-1d")

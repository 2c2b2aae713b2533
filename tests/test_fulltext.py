"""Full text over columns and through the index, next to a plain reading of the search."""

import random

import pytest
from pyspark.sql import functions as F

from rollcall.operators import fulltext, profile as pr
from rollcall.session import scratch_path


def plain(text, parts):
    """What a search means, word by word."""
    own = [w for w in "".join(c.lower() if c.isalnum() or c == "_" else " " for c in text or "").split()]

    def one(kind, what):
        if kind == "group":
            return plain(text, what)
        if kind == "prefix":
            return any(w.startswith(what) for w in own)
        run = [what] if kind == "word" else what
        return any(own[i : i + len(run)] == run for i in range(len(own)))

    must, never, either = ([one(k, w) for s, k, w in parts if s == sign] for sign in ("+", "-", ""))
    return all(must) and not any(never) and (bool(must) or not either or any(either))


SEARCHES = ['+a +b -c', '"a b"', '"a a b" d', 'be*', '+(a b) -"b a"', '-a', '+a (b c)', '+(+a -b) c', '"d"', 'x_1 "c, d"', '']


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    lexicon = ["a", "b", "c", "d", "bee", "Beta", "x_1", "A", "é"]
    rows = [(k, " ".join(draw.choices(lexicon, k=draw.randint(0, 9)))) for k in range(60)]
    return [*rows, (60, None), (61, ""), (62, "a, b; c."), (63, "a " * 3000 + "b")]


@pytest.mark.parametrize("search", SEARCHES)
def test_column_search(spark, texts, search):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id for r in docs.where(fulltext.text_matches("text", search)).collect()}
    assert got == {k for k, x in texts if plain(x, fulltext.parts_of(search))}


def test_index_search_and_update(spark, texts):
    path = scratch_path(spark, "fulltext")
    docs = spark.createDataFrame([*texts, (None, "a b")], "doc_id long, text string")
    fulltext.index_documents(docs, path)
    for search in SEARCHES:
        got = sorted(r.doc for r in fulltext.search_index(spark, path, search).collect())
        assert got == sorted(k for k, x in texts if plain(x, fulltext.parts_of(search))), search
    plan = fulltext.search_index(spark, path, "+a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    # Two documents change and one comes in; the same update twice is one update.
    changed = [(1, "zebra a"), (2, ""), (99, "zebra")]
    for _ in range(2):
        fulltext.index_documents(spark.createDataFrame(changed, "doc_id long, text string"), path, version=2)
    now = dict(texts) | dict(changed)
    for search in ("zebra", "+a -zebra", "zeb*", "-a"):
        got = sorted(r.doc for r in fulltext.search_index(spark, path, search).collect())
        assert got == sorted(k for k, x in now.items() if plain(x, fulltext.parts_of(search))), search


def test_postings_are_made_within_rows(spark, texts):
    """Neither words nor texts of ids that stand once are moved; of rows with one id the longest counts."""
    rows = [*texts, (1, "a much longer text with other words in it, zebra"), (60, "once null"), (None, "a b")]
    own = fulltext.one_text(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    found = fulltext.postings_of(own)
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Union")[0]
    assert "Exchange" not in above and "Aggregate" not in above and plan.count("Exchange hashpartitioning") == 1
    want = {}
    for k, x in (dict(texts) | {1: rows[-3][1], 60: "once null"}).items():
        for at, w in enumerate("".join(c.lower() if c.isalnum() or c == "_" else " " for c in x or "").split()):
            want.setdefault((w, k), []).append(at)
    got = [((r.term, r.doc), r.positions) for r in found.collect()]
    assert dict(got) == want and len(got) == len(want)


@pytest.mark.parametrize("search", ["(a", "a)"])
def test_groups_must_be_closed(search):
    with pytest.raises(ValueError):
        fulltext.parts_of(search)


def test_frequent_values_where_many_tie(spark, monkeypatch):
    monkeypatch.setattr(pr, "FEW_CANDIDATES", 3)
    draw = random.Random(2)
    unique = [f"v{k:03d}" for k in range(200)]
    draw.shuffle(unique)
    # Sixty values three times, a hundred once, one of them often: the last places tie at three.
    often = [x for k, x in enumerate(unique[:160]) for _ in range(3 if k < 60 else 1)] + ["top"] * 9
    rows = list(zip(often, (unique * 2)[: len(often)]))
    draw.shuffle(rows)
    found = {r.name: r for r in pr.profile(spark.createDataFrame(rows, "often string, twice string").repartition(4)).collect()}
    for name, values in (("often", [r[0] for r in rows]), ("twice", [r[1] for r in rows])):
        counts = {v: values.count(v) for v in values}
        want = [v for v, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:32]
        assert found[name].sample == want and found[name].distinct == len(counts)


def test_profile_shuffles_no_texts(spark):
    """Texts a hundred times as long are no more bytes in the counts."""
    short = spark.range(300).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("v"))
    long = short.select(F.repeat("v", 100).alias("v"))
    assert pr._counted_cells(long).columns == pr._counted_cells(short).columns == ["position", "_a", "_b", "_n"]
    assert pr.profile(long).first().sample == sorted(f"x{k}" * 100 for k in range(300))[:32]

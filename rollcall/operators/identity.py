"""Identity resolution: which rows belong to which person.

Rows carry ``identifiers``, an array of (type, value).  Rows that share a value,
directly or through other rows, are one person: the transitive closure, which
does not depend on row order.  (A greedy, first-come matching would give A{e},
B{e,p}, C{p} two people in some orders; here they are always one.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rollcall.functions.dates import date_window
from rollcall.functions.text import hash_v1, normalize_phone
from rollcall.operators.merge import read_files, upsert, upsert_files
from rollcall.plans.skew import HOT_ROWS, dense_ids, join_weighted, keep_latest
from rollcall.session import materialize

IDENTIFIERS = "array<struct<type:string,value:string>>"

# Identifier types, the strongest first.
REMOTE, EMAIL, PHONE = "remote_person_id", "email_hash_v1", "phone_hash_v1"

# Columns that date a person row, the most telling first.
PERSON_DATE_FIELDS = ("ts", "remote_last_modified", "last_modified", "date_created")


def extract_identifiers(df: DataFrame, plugin_id: str | Column | None = None) -> DataFrame:
    """Adds ``identifiers`` from remote_person_id, email and phone (or their hashes)."""

    def given(name: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast("string")
        text = F.trim(F.col(name).cast("string"))
        return F.when(text != "", text)

    def entry(kind: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(kind).alias("type"), value.alias("value")))

    plugin = plugin_id if isinstance(plugin_id, Column) else F.lit(plugin_id or "")
    remote = F.concat(plugin, F.lit("."), given(REMOTE))
    email, phone = given("email"), normalize_phone(given("phone"))
    entries = F.array(
        entry(REMOTE, remote),
        entry(EMAIL, F.coalesce(F.when(email.isNotNull(), hash_v1(email)), given(EMAIL))),
        entry(PHONE, F.coalesce(F.when(phone.isNotNull(), hash_v1(phone)), given(PHONE))),
    )
    return df.withColumn("identifiers", F.filter(entries, lambda e: e.isNotNull()).cast(IDENTIFIERS))


def exploded(rows: DataFrame, row_id: str) -> DataFrame:
    """(row id, id_type, id_value), one row per identifier."""
    return rows.select(row_id, F.explode("identifiers").alias("_i")).select(
        row_id, F.col("_i.type").alias("id_type"), F.col("_i.value").alias("id_value")
    )


def _known_matches(rows: DataFrame, row_id: str, known: DataFrame) -> DataFrame:
    """(row id, _direct): the person of the strongest known identifier of each row, a
    remote_person_id before any other, the lowest person id among equals.

    Both sides are shuffled for the join, so a value that many rows share is split
    by Spark's skew handling."""
    found = exploded(rows, row_id).select(row_id, "id_value").join(
        known.select("id_value", F.col("id_type").alias("known_type"), "person_id"), "id_value"
    )
    priority = F.when(F.col("known_type") == REMOTE, 0).otherwise(1).alias("priority")
    return found.groupBy(row_id).agg(F.min(F.struct(priority, "person_id")).alias("_direct"))


def match_known(rows: DataFrame, row_id: str, known: DataFrame) -> DataFrame:
    """(row id, person_id) for rows that have an identifier in ``known``.

    ``known`` is (id_value, id_type, person_id), one row per id_value; a
    remote_person_id beats any other identifier.
    """
    return _known_matches(rows, row_id, known).select(row_id, "_direct.person_id")


# --- connected components -----------------------------------------------------------


def _large_star(edges: DataFrame, hot_rows: int) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    smallest = both.groupBy("hi").agg(F.min("lo").alias("least"), F.count(F.lit(1)).alias("weight"))
    smallest = smallest.select(F.col("hi").alias("lo"), F.least("hi", "least").alias("least"), "weight")
    linked = join_weighted(edges, smallest, "lo", hot_rows)
    return linked.select("hi", F.col("least").alias("lo"))


def _small_star(edges: DataFrame, hot_rows: int) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them."""
    smallest = edges.groupBy("hi").agg(F.min("lo").alias("least"), F.count(F.lit(1)).alias("weight"))
    linked = join_weighted(edges, smallest, "hi", hot_rows)
    pairs = F.array(
        F.struct(F.col("hi").alias("hi"), F.col("least").alias("lo")),
        F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")),
    )
    return linked.select(F.inline(pairs)).where("hi > lo").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether the edges form stars: every node has at most one smaller neighbour, and a node
    that has one is nobody's smaller neighbour."""
    ends = F.array(
        F.struct(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")),
    )
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    worst, inner = nodes.agg(
        F.coalesce(F.max("up"), F.lit(0)),
        F.count_if((F.col("up") > 0) & (F.col("down") > 0)),
    ).first()
    return worst <= 1 and inner == 0


def components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, component) for every node of ``edges`` (hi, lo: two numbers), the
    component being its smallest node.

    Large-star / small-star contraction (Kiveris et al., 2014): each round every
    node re-attaches to the smallest node in reach, until all components are
    stars.  The number of rounds grows with the logarithm of the size, not with
    the length of the longest chain, and the loop ends only when they are stars.
    Each round is written to the shared folder, which cuts the plan and survives
    lost executors.  A node with a huge number of edges is re-attached by
    broadcasting its one row (``join_weighted``), never gathered in one task.
    """
    now = materialize(edges.where("hi > lo").distinct(), "edges")
    while not _stars(now):
        now = materialize(_small_star(_large_star(now, hot_rows), hot_rows), "edges")
    roots = now.select(F.col("lo").alias("node")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def link_within(rows: DataFrame, row_id: str, values: str = "values", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(row id, component): rows that share a value, through any number of others,
    get one component number.  Rows without values get none.

    ``values`` is an array column, so the links inside a row need no shuffle.  The
    distinct links are kept, their values numbered (in the order of ``dense_ids``, so
    a rerun gives the same numbers), and the contraction runs on pairs of numbers.
    A component's number is the smallest of its values' numbers.
    """
    own = rows.where(F.size(values) > 0).select(row_id, F.array_min(values).alias("node"), values)
    links = materialize(own.select(F.explode(values).alias("hi"), F.col("node").alias("lo")).distinct(), "links")
    # Every value is the upper end of a link, if only of one to itself.
    numbers = materialize(dense_ids(links.select("hi").distinct(), "hi", "number"), "numbers")
    edges = (
        links.where("hi <> lo")
        .join(numbers, "hi")
        .join(numbers.select(F.col("hi").alias("lo"), F.col("number").alias("_lo")), "lo")
        .select(F.greatest("number", "_lo").alias("hi"), F.least("number", "_lo").alias("lo"))
    )
    labels = components(edges, hot_rows).withColumnRenamed("node", "number")
    named = numbers.join(labels, "number", "left").select(
        F.col("hi").alias("node"), F.coalesce("component", "number").alias("component")
    )
    return own.select(row_id, "node").join(named, "node").select(row_id, "component")


def assign_person_ids(
    rows: DataFrame,
    row_id: str,
    known: DataFrame | None = None,
    max_person_id: Column | int = 0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``rows`` with ``person_id``.

    1. A row with a known identifier takes that person.
    2. Other rows take the person known to their component, if there is one.
    3. What is left gets new ids after ``max_person_id``, one per component; a row
       without any identifier is a person of its own.

    The work is done on (row id, identifiers) alone; the rows themselves are joined
    to the outcome once.
    """
    rows = rows.drop("person_id")
    ids = materialize(rows.select(row_id, "identifiers"), "identifiers")
    linked = link_within(
        ids.withColumn("_values", F.transform("identifiers", lambda i: i["value"])), row_id, "_values", hot_rows
    )
    alone = F.concat(F.lit("row:"), F.col(row_id).cast("string"))
    labelled = ids.select(row_id).join(linked, row_id, "left").select(
        row_id, F.coalesce(F.col("component").cast("string"), alone).alias("component")
    )
    if known is None:
        none = F.lit(None).cast("struct<priority:int,person_id:bigint>")
        state = materialize(labelled.withColumn("_direct", none), "labels")
    else:
        state = materialize(labelled.join(_known_matches(ids, row_id, known), row_id, "left"), "labels")

    by_component = state.groupBy("component").agg(
        F.min("_direct").alias("_known"), F.count(F.lit(1)).alias("weight")
    )
    by_component = materialize(by_component, "components")
    fresh = dense_ids(by_component.where("_known is null"), "component", "_fresh", max_person_id)
    people = by_component.join(fresh, "component", "left").select(
        "component", F.coalesce("_known.person_id", "_fresh").alias("_person"), "weight"
    )
    resolved = join_weighted(state, people, "component", hot_rows).select(
        row_id, F.coalesce("_direct.person_id", "_person").alias("person_id")
    )
    return rows.join(resolved, row_id)


def new_identifiers(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Identifier rows ``known`` does not have: one per value, with its source input.

    ``rows`` carry person_id, identifiers and (optionally) input_id.
    """
    source = F.col("input_id") if "input_id" in rows.columns else F.lit("00000000-0000-0000-0000-000000000000")
    found = rows.select("person_id", source.alias("source_input_id"), F.explode("identifiers").alias("_i")).select(
        F.col("_i.value").alias("id_value"),
        F.struct("person_id", "source_input_id", F.col("_i.type").alias("id_type")).alias("_r"),
    )
    first = found.groupBy("id_value").agg(F.min("_r").alias("_r"))
    return first.join(known.select("id_value"), "id_value", "left_anti").select(
        "_r.person_id", "_r.source_input_id", "_r.id_type", "id_value"
    )


# --- people and transactions from tables ---------------------------------------------


def first_present(df: DataFrame, names: tuple[str, ...]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def people_from_table(
    table: DataFrame,
    plugin_id: str,
    start=None,
    end=None,
    date_fields: tuple[str, ...] = PERSON_DATE_FIELDS,
    at: Column | None = None,
) -> DataFrame:
    """Person rows of a source table, bounded on the first date column it has.

    The table's own ``id`` is left behind.  Sources with other date columns name
    them in ``date_fields``.
    """
    if start is not None or end is not None:
        field = first_present(table, date_fields)
        if field is None:
            raise ValueError("start or end given, but the table has no date column")
        table = date_window(table, field, start, end, at)
    return table.drop("id").withColumn("plugin_id", F.lit(plugin_id))


def transactions_from_table(table: DataFrame, plugin_id: str, start=None, end=None, at: Column | None = None) -> DataFrame:
    """Transaction rows of a source table, ready for identification.

    remote_transaction_id becomes remote_entry_id.  Without a type column of its
    own, a table with ``recurs`` is split into recurring and one-time.
    """
    rows = date_window(table, "ts", start, end, at)
    rows = rows.withColumn("remote_entry_id", F.col("remote_transaction_id"))
    if "entry_type" not in rows.columns and "entry_type_id" not in rows.columns:
        if "recurs" in rows.columns:
            kind = F.when(F.length("recurs") > 0, "TRANSACTION_RECURRING").otherwise("TRANSACTION_ONE_TIME")
        else:
            kind = F.lit("TRANSACTION")
        rows = rows.withColumn("entry_type", kind)
    return rows.drop("id", "person_id", "remote_transaction_id").withColumn("plugin_id", F.lit(plugin_id))


# --- loading people -------------------------------------------------------------------

PERSON_STATE = {
    "person": "id bigint, given_name string, family_name string",
    "person_identifier": "person_id bigint, source_input_id string, id_type string, id_value string",
    "person_email": "person_id bigint, email string, email_type string, email_hash_v1 string",
    "person_phone": "person_id bigint, phone string, phone_type string, phone_hash_v1 string",
}

PERSON_KEYS = {
    "person": ["id"],
    "person_identifier": ["id_value"],
    "person_email": ["person_id", "email_hash_v1"],
    "person_phone": ["person_id", "phone_hash_v1"],
}


def empty_state(spark) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in PERSON_STATE.items()}


def custom_fields(df: DataFrame, table: str, key: str = "person_id") -> DataFrame | None:
    """The ``table.field`` columns as rows of that table, keyed by person."""
    lead = f"{table}."
    names = [c for c in df.columns if c.startswith(lead)]
    if not names:
        return None
    values = [F.col(f"`{c}`").alias(c[len(lead):]) for c in names]
    some = F.lit(False)
    for c in names:
        some = some | F.col(f"`{c}`").isNotNull()
    return df.where(some).select(key, *values)


def _prepared(df: DataFrame, plugin_id: str | None, input_id: str | None, row_id: str | None) -> tuple[DataFrame, str]:
    """``df`` with input_id and identifiers, and the column its rows are known by."""

    def own_or(name: str, value: str | None) -> Column:
        fallback = F.lit(value).cast("string")
        return F.coalesce(F.col(name).cast("string"), fallback) if name in df.columns else fallback

    rows = df.withColumn("input_id", own_or("input_id", input_id))
    rows = extract_identifiers(rows, own_or("plugin_id", plugin_id))
    if row_id is None:
        row_id = "_row"
        rows = rows.dropDuplicates(df.columns).withColumn(
            row_id, F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), 256)
        )
    return rows, row_id


def _person_rows(rows: DataFrame, last: list[str]) -> dict[str, DataFrame]:
    """What resolved ``rows`` say about people, by table; ``last`` decides whose word counts."""
    named = [c for c in ("given_name", "family_name") if c in rows.columns]
    incoming = {"person": rows.select(F.col("person_id").alias("id"), *named, *last)}
    if "email" in rows.columns:
        kind = F.col("email_type") if "email_type" in rows.columns else F.lit(None).cast("string")
        incoming["person_email"] = rows.where(F.trim("email") != "").select(
            "person_id", F.trim("email").alias("email"), kind.alias("email_type"),
            hash_v1("email").alias("email_hash_v1"), *[c for c in last if c != "email"],
        )
    if "phone" in rows.columns:
        kind = F.col("phone_type") if "phone_type" in rows.columns else F.lit(None).cast("string")
        phone = normalize_phone("phone")
        incoming["person_phone"] = rows.where(phone.isNotNull()).select(
            "person_id", F.col("phone"), kind.alias("phone_type"), hash_v1(phone).alias("phone_hash_v1"),
            *[c for c in last if c != "phone"],
        )
    return incoming


def load_people(
    df: DataFrame,
    state: dict[str, DataFrame],
    plugin_id: str | None = None,
    input_id: str | None = None,
    row_id: str | None = None,
    order: str | None = None,
    custom_tables: dict[str, list[str]] | None = None,
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Resolve ``df`` to people and write them into ``state``.

    Returns the rows with person_id, and the updated person tables.  Rows may carry
    their own plugin_id and input_id; the arguments fill in for those that do not.
    ``row_id`` names a unique column; without one a row is known by its content, so copies
    of a row are one.  ``order`` decides which of several rows for one person
    has the last word.
    """

    rows, row_id = _prepared(df, plugin_id, input_id, row_id)
    top = F.coalesce(state["person"].agg(F.max("id")).scalar(), F.lit(0))
    rows = materialize(
        assign_person_ids(rows, row_id, state["person_identifier"], top, hot_rows), "people"
    )
    last = [order] if order else [row_id]
    incoming = _person_rows(rows, last)
    out = dict(state)
    for name, frame in incoming.items():
        out[name] = upsert(state[name], frame, PERSON_KEYS[name], last)
    added = new_identifiers(rows, state["person_identifier"])
    out["person_identifier"] = state["person_identifier"].unionByName(added)
    for table in custom_tables or {}:
        fields = custom_fields(rows, table)
        if fields is not None:
            out[table] = upsert(state[table], fields, ["person_id"]) if table in state else fields
    changed = {name: materialize(frame, name) for name, frame in out.items() if frame is not state.get(name)}
    return rows.drop("_row"), {**state, **changed}


# --- people kept in files --------------------------------------------------------------

# Hexadecimal digits of a key's hash that name its folder: 256 folders.
FOLDER_DIGITS = 2
# What decides the folder of a row: people by their id, identifiers by their value.
FOLDER_KEYS = {"person": "id", "person_identifier": "id_value", "person_email": "person_id", "person_phone": "person_id"}


def folder_of(key: Column | str, digits: int = FOLDER_DIGITS) -> Column:
    value = F.col(key) if isinstance(key, str) else key
    return F.substring(F.md5(value.cast("string").cast("binary")), 1, digits)


def stored_people(spark, path: str) -> dict[str, DataFrame]:
    """The person tables kept at ``path``; tables nothing was written to are empty."""
    state = empty_state(spark)
    for name in state:
        found = read_files(spark, f"{path}/{name}")
        if found is not None:
            state[name] = found.drop("part").select(*state[name].columns)
    return state


def _stored_identifiers(spark, path: str, wanted: DataFrame, digits: int) -> DataFrame:
    """The stored identifiers among ``wanted`` (id_value); only the folders their hashes name are opened."""
    stored = read_files(spark, f"{path}/person_identifier")
    if stored is None:
        return spark.createDataFrame([], PERSON_STATE["person_identifier"])
    wanted = materialize(wanted.withColumn("part", F.concat(F.lit("p-"), folder_of("id_value", digits))), "wanted")
    names = wanted.where("part >= 'p-'").select("part").distinct()
    near = stored.join(names, "part", "left_semi")
    return near.join(wanted.select("id_value"), "id_value", "left_semi").drop("part")


def load_people_files(
    df: DataFrame,
    path: str,
    plugin_id: str | None = None,
    input_id: str | None = None,
    row_id: str | None = None,
    order: str | None = None,
    hot_rows: int = HOT_ROWS,
    digits: int = FOLDER_DIGITS,
) -> DataFrame:
    """:func:`load_people` into person tables stored at ``path`` (made if missing); returns
    the rows with person_id.

    Tables are kept in folders by a hash of the person or of the identifier.  A load reads the
    identifier folders its own identifiers fall in, contracts its rows together with what
    those say (each stored identifier points straight to its person), and replaces only the
    folders of people and identifiers that it adds to or changes.  ``digits`` (hexadecimal, 16
    ** digits folders) must be the same for all loads of a store.  The same load twice changes
    nothing; tables are written one after the other, identifiers last, so a load that failed
    half way is simply repeated.
    """
    spark = df.sparkSession
    rows, row_id = _prepared(df, plugin_id, input_id, row_id)
    rows = materialize(rows, "input")
    wanted = rows.select(F.explode("identifiers.value").alias("id_value")).distinct()
    known = materialize(_stored_identifiers(spark, path, wanted, digits), "known")
    people = read_files(spark, f"{path}/person")
    top = 0 if people is None else F.coalesce(people.agg(F.max("id")).scalar(), F.lit(0))
    rows = materialize(assign_person_ids(rows, row_id, known, top, hot_rows), "people")
    last = [order] if order else [row_id]
    tables = _person_rows(rows, last) | {"person_identifier": new_identifiers(rows, known)}
    for name, frame in tables.items():
        columns = [c.split()[0] for c in PERSON_STATE[name].split(", ")]
        frame = frame.select(*[c for c in columns if c in frame.columns], *[c for c in last if c not in columns and c in frame.columns])
        kinds = dict(c.split() for c in PERSON_STATE[name].split(", "))
        frame = frame.withColumns({c: F.lit(None).cast(kinds[c]) for c in columns if c not in frame.columns})
        stored = read_files(spark, f"{path}/{name}")
        if stored is not None:
            frame = _changed(frame, stored, name, columns, last, digits)
        upsert_files(f"{path}/{name}", frame, PERSON_KEYS[name], folder_of(FOLDER_KEYS[name], digits), [c for c in last if c in frame.columns])
    return rows.drop("_row")


def _changed(frame: DataFrame, stored: DataFrame, name: str, columns: list[str], last: list[str], digits: int) -> DataFrame:
    """The last row per key of ``frame``, without those that ``stored`` has already."""
    keys = PERSON_KEYS[name]
    latest = keep_latest(frame, keys, [c for c in last if c in frame.columns]).select(*columns)
    names = latest.select(F.concat(F.lit("p-"), folder_of(FOLDER_KEYS[name], digits)).alias("part")).distinct()
    near = stored.join(materialize(names, "folders").where("part >= 'p-'"), "part", "left_semi").select(*columns)
    # Rows are compared by value, nulls included; each key has one row on either side.
    return latest.subtract(near)

"""Dictionary ids, entry ids, the activity timeline, and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rollcall.functions.dates import date_window, relative_bound
from rollcall.functions.text import email_domain, normalize_lookup
from rollcall.operators.clean import require_timeline
from rollcall.operators.identity import load_people
from rollcall.operators.merge import read_range, upsert, upsert_files
from rollcall.operators.profile import infer_types
from rollcall.plans.skew import HOT_ROWS, dense_ids, keep_latest, top_per_group
from rollcall.session import materialize

# The entry types this package ships with, and their codes.  The codes are ours;
# pass another mapping where a deployment has its own.
ENTRY_TYPES = {
    "UNKNOWN": 0,
    "SOURCE_CODE_OVERRIDE": 1,
    "TRANSACTION": 10,
    "TRANSACTION_ONE_TIME": 11,
    "TRANSACTION_INITIAL": 12,
    "TRANSACTION_SUBSEQUENT": 13,
    "TRANSACTION_RECURRING": 14,
    "TRANSACTION_REFUND": 15,
    "FORM_SUBMIT": 20,
}
EPOCH_TYPE = "SOURCE_CODE_OVERRIDE"

# Timeline columns, which a detail table does not repeat.
TIMELINE = ["id", "ts", "input_id", "entry_type_id", "source_code_id", "person_id"]
NOT_DETAIL = [*TIMELINE, "remote_input_id", "remote_input_name"]

TOP_DOMAINS = 50


def append_dictionary_id(
    df: DataFrame,
    dictionary: DataFrame,
    field: str,
    out: str,
    id_column: str = "id",
    default: str | None = None,
    extra: dict[str, str] | None = None,
    order: list[Column | str] = (),
) -> tuple[DataFrame, DataFrame]:
    """``df`` with the dictionary id of ``field``, and the dictionary rows to add.

    Values match trimmed and case-insensitively.  Blank is 0.  Each unknown value
    is added once, in the spelling that comes first by ``order`` (then by text),
    numbered after the largest id.  The rows are counted per value inside each task
    before anything moves; the join back is left to Spark, which broadcasts a
    small dictionary and splits the partitions of a hot value otherwise.

    ``extra`` restricts the dictionary to rows with
    those values (an input's plugin, say) and is set on new rows.
    """
    text = F.trim(F.col(field).cast("string"))
    if default is not None:
        text = F.when(F.coalesce(text, F.lit("")) == "", F.lit(default)).otherwise(text)
    given = F.col(out) if out in df.columns else F.lit(None).cast("bigint")
    rows = df.withColumn(field, text).withColumn("_given", given)
    needs = F.coalesce(F.col(field), F.lit("")) != ""
    rows = rows.withColumn("_key", F.when(needs & F.coalesce(F.col("_given") == 0, F.lit(True)), normalize_lookup(field)))

    scoped = dictionary
    for name, value in (extra or {}).items():
        scoped = scoped.where(F.col(name) == value)
    known = scoped.select(normalize_lookup(field).alias("_key"), F.col(id_column).alias("_id"))
    known = known.groupBy("_key").agg(F.min("_id").alias("_id"))

    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order], F.col(field))
    spelled = rows.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min_by(field, rank).alias("_spelling"))
    unknown = spelled.join(known, "_key", "left_anti")
    top = F.coalesce(dictionary.agg(F.max(id_column)).scalar(), F.lit(0))
    numbered = dense_ids(unknown, "_key", "_id", top)
    added = unknown.join(numbered, "_key").select(
        F.col("_id").alias(id_column),
        F.col("_spelling").alias(field),
        *[F.lit(value).alias(name) for name, value in (extra or {}).items()],
    )
    found = rows.join(known.unionByName(numbered), "_key", "left")
    # A given id stays; blank is 0.
    value = F.coalesce(F.nullif("_given", F.lit(0)), "_id", F.lit(0))
    return found.withColumn(out, value).drop("_key", "_id", "_given"), added


def append_source_code_id(df: DataFrame, dictionary: DataFrame, order: list[Column | str] = ()):
    return append_dictionary_id(df, dictionary, "source_code", "source_code_id", "source_code_id", order=order)


def append_input_id(df: DataFrame, inputs: DataFrame, plugin_id: str, default: str | None = None, order: list[Column | str] = ()):
    """Input ids within one plugin, by remote_input_id."""
    return append_dictionary_id(
        df, inputs, "remote_input_id", "input_id", "id", default=default, extra={"plugin_id": plugin_id}, order=order
    )


def append_entry_type_id(df: DataFrame, default: str | None = None, types: dict[str, int] | None = None) -> DataFrame:
    """Entry type names to codes; a missing or unknown name fails the job."""
    codes = types or ENTRY_TYPES
    name = F.col("entry_type") if "entry_type" in df.columns else F.lit(None).cast("string")
    name = F.coalesce(F.nullif(name, F.lit("")), F.lit(default).cast("string"))
    mapping = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    code = (
        F.when(name.isNull(), F.raise_error(F.lit("no entry_type and no default")).cast("int"))
        .when(mapping[name].isNull(), F.raise_error(F.concat(F.lit("invalid entry_type: "), name)).cast("int"))
        .otherwise(mapping[name].cast("int"))
    )
    if "entry_type_id" in df.columns:
        code = F.coalesce(F.col("entry_type_id").cast("int"), code)
    out = df.withColumn("_type_name", name).withColumn("entry_type_id", code)
    if "ts" in df.columns:
        kind = df.schema["ts"].dataType
        epoch = F.lit("1970-01-01").cast(kind)
        out = out.withColumn("ts", F.when(F.col("ts").isNull() & (F.col("_type_name") == EPOCH_TYPE), epoch).otherwise(F.col("ts")))
    return out.drop("_type_name")


def entry_hex(millis: Column, *parts: Column) -> Column:
    """The digits an entry id is made of: 48 bits of time, then a hash of what
    identifies the entry.  The same entry gets the same digits whenever it is loaded."""
    digest = F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.concat(F.lower(F.lpad(F.hex(millis), 12, "0")), digest)


def uuid_of(hex_column: str) -> Column:
    """A column of :func:`entry_hex` digits laid out as a UUID, version 7, so that ids
    sort by time.  It takes a column name: Spark then computes the digits once per
    row instead of once per place they are used in."""
    h = F.col(hex_column)
    variant = F.translate(F.substring(h, 16, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("7"), F.substring(h, 13, 3)),
        F.concat(variant, F.substring(h, 17, 3)),
        F.substring(h, 20, 12),
    )


def append_entry_id(df: DataFrame, input_id: str | None = None, default_ts: str | None = None) -> DataFrame:
    """Entry ids: a given one stays; others derive from input, type, person, time and
    remote entry id (remote_transaction_id counts as one).  No time fails the job."""

    def optional(name: str, kind: str = "string") -> Column:
        return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)

    remote = F.coalesce(F.nullif(optional("remote_entry_id"), F.lit("")), optional("remote_transaction_id"))
    ts = F.coalesce(optional("ts", "timestamp"), F.lit(default_ts).cast("timestamp"))
    own = F.nullif(optional("id"), F.lit(""))
    millis = F.unix_millis("ts")
    rows = df.withColumn("ts", ts).withColumn("remote_entry_id", remote)
    source = F.coalesce(optional("input_id"), F.lit(input_id).cast("string"))
    digits = entry_hex(
        millis, source, F.col("entry_type_id"), optional("person_id", "bigint"), millis, F.col("remote_entry_id")
    )
    value = (
        F.when(own.isNotNull(), own)
        .when(F.col("ts").isNull(), F.raise_error(F.lit("no ts and no default timestamp")).cast("string"))
        .otherwise(uuid_of("_hex"))
    )
    return rows.withColumn("_hex", digits).withColumn("id", value).drop("_hex")


def entry_day(entry_id: Column | str) -> Column:
    """The partition an entry belongs to, from its id alone: the day in the leading
    bits of a version 7 id, otherwise one of 256 hash groups.  The same id always
    lands in the same partition, so an upsert rewrites only the days it brings."""
    c = F.col(entry_id) if isinstance(entry_id, str) else entry_id
    clock = F.conv(F.concat(F.substring(c, 1, 8), F.substring(c, 10, 4)), 16, 10).cast("bigint")
    own = F.date_format(F.timestamp_millis(clock), "yyyy-MM-dd")
    group = F.concat(F.lit("h-"), F.substring(F.md5(c.cast("binary")), 1, 2))
    return F.when(F.substring(c, 15, 1) == "7", own).otherwise(group)


def append_email_domain(df: DataFrame, email: str = "email") -> DataFrame:
    return df.withColumn("email_domain", email_domain(email))


def identify(
    df: DataFrame,
    state: dict[str, DataFrame],
    dictionary: DataFrame,
    plugin_id: str | None = None,
    input_id: str | None = None,
    default_entry_type: str | None = None,
    default_ts: str | None = None,
    row_id: str | None = None,
    order: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """A raw input to timeline rows: type, source code, person, entry id.

    Rows of many inputs go through at once when they carry input_id and plugin_id
    (as ``scan_stored_inputs`` adds them).  Returns (rows, updated person tables, dictionary rows to add).
    """
    typed = append_entry_type_id(df, default_entry_type)
    added = dictionary.limit(0)
    if "source_code" in typed.columns:
        typed, added = append_source_code_id(typed, dictionary, [order] if order else [])
    else:
        typed = typed.withColumn("source_code_id", F.lit(0).cast("bigint"))
    people, state = load_people(typed, state, plugin_id, input_id, row_id, order, hot_rows=hot_rows)
    rows = append_entry_id(people, input_id, default_ts)
    if "email" in rows.columns:
        rows = append_email_domain(rows)
    return rows, state, added


def identify_inputs(
    files: DataFrame, state: dict[str, DataFrame], dictionary: DataFrame, inputs: DataFrame, **options
) -> tuple[DataFrame, dict[str, DataFrame], DataFrame, DataFrame]:
    """:func:`identify` for the rows of many inputs in one go, and the input table with
    its first and last timestamps stretched to what was found."""
    rows, state, added = identify(files, state, dictionary, **options)
    return rows, state, added, widen_bounds(inputs, input_bounds(rows))


def input_bounds(rows: DataFrame) -> DataFrame:
    """Records, first and last timestamp per input."""
    return rows.groupBy("input_id").agg(
        F.count(F.lit(1)).alias("records"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts")
    )


def widen_bounds(inputs: DataFrame, found: DataFrame) -> DataFrame:
    """The input table with first and last timestamps stretched to what was found."""
    seen = found.select(F.col("input_id").alias("id"), F.col("min_ts").alias("_lo"), F.col("max_ts").alias("_hi"))
    return (
        inputs.join(seen, "id", "left")
        .withColumn("min_ts", F.least("min_ts", "_lo"))
        .withColumn("max_ts", F.greatest("max_ts", "_hi"))
        .select(*inputs.columns)
    )


# --- timeline tables --------------------------------------------------------------------


def load_timeline(rows: DataFrame, timeline: DataFrame, order: list[Column | str], input_id: str | None = None) -> DataFrame:
    """``timeline`` with complete entries written over it by id; loading twice changes nothing.

    ``order`` (the time of a file, the number of a line) decides which version of an entry is
    the last; the entry's own time cannot, it is part of the id."""
    if input_id is not None:
        given = F.col("input_id") if "input_id" in rows.columns else F.lit(None).cast("string")
        rows = rows.withColumn("input_id", F.coalesce(given, F.lit(input_id)))
    columns = [c for c in timeline.columns if c in rows.columns]
    ranked = [c for c in order if isinstance(c, str) and c not in columns]
    return upsert(timeline, require_timeline(rows).select(*columns, *ranked), ["id"], list(order))


def load_timeline_files(rows: DataFrame, path: str, order: list[Column | str], input_id: str | None = None) -> None:
    """:func:`load_timeline` into the timeline stored at ``path``: only the days that the
    rows fall in are read and rewritten."""
    if input_id is not None:
        given = F.col("input_id") if "input_id" in rows.columns else F.lit(None).cast("string")
        rows = rows.withColumn("input_id", F.coalesce(given, F.lit(input_id)))
    columns = [c for c in TIMELINE if c in rows.columns]
    # The last version of each entry is chosen here, so that what it is chosen by is not stored.
    latest = keep_latest(require_timeline(rows), ["id"], list(order)).select(*columns)
    upsert_files(path, latest, ["id"], entry_day("id"), bounds="ts")


def detail_columns(df: DataFrame) -> list[str]:
    return ["id", *[c for c in df.columns if c not in NOT_DETAIL]]


def load_details(rows: DataFrame, details: DataFrame | None = None, order: list[Column | str] = ()) -> DataFrame:
    """Everything the timeline does not hold, keyed by entry id; made if missing.  Columns
    that are new to ``details`` are added to it."""
    fresh = rows.select(*detail_columns(rows))
    if details is None:
        details = fresh.limit(0)
    new = [f for f in fresh.schema.fields if f.name not in details.columns]
    details = details.withColumns({f.name: F.lit(None).cast(f.dataType) for f in new})
    return upsert(details, fresh, ["id"], list(order))


def detail_schema(rows: DataFrame, hints: dict[str, str] | None = None) -> DataFrame:
    """(position, name, type) of the detail table an input needs, id first."""
    return infer_types(rows.select(*detail_columns(rows)), hints)


def timeline_detail_summary(
    details: DataFrame,
    timeline: DataFrame,
    inputs: DataFrame,
    plugins: DataFrame,
    dictionary: DataFrame,
    types: dict[str, int] | None = None,
) -> DataFrame:
    """Each detail row with its entry, input, plugin and source code."""
    names = F.create_map(*[F.lit(x) for name, code in (types or ENTRY_TYPES).items() for x in (code, name)])

    def renamed(df: DataFrame, prefix: str, columns: list[str]) -> list[Column]:
        return [F.col(f"{prefix}.{c}").alias(f"plugin_{c}" if prefix == "p" else c) for c in columns if c in df.columns]

    own = [F.col(f"d.{c}") for c in detail_columns(details) if c != "id"]
    created = [F.col("t.created_at")] if "created_at" in timeline.columns else []
    return (
        details.alias("d")
        .join(timeline.alias("t"), F.col("d.id") == F.col("t.id"))
        .join(inputs.alias("i"), F.col("t.input_id") == F.col("i.id"))
        .join(plugins.alias("p"), F.col("i.plugin_id") == F.col("p.id"))
        .join(dictionary.alias("s"), F.col("t.source_code_id") == F.col("s.source_code_id"), "left")
        .select(
            "t.id",
            "t.ts",
            "t.entry_type_id",
            F.coalesce(names[F.col("t.entry_type_id")], F.lit("N/A")).alias("entry_type"),
            *created,
            "t.person_id",
            "t.input_id",
            *renamed(inputs, "i", ["input_type", "remote_input_id", "remote_input_name"]),
            *renamed(plugins, "p", ["path", "name", "nickname", "remote_plugin_id"]),
            "s.source_code_id",
            "s.source_code",
            *own,
        )
    )


def timeline_range(timeline: DataFrame, start=None, end=None, at: Column | None = None) -> DataFrame:
    return date_window(timeline, "ts", start, end, at)


def stored_range(spark, path: str, start=None, end=None, at: Column | None = None) -> DataFrame:
    """:func:`timeline_range` of a timeline stored by ``load_timeline_files``: only folders
    that hold times between the bounds are opened.  An entry is found by its own time even
    if its id, which decides the folder, tells another day."""
    return read_range(spark, path, "ts", relative_bound(start, at), relative_bound(end, at)).drop("part")


# --- statistics -------------------------------------------------------------------------


def once(timeline: DataFrame, order: list[Column | str]) -> DataFrame:
    """Each entry id once, however often its file was loaded: its last version by ``order``."""
    return keep_latest(timeline, ["id"], list(order))


def _measures() -> list[Column]:
    return [F.count(F.lit(1)).alias("records"), F.count_distinct("person_id").alias("distinct_people")]


def stats_total(timeline: DataFrame, by: list[str] = ()) -> DataFrame:
    return timeline.groupBy(*by).agg(*_measures(), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def stats_by_type(timeline: DataFrame, kind: str = "entry_type_id", by: list[str] = ()) -> DataFrame:
    return timeline.groupBy(*by, kind).agg(*_measures())


def stats_by_type_by_date(timeline: DataFrame, kind: str = "entry_type_id", by: list[str] = ()) -> DataFrame:
    dated = timeline.withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    return dated.groupBy(*by, "date", kind).agg(*_measures()).orderBy(*by, "date", kind)


def top_groups(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values (ties in text order): ``n`` rows, so safe to broadcast."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), column).limit(n).select(column)


def stats_by_email_domain(timeline: DataFrame, kind: str = "entry_type_id", n: int = TOP_DOMAINS) -> DataFrame:
    largest = top_groups(timeline, "email_domain", n)
    return (
        timeline.join(F.broadcast(largest), "email_domain", "left_semi")
        .groupBy("email_domain", kind)
        .agg(*_measures())
    )


def people_bitmaps(rows: DataFrame, by: list[str], person: str = "person_id") -> DataFrame:
    """(by, bucket, records, people): who occurs in each group, as bitmaps.

    A bitmap holds the persons of one bucket of 32,768 numbers; person ids are dense, so the
    bitmaps are.  Groups merge by ``or``: any coarser table is summed up from this one, and
    its distinct people are exact.  Bitmaps are built within tasks first, so a group with a
    third of all rows moves no more than its bitmaps.  Rows without a person count as records.
    """
    number = F.col(person).cast("bigint")
    bucket = F.bitmap_bucket_number(number).alias("bucket")
    return rows.groupBy(*by, bucket).agg(
        F.count(F.lit(1)).alias("records"), F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("people")
    )


def roll_up(bitmaps: DataFrame, by: list[str]) -> DataFrame:
    """Records and distinct people by fewer columns than ``bitmaps`` has."""
    merged = bitmaps.groupBy(*by, "bucket").agg(F.sum("records").alias("records"), F.bitmap_or_agg("people").alias("people"))
    return merged.groupBy(*by).agg(
        F.sum("records").alias("records"), F.sum(F.bitmap_count("people")).cast("bigint").alias("distinct_people")
    )


def input_statistics(
    files: DataFrame, order: list[Column | str], source: str = "source", kind: str = "entry_type_id"
) -> dict[str, DataFrame]:
    """Total, by type, by type and date and (with email_domain) by domain, per source.

    The last version of each entry by ``order`` is counted, and who it is of kept as bitmaps
    by type and day and by type and domain; the four tables are or-ed from those.
    """
    domain = ["email_domain"] if "email_domain" in files.columns else []
    dated = keep_latest(files, [source, "id"], list(order)).withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    number = F.col("person_id").cast("bigint")
    dated = dated.withColumns({"bucket": F.bitmap_bucket_number(number), "_bit": F.bitmap_bit_position(number)})
    # By day and, in the same pass, by domain: days times domains would be many thin bitmaps.
    keys = [source, "date", kind, "bucket", *domain]
    sets = [[source, "date", kind, "bucket"], *([[source, kind, "bucket", *domain]] if domain else [])]
    counted = materialize(
        dated.groupingSets(sets, *keys).agg(
            F.count(F.lit(1)).alias("records"), F.bitmap_construct_agg("_bit").alias("people"),
            F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.grouping("date").alias("_by_domain"),
        ),
        "statistics",
    )
    daily = counted.where("_by_domain = 0")
    total = daily.groupBy(source).agg(F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))
    out = {
        "total": roll_up(daily, [source]).join(total, source),
        "by_type": roll_up(daily, [source, kind]),
        "by_type_by_date": roll_up(daily, [source, "date", kind]).orderBy(source, "date", kind),
    }
    if domain:
        domains = counted.where("_by_domain = 1")
        sizes = domains.groupBy(source, "email_domain").agg(F.sum("records").alias("_size"))
        largest = top_per_group(sizes, [source], [F.desc("_size"), F.col("email_domain")], TOP_DOMAINS)
        kept = domains.join(largest.select(source, "email_domain"), [source, "email_domain"], "left_semi")
        out["by_email_domain"] = roll_up(kept, [source, "email_domain", kind])
    return out


def write_statistics(stats: dict[str, DataFrame], folder: str) -> None:
    """Each table of :func:`input_statistics` as JSON lines under ``folder``."""
    for name, frame in stats.items():
        frame.write.mode("overwrite").json(f"{folder}/{name}")

"""Text, hash and search functions (T)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rollcall.functions import text as x
from rollcall.functions.expressions import cast_int, generated_uuid
from rollcall.plans.query import run_query
from rollcall.operators import fulltext
from rollcall.session import scratch_path
from rollcall.suite import case, plain


@case(
    "t1_locate",
    """select doc_id, strpos(text, 'the')::bigint as first,
       case when strpos(substr(text, 51), 'the') > 0 then strpos(substr(text, 51), 'the') + 50 else 0 end::bigint as later from documents""",
)
def _(t):
    return plain(t.documents.select("doc_id", x.locate("the", "text").alias("first"), x.locate("the", "text", 51).alias("later")))


@case(
    "t2_concat_trim",
    """select event_id, event_type || ':' || nullif(user_id, 8) as tag, trim('  ' || event_type || ' ') as trimmed from events""",
)
def _(t):
    spec = {
        "table": "events",
        "columns": [
            "event_id",
            {"eql": "concat(event_type, ':', nullif(user_id, 8))", "name": "tag"},
            {"eql": "trim(concat('  ', event_type, ' '))", "name": "trimmed"},
        ],
    }
    return run_query(spec, t.named("events"))


@case("t3_regexp", "select doc_id, regexp_matches(text, '(?i)thE [a-z]+ing') as found, regexp_matches(text, '(?i)@mail[0-9]') as mail from documents")
def _(t):
    spec = {"table": "documents", "columns": ["doc_id", {"eql": "regexp_like(text, 'thE [a-z]+ing')", "name": "found"}]}
    other = t.documents.select("doc_id", x.matches("text", "@MAIL[0-9]").alias("mail"))
    return run_query(spec, t.named("documents")).join(other, "doc_id")


_BAG = r"string_split_regex(lower(text), '[^\p{L}\p{N}_]+')"


@case(
    "t4_fulltext",
    f"""select doc_id, list_contains({_BAG}, 'the') and list_contains({_BAG}, 'and') and not list_contains({_BAG}, 'of') as must,
        list_contains({_BAG}, 'de') or list_contains({_BAG}, 'la') as either from documents""",
)
def _(t):
    spec = {"table": "documents", "columns": ["doc_id", {"eql": "fulltext_boolean(text, 'de la')", "name": "either"}]}
    must = t.documents.select("doc_id", x.fulltext_boolean("text", "+the +and -of").alias("must"))
    return run_query(spec, t.named("documents")).join(must, "doc_id")


_LINE = "' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: w <> ''), ' ') || ' '"
_SEARCHES = {
    "phrase": ('+"of the" -is', "l like '% of the %' and l not like '% is %'"),
    "prefix": ("+th* +(der die) -wor*", "l like '% th%' and (l like '% der %' or l like '% die %') and l not like '% wor%'"),
    "either": ('"de la" (+the +and -for) worthless', "l like '% de la %' or (l like '% the %' and l like '% and %' and l not like '% for %') or l like '% worthless %'"),
    "never": ("-the -de", "l not like '% the %' and l not like '% de %'"),
}


@case(
    "t4_fulltext_phrases",
    f"select doc_id, {', '.join(f'{test} as {name}' for name, (_, test) in _SEARCHES.items())} from (select doc_id, {_LINE} as l from documents)",
)
def _(t):
    return t.documents.select("doc_id", *[fulltext.text_matches("text", search).alias(name) for name, (search, _) in _SEARCHES.items()])


@case(
    "t4_fulltext_index",
    "with lines as (select doc_id, " + _LINE + " as l from documents) "
    + " union all ".join(f"select '{name}' as search, doc_id from lines where {test}" for name, (_, test) in _SEARCHES.items()),
)
def _(t):
    path = scratch_path(t.spark, "fulltext")
    late = F.col("doc_id") % 10 == 3
    # A tenth of the texts is indexed with other words first and replaced later.
    before = t.documents.withColumn("text", F.when(late, F.lit("of the worthless")).otherwise(F.col("text")))
    fulltext.index_documents(before, path)
    fulltext.index_documents(t.documents.where(late), path, version=2)
    found = [
        fulltext.search_index(t.spark, path, search).select(F.lit(name).alias("search"), F.col("doc").alias("doc_id"))
        for name, (search, _) in _SEARCHES.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), found)


@case("t5_hash_v1", "select doc_id, sha256(lower(trim(coalesce(nullif(source, 'src1'), '')))) as source_hash, sha256(lower(trim(text, ' '))) as text_hash from documents")
def _(t):
    return t.documents.select(
        "doc_id", x.hash_v1(F.nullif("source", F.lit("src1"))).alias("source_hash"), x.hash_v1("text").alias("text_hash")
    )


@case("t6_sha_upper", "select p_partkey, upper(sha1(p_name || p_brand)) as digest from part")
def _(t):
    return t.part.select("p_partkey", x.sha_upper("p_name", "p_brand").alias("digest"))


@case(
    "t7_email_domain",
    """select c_custkey, lower(c_mktsegment) || '.org' as last_rule, 'sub@' || lower(c_mktsegment) || '.org' as first_rule,
       lower(c_name) as without, '' as missing from customer""",
)
def _(t):
    email = F.concat("c_name", F.lit("@Sub@"), "c_mktsegment", F.lit(".ORG"))
    return t.customer.select(
        "c_custkey",
        x.email_domain(email).alias("last_rule"),
        x.email_domain_first(email).alias("first_rule"),
        x.email_domain("c_name").alias("without"),
        x.email_domain(F.nullif("c_name", F.col("c_name"))).alias("missing"),
    )


@case("t8_cast_int", "select event_id, try_cast(regexp_extract(props, '[0-9]+') as bigint) as k, try_cast(props as bigint) as nothing from events")
def _(t):
    return t.events.select(
        "event_id", cast_int(F.regexp_extract("props", "[0-9]+", 0)).alias("k"), cast_int("props").alias("nothing")
    )


@case("t9_uuid", "select event_type, count(*) as rows, count(*) as different, count(*) as well_formed from events group by 1")
def _(t):
    made = t.events.select("event_type", generated_uuid().alias("id"))
    return made.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("id").alias("different"),
        F.count_if(F.col("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("well_formed"),
    )


@case("t10_clean_columns", "select c_custkey as customer_key, c_name as full_name_, c_acctbal as balance____ from customer")
def _(t):
    messy = t.customer.select(
        F.col("c_custkey").alias("Customer Key"),
        F.col("c_name").alias("Full.Name!"),
        F.col("c_mktsegment").alias("full name?"),
        F.col("c_acctbal").alias("Balance ($)"),
    )
    return x.clean_columns(messy)


@case(
    "t11_phone",
    r"""select doc_id, raw, '+' || regexp_replace(raw, '[^0-9]', '', 'g') as phone, '+1' || substr(regexp_replace(raw, '[^0-9]', '', 'g'), 2) as bare
        from (select doc_id, unnest(regexp_extract_all(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}')) as raw from documents)""",
)
def _(t):
    raw = F.explode(F.regexp_extract_all("text", F.lit(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"), F.lit(0)))
    found = t.documents.select("doc_id", raw.alias("raw"))
    return found.select(
        "doc_id",
        "raw",
        x.normalize_phone("raw").alias("phone"),
        x.normalize_phone(F.regexp_replace("raw", r"^\+1 ", "")).alias("bare"),
    )

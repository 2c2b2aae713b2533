"""The operators of this package as queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rollcall.llm import embedding_dedup, exact_topk, filter_audit, language_mixture, license_scan, near_dedup, packing, quality_kn, records, source_mix, substring_dedup, token_alignment, url_filter
from rollcall.llm.shipping import ship
from rollcall.session import scratch_path
from rollcall.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def case(name: str, sql: str | None = None):
    def add(fn):
        def query(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(Tables(spark, folder))

        QUERIES[name] = query
        if sql:
            SQL[name] = sql.strip()
        return fn

    return add


@case("op7_license_scan")
def op7(t: Tables) -> DataFrame:
    return license_scan.license_labels(t.documents)


@case("op8_mixture_packing")
def op8(t: Tables) -> DataFrame:
    packed = packing.pack(t.documents, public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=2048)
    return packed.drop("ids", "source")


@case("op9_binary_records")
def op9(t: Tables) -> DataFrame:
    path, index = scratch_path(t.spark, "records"), scratch_path(t.spark, "records-index")
    records.write_records(t.documents, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    records.write_index(t.spark, path, index)
    return records.token_offsets(t.spark, path)


@case("op10_itq_embedding_dedup")
def op10(t: Tables) -> DataFrame:
    return embedding_dedup.link_vectors(t.embeddings)


@case(
    "op6_nra_topk",
    """
    with v as (
        select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e
        from embeddings
        where embedding is not null and len(embedding) > 0 and vec_id is not null
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), s as (
        select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e::double[], c.e::double[]) as bigint) as score
        from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
    )
    select query_id, cast(rank as integer) as rank, vec_id, score
    from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
    where rank <= 20
    """,
)
def op6(t: Tables) -> DataFrame:
    return exact_topk.top_scores(t.embeddings, lambda vec_id: vec_id % 20 == 0, k=20)


@case("op2_setsketch_near_dedup")
def op2(t: Tables) -> DataFrame:
    return near_dedup.link_documents(t.documents)


@case("op3_paragraph_dedup")
def op3(t: Tables) -> DataFrame:
    return substring_dedup.drop_repeats(t.documents).select("doc_id", "removed_words", "text")


@case("op1_kneser_ney_quality")
def op1(t: Tables) -> DataFrame:
    return quality_kn.quality_model(t.documents, t.labels).judged()


@case(
    "op5_hierarchical_mix",
    r"""
    with d as (
        select doc_id, coalesce(lang, '') as l, coalesce(source, '') as s,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 as tokens,
               case (length(source) + ascii(right(source, 1))) % 3 when 0 then 'web' when 1 then 'books' else 'reference' end as d
        from documents
    ), supply as (
        select d, l, s, sum(tokens)::bigint as tokens from d group by all
    ), n1 as (
        select d, sum(tokens) * 2 as c, case d when 'web' then 5.0::double when 'books' then 3.0 else 2.0 end as w,
               (select sum(tokens) from supply)::double as o from supply group by d
    ), f1 as (
        select *, (o - coalesce(sum(c) over (order by c / w, d rows between unbounded preceding and 1 preceding), 0))
               / sum(w) over (order by c / w, d rows between current row and unbounded following) as v from n1
    ), g1 as (select *, max(case when v * w <= c then v end) over () as m from f1),
    b1 as (select d, coalesce(least(c::double, greatest(0.0, m * w)), c::double) as b from g1),
    n2 as (
        select d, l, sum(tokens) * 2 as c,
               case l when 'en' then 6.0::double when 'de' then 2.0 when 'fr' then 2.0 else 1.0 end as w, any_value(b) as o
        from supply join b1 using (d) group by d, l
    ), f2 as (
        select *, (o - coalesce(sum(c) over (partition by d order by c / w, l rows between unbounded preceding and 1 preceding), 0))
               / sum(w) over (partition by d order by c / w, l rows between current row and unbounded following) as v from n2
    ), g2 as (select *, max(case when v * w <= c then v end) over (partition by d) as m from f2),
    b2 as (select d, l, coalesce(least(c::double, greatest(0.0, m * w)), c::double) as b from g2),
    n3 as (select d, l, s, tokens, tokens * 2 as c, 1.0::double as w, b as o from supply join b2 using (d, l)),
    f3 as (
        select *, (o - coalesce(sum(c) over (partition by d, l order by c / w, s rows between unbounded preceding and 1 preceding), 0))
               / sum(w) over (partition by d, l order by c / w, s rows between current row and unbounded following) as v from n3
    ), g3 as (select *, max(case when v * w <= c then v end) over (partition by d, l) as m from f3),
    leaves as (
        select d, l, s, tokens, floor(coalesce(least(c::double, greatest(0.0, m * w)), c::double) + 1e-6)::bigint as b from g3
    ), cuts as (select d, l, s, b // tokens as whole, b % tokens as rest from leaves),
    placed as (
        select d.*, whole, rest, md5('20:' || whole || ':' || coalesce(cast(doc_id as varchar), '')) as place
        from d join cuts using (d, l, s)
    ), summed as (
        select *, sum(tokens) over (partition by d, l, s order by place range between unbounded preceding and current row) as upto
        from placed
    ), used as (select *, whole + case when upto <= rest then 1 else 0 end as times from summed)
    select doc_id, l as lang, s as source, d as domain, cast(tokens as bigint) as tokens,
           cast(unnest(range(0, times)) as integer) as epoch
    from used
    """,
)
def op5(t: Tables) -> DataFrame:
    levels = source_mix.corpus_levels()
    docs = source_mix.mix(t.documents, levels, source_mix.WEIGHTS, share=1.0, epochs=2)
    return docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        levels["domain"].alias("domain"),
        source_mix.token_cost(F.col("text")).alias("tokens"),
        "epoch",
    )


@case("op4_em_language_mixture")
def op4(t: Tables) -> DataFrame:
    docs = t.documents
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = language_mixture.identify(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@case("op11_token_alignment")
def op11(t: Tables) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.aligned_counts(t.documents, a, b)


@case(
    "op12_filter_audit",
    r"""
    with texts as (
        select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
        from documents
    ), firsts as (
        select text, min(doc_id) as first_id from texts group by text
    ), said as (
        select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id
    ), bits as (
        select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
               (case when len(words) < 100 then 1 else 0 end)
               + (case when 100 * len(list_distinct(words)) < 80 * len(words) then 2 else 0 end)
               + (case when 100 * (length(t.text) - length(regexp_replace(t.text, '[A-Z]', '', 'g'))) > 10 * length(t.text) then 4 else 0 end)
               + (case when regexp_matches(t.text, '[#$%&*|]') then 8 else 0 end)
               + (case when t.doc_id > first_id then 16 else 0 end) as mask
        from texts t join firsts f on f.text = t.text left join said on said.doc_id = t.doc_id
    ), cells as (
        select part, mask, count(*) as n, count_if(good) as good, count_if(toxic) as toxic from bits group by part, mask
    ), letters(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    orders as (
        select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order,
               [a.bit, b.bit, c.bit, d.bit, e.bit] as taken
        from letters a, letters b, letters c, letters d, letters e
        where a.bit | b.bit | c.bit | d.bit | e.bit = 31
    ), steps as (
        select filter_order, cast(k as integer) as step, taken[k] as bit,
               cast(coalesce(list_sum(taken[1:k - 1]), 0) as integer) as before
        from orders, (select unnest(range(1, 6)) as k)
    ), counted as (
        select part, filter_order, step, bit,
               sum(case when mask & (before | bit) = 0 then n else 0 end) as kept,
               sum(case when mask & before = 0 and mask & bit <> 0 then n else 0 end) as removed,
               sum(case when mask & before <> 0 and mask & bit <> 0 then n else 0 end) as redundant,
               sum(case when mask = bit then n else 0 end) as unique_fails,
               sum(case when mask & before = 0 and mask & bit <> 0 then good else 0 end) as good_lost,
               sum(case when mask & before = 0 and mask & bit <> 0 then toxic else 0 end) as toxic_lost
        from cells, steps group by part, filter_order, step, bit
    )
    select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
           cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
           cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
           cast(sum(removed) over (partition by part, bit) as bigint) as shapley
    from counted
    """,
)
def op12(t: Tables) -> DataFrame:
    return filter_audit.audit(t.documents, t.labels)


@case("op13_url_filter")
def op13(t: Tables) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(t.spark))
    return url_filter.judge(t.pages.select("page_id", "url"), model).select("page_id", "host", "path", "rule", "verdict", "score")

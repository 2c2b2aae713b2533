"""Identity resolution (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions.text import hash_v1
from rollcall.operators import identity as i
from rollcall.session import scratch_path
from rollcall.suite import case, plain


def _phone():
    return F.concat(F.lit("(555) "), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0"))


def contacts(t):
    """Customers as a person file: remote id, an e-mail some share, a phone some lack."""
    return t.customer.select(
        "c_custkey",
        F.col("c_custkey").alias("remote_person_id"),
        F.concat(F.lit(" User"), "c_nationkey", F.lit("-"), F.floor(F.col("c_acctbal") / 20), F.lit("@Example.org ")).alias("email"),
        F.when(F.col("c_mktsegment") != "BUILDING", _phone()).alias("phone"),
    )


_EMAIL = "lower('user' || c_nationkey || '-' || floor(c_acctbal / 20)::bigint || '@example.org')"
_PHONE = "'+1555' || lpad((c_custkey % 1000)::varchar, 3, '0') || lpad(c_nationkey::varchar, 4, '0')"
_IDS = f"""select c_custkey, 'remote_person_id' as id_type, 'shop.' || c_custkey as id_value from customer
    union all select c_custkey, 'email_hash_v1', sha256({_EMAIL}) from customer
    union all select c_custkey, 'phone_hash_v1', sha256({_PHONE}) from customer where c_mktsegment <> 'BUILDING'"""


@case("i1_extract_identifiers", _IDS)
def _(t):
    return i.exploded(i.extract_identifiers(contacts(t), "shop"), "c_custkey")


@case(
    "i2_match_known",
    f"""with ids as ({_IDS}),
        known as (select 'shop.' || c_custkey as id_value, 'remote_person_id' as id_type, c_custkey + 1000000 as person_id from customer where c_acctbal < 3000
          union all select sha256({_EMAIL}), 'email_hash_v1', min(c_custkey) from customer where c_acctbal > 1000 group by 1)
        select c_custkey, coalesce(min(person_id) filter (known.id_type = 'remote_person_id'), min(person_id))::bigint as person_id
        from ids join known using (id_value) group by 1""",
)
def _(t):
    rows = i.extract_identifiers(contacts(t), "shop")
    remote = t.customer.where("c_acctbal < 3000").select(
        F.concat(F.lit("shop."), F.col("c_custkey").cast("string")).alias("id_value"),
        F.lit(i.REMOTE).alias("id_type"),
        (F.col("c_custkey") + 1000000).alias("person_id"),
    )
    mail = (
        contacts(t)
        .join(t.customer.where("c_acctbal > 1000").select("c_custkey"), "c_custkey", "left_semi")
        .groupBy(hash_v1("email").alias("id_value"))
        .agg(F.lit(i.EMAIL).alias("id_type"), F.min("c_custkey").alias("person_id"))
    )
    return i.match_known(rows, "c_custkey", remote.unionByName(mail))


# Two identifiers per customer, each shared by some others: whole dollars of the
# balance, and nation with the balance in steps of 20 taken at an offset.
def linked_customers(t):
    values = F.array(
        F.concat(F.lit("b:"), F.floor("c_acctbal").cast("string")),
        F.concat(F.lit("n:"), F.col("c_nationkey").cast("string"), F.lit(":"), F.floor((F.col("c_acctbal") + 7) / 20).cast("string")),
    )
    return t.customer.select("c_custkey", values.alias("values"))


_REACH = """with recursive ids as (
      select c_custkey as k, 'b:' || floor(c_acctbal)::bigint as v from customer
      union all select c_custkey, 'n:' || c_nationkey || ':' || floor((c_acctbal + 7) / 20)::bigint from customer),
    edges as (select distinct a.k as x, b.k as y from ids a join ids b on a.v = b.v),
    reach as (select c_custkey as k, c_custkey as y from customer union select r.k, e.y from reach r join edges e on r.y = e.x),
    comp as (select k, min(y) as root from reach group by k)"""


@case("i3_link_within", f"{_REACH} select k as c_custkey, root from comp")
def _(t):
    found = i.link_within(linked_customers(t), "c_custkey")
    roots = found.groupBy("component").agg(F.min("c_custkey").alias("root"))
    return found.join(roots, "component").select("c_custkey", "root")


@case(
    "i4_assign_person_ids",
    f"""{_REACH},
    known as (select 'b:' || floor(s_acctbal)::bigint as v, min(s_suppkey) + 500000 as p from supplier group by 1),
    numbers as (select v, row_number() over (order by md5(v), v) as n from (select distinct v from ids)),
    cname as (select root, min(n)::varchar as name from comp join ids using (k) join numbers using (v) group by 1),
    direct as (select k, min(p) as p from ids join known using (v) group by 1),
    cknown as (select root, min(p) as p from comp join direct using (k) group by 1),
    fresh as (select root, row_number() over (order by md5(name), name) + 600000 as p from cname where root not in (select root from cknown))
    select comp.k as c_custkey, coalesce(direct.p, cknown.p, fresh.p)::bigint as person_id
    from comp left join direct on comp.k = direct.k left join cknown on comp.root = cknown.root left join fresh on comp.root = fresh.root""",
)
def _(t):
    rows = linked_customers(t).select(
        "c_custkey", F.transform("values", lambda v: F.struct(F.lit("account").alias("type"), v.alias("value"))).alias("identifiers")
    )
    known = (
        t.supplier.groupBy(F.concat(F.lit("b:"), F.floor("s_acctbal").cast("string")).alias("id_value"))
        .agg(F.lit("account").alias("id_type"), (F.min("s_suppkey") + 500000).alias("person_id"))
    )
    return i.assign_person_ids(rows, "c_custkey", known, 600000).select("c_custkey", "person_id")


@case(
    "i5_new_identifiers",
    f"""with ids as ({_IDS}) select id_value, min(c_custkey) as person_id, 'input-1' as source_input_id, min(id_type) as id_type from ids
        where id_value not in (select sha256({_EMAIL}) from customer where c_acctbal > 1000) group by 1""",
)
def _(t):
    rows = i.extract_identifiers(contacts(t), "shop").withColumns({"person_id": F.col("c_custkey"), "input_id": F.lit("input-1")})
    known = (
        contacts(t)
        .join(t.customer.where("c_acctbal > 1000").select("c_custkey"), "c_custkey", "left_semi")
        .select(hash_v1("email").alias("id_value"))
        .distinct()
    )
    return i.new_identifiers(rows, known)


@case(
    "i6_people_from_table",
    """select o_custkey as remote_person_id, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') as last_modified, 'shop' as plugin_id
       from orders where o_orderdate >= timestamp '1996-03-01' and o_orderdate < timestamp '1999-01-01'""",
)
def _(t):
    table = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("remote_person_id"), "o_orderstatus",
        F.col("o_orderdate").alias("last_modified"),
    )
    return plain(i.people_from_table(table, "shop", "1996-03-01", "1999-01-01"))


@case(
    "i7_transactions_from_table",
    """select strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') as ts, o_totalprice as amount, case when o_orderstatus = 'F' then 'monthly' else '' end as recurs,
       o_orderkey as remote_entry_id, case when o_orderstatus = 'F' then 'TRANSACTION_RECURRING' else 'TRANSACTION_ONE_TIME' end as entry_type, 'shop' as plugin_id
       from orders where o_orderdate >= timestamp '1997-01-01'""",
)
def _(t):
    table = t.orders.select(
        F.monotonically_increasing_id().alias("id"),
        F.col("o_custkey").alias("person_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "monthly").otherwise("").alias("recurs"),
        F.col("o_orderkey").alias("remote_transaction_id"),
    )
    return plain(i.transactions_from_table(table, "shop", start="1997-01-01"))


# The components of customers by e-mail and phone, which link some of them through others.
_LINKED = f"""with recursive ids as (select c_custkey as k, 'm' || {_EMAIL} as v from customer
      union all select c_custkey, 'p' || {_PHONE} from customer where c_mktsegment <> 'BUILDING'),
    edges as (select distinct a.k as x, b.k as y from ids a join ids b on a.v = b.v),
    reach as (select k, k as y from ids union select r.k, e.y from reach r join edges e on r.y = e.x),
    comp as (select k, min(y) as root from reach group by k)"""


def rooted(found, row, person="person_id"):
    """Each row with the smallest row of its person."""
    return found.join(found.groupBy(person).agg(F.min(row).alias("root")), person).select(row, "root")


@case(
    "i8_load_people",
    f"""{_LINKED} select c_custkey, root, (select count(distinct root) from comp) as people,
        (select count(distinct (root, {_EMAIL})) from comp join customer on k = c_custkey) as emails,
        (select count(distinct (root, {_PHONE})) from comp join customer on k = c_custkey where c_mktsegment <> 'BUILDING') as phones,
        (select count(*) + count(distinct {_EMAIL}) + count(distinct {_PHONE}) filter (c_mktsegment <> 'BUILDING') from customer) as identifiers
        from customer join comp on k = c_custkey""",
)
def _(t):
    rows = contacts(t)
    state = i.empty_state(t.spark)
    first, state = i.load_people(rows, state, "shop", "input-1", "c_custkey")
    again, state = i.load_people(rows, state, "shop", "input-2", "c_custkey")
    # Loading the file a second time must find the same people and add nothing.
    same = first.select("c_custkey", "person_id").join(again.select("c_custkey", "person_id"), ["c_custkey", "person_id"])
    tables = {"people": "person", "emails": "person_email", "phones": "person_phone", "identifiers": "person_identifier"}
    out = rooted(same, "c_custkey")
    for name, table in tables.items():
        out = out.withColumn(name, state[table].agg(F.count(F.lit(1))).scalar())
    return out


@case(
    "i8_load_people_files",
    """select c_custkey, min(c_custkey) over (partition by c_custkey // 4) as root,
       (select count(distinct c_custkey // 4) from customer) as people, (select count(distinct c_custkey // 4) from customer) as emails from customer""",
)
def _(t):
    # Four neighbours share an e-mail; one in eight of them comes with a later, second load.
    rows = t.customer.select(
        "c_custkey", F.col("c_custkey").alias("remote_person_id"),
        F.concat(F.lit("u"), F.floor(F.col("c_custkey") / 4).cast("string"), F.lit("@example.org")).alias("email"),
    )
    path = scratch_path(t.spark, "people")
    late = F.col("c_custkey") % 8 == 3
    found = i.load_people_files(rows.where(~late), path, "shop", "input-1", "c_custkey", digits=1)
    later = i.load_people_files(rows.where(late), path, "shop", "input-2", "c_custkey", digits=1)
    i.load_people_files(rows.where(late), path, "shop", "input-2", "c_custkey", digits=1)
    out = rooted(found.unionByName(later), "c_custkey")
    state = i.stored_people(t.spark, path)
    return out.withColumns({
        "people": state["person"].agg(F.count(F.lit(1))).scalar(), "emails": state["person_email"].agg(F.count(F.lit(1))).scalar(),
    })

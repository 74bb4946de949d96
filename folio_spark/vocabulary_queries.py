"""Registered queries over terms, links, keys and functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog_queries import part_attrs, query, table
from .functions import text as T
from .operators import graph as G
from .operators import relational as R
from .operators import vocabulary as V

# A hierarchy of the driver's tables: supplier -> nation -> region, and customers filed under nations.
EDGES = "edges as (select 's' || s_suppkey child, 'n' || s_nationkey parent from supplier union all select 'n' || n_nationkey, 'r' || n_regionkey from nation)"
# Links between two vocabularies: parts and brands x types.
LINKS = "links as (select 'https://a.org/' || p_partkey || '/' src, case when p_size % 2 = 0 then 'exact' else 'close' end rel, 'http://b.org/' || p_partkey // 3 dst from part)"


def edges(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    named = lambda t, a, x, b, y: t.select(F.concat(F.lit(a), x).alias("child"), F.concat(F.lit(b), y).alias("parent"))
    return named(s, "s", "s_suppkey", "n", "s_nationkey").unionAll(named(n, "n", "n_nationkey", "r", "n_regionkey"))


def links(spark, d):
    rel = F.when(F.col("p_size") % 2 == 0, "exact").otherwise("close")
    p = table(spark, d, "part")
    return p.select(F.concat(F.lit("https://a.org/"), "p_partkey", F.lit("/")).alias("src"), rel.alias("rel"), F.concat(F.lit("http://b.org/"), F.floor(F.col("p_partkey") / 3).cast("long")).alias("dst"))


@query(f"with {EDGES} select s.child id, [s.child, s.parent, n.parent] path from edges s join edges n on s.parent = n.child union all select child, [child, parent] from edges where parent like 'r%' union all select distinct parent, [parent] from edges where parent like 'r%'")
def root_path(spark, d):
    return G.root_paths(edges(spark, d))


@query(f"""with {EDGES}, seeds as (select c_custkey item_id, 'n' || c_nationkey term from customer),
w as (select item_id, term, 1.0::double w from seeds union all select item_id, parent, 0.5 from seeds join edges on term = child union all select item_id, child, 0.5 from seeds join edges on term = parent)
select item_id, term, max(w) weight from w group by all""")
def concept_expand(spark, d):
    e = edges(spark, d)
    seeds = table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), F.concat(F.lit("n"), "c_nationkey").alias("term"))
    return G.expand_concepts(seeds, R.closure(e), e)


# Every part is merged into the one of half its number; those numbered up to 5 are ends.
@query("select p_partkey from_id, (p_partkey >> floor(log2(p_partkey / 5.0000001))::int >> (case when (p_partkey >> floor(log2(p_partkey / 5.0000001))::int) > 5 then 1 else 0 end))::bigint to_id from part where p_partkey > 5")
def redirects(spark, d):
    merges = table(spark, d, "part").where("p_partkey > 5").select(F.col("p_partkey").alias("from_id"), F.floor(F.col("p_partkey") / 2).cast("long").alias("to_id"))
    return G.redirects(merges, cycles=True)


@query(f"with {EDGES} select child parent, parent child, true would_cycle from edges where parent like 'n%' union all select 's' || s_suppkey, 's' || (s_suppkey + 1), false from supplier")
def would_cycle(spark, d):
    """A nation under one of its suppliers closes a cycle; a supplier under another doesn't."""
    e, s = edges(spark, d), table(spark, d, "supplier")
    turned = e.where("parent like 'n%'").select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    flat = s.select(F.concat(F.lit("s"), F.col("s_suppkey") + 1).alias("child"), F.concat(F.lit("s"), "s_suppkey").alias("parent"))
    return G.closes_cycle(turned.unionAll(flat), R.closure(e))


@query(f"""with {LINKS}, canon as (select regexp_replace(regexp_replace(src, '^https?://', ''), '/$', '') a, regexp_replace(dst, '^https?://', '') b, case rel when 'exact' then 2 else 1 end w from links),
sym as (select a, b, max(w) w from (select * from canon union all select b, a, w from canon) group by a, b),
found as (select a, b, w, 1 direct from sym union all select x.a, y.b, least(x.w, y.w), 0 from sym x join sym y on x.b = y.a where x.a <> y.b),
best as (select *, row_number() over (partition by a, b order by w desc, direct desc) r from found)
select a src, b dst, case w when 2 then 'exact' else 'close' end strength, direct = 1 direct from best where r = 1""")
def equivalents(spark, d):
    return V.equivalents(links(spark, d))


@query(f"""with {LINKS}, u as (select 'https://b.org/' || n_nationkey || '/' uri, 'b.org/' || n_nationkey k from nation union all select 'a.org/' || n_nationkey, 'a.org/' || n_nationkey from nation),
t as (select regexp_replace(regexp_replace(src, '^https?://', ''), '/$', '') k, 0 tier, src id from links union all select regexp_replace(dst, '^https?://', ''), case rel when 'exact' then 1 else 2 end, src from links),
best as (select u.uri, t.id, row_number() over (partition by u.uri order by tier, id) r from u join t using (k)) select uri, 'a' as scheme, id from best where r = 1""")
def match_identifier(spark, d):
    n = table(spark, d, "nation")
    uris = n.select(F.concat(F.lit("https://b.org/"), "n_nationkey", F.lit("/")).alias("uri")).unionAll(n.select(F.concat(F.lit("a.org/"), "n_nationkey")))
    found = links(spark, d)
    return V.match_identifiers(uris, found.select(F.lit("a").alias("scheme"), F.col("src").alias("id")).distinct(), found)


@query("""with h as (select distinct '  ' || upper(p_name) || ' ' heading, lower(p_name) k from part), l as (select lower(p_name) k, p_partkey id, case when p_size > 25 then 0.75 else 0.9 end::double c from part),
r as (select heading, id, c, row_number() over (partition by heading order by c desc, id) r from h join l using (k)) select heading, id, c confidence from r where r = 1""")
def match_label(spark, d):
    p = table(spark, d, "part")
    headings = p.select(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")).alias("heading")).distinct()
    return V.match_labels(headings, p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), (F.col("p_size") > 25).alias("alt")))


@query("select distinct l_orderkey work_id, case when l_suppkey % 4 = 1 then l_suppkey + 1 else l_suppkey end term from lineitem")
def authority_merge(spark, d):
    carriers = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("work_id"), F.col("l_suppkey").alias("term"))
    merged = table(spark, d, "lineitem").where("l_suppkey % 4 = 1").select(F.col("l_suppkey").alias("loser"), (F.col("l_suppkey") + 1).alias("winner")).distinct()
    return V.rewrite_references(carriers, "term", merged)


@query("select p_partkey work_id, 'subject' kind, 'https://a.org/small' as value from part where list_contains(string_split(p_name, ' '), 'small') union all select p_partkey, 'tag', word from (select p_partkey, unnest(string_split(p_name, ' ')) word from part) where word <> 'small'")
def promote_tag(spark, d):
    """Works with a tag gain the subject it was promoted to, and lose the tag."""
    tags = table(spark, d, "part").select(F.col("p_partkey").alias("work_id"), F.explode(F.split("p_name", " ")).alias("value"))
    gained = tags.where("value = 'small'").select("work_id", F.lit("subject").alias("kind"), F.lit("https://a.org/small").alias("value")).distinct()
    return gained.unionByName(tags.where("value <> 'small'").select("work_id", F.lit("tag").alias("kind"), "value"))


@query("select l_orderkey key, min(l_partkey) work_id from lineitem group by l_orderkey having count(distinct l_partkey) = 1")
def isbn_index(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("work_id"))
    return V.unambiguous(pairs, "key", "work_id")


@query("""with w as (select o_orderkey, row_number() over (order by o_orderkey) n from orders where o_orderstatus = 'P'), used as (select distinct 9000 + (c_custkey * 3) % 997 u from customer where c_custkey > 0),
free as (select x, row_number() over (order by x) n from (select unnest(range(9001, 9001 + (select count(*) from w) + 1000)) x) where x not in (select u from used)) select o_orderkey, x number from w join free using (n)""")
def next_ids(spark, d):
    """Numbers behind 9000 but those that are in use."""
    used = table(spark, d, "customer").where("c_custkey > 0").select((9000 + (F.col("c_custkey") * 3) % 997).alias("number"))
    return V.next_numbers(table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey"), "o_orderkey", 9000, used)


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def orphan_blobs(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("select c_custkey work_id, case when c_custkey in (select o_custkey from orders) then 'stays' when c_mktsegment = 'BUILDING' then 'kept' else 'leaves' end state from customer")
def feed_leavers(spark, d):
    """Works that a feed no longer names leave it, unless protected."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("work_id"), "c_mktsegment")
    present = table(spark, d, "orders").select(F.col("o_custkey").alias("work_id"), F.lit(True).alias("here")).distinct()
    state = F.when(F.col("here"), "stays").when(F.col("c_mktsegment") == "BUILDING", "kept").otherwise("leaves")
    return c.join(present, "work_id", "left").select("work_id", state.alias("state"))


@query("select l_orderkey barcode, count(distinct l_partkey) n, list_sort(list(distinct l_partkey)) works from lineitem where l_returnflag = 'R' group by l_orderkey having count(distinct l_partkey) >= 2")
def dup_barcodes(spark, d):
    t = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("barcode"))
    return t.agg(F.count_distinct("l_partkey").alias("n"), F.array_sort(F.collect_set("l_partkey")).alias("works")).where("n >= 2")


@query("select flags lang, count(*) n from (select case when count(distinct l_returnflag) > 1 then 'multilingual' else min(l_returnflag) end flags from lineitem group by l_orderkey) group by flags")
def lang_distribution(spark, d):
    one = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("lo"), F.max("l_returnflag").alias("hi"))
    return one.select(F.when(F.col("lo") != F.col("hi"), "multilingual").otherwise(F.col("lo")).alias("lang")).groupBy("lang").agg(F.count("*").alias("n"))


@query("select l_partkey work_id, list_sort(list(distinct l_returnflag) filter (l_suppkey = first)) langs from (select *, min(l_suppkey) over (partition by l_partkey) as first from lineitem) group by l_partkey")
def merged_languages(spark, d):
    """The languages that the first feed gives a work."""
    by_feed = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("langs"))
    return by_feed.groupBy(F.col("l_partkey").alias("work_id")).agg(F.min_by("langs", "l_suppkey").alias("langs"))


@query("select p_name base, min_by(p_partkey, struct_pack(a := p_brand, b := p_partkey)) target, count(distinct p_brand) n from part group by p_name having count(distinct p_brand) >= 2")
def translation_of(spark, d):
    t = table(spark, d, "part").groupBy(F.col("p_name").alias("base"))
    return t.agg(F.min_by("p_partkey", F.struct("p_brand", "p_partkey")).alias("target"), F.count_distinct("p_brand").alias("n")).where("n >= 2")


@query("select lower(p_name) series, count(*) n, bool_or(p_size > 45) traced from part group by 1")
def series_merge(spark, d):
    titles = table(spark, d, "part").select(F.concat(F.initcap("p_name"), F.lit(" ;")).alias("title"), (F.col("p_size") > 45).alias("traced"))
    return titles.groupBy(T.series_key(F.col("title")).alias("series")).agg(F.count("*").alias("n"), F.bool_or("traced").alias("traced"))


@query("(select 'added' change, l_orderkey, l_partkey from lineitem where l_quantity > 20 except all select 'added', l_orderkey, l_partkey from lineitem where l_quantity <= 40) union all (select 'removed', l_orderkey, l_partkey from lineitem where l_quantity <= 40 except all select 'removed', l_orderkey, l_partkey from lineitem where l_quantity > 20)")
def graph_diff(spark, d):
    li = table(spark, d, "lineitem")
    old, new = (li.where(c).select("l_orderkey", "l_partkey") for c in ("l_quantity <= 40", "l_quantity > 20"))
    return new.exceptAll(old).select(F.lit("added").alias("change"), "*").unionByName(old.exceptAll(new).select(F.lit("removed").alias("change"), "*"))


@query("(select distinct l_orderkey, l_partkey from lineitem where (l_orderkey, l_partkey) not in (select l_orderkey, l_partkey from lineitem where l_returnflag = 'R')) union select o_orderkey, -1 from orders where o_orderstatus = 'P'")
def patch_apply(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    gone = li.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
    added = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(-1).cast("long").alias("l_partkey"))
    return li.select("l_orderkey", "l_partkey").join(gone, ["l_orderkey", "l_partkey"], "left_anti").unionByName(added).distinct()


@query("select o_orderkey from orders where o_orderstatus = 'P' and o_orderpriority <> '1-URGENT'")
def withdrawn_queue(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'P' and o_orderpriority <> '1-URGENT'").select("o_orderkey")


@query("select p_partkey from part where p_brand in ('Brand#1', 'Brand#2', 'Brand#11', 'Brand#12') and not list_contains(string_split(p_name, ' '), 'small')")
def facet_exclude(spark, d):
    a = part_attrs(spark, d)
    only = a.where("dim = 'contributor' and value in ('Brand#1', 'Brand#2', 'Brand#11', 'Brand#12')").select("work_id")
    out = a.where("dim = 'tag' and value = 'small'").select("work_id")
    return table(spark, d, "part").select(F.col("p_partkey").alias("work_id")).join(only, "work_id", "left_semi").join(out, "work_id", "left_anti").select(F.col("work_id").alias("p_partkey"))


@query("select p_partkey from part where contains(lower(p_name), 'ma') or contains(lower(p_type), 'ma') or contains(cast(p_partkey as varchar), 'ma')")
def work_match(spark, d):
    fields = F.array("p_name", "p_type", F.col("p_partkey").cast("string"))
    return table(spark, d, "part").where(F.exists(fields, lambda x: F.contains(F.lower(x), F.lit("ma")))).select("p_partkey")


@query("""select page_id, case when starts_with(url, 'http://') then 'plain' when starts_with(url, 'https://www.') then 'www' when starts_with(url, 'https://') then 'tls' end as scheme,
 regexp_replace(regexp_replace(url, '^https?://', ''), '/$', '') uri from pages""")
def scheme_of(spark, d):
    scheme = T.scheme_of(F.col("url"), [("http://", "plain"), ("https://www.", "www"), ("https://", "tls")])
    return table(spark, d, "pages").select("page_id", scheme.alias("scheme"), T.canon_uri(F.col("url")).alias("uri"))


@query("""select p_partkey, string_split(p_name, ' ')[2] || ', ' || string_split(p_name, ' ')[1] inverted, p_name as name, p_type as role, p_brand core, '978' || lpad(p_partkey::varchar, 10, '0') isbn,
 string_split(p_name, ' ') parts, case when p_size % 3 = 0 then p_name when p_size % 3 = 1 then p_type else p_brand end label from part""")
def text_functions(spark, d):
    """Names, roles, title cores, ISBNs, lists and labels."""
    p = table(spark, d, "part")
    role = T.split_role(F.concat("p_name", F.lit(" ("), "p_type", F.lit(") ")))
    labels = F.create_map(F.lit("de"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(""), F.lit("en"), F.when(F.col("p_size") % 3 == 1, F.col("p_type")).otherwise(""), F.lit("fr"), F.col("p_brand"))
    return p.select(
        "p_partkey",
        T.last_first(F.col("p_name")).alias("inverted"),
        role["name"].alias("name"),
        role["role"].alias("role"),
        T.title_core(F.concat("p_brand", F.lit(": "), "p_name")).alias("core"),
        T.norm_isbn(F.concat(F.lit("978-"), F.lpad(F.col("p_partkey").cast("string"), 10, "0"))).alias("isbn"),
        T.split_list(F.replace(F.col("p_name"), F.lit(" "), F.lit(" , ,"))).alias("parts"),
        T.pick_label(labels, ["de"]).alias("label"),
    )

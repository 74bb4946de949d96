"""Registered queries over works: near-duplicate tiers, facet predicate, pages, label search, categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog_queries import query, table
from .functions import text as T
from .operators import works as W


@query("""with w as (select p_partkey id, lower(p_name) core, case when p_partkey % 10 = 0 then '' else replace(lower(p_brand), '#', ' ') end author, lower(p_type) sub, (p_size % 3)::varchar lang, floor(p_retailprice)::bigint::varchar isbn from part),
k as (select id, author, unnest([0, 1, 2, 3]) t, unnest([author || chr(31) || core || ' ' || sub || chr(31) || lang, case when author <> '' then concat_ws('/', core, author, lang) end, isbn, concat_ws('/', core, lang)]) key from w),
pairs as (select a.t, a.key, a.id x, b.id y from k a join k b on a.t = b.t and a.key = b.key and a.id < b.id),
fresh as (select t, key from (select *, min(t) over (partition by x, y) as first from pairs) where t = first group by all),
good as (select t, key from k join fresh using (t, key) group by all having t < 3 or count(distinct author) > 1)
select ['exact', 'subtitle', 'identifier', 'contributor'][t + 1] tier, key, id work_id from k join good using (t, key)""")
def near_dup(spark, d):
    """A work without an author has no subtitle tier; among contributors none is a value like others."""
    p = table(spark, d, "part").withColumns({"work_id": F.col("p_partkey"), "title": F.concat("p_name", F.lit(": "), "p_type"), "lang": (F.col("p_size") % 3).cast("string")})
    author = F.when(F.col("p_partkey") % 10 != 0, F.col("p_brand"))
    core, name = T.norm_key(T.title_core(F.col("title"))), T.norm_key(author)
    tiers = {
        "exact": T.cluster_key(F.coalesce(author, F.lit("")), F.col("title"), F.array("lang")),
        "subtitle": F.when(name != "", F.concat_ws("/", core, name, "lang")),
        "identifier": F.floor("p_retailprice").cast("long").cast("string"),
        "contributor": F.concat_ws("/", core, "lang"),
    }
    return W.near_duplicates(p, "work_id", tiers, {"contributor": name})


@query("select p_partkey from part where p_brand in ('Brand#1', 'Brand#2', 'Brand#11') and len(list_intersect(string_split(p_name, ' '), ['small', 'cold'])) > 0")
def facet_filter(spark, d):
    """Contributors are compared as they are, tags without case; no subject is chosen."""
    values = {"contributor": F.array("p_brand"), "tag": F.split("p_name", " "), "subject": F.array("p_type")}
    chosen = {"contributor": ["Brand#1", "Brand#2", "Brand#11", "brand#5"], "tag": ["SMALL", "Cold"], "subject": []}
    return table(spark, d, "part").where(W.matches_facets(values, chosen)).select("p_partkey")


@query("""with o as (select o_orderkey, o_orderstatus = 'P' gone, o_orderpriority = '1-URGENT' hit from orders)
select o_orderkey, (select count(*) from o where not gone) total, (select count(*) from o where not gone and hit) matched from (select o_orderkey from o where not gone and hit order by o_orderkey limit 50 offset 20)""")
def works_page(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return W.works_page(o, F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "P", ["o_orderkey"], offset=20).select("o_orderkey", "total", "matched")


@query("""with l as (select 's' || s_suppkey uri, lower(s_name) norm from supplier union all select 'n' || n_nationkey, lower(n_name) from nation union all select 's' || s_suppkey, 'sup' from supplier where s_suppkey % 10 = 0)
select uri, min(norm) norm from l where starts_with(norm, 'sup') group by uri""")
def prefix_search(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    uri = F.concat(F.lit("s"), "s_suppkey").alias("uri")
    labels = s.select(uri, F.col("s_name").alias("label")).unionAll(n.select(F.concat(F.lit("n"), "n_nationkey"), "n_name")).unionAll(s.where("s_suppkey % 10 = 0").select(uri, F.lit(" SUP ").alias("label")))
    return W.prefix_hits(labels, "  Sup")


@query("""with o as (select 'p' || p_partkey uri, lower(p_name) || ' *' norm from part where p_partkey % 5 = 0), s as (select 'p' || p_partkey uri, lower(p_name) norm from part)
select uri, norm, origin from (select uri, norm, 'overlay' origin from o union all select uri, norm, 'snapshot' from s where uri not in (select uri from o)) order by norm, uri limit 40""")
def merge_hits(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("uri"), F.lower("p_name").alias("norm"), "p_partkey")
    return W.merge_hits(p.where("p_partkey % 5 = 0").select("uri", F.concat("norm", F.lit(" *")).alias("norm")), p.select("uri", "norm"), 40)


@query("""select category, uri from (select 'area' || r_regionkey category, 'r' || r_regionkey uri from region union all select 'area' || n_regionkey, 'n' || n_nationkey from nation
 union all select 'area' || n_regionkey, 's' || s_suppkey from supplier join nation on s_nationkey = n_nationkey union all select 'first', 'n1' union all select 'first', 's' || s_suppkey from supplier where s_nationkey = 1)""")
def category_roots(spark, d):
    n, r, s = (table(spark, d, t) for t in ("nation", "region", "supplier"))
    edges = n.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent")).unionAll(s.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey")))
    roots = r.select(F.concat(F.lit("area"), "r_regionkey").alias("category"), F.concat(F.lit("r"), "r_regionkey").alias("root"))
    return W.category_members(roots.unionAll(n.where("n_nationkey = 1").select(F.lit("first"), F.lit("n1"))), edges)


ONE = "case when length({0}) > 3 and {0} like '%ies' then regexp_replace({0}, 'ies$', 'y') when length({0}) > 3 and {0} like '%es' then regexp_replace({0}, 'es$', '') when length({0}) > 2 and {0} like '%s' then regexp_replace({0}, 's$', '') else {0} end"


@query(rf"select p_partkey, regexp_matches(' ' || lower(p_name) || ' ', ' small widget(s|es)? ') hit, regexp_matches(' ' || lower(p_name) || 's ', ' widget(s|es)? ') many, list_transform(string_split(lower(p_name) || 's', ' '), lambda w: {ONE.format('w')}) = list_transform(string_split(lower(p_name), ' '), lambda w: {ONE.format('w')}) same from part")
def keyword_match(spark, d):
    """A keyword within a heading, its plural, and two headings that differ in plural endings alone."""
    name = F.col("p_name")
    same = T.plural_equal(F.concat(F.lower(name), F.lit("s")), F.lower(name)).alias("same")
    return table(spark, d, "part").select("p_partkey", T.has_keywords(name, "Small, widget").alias("hit"), T.has_keywords(F.concat(name, F.lit("s")), "widget").alias("many"), same)


@query("select p_type scheme, p_brand term, count(*) works from part where p_type = 'ECONOMY' group by all having count(*) between 2 and 60")
def usage_window(spark, d):
    usage = table(spark, d, "part").groupBy(F.col("p_type").alias("scheme"), F.col("p_brand").alias("term")).agg(F.count("*").alias("works"))
    return W.usage_window(usage, "ECONOMY", 2, 60)


@query(r"""with t as (select doc_id, unnest(string_split(string_split(coalesce(text, ''), chr(10))[1], ' ')[1:4]) raw from documents), f as (select doc_id, lower(trim(regexp_replace(raw, '[\s\x{a0}]+', ' ', 'g'))) tag from t)
select tag, count(distinct doc_id) n from f where length(tag) between 2 and 60 and not regexp_matches(tag, '://|www\.|<|>|&#|\\u|\{|\}|[\x00-\x1f]') group by tag""")
def folk_tags(spark, d):
    """The first words of documents as readers' tags; the table's letters are composed, so that SQL needs no Unicode form."""
    from .functions.cleaning import folk_tag

    words = F.slice(F.split(F.split(F.coalesce("text", F.lit("")), "\n")[0], " "), 1, 4)
    tags = table(spark, d, "documents").select("doc_id", F.explode(words).alias("raw")).select("doc_id", folk_tag("raw").alias("tag"))
    return tags.where("tag is not null").groupBy("tag").agg(F.count_distinct("doc_id").alias("n"))

"""Registered queries of the catalog engine over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import relational as R
from .operators.similarity import Options, similar_works

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries():
    from . import graph_queries, vocabulary_queries, work_queries  # noqa: F401  they register their queries

    return dict(QUERIES)


def oracle_sql():
    from . import graph_queries, vocabulary_queries, work_queries  # noqa: F401

    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_attrs(spark, d) -> DataFrame:
    """(work_id, dim, value): brand as contributor, type as subject, words of the name as tags."""
    p = table(spark, d, "part")
    one = lambda dim, c: F.struct(F.lit(dim).alias("dim"), c.alias("value"))
    tags = F.transform(F.split("p_name", " "), lambda w: F.struct(F.lit("tag").alias("dim"), w.alias("value")))
    return p.select(F.col("p_partkey").alias("work_id"), F.explode(F.concat(F.array(one("contributor", F.col("p_brand")), one("subject", F.col("p_type"))), tags)).alias("a")).select("work_id", "a.dim", "a.value")


ATTRS = """attrs as (select p_partkey work_id, 'contributor' dim, p_brand as value from part union all select p_partkey, 'subject', p_type from part
 union all select p_partkey, 'tag', unnest(string_split(p_name, ' ')) from part)"""


@query(f"with {ATTRS} select dim, value, count(distinct work_id) n from attrs where value <> '' group by all")
def facets(spark, d):
    return R.facet_counts(part_attrs(spark, d))


@query("""with p as (select p_brand, p_type, cast(p_size as varchar) p_size, p_brand in ('Brand#11','Brand#23') b, p_type in ('ECONOMY','STANDARD','PROMO') t from part),
c as (select 'brand' dim, p_brand as value, count(*) n from p where t group by all union all select 'type', p_type, count(*) from p where b group by all union all select 'size', p_size, count(*) from p where b and t group by all),
r as (select *, row_number() over (partition by dim order by n desc, value) r from c),
pin as (select * from (values ('brand','Brand#11'),('brand','Brand#23'),('type','ECONOMY'),('type','STANDARD'),('type','PROMO')) v(dim, value))
select coalesce(r.dim, pin.dim) dim, coalesce(r.value, pin.value) as value, coalesce(n, 0) n from r full join pin on r.dim = pin.dim and r.value = pin.value where r <= 20 or pin.dim is not null""")
def facets_self_excluding(spark, d):
    chosen = {"brand": ["Brand#11", "Brand#23"], "type": ["ECONOMY", "STANDARD", "PROMO"]}
    return R.self_excluding_facets(table(spark, d, "part"), {"brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size")}, chosen)


@query("""with a as (select distinct l_partkey work_id, 'subject' rel, l_orderkey as value from lineitem union select distinct l_partkey, 'contributor', l_suppkey from lineitem),
n as (select greatest(2, floor(count(distinct work_id) * 0.2)) cap from a),
w as (select rel, value, count(*) df from a group by all having count(*) > 1 and count(*) <= (select cap from n)),
p as (select x.work_id, y.work_id other_id, round(sum(1 / log2(df + 2)), 6) score from a x join w using (rel, value) join a y using (rel, value) where x.work_id <> y.work_id group by all),
r as (select *, row_number() over (partition by work_id order by score desc, other_id) rank from p) select work_id, other_id, score, rank from r where rank <= 8""")
def similar_topk(spark, d):
    """Orders and suppliers in common, weighted alike; the commonest values have most of the pairs."""
    # Lines are dealt by part once; equal rows of a part meet there.
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("work_id"), "l_orderkey", "l_suppkey").repartition("work_id")
    one = lambda rel, c: F.struct(F.lit(rel).alias("rel"), F.col(c).alias("value"))
    attrs = li.select("work_id", F.explode(F.array(one("subject", "l_orderkey"), one("contributor", "l_suppkey"))).alias("a")).select("work_id", "a.rel", "a.value").distinct()
    return similar_works(attrs, options=Options(weights={}))


@query("""with g as (select *, case when ts - lag(ts) over w > interval 30 minute or lag(ts) over w is null then 1 else 0 end nw from events where user_id is not null window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(nw) over (partition by user_id order by ts, event_id rows unbounded preceding) s from g) select user_id, min(ts) started, max(ts) ended, count(*) n from s group by user_id, s""")
def sessions(spark, d):
    return R.sessions(table(spark, d, "events"))


@query("select l_suppkey term, count(distinct l_partkey) n_works, count(*) n_links from lineitem group by all")
def authority_usage(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("term")).agg(F.count_distinct("l_partkey").alias("n_works"), F.count("*").alias("n_links"))


@query("""with e as (select 'n' || n_nationkey child, 'r' || n_regionkey parent from nation union all select 'r' || r_regionkey, 'world' from region),
i as (select c_custkey item_id, 'n' || c_nationkey term from customer)
select term, count(distinct item_id) n from (select item_id, term from i union all select item_id, parent from i join e on child = term union all select item_id, 'world' from i join e on child = term) group by term""")
def hierarchy_rollup(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    edges = n.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent")).unionAll(r.select(F.concat(F.lit("r"), "r_regionkey"), F.lit("world")))
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), F.concat(F.lit("n"), "c_nationkey").alias("term"))
    return R.rollup_hierarchy(items, R.closure(edges))


@query("""with edges as (select 's' || s_suppkey child, 'n' || s_nationkey parent from supplier union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 'r' || r_regionkey, 'world' from region)
select child id, parent ancestor, 1 hops from edges union all select a.child, b.parent, 2 from edges a join edges b on a.parent = b.child union all select a.child, c.parent, 3 from edges a join edges b on a.parent = b.child join edges c on b.parent = c.child""")
def ancestors(spark, d):
    """The way up from suppliers, nations and regions."""
    named = lambda t, a, x, b: table(spark, d, t).select(F.concat(F.lit(a), x).alias("child"), b.alias("parent"))
    edges = named("supplier", "s", "s_suppkey", F.concat(F.lit("n"), "s_nationkey")).unionAll(named("nation", "n", "n_nationkey", F.concat(F.lit("r"), "n_regionkey"))).unionAll(named("region", "r", "r_regionkey", F.lit("world")))
    return R.closure(edges)


@query("select doc_id, trim(lower(regexp_replace(text, '[^\\p{L}\\p{Nd}]+', ' ', 'g'))) norm from documents")
def norm_key(spark, d):
    return table(spark, d, "documents").select("doc_id", T.norm_key(F.col("text")).alias("norm"))


KEYED = """keyed as (select doc_id, lang, source, trim(lower(regexp_replace(string_split(text, chr(10))[1], '[^\\p{L}\\p{Nd}]+', ' ', 'g'))) title from documents)"""


@query(f"with {KEYED} select title, lang, count(distinct doc_id) n, min(doc_id) first_id from keyed where title <> '' group by all having count(distinct doc_id) >= 2")
def dup_keys(spark, d):
    t = table(spark, d, "documents").select("doc_id", "lang", T.norm_key(F.split("text", "\n")[0]).alias("title"))
    return t.where("title <> ''").groupBy("title", "lang").agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("first_id")).where("n >= 2")


@query(f"with {KEYED}, one as (select title, lang from keyed where title <> '' group by all having count(distinct doc_id) = 2 and count(distinct source) = 2 and count(distinct (doc_id, source)) = 2) select a.doc_id a, b.doc_id b from keyed a join keyed b on a.title = b.title and a.lang = b.lang and a.source < b.source semi join one on a.title = one.title and a.lang = one.lang")
def cross_feed_merge(spark, d):
    """Works of two feeds with one key: a pair if the key names one work in each and none elsewhere; an ambiguous key bridges nothing."""
    t = table(spark, d, "documents").select("doc_id", "lang", "source", T.norm_key(F.split("text", "\n")[0]).alias("title")).where("title <> ''")
    return R.bridges(t, ["title", "lang"], "source", "doc_id")


@query("select lang, count(*) n, sum(n_chars)::bigint chars, round(avg((quality = 1)::int) filter (quality is not null), 6) good, count(quality) labelled, count(*) - count(quality) unlabelled from documents left join labels using (doc_id) group by all")
def coverage_audit(spark, d):
    """Shares over labelled works, with explicit denominators; works without a label are in none."""
    j = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    good = F.round(F.avg((F.col("quality") == 1).cast("int")), 6)  # null without a label, which no average counts
    return j.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), good.alias("good"), F.count("quality").alias("labelled"), (F.count("*") - F.count("quality")).alias("unlabelled"))


@query(f"with {ATTRS}, c as (select dim, value, count(distinct work_id) n from attrs group by all), r as (select *, row_number() over (partition by dim order by n desc, value) rank, count(*) over (partition by dim) total from c) select dim, value, n, rank, total from r where rank <= 10")
def term_histogram(spark, d):
    from pyspark.sql import Window

    c = R.facet_counts(part_attrs(spark, d)).withColumn("total", F.count("*").over(Window.partitionBy("dim")))
    return R.top_per_group(c, ["dim"], [F.desc("n"), F.col("value")], 10)


@query("select event_id, user_id, value from events where event_type <> 'click' or value is null union all select event_id, user_id, -1.0 from events where event_type = 'click'")
def override_shadow(spark, d):
    e = table(spark, d, "events")
    edits = e.where("event_type = 'click'").select("event_id", "user_id", F.lit(-1.0).alias("value"))
    return R.override_shadow(e.select("event_id", "user_id", "value"), edits, ["event_id"])


@query("select o_orderkey work_id, case when o_orderstatus = 'F' then 'tombstoned' when o_orderpriority = '1-URGENT' then 'suppressed' when o_orderstatus = 'P' and o_totalprice < 100000 then 'withdrawn' else 'public' end bucket from orders")
def visibility_bucket(spark, d):
    o = table(spark, d, "orders")
    bucket = F.when(F.col("o_orderstatus") == "F", "tombstoned").when(F.col("o_orderpriority") == "1-URGENT", "suppressed").when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 100000), "withdrawn").otherwise("public")
    return o.select(F.col("o_orderkey").alias("work_id"), bucket.alias("bucket"))


@query("""select l_partkey, arg_min(l_returnflag, struct_pack(a := l_suppkey, b := l_orderkey, c := l_linenumber)) flag, bool_or(l_quantity > 49) big from lineitem group by all""")
def merge_feeds(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", F.col("l_returnflag").alias("flag"), (F.col("l_quantity") > 49).alias("big"), F.struct("l_suppkey", "l_orderkey", "l_linenumber").alias("rank"))
    return R.merge_feeds(rows, "l_partkey", "rank", ["flag"], ["big"])


POSTINGS = """post as (select doc_id, term, count(*) tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')) term from documents) group by all)"""


@query(f"with {POSTINGS}, len as (select doc_id, sum(tf) len from post group by all), st as (select count(*) n, avg(len) mean from len), h as (select * from post where term in ('idiot','heretion','clown')), df as (select term, count(*) df from h group by all) select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) score from h join df using (term) join len using (doc_id), st group by doc_id order by score desc, doc_id limit 20")
def bm25_topk(spark, d):
    return R.bm25(table(spark, d, "documents"), "doc_id", F.col("text"), ["idiot", "heretion", "clown"], 20)


@query(f"with {POSTINGS} select doc_id from post where term in ('the','of','that') group by doc_id having count(*) = 3")
def term_and(spark, d):
    return R.all_terms(table(spark, d, "documents"), "doc_id", F.col("text"), ["the", "of", "that"])


@query("select p_partkey, hits from (select p_partkey, (contains(lower(p_name),'sma')::int + contains(lower(p_name),'mal')::int + contains(lower(p_name),'all')::int)::bigint hits from part) where hits >= 2")
def trigram_search(spark, d):
    return R.trigram_search(table(spark, d, "part"), "p_partkey", F.col("p_name"), "small", 1)


@query("""with u as (select vec_id, embedding::double[] e from embeddings), p as (select a.vec_id query_id, b.vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) cosine from u a, u b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by cosine desc, vec_id) rank from p) select query_id, vec_id, cosine, rank from r where rank <= 5""")
def vector_topk(spark, d):
    return R.vector_topk(table(spark, d, "embeddings"))


@query("select date_trunc('hour', ts) start, user_id, count(*) n from events group by all")
def rate_limit(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "user_id").agg(F.count("*").alias("n"))


@query("select user_id, count(*) n, count(distinct cast(ts as date)) active_days, min(ts) first_ts, max(ts) last_ts, count(distinct event_type) kinds from events group by all")
def actor_stats(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("active_days"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("event_type").alias("kinds"))


@query("""with b as (select user_id, ts, event_id, (value < 50)::int bad from events), i as (select *, sum(1 - bad) over (partition by user_id order by ts, event_id rows unbounded preceding) g from b)
select user_id, max(run) run from (select user_id, g, count(*) run from i where bad = 1 group by all) group by user_id having max(run) >= 5""")
def breaker_trip(spark, d):
    return R.runs_of_failures(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.coalesce(F.col("value") < 50, F.lit(False)), 5)


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1 and event_type <> 'view'")
def feed_replay(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return R.latest(e, "user_id", F.struct("ts", "event_id"), F.col("event_type") != "view").drop("ts")


@query("""with o as (select o_orderkey, o_orderstatus tag from orders where o_orderkey % 3 <> 0), n as (select o_orderkey, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end tag from orders where o_orderkey % 7 <> 0)
select coalesce(o.o_orderkey, n.o_orderkey) o_orderkey, case when o.tag is null then 'added' when n.tag is null then 'removed' else 'changed' end change from o full join n on o.o_orderkey = n.o_orderkey where o.tag is distinct from n.tag""")
def etag_diff(spark, d):
    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("tag"))
    new = o.where("o_orderkey % 7 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("tag"))
    return R.listing_diff(old, new, "o_orderkey", "tag")


@query("select p_name, count(*) n, min(p_partkey) work_id from part group by p_name, p_brand, p_type having count(*) = 1")
def unambiguous_key(spark, d):
    """Keys that one work alone has."""
    return table(spark, d, "part").groupBy("p_name", "p_brand", "p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("work_id")).where("n = 1").select("p_name", "n", "work_id")


@query("select * from (select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey > 500 order by o_orderkey limit 50)")
def keyset_page(spark, d):
    return table(spark, d, "orders").where("o_orderkey > 500").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").limit(50)


@query("(select distinct l_partkey from lineitem where l_returnflag = 'R' intersect select distinct l_partkey from lineitem where l_returnflag = 'A') except select distinct l_partkey from lineitem where l_quantity > 49")
def set_ops(spark, d):
    li = table(spark, d, "lineitem")
    of = lambda c: li.where(c).select("l_partkey")
    return of("l_returnflag = 'R'").intersect(of("l_returnflag = 'A'")).subtract(of("l_quantity > 49"))


@query("select word tag, count(*) n from (select unnest(string_split(p_name, ' ')) word from part) where contains(lower(word), 'e') group by all order by n desc, tag limit 25")
def tag_typeahead(spark, d):
    tags = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("tag")).where(F.contains(F.lower("tag"), F.lit("e")))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(25)


@query("select o_custkey work_id, o_orderpriority term, count(*) support, round(max(o_totalprice), 2) best, bool_or(o_orderstatus = 'F') and bool_or(o_orderstatus = 'O') disputed from orders group by all")
def suggestion_agg(spark, d):
    o = table(spark, d, "orders")
    has = lambda s: F.bool_or(F.col("o_orderstatus") == s)
    return o.groupBy(F.col("o_custkey").alias("work_id"), F.col("o_orderpriority").alias("term")).agg(F.count("*").alias("support"), F.round(F.max("o_totalprice"), 2).alias("best"), (has("F") & has("O")).alias("disputed"))

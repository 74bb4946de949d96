"""Registered queries over quads and records that are derived from the tables: projection, identity, loading, similarity, peers, drill-down."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_queries import ATTRS, part_attrs, query, table
from .operators import canonical, drilldown, exports, peers, pivots, sets
from .operators import identity as I
from .operators import loading as L
from .operators import projection as P
from .operators import similarity as S
from .operators.lineage import cut
from .streaming import coalesce
from .streaming.feed import signed_counts

FEED, EDITORIAL = "feed:parts", "editorial:"
NAMES = {"bf": P.BF, "bflc": P.BFLC, "rdf": P.RDF, "rdfs": P.RDFS, "skos": P.SKOS, "own": P.OWN, "t": "http://terms.example/"}
SCHEMES = [("http://terms.example/p", "places"), ("http://terms.example/", "terms")]


def _quad(source: str, grain: str, ord_: str, s: str, p: str, o: str, kind: str = "literal", where: str = "true", g: str = FEED, lang: str = "cast(null as string)") -> str:
    head, _, tail = p.partition(":")
    return f"select {grain} as grain, cast({ord_} as bigint) as ord, {s} as s, '{NAMES[head]}{tail}' as p, {o} as o, '{kind}' as o_kind, {lang} as o_lang, '{g}' as g from {source} where {where}"


INSTANCES = "select l_partkey, l_returnflag, min(l_suppkey) as supplier, min(l_shipdate) as shipped from {lineitem} group by l_partkey, l_returnflag"


def _quads_sql() -> str:
    """SQL that Spark and DuckDB read alike: parts as works, their flags of return as instances, nations and regions as terms."""
    pt, term = "{part}", NAMES["t"]
    key = "cast(p_partkey as string)"
    grain, w = f"'w' || {key}", f"'#w' || {key} || 'Work'"
    ed = {"g": EDITORIAL}

    def part(ord_, s, p, o, kind="literal", where="true", **more):
        return _quad(pt, grain, str(ord_), w if s == "w" else f"'{s}'", p, o, kind, where, **more)

    rows = [
        part(1, "w", "rdf:type", f"'{P.BF}Work'", "iri"),
        part(2, "w", "bf:title", "'_:t'", "blank"),
        part(3, "_:t", "bf:mainTitle", "p_name"),
        part(4, "_:t", "bf:subtitle", "p_type", where="p_size % 3 = 0"),
        part(5, "w", "bf:summary", "'_:s0'", "blank", "p_size % 8 = 1"),
        part(6, "w", "bf:summary", "'_:s1'", "blank", "p_size % 4 = 1"),
        part(7, "_:s1", "rdfs:label", "'About ' || p_name"),
        part(8, "w", "bf:contribution", "'_:c2'", "blank"),
        part(9, "w", "bf:contribution", "'_:c1'", "blank"),
        part(10, "_:c1", "rdf:type", f"'{P.BFLC}PrimaryContribution'", "iri"),
        part(11, "_:c1", "bf:agent", "'_:a1'", "blank"),
        part(12, "_:a1", "rdfs:label", "p_brand"),
        part(13, "_:c1", "bf:role", "'_:r1'", "blank"),
        part(14, "_:r1", "rdfs:label", "'maker'"),
        part(15, "_:c2", "bf:agent", "'_:a2'", "blank"),
        part(16, "_:a2", "rdfs:label", "'Maker ' || cast(p_size % 5 as string)", where="p_size % 9 <> 0"),
        part(17, "w", "bf:contribution", "'#e1'", "iri", "p_partkey % 5 = 0", **ed),
        part(18, "#e1", "bf:agent", "'#ea'", "iri", "p_partkey % 5 = 0", **ed),
        part(19, "#ea", "rdfs:label", "p_brand", "literal", "p_partkey % 5 = 0", **ed),
        part(20, "#e1", "bf:role", "'#er'", "iri", "p_partkey % 10 = 0", **ed),
        part(21, "#er", "rdfs:label", "'maker'", "literal", "p_partkey % 10 = 0", **ed),
        part(22, "w", "bf:subject", f"'{term}p' || cast(p_size % 25 as string)", "iri"),
        part(23, "w", "bf:subject", f"'{term}p' || cast(p_partkey % 25 as string)", "iri", "p_partkey % 4 = 0", **ed),
        part(24, "w", "bf:subject", "'_:s2'", "blank"),
        part(25, "_:s2", "rdfs:label", "split_part(p_name, ' ', 1)"),
        part(26, "w", "bf:subject", "'#sk'", "iri", "p_partkey % 6 = 0"),
        part(27, "#sk", "rdfs:label", "split_part(p_name, ' ', 2)", "literal", "p_partkey % 6 = 0"),
        part(28, "w", "own:overrides", f"'{P.BF}subject'", "iri", "p_partkey % 7 = 0", **ed),
        part(29, "w", "own:tag", "'tag' || cast(p_size % 9 as string)", "literal", "p_partkey % 3 = 0", **ed),
        part(30, "w", "bf:language", "'http://id.loc.gov/vocabulary/languages/' || case p_size % 3 when 0 then 'eng' when 1 then 'fra' else 'spa' end", "iri"),
        part(31, "w", "bf:language", "'http://id.loc.gov/vocabulary/languages/spa'", "iri", "p_partkey % 10 = 0", **ed),
        part(32, "w", "own:tombstoned", "'2024'", "literal", "p_partkey % 11 = 0", **ed),
        part(33, "w", "own:suppressed", "case when p_partkey % 2 = 0 then 'true' else 'false' end", "literal", "p_partkey % 13 = 0", **ed),
        part(34, "w", "own:withdrawnFromFeed", "'2024'", "literal", "p_partkey % 19 = 0", **ed),
        part(36, "w", "own:extra/cover", f"'c' || {key}", where="p_partkey % 5 = 0"),
        part(37, "w", "own:extra/sources", "'alpha, beta,' || p_brand", where="p_size % 2 = 0"),
        part(38, "w", "own:extra/price", "cast(p_size as string)"),
        part(35, "w", "bf:hasPart", f"'#w' || cast(p_partkey + 1 as string) || 'Work'", "iri", "p_partkey % 8 = 0", **ed),
    ]
    inst = "{instances} x"
    ig, iw = "'w' || cast(l_partkey as string)", "'#i' || cast(l_partkey as string) || l_returnflag || 'Instance'"
    node = lambda n: f"'_:{n}' || l_returnflag"
    flag = "ascii(l_returnflag)"

    def of_inst(ord_, s, p, o, kind="literal", where="true"):
        return _quad(inst, ig, f"{ord_} + {flag}", iw if s == "i" else node(s), p, o, kind, where)

    rows += [
        _quad(inst, ig, f"100 + {flag}", "'#w' || cast(l_partkey as string) || 'Work'", "bf:hasInstance", iw, "iri"),
        of_inst(200, "i", "bf:identifiedBy", node("d1"), "blank"),
        of_inst(300, "d1", "rdf:type", f"'{P.BF}Isbn'", "iri"),
        of_inst(400, "d1", "rdf:value", f"'978' || cast(l_partkey * 100 + {flag} as string)"),
        of_inst(500, "i", "bf:identifiedBy", node("d2"), "blank", "l_returnflag = 'R'"),
        of_inst(600, "d2", "rdf:value", "'77' || cast(l_partkey as string)", "literal", "l_returnflag = 'R'"),
        of_inst(700, "d2", "bf:source", node("sc"), "blank", "l_returnflag = 'R'"),
        of_inst(800, "sc", "rdfs:label", "case when l_partkey % 2 = 0 then 'lend' else 'shop' end", "literal", "l_returnflag = 'R'"),
        of_inst(900, "i", "bf:media", node("m"), "blank", "l_returnflag <> 'R'"),
        of_inst(1000, "m", "rdfs:label", "case l_returnflag when 'A' then 'audio' else 'computer' end", "literal", "l_returnflag <> 'R'"),
        of_inst(1100, "i", "bf:carrier", node("k"), "blank"),
        of_inst(1200, "k", "rdfs:label", "'volume'"),
        of_inst(1300, "i", "bf:provisionActivity", node("p"), "blank"),
        of_inst(1400, "p", "rdf:type", f"'{P.BF}Publication'", "iri"),
        of_inst(1500, "p", "bflc:simpleAgent", "'S' || cast(supplier as string)"),
        of_inst(1600, "p", "bf:date", "cast(extract(year from shipped) as string)"),
    ]
    item = "'_:x' || cast(l_orderkey as string) || '_' || cast(l_linenumber as string)"
    rows.append(_quad("{lineitem}", ig, "10000 + l_orderkey * 10 + l_linenumber", iw, "bf:hasItem", item, "blank", "l_quantity = 50 and l_returnflag = 'A'"))
    rows.append(_quad("{lineitem}", ig, "10000 + l_orderkey * 10 + l_linenumber", item, "bf:shelfMark", "'QA ' || cast(l_suppkey as string)", "literal", "l_quantity = 50 and l_returnflag = 'A'"))
    told = {"g": "authority:terms", "lang": "'en'"}
    place, region = f"'{term}p' || cast(n_nationkey as string)", f"'{term}r' || cast(n_regionkey as string)"
    rows += [
        _quad("{nation}", "'authorities'", "n_nationkey", place, "rdfs:label", "'alt ' || n_name", **told),
        _quad("{nation}", "'authorities'", "100 + n_nationkey", place, "skos:prefLabel", "n_name", **told),
        _quad("{nation}", "'authorities'", "200 + n_nationkey", place, "skos:prefLabel", "lower(n_name)", "literal", "n_nationkey % 3 = 0", "authority:terms", "'de'"),
        _quad("{nation}", "'authorities'", "300 + n_nationkey", place, "skos:broader", region, "iri", "true", "authority:terms"),
        _quad("{nation}", "'authorities'", "400 + n_nationkey", place, "own:tagAlias", "'tag' || cast(n_nationkey % 9 as string)", "literal", "n_nationkey % 5 = 0", "authority:terms"),
        _quad("{region}", "'authorities'", "500 + r_regionkey", f"'{term}r' || cast(r_regionkey as string)", "skos:prefLabel", "r_name", **told),
        _quad("{region}", "'authorities'", "600 + r_regionkey", f"'{term}r' || cast(r_regionkey as string)", "skos:broader", f"'{term}world'", "iri", "true", "authority:terms"),
        # Terms that no work has: suppliers of a nation lie below it.
        _quad("{supplier}", "'authorities'", "1000 + s_suppkey", f"'{term}s' || cast(s_suppkey as string)", "skos:prefLabel", "s_name", **told),
        _quad("{supplier}", "'authorities'", "1000000 + s_suppkey", f"'{term}s' || cast(s_suppkey as string)", "skos:broader", f"'{term}p' || cast(s_nationkey as string)", "iri", "true", "authority:terms"),
    ]
    return " union all ".join(rows)


TABLES = ("part", "lineitem", "nation", "region", "supplier")
QUADS = _quads_sql()
QUADS_CTE = "quads as (" + QUADS.format(**{t: t for t in TABLES}, instances=f"({INSTANCES})".format(lineitem="lineitem")) + ")"


def quads(spark: SparkSession, d: str) -> DataFrame:
    """The quads of the tables; instances are grouped once and saved, since many statements are made of each."""
    of = {t: table(spark, d, t) for t in TABLES}
    return spark.sql(QUADS, **of, instances=cut(spark.sql(INSTANCES, lineitem=of["lineitem"])))


def works(spark: SparkSession, d: str) -> DataFrame:
    return works_of(quads(spark, d))


def works_of(q: DataFrame) -> DataFrame:
    return P.project_works(q, FEED, available=["lend"], schemes=SCHEMES)


# The view by joins: what the editorial graph claims hides the feed's statements; first values by graph, then order.
VIEW = f"""{QUADS_CTE}, ov as (select distinct grain, s, o as p from quads where g = '{EDITORIAL}' and p = '{P.OWN}overrides'),
v as (select q.*, q.g = '{EDITORIAL}' ed from quads q left join ov on ov.grain = q.grain and ov.s = q.s and ov.p = q.p where q.g = '{EDITORIAL}' or q.g = '{FEED}' and (ov.s is null or starts_with(q.s, '_:'))),
lit as (select grain, s, p, arg_min(o, (ed, ord)) o from v where o_kind = 'literal' group by grain, s, p),
one as (select grain, s, p, arg_min(o, (ed, ord)) o from v group by grain, s, p),
shown as (select distinct v.grain, v.s w from v where p = '{P.RDF}type' and o = '{P.BF}Work' and starts_with(v.s, '#') and not exists (select 1 from v t where t.grain = v.grain and t.s = v.s and t.p = '{P.OWN}tombstoned') and not exists (select 1 from lit t where t.grain = v.grain and t.s = v.s and t.p = '{P.OWN}suppressed' and t.o = 'true')),
contr as (select x.grain, x.w, l.o name, coalesce(rl.o, '') as role, bool_or(exists (select 1 from v t where t.grain = v.grain and t.s = v.o and t.p = '{P.RDF}type' and t.o = '{P.BFLC}PrimaryContribution')) lead from shown x join v on v.grain = x.grain and v.s = x.w and v.p = '{P.BF}contribution' join one a on a.grain = v.grain and a.s = v.o and a.p = '{P.BF}agent' join lit l on l.grain = v.grain and l.s = a.o and l.p = '{P.RDFS}label'
 left join one r on r.grain = v.grain and r.s = v.o and r.p = '{P.BF}role' left join lit rl on rl.grain = v.grain and rl.s = r.o and rl.p = '{P.RDFS}label' where l.o <> '' group by 1, 2, 3, 4),
subj as (select distinct x.grain, x.w, v.o uri from shown x join v on v.grain = x.grain and v.s = x.w and v.p = '{P.BF}subject' where v.o_kind = 'iri' and not starts_with(v.o, '#')),
alias as (select distinct s uri, o tag from quads where p = '{P.OWN}tagAlias'),
tags as (select x.grain, x.w, l.o tag from shown x join v on v.grain = x.grain and v.s = x.w and v.p = '{P.BF}subject' join lit l on l.grain = v.grain and l.s = v.o and l.p = '{P.RDFS}label' where v.o_kind = 'blank' or starts_with(v.o, '#') union select x.grain, x.w, v.o from shown x join v on v.grain = x.grain and v.s = x.w and v.p = '{P.OWN}tag' where v.o <> ''),
kept_tags as (select * from tags t where not exists (select 1 from subj join alias using (uri) where subj.grain = t.grain and subj.w = t.w and alias.tag = t.tag)),
label as (select s uri, coalesce(arg_max(o, ord) filter (p = '{P.SKOS}prefLabel'), arg_min(o, ord) filter (p = '{P.RDFS}label')) en from quads where o_lang = 'en' group by s),
inst as (select x.grain, x.w, v.o i from shown x join v on v.grain = x.grain and v.s = x.w and v.p = '{P.BF}hasInstance'),
idents as (select i.grain, i.w, i.i, l.o as value, coalesce(sl.o, '') source, exists (select 1 from v t where t.grain = n.grain and t.s = n.o and t.p = '{P.RDF}type' and t.o = '{P.BF}Isbn') isbn from inst i join v n on n.grain = i.grain and n.s = i.i and n.p = '{P.BF}identifiedBy' join lit l on l.grain = n.grain and l.s = n.o and l.p = '{P.RDF}value' left join one sc on sc.grain = n.grain and sc.s = n.o and sc.p = '{P.BF}source' left join lit sl on sl.grain = n.grain and sl.s = sc.o and sl.p = '{P.RDFS}label'),
forms as (select i.*, case when ml.o is not null then coalesce(map {{'audio': 'audiobook', 'computer': 'ebook', 'video': 'video', 'unmediated': 'print'}}[ml.o], ml.o) when cl.o = 'volume' then 'print' else '' end form,
 (select count(*) from v t where t.grain = i.grain and t.s = i.i and t.p = '{P.BF}hasItem') n_items, pl.o publisher, pd.o published from inst i left join one m on m.grain = i.grain and m.s = i.i and m.p = '{P.BF}media' left join lit ml on ml.grain = i.grain and ml.s = m.o and ml.p = '{P.RDFS}label' left join one c on c.grain = i.grain and c.s = i.i and c.p = '{P.BF}carrier' left join lit cl on cl.grain = i.grain and cl.s = c.o and cl.p = '{P.RDFS}label'
 left join one p on p.grain = i.grain and p.s = i.i and p.p = '{P.BF}provisionActivity' left join lit pl on pl.grain = i.grain and pl.s = p.o and pl.p = '{P.BFLC}simpleAgent' left join lit pd on pd.grain = i.grain and pd.s = p.o and pd.p = '{P.BF}date'),
held as (select f.*, n_items > 0 or exists (select 1 from idents d where d.grain = f.grain and d.i = f.i and not isbn and source = 'lend') and not exists (select 1 from v t where t.grain = f.grain and t.s = f.w and t.p = '{P.OWN}withdrawnFromFeed') as held from forms f)"""


@query(f"""with {VIEW},
texts as (select x.grain, x.w, coalesce(mt.o, '') title, coalesce(st.o, '') subtitle from shown x left join one t on t.grain = x.grain and t.s = x.w and t.p = '{P.BF}title' left join lit mt on mt.grain = x.grain and mt.s = t.o and mt.p = '{P.BF}mainTitle' left join lit st on st.grain = x.grain and st.s = t.o and st.p = '{P.BF}subtitle'),
sums as (select x.grain, x.w, arg_min(l.o, (v.ed, v.ord)) summary from shown x join v on v.grain = x.grain and v.s = x.w and v.p = '{P.BF}summary' join lit l on l.grain = v.grain and l.s = v.o and l.p = '{P.RDFS}label' where l.o <> '' group by 1, 2),
langs as (select x.grain, x.w, string_agg(distinct regexp_extract(v.o, '[^/#]*$'), ',' order by regexp_extract(v.o, '[^/#]*$')) langs from shown x join v on v.grain = x.grain and v.s = x.w and v.p = '{P.BF}language' group by 1, 2),
by_inst as (select grain, w, string_agg(distinct form, ',' order by form) filter (form <> '') formats, bool_or(held) held, sum(n_items)::bigint n_items, string_agg(regexp_extract(i, '^#(.*)Instance$', 1) || ':' || form || ':' || publisher || ':' || published || ':' || held::varchar, ';' order by i) instances from held group by 1, 2),
parts as (select x.grain, x.w, string_agg(t.title, ',' order by v.o) parts from shown x join v on v.grain = x.grain and v.s = x.w and v.p = '{P.BF}hasPart' join texts t on t.w = v.o group by 1, 2)
select regexp_extract(t.w, '^#(.*)Work$', 1) work_id, title, subtitle, coalesce(summary, '') summary, coalesce(langs, '') languages, coalesce(formats, '') formats, coalesce(held, false) held, coalesce(n_items, 0) n_items, coalesce(instances, '') instances, coalesce(parts, '') parts
from texts t left join sums using (grain, w) left join langs using (grain, w) left join by_inst using (grain, w) left join parts using (grain, w)""")
def project_works(spark, d):
    one = lambda i: F.concat_ws(":", i["id"], i["format"], i["publisher"], i["published"], i["held"].cast("string"))
    n_items = F.aggregate("instances", F.lit(0).cast("long"), lambda n, i: n + F.size(i["items"]))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return works(spark, d).select("work_id", "title", "subtitle", "summary", joined("languages"), joined("formats"), "held", n_items.alias("n_items"), F.array_join(F.transform("instances", one), ";").alias("instances"), F.array_join(F.transform("has_part", lambda p: p["title"]), ",").alias("parts"))


@query(f"with {VIEW} select regexp_extract(w, '^#(.*)Work$', 1) work_id, name, role, row_number() over (partition by grain, w order by lead desc, name, role) - 1 pos from contr")
def contributors(spark, d):
    return works(spark, d).select("work_id", F.posexplode("contributors").alias("pos", "c")).select("work_id", "c.name", "c.role", F.col("pos").cast("long").alias("pos"))


@query(f"""with {VIEW} select regexp_extract(w, '^#(.*)Work$', 1) work_id, 'subject' kind, uri as value, coalesce(en, '') label, case when contains(uri, '/p') then 'places' else 'terms' end scheme from subj left join label using (uri)
union all select regexp_extract(w, '^#(.*)Work$', 1), 'tag', tag, '', '' from kept_tags""")
def subjects_tags(spark, d):
    w = works(spark, d).select("work_id", "subjects", "tags")
    subjects = w.select("work_id", F.explode("subjects").alias("s")).select("work_id", F.lit("subject").alias("kind"), F.col("s.id").alias("value"), F.coalesce(F.try_element_at("s.labels", F.lit("en")), F.lit("")).alias("label"), F.col("s.scheme").alias("scheme"))
    tags = w.select("work_id", F.lit("tag").alias("kind"), F.explode("tags").alias("value"), F.lit("").alias("label"), F.lit("").alias("scheme"))
    return subjects.unionByName(tags)


@query(f"""with recursive {VIEW}, up(uri) as (select uri from subj union select o from up join quads on s = uri where p = '{P.SKOS}broader')
select uri id, coalesce(en, '') label, (select coalesce(string_agg(distinct o, ',' order by o), '') from quads where s = uri and p = '{P.SKOS}broader') broader from up left join label using (uri) where en is not null or exists (select 1 from quads where s = uri and p = '{P.SKOS}broader')""")
def term_sideband(spark, d):
    q = quads(spark, d)
    out = P.term_sideband(works_of(q), P.term_index(q))
    return out.select("id", F.coalesce(F.try_element_at("labels", F.lit("en")), F.lit("")).alias("label"), F.array_join("broader", ",").alias("broader"))


# Records are orders: a key of their own and one that orders share; customers are what earlier runs have settled.
RECORDS = """records as (select o_orderkey ord, 'o:' || o_orderkey k1, 'c:' || o_custkey || ':' || (o_orderkey % 4) k2, case when o_orderkey % 6 = 0 then '' else (o_custkey // 2) || '/' || o_orderpriority end ck, case when o_orderkey % 10 < 3 then 'a:' || (o_custkey // 3) end anchor from orders),
keys as (select ord, 1 pos, case when ord % 2 = 0 then k1 else k2 end as key from records union all select ord, 2, case when ord % 2 = 0 then k2 else k1 end from records),
seed_inst as (select 'c:' || c_custkey || ':0' as key, 'is' || c_custkey inst, 'ws' || c_custkey work from customer where c_custkey % 20 = 0),
seed_work as (select (c_custkey // 2) || '/1-URGENT' as key, 'ws' || c_custkey work from customer where c_custkey % 20 = 0),
seed_anchor as (select 'a:' || (c_custkey // 3) as key, 'ws' || c_custkey work from customer where c_custkey % 60 = 0),
pins as (select 'is' || c_custkey inst, 'wp' || c_custkey work from customer where c_custkey % 80 = 0),
merges as (select 'ws' || c_custkey a, 'ws' || (c_custkey + 40) b from customer where c_custkey % 100 = 0)"""


RESOLVED = f"""with recursive {RECORDS},
holder as (select key, min(ord) h from keys group by key),
known as (select k.ord, arg_min({{'inst': inst, 'h': case when inst is null then h end}}, pos) x from keys k join holder using (key) left join seed_inst using (key) where inst is not null or h < k.ord group by k.ord),
ptr as (select r.ord, x.inst inst, x.h up from records r left join known on known.ord = r.ord),
fall(ord, spot) as (select ord, ord from ptr union all select f.ord, p.up from fall f join ptr p on p.ord = f.spot where p.up is not null),
root as (select f.ord, f.spot from fall f join ptr p on p.ord = f.spot where p.up is null),
placed as (select r.ord, coalesce(p.inst, 'i' || substr(sha256(concat_ws(chr(31), 'i', 'run', p.ord::varchar, '0')), 1, 16)) inst, p.inst is null and r.ord = r.spot fresh from root r join ptr p on p.ord = r.spot),
heads as (select inst, min(ord) ord from placed group by inst),
settled as (select h.ord, inst, coalesce(p.work, s.work) work from heads h left join (select distinct inst, work from seed_inst) s using (inst) left join pins p using (inst)),
opened as (select s.ord, ck, anchor from settled s join records r on r.ord = s.ord where work is null),
ah as (select anchor, min(ord) h from opened where anchor is not null group by anchor),
anchored as (select o.ord, a.work, case when a.work is null then h end up from opened o join ah using (anchor) left join seed_anchor a on a.key = anchor where a.work is not null or h < o.ord),
loose as (select * from opened where ord not in (select ord from anchored)),
kh as (select ck, min(ord) h from loose where ck <> '' group by ck),
keyed as (select l.ord, s.work, case when s.work is null then h end up from loose l join kh using (ck) left join (select key, max(work) work from seed_work group by key) s on s.key = ck where s.work is not null or h < l.ord),
wptr as (select o.ord, x.work, x.up from opened o left join (select * from anchored union all select * from keyed) x using (ord)),
wfall(ord, spot) as (select ord, ord from wptr union all select f.ord, p.up from wfall f join wptr p on p.ord = f.spot where p.up is not null),
worked as (select f.ord, coalesce(p.work, 'w' || substr(sha256(concat_ws(chr(31), 'w', 'run', p.ord::varchar, '0')), 1, 16)) work, p.work is null and f.ord = f.spot fresh from wfall f join wptr p on p.ord = f.spot where p.up is null union all select ord, work, false from settled where work is not null)
select p.ord, p.inst instance_id, coalesce(m2.b, m.b, w.work) work_id, p.fresh minted_instance, w.fresh and p.ord = h.ord minted_work from placed p join heads h using (inst) join worked w on w.ord = h.ord left join merges m on m.a = w.work left join merges m2 on m2.a = m.b"""


@query(RESOLVED)
def resolve_ids(spark, d):
    return I.resolve(*_records(spark, d), "run")


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, I.Prior]:
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("ord"))
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    customer, order, own = F.col("o_custkey"), F.col("o_orderkey"), F.col("c_custkey")
    keys = [text("o:", order), F.concat(text("c:", customer), text(":", order % 4))]
    keys = F.when(order % 2 == 0, F.array(*keys)).otherwise(F.array(*reversed(keys)))
    cluster = F.when(order % 6 == 0, "").otherwise(F.concat(text("", F.floor(customer / 2)), F.lit("/"), "o_orderpriority"))
    anchors = F.when(order % 10 < 3, F.array(text("a:", F.floor(customer / 3))))
    records = o.select(order.alias("ord"), keys.alias("keys"), cluster.alias("cluster_key"), anchors.alias("anchors"), "o_orderpriority")
    instance, work = text("is", own).alias("instance_id"), text("ws", own).alias("work_id")
    some = c.where("c_custkey % 20 = 0")
    prior = I.Prior(
        instances=some.select("ord", instance, work, F.array(F.concat(text("c:", own), F.lit(":0"))).alias("keys")),
        works=some.select("ord", work, F.concat(text("", F.floor(own / 2)), F.lit("/1-URGENT")).alias("cluster_key")),
        anchors=c.where("c_custkey % 60 = 0").select("ord", text("a:", F.floor(own / 3)).alias("anchor"), work),
        merges=c.where("c_custkey % 100 = 0").select("ord", text("ws", own).alias("from_id"), text("ws", own + 40).alias("to_id")),
        pins=c.where("c_custkey % 80 = 0").select("ord", instance, text("wp", own).alias("work_id")),
    )
    return records, prior


@query(f"with resolved as ({RESOLVED}) select work_id, min(ord) first_ord, arg_min(o_orderpriority, ord) o_orderpriority, count(*) n_records, count(distinct instance_id) n_instances, bool_or(minted_work) minted from resolved join orders on o_orderkey = ord group by work_id")
def fold_groups(spark, d):
    records, prior = _records(spark, d)
    groups, _ = I.fold_groups(records, I.resolve(records, prior, "run"), ["o_orderpriority"])
    return groups


@query(f"""with recursive {QUADS_CTE},
named as (select s uri from quads where not starts_with(g, 'authority:') and not starts_with(s, '_:') union select o from quads where not starts_with(g, 'authority:') and o_kind = 'iri'),
up(uri) as (select uri from named union select o from up join quads on s = uri where starts_with(g, 'authority:') and p = '{P.BROADER}')
select grain, ord, s, p, o, coalesce(o_lang, '') o_lang from quads where starts_with(g, 'authority:') and s in (select uri from up) and p in ('{P.PREF_LABEL}', '{P.LABEL}', '{P.BROADER}', '{P.OWN}tagAlias')""")
def selective_load(spark, d):
    """What is kept of the vocabularies; other graphs stay whole."""
    kept = L.selective_load(quads(spark, d)).where(L.is_authority(F.col("g")))
    return kept.select("grain", "ord", "s", "p", "o", F.coalesce("o_lang", F.lit("")).alias("o_lang"))


@query(f"""with recursive {QUADS_CTE},
named as (select s uri from quads where not starts_with(g, 'authority:') and not starts_with(s, '_:') union select o from quads where not starts_with(g, 'authority:') and o_kind = 'iri'),
up(uri) as (select uri from named union select o from up join quads on s = uri where starts_with(g, 'authority:') and p = '{P.BROADER}')
select g, count(*) scanned, count(*) filter (not starts_with(g, 'authority:') or s in (select uri from up) and p in ('{P.PREF_LABEL}', '{P.LABEL}', '{P.BROADER}', '{P.OWN}tagAlias')) kept from quads group by g""")
def load_counts(spark, d):
    q = quads(spark, d)
    return L.load_counts(q, L.selective_load(q))


# Enrichment of orders by customers: a customer leads to a blank node, that to a later customer of its grain, some back again.
ENRICHED = """select 'g' || cast(o_custkey % 7 as string) as grain, '#w' || cast(o_orderkey as string) || 'Work' as s, 'about' as p, 'urn:c:' || cast(o_custkey as string) as o, 'iri' as o_kind from {orders}
union all select 'g' || cast(c_custkey % 7 as string), 'urn:c:' || cast(c_custkey as string), 'label', c_name, 'literal' from {customer}
union all select 'g' || cast(c_custkey % 7 as string), 'urn:c:' || cast(c_custkey as string), 'near', '_:b' || cast(c_custkey as string), 'blank' from {customer} where c_custkey % 3 <> 0
union all select 'g' || cast(c_custkey % 7 as string), '_:b' || cast(c_custkey as string), 'to', 'urn:c:' || cast(cast(c_custkey + 7 * (floor(c_custkey / 7) + 1) as bigint) as string), 'iri' from {customer}
union all select 'g' || cast(c_custkey % 7 as string), '_:b' || cast(c_custkey as string), 'back', 'urn:c:' || cast(c_custkey as string), 'iri' from {customer} where c_custkey % 11 = 0"""
FRESH = """select 'g' || cast(c_custkey % 7 as string) as grain, 'urn:c:' || cast(c_custkey as string) as s, 'label' as p, 'New ' || c_name as o, 'literal' as o_kind from {customer} where c_custkey % 9 = 0
union all select 'g' || cast(o_custkey % 7 as string), '#w' || cast(o_orderkey as string) || 'Work', 'about', 'urn:new', 'iri' from {orders} where o_orderkey % 3 = 0"""
RESOLVED_WORKS = "select 'g' || cast(o_custkey % 7 as string) as grain, cast(o_orderkey as string) as n from {orders} where o_orderkey % 3 = 0"
ENRICHMENT = {k: v.format(orders="orders", customer="customer") for k, v in (("old", ENRICHED), ("fresh", FRESH), ("done", RESOLVED_WORKS))}


@query(f"""with recursive old as ({ENRICHMENT['old']}), fresh as ({ENRICHMENT['fresh']}), done as ({ENRICHMENT['done']}),
kept as (select * from old where starts_with(s, '#') and not exists (select 1 from done where done.grain = old.grain and old.s = '#w' || n || 'Work')),
terms as (select * from old where not starts_with(s, '#') and not exists (select 1 from fresh f where f.grain = old.grain and f.s = old.s)),
reach(grain, term) as (select k.grain, k.o from kept k where o_kind <> 'literal' union select r.grain, t.o from reach r join terms t on t.grain = r.grain and t.s = r.term where t.o_kind <> 'literal')
select * from fresh union all select * from kept union all select t.* from terms t where exists (select 1 from reach r where r.grain = t.grain and r.term = t.s)""")
def preserved_enrichment(spark, d):
    of = {t: table(spark, d, t) for t in ("orders", "customer")}
    old, fresh = (spark.sql(x, **{t: v for t, v in of.items() if f"{{{t}}}" in x}) for x in (ENRICHED, FRESH))
    done = spark.sql(RESOLVED_WORKS, orders=of["orders"]).select("grain", F.concat(F.lit("w"), "n").alias("work_id"))
    return L.with_preserved_enrichment(old, fresh, done)


@query(f"""with {QUADS_CTE}, lit as (select grain, g, s, p, arg_min(o, ord) o from quads where o_kind = 'literal' group by all),
w as (select distinct grain, g, s from quads where p = '{P.RDF}type' and o = '{P.BF}Work' and starts_with(s, '#')),
lead as (select c.grain, c.g, c.s, arg_min(l.o, c.ord) author from quads c join quads t on t.grain = c.grain and t.g = c.g and t.s = c.o and t.p = '{P.RDF}type' and t.o = '{P.BFLC}PrimaryContribution' join quads a on a.grain = c.grain and a.g = c.g and a.s = c.o and a.p = '{P.BF}agent' join lit l on l.grain = c.grain and l.g = c.g and l.s = a.o and l.p = '{P.RDFS}label' where c.p = '{P.BF}contribution' group by all),
named as (select w.grain, w.g, w.s, author, m.o title, (select coalesce(string_agg(distinct regexp_extract(o, '[^/#]*$'), ' ' order by regexp_extract(o, '[^/#]*$')), '') from quads q where q.grain = w.grain and q.g = w.g and q.s = w.s and q.p = '{P.BF}language') langs from w left join lead using (grain, g, s) left join quads t on t.grain = w.grain and t.g = w.g and t.s = w.s and t.p = '{P.BF}title' left join lit m on m.grain = w.grain and m.g = w.g and m.s = t.o and m.p = '{P.BF}mainTitle')
select regexp_extract(s, '^#(.*)Work$', 1) work_id, case when title is null then '' else concat_ws(chr(31), trim(lower(regexp_replace(coalesce(author, ''), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))), trim(lower(regexp_replace(title, '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))), langs) end cluster_key, substr(g, 6) feed from named""")
def scan_identities(spark, d):
    prior, feeds = L.prior_state(quads(spark, d))
    return prior.works.join(feeds, "work_id").select("work_id", "cluster_key", "feed")


# Parts as works; their brands, words of names and places, regions above places; tombstoned ones are out.
SIMILAR = """live as (select * from part where p_partkey % 11 <> 0),
edges as (select 'p' || n_nationkey child, 'r' || n_regionkey parent from nation union all select 'r' || r_regionkey, 'world' from region),
attrs as (select p_partkey w, 'contributor' rel, p_brand v from live union select p_partkey, 'tag', unnest(string_split(p_name, ' ')) from live union select p_partkey, 'subject', 'p' || (p_size % 25) from live union select p_partkey, 'subject', 'r' || (p_partkey % 5) from live where p_partkey % 4 = 0 union select p_partkey, 'series', p_name || p_type from live where p_size % 3 = 0)"""


@query(f"""with {SIMILAR},
hops as (select w, v, 1.0 hop from attrs where rel = 'subject' union all select w, parent, 0.5 from attrs join edges on child = v where rel = 'subject' union all select w, b.parent, 0.25 from attrs join edges a on a.child = v join edges b on b.child = a.parent where rel = 'subject' union all select w, child, 0.5 from attrs join edges on parent = v where rel = 'subject'),
asks as (select w, rel, v, 1.0 hop from attrs where rel <> 'subject' union all select w, 'subject', v, max(hop) from hops group by w, v),
keys as (select rel, v, case rel when 'series' then 5 when 'contributor' then 3 when 'tag' then 2 else 1 end / log2(count(*) + 2) x from attrs group by rel, v having count(*) <= (select greatest(2, floor(count(*) * 0.2)) from live)),
scored as (select a.w, b.w o, sum(x * hop) s from asks a join keys using (rel, v) join attrs b using (rel, v) where a.w <> b.w group by a.w, b.w),
total as (select w, o, round(s + case when l.p_size % 3 = m.p_size % 3 then 20 else 0 end + case when m.p_partkey % 4 = 0 then 0.3 else 0 end, 6) score from scored join live l on l.p_partkey = w join live m on m.p_partkey = o),
top as (select * from (select *, row_number() over (partition by w order by score desc, o) rank from total) where rank <= 8),
shared as (select t.w, t.o, a.v, max(x * hop) x from top t join asks a on a.w = t.w join keys k on k.rel = a.rel and k.v = a.v join attrs b on b.w = t.o and b.rel = a.rel and b.v = a.v group by t.w, t.o, a.v),
named as (select w, o, string_agg(v, ',' order by x desc, v) shared from (select *, row_number() over (partition by w, o order by x desc, v) n from shared) where n <= 5 group by w, o)
select t.w work_id, t.o other_id, score, rank, shared from top t join named using (w, o)""")
def similar_works(spark, d):
    """Weights by relation, places through their regions, a bonus for the language and for what is held, and the values in common."""
    p = table(spark, d, "part").where("p_partkey % 11 <> 0").withColumn("work_id", F.col("p_partkey"))
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    rel = lambda name, value, rows=p: rows.select("work_id", F.lit(name).alias("rel"), value.alias("value"))
    attrs = rel("contributor", F.col("p_brand")).unionAll(rel("tag", F.explode(F.split("p_name", " ")))).unionAll(rel("subject", text("p", F.col("p_size") % 25)))
    attrs = attrs.unionAll(rel("subject", text("r", F.col("p_partkey") % 5), p.where("p_partkey % 4 = 0"))).unionAll(rel("series", F.concat("p_name", "p_type"), p.where("p_size % 3 = 0"))).distinct()
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    edges = n.select(text("p", F.col("n_nationkey")).alias("child"), text("r", F.col("n_regionkey")).alias("parent")).unionAll(r.select(text("r", F.col("r_regionkey")), F.lit("world")))
    languages = p.select("work_id", (F.col("p_size") % 3).cast("string").alias("language"))
    found = S.similar_works(attrs, languages=languages, held=p.where("p_partkey % 4 = 0").select("work_id"), edges=edges, explain=5)
    return found.withColumn("shared", F.array_join("shared", ","))


# Parts as works of one library, order lines as items of seven peers, whose authors are qualified and whose ISBNs name cover files.
PEERS = r"""works as (select p_partkey work_id, p_name || ': ' || p_type title, '978' || p_partkey isbn, p_type || ' ' || p_name || ' ' || p_size contributor, 'u' || (p_partkey % 50) subject from part),
items as (select distinct 'h' || (l_suppkey % 7) host, 'u' || (l_orderkey % 50) uri, case l_linenumber % 3 when 0 then '97-8' || l_partkey || '/SC.GIF' when 1 then '979' else '' end isbn, upper(p_name) || '!' title, case when l_linenumber % 5 = 0 then '' else split_part(p_name, ' ', 2) || ', ' || p_type || ' (Maker) 1950-' end author, 'k' || (l_orderkey % 3) link from lineitem join part on p_partkey = l_partkey),
clean as (select *, replace(split_part(isbn, '/', 1), '-', '') code from items),
sure as (select work_id, uri, host, 0 tier, code as key, link from clean join works on works.isbn = code),
words as (select *, trim(regexp_replace(lower(split_part(title, ':', 1)), '[^a-z0-9]+', ' ', 'g')) fold, list_filter(list_distinct(string_split(trim(regexp_replace(lower(regexp_replace(author, '\([^)]*\)', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda x: x <> '' and not regexp_matches(x, '^[0-9]+$')) want from clean where author <> '' and code not in (select isbn from works)),
shelf as (select work_id, trim(regexp_replace(lower(split_part(title, ':', 1)), '[^a-z0-9]+', ' ', 'g')) fold, string_split(trim(regexp_replace(lower(contributor), '[^a-z0-9]+', ' ', 'g')), ' ') have from works),
likely as (select work_id, uri, host, 1 tier, title || ' / ' || author as key, link from words join shelf using (fold) where len(want) > 0 and list_has_all(have, want)),
per_host as (select work_id, uri, host, min((tier, key, link)) x from (select * from sure union all select * from likely) f where not exists (select 1 from works w where w.work_id = f.work_id and w.subject = f.uri) group by work_id, uri, host)"""


@query(f"with {PEERS} select work_id, uri, case when min(x[1]) = 0 then 0.9 else 0.75 end::double confidence, count(*) n_hosts, string_agg(host || ':' || case when x[1] = 0 then 'isbn' else 'title+author' end || ':' || x[2] || ':' || x[3], ';' order by host) hosts from per_host group by work_id, uri")
def consensus(spark, d):
    p = table(spark, d, "part")
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    works = p.select(F.col("p_partkey").alias("work_id"), F.concat("p_name", F.lit(": "), "p_type").alias("title"), F.array(text("978", F.col("p_partkey"))).alias("isbns"), F.array(F.concat_ws(" ", "p_type", "p_name", F.col("p_size").cast("string"))).alias("contributors"), F.array(text("u", F.col("p_partkey") % 50)).alias("subjects"))
    line = table(spark, d, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"), "l_partkey")
    isbn = F.when(F.col("l_linenumber") % 3 == 0, F.concat(text("97-8", F.col("l_partkey")), F.lit("/SC.GIF"))).when(F.col("l_linenumber") % 3 == 1, "979").otherwise("")
    author = F.when(F.col("l_linenumber") % 5 != 0, F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(", "), "p_type", F.lit(" (Maker) 1950-")))
    items = line.select(text("h", F.col("l_suppkey") % 7).alias("host"), text("u", F.col("l_orderkey") % 50).alias("uri"), isbn.alias("isbn"), F.concat(F.upper("p_name"), F.lit("!")).alias("title"), author.alias("author"), text("k", F.col("l_orderkey") % 3).alias("link"))
    out = peers.peer_consensus(works, items)
    host = F.transform("attributions", lambda a: F.concat_ws(":", a["source"], a["basis"], a["key"], a["ref"]))
    return out.select("work_id", "uri", "confidence", "n_hosts", F.array_join(host, ";").alias("hosts"))


CHOSEN = {"contributor": ["Brand#11", "Brand#3"], "tag": ["small", "cold"], "subject": []}


@query(f"""with {ATTRS}, hit as (select work_id, bool_or(dim = 'contributor' and value in ('Brand#11', 'Brand#3')) c, bool_or(dim = 'tag' and value in ('small', 'cold')) t from attrs group by work_id)
select dim, value, count(distinct work_id) n from attrs join hit using (work_id) where case dim when 'contributor' then t when 'tag' then c else c and t end group by dim, value""")
def facets_drilldown(spark, d):
    index = drilldown.facet_bits(part_attrs(spark, d).withColumnRenamed("work_id", "row"))
    return drilldown.facets_drilldown(index, CHOSEN)


@query(f"""with {ATTRS}, many as (select o_custkey % (select count(*) from part) work_id from orders where o_orderpriority = '1-URGENT' group by 1)
select dim, value, count(distinct work_id) n from attrs join many using (work_id) where dim <> 'tag' and work_id in (select work_id from attrs where dim = 'tag' and value = 'small') or dim = 'tag' and work_id in (select work_id from many) group by dim, value""")
def facets_ranked(spark, d):
    """Counts in a searched set of works, with one choice on top."""
    index = drilldown.facet_bits(part_attrs(spark, d).withColumnRenamed("work_id", "row"))
    n = table(spark, d, "part").count()
    hits = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select((F.col("o_custkey") % n).alias("row")).distinct()
    return drilldown.facets_drilldown(index, {"tag": ["small"]}, among=hits)


@query("""with recursive e as (select user_id, ts, row_number() over (partition by user_id order by ts, event_id) rn from events where user_id is not null),
run as (select user_id, rn, ts first, ts last, 1 n, 1 burst from e where rn = 1 union all
 select e.user_id, e.rn, case when o then e.ts else first end, e.ts, case when o then 1 else n + 1 end, case when o then burst + 1 else burst end from (select r.*, e.ts, e.rn next, e.ts >= least(last + interval 8 hour, first + interval 24 hour) o from run r join e on e.user_id = r.user_id and e.rn = r.rn + 1) x join e on e.user_id = x.user_id and e.rn = x.next)
select user_id::varchar as key, arg_max(first, rn) started, max(last) ended, max(n) n, case when max(last) + interval 8 hour < arg_max(first, rn) + interval 24 hour then 'quiet' else 'max delay' end reason from run group by user_id, burst""")
def coalesced_bursts(spark, d):
    changes = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"))
    out = coalesce.coalesce_changes(changes, timedelta(hours=8), 3)
    return out.select("key", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "ended")], "n", "reason")


@query("""with n as (select o_orderpriority, o_orderstatus from orders where o_orderkey % 7 <> 0 union all select 'moved', o_orderstatus from orders where o_orderkey % 7 = 0 and o_orderkey % 2 = 0)
select 'priority' dim, o_orderpriority as value, count(*) n from n group by 2 union all select 'status', o_orderstatus, count(*) from n group by 2""")
def incremental_counts(spark, d):
    """Counts of a table after changes: those from before, and signed differences of the changed rows alone."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    values = lambda rows: rows.select(F.explode(F.array(F.struct(F.lit("priority").alias("dim"), F.col("o_orderpriority").alias("value")), F.struct(F.lit("status").alias("dim"), F.col("o_orderstatus").alias("value")))).alias("x")).select("x.*")
    changed = o.where("o_orderkey % 7 = 0")
    after = changed.where("o_orderkey % 2 = 0").withColumn("o_orderpriority", F.lit("moved"))
    before = values(o).groupBy("dim", "value").agg(F.count("*").alias("n"))
    return before.unionByName(signed_counts(values(changed), values(after))).groupBy("dim", "value").agg(F.sum("n").alias("n")).where("n <> 0")


@query()
def canonical_grains(spark, d):
    """A digest of each work's grain in canonical form; SQL has no colour refinement."""
    rows = quads(spark, d).withColumn("o_type", F.lit(None).cast("string"))
    return canonical.canonical_grains(rows).select("grain", F.sha2("text", 256).alias("sha256"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


# Parts as terms of three vocabularies, six to a node; their names' words are labels, some lie below others.
PIVOTS = """terms as (select p_partkey k, ['a', 'b', 'c'][(p_partkey % 3 + 1)::int] as scheme, 'urn:' || ['a', 'b', 'c'][(p_partkey % 3 + 1)::int] || ':' || p_partkey id, split_part(p_name, ' ', 2) || case when p_size % 2 = 0 then 's' else '' end pref, split_part(p_name, ' ', 1) alt, p_size from part),
links as (select a, b, max(w) w from (select id a, 'n:' || (k // 6) b, case when p_size % 4 = 0 then 1 else 2 end w from terms union all select t.id, u.id, 1 from terms t join terms u on u.k = t.k + 1 where t.k % 10 = 0) group by a, b),
edges as (select t.id child, u.id parent from terms t join terms u on u.k = t.k - 3 where t.k % 6 >= 3 and t.k % 5 <> 0),
told as (select id, pref as label, false alt from terms union all select id, alt, true from terms),
forms as (select id, case when length(x) > 3 and ends_with(x, 'ies') then x[:-4] || 'y' when length(x) > 3 and ends_with(x, 'es') then x[:-3] when length(x) > 2 and ends_with(x, 's') then x[:-2] else x end form, min(alt::int) = 1 alt from (select id, lower(label) x, alt from told) group by id, form),
pv as (select src, cand, via, max(w) w from (select x.a src, y.a cand, x.b via, least(x.w, y.w) w from links x join links y on x.b = y.b union all select x.b, y.b, x.a, least(x.w, y.w) from links x join links y on x.a = y.a union all select x.a, y.b, x.b, least(x.w, y.w) from links x join links y on x.b = y.a where x.b in (select id from terms)) where src <> cand and src in (select id from terms) group by src, cand, via),
alike as (select src, cand, bool_or(not f.alt and g.alt = false) matched from (select distinct src, cand from pv) join forms f on f.id = src join forms g on g.id = cand and g.form = f.form group by src, cand),
rows0 as (select pv.*, s.scheme src_scheme, c.scheme cand_scheme, coalesce(matched, false) matched, matched is not null exempt from pv join terms s on s.id = src join terms c on c.id = cand left join alike using (src, cand)),
rows1 as (select *, not exempt and exists (select 1 from rows0 o join edges e on e.child = r.cand and e.parent = o.cand where o.src = r.src and o.via = r.via and o.cand_scheme = r.cand_scheme) gone, exists (select 1 from rows0 o join edges e on e.child = r.src and e.parent = o.cand where o.src = r.src and o.via = r.via and o.cand_scheme = r.src_scheme) narrow from rows0 r),
partner as (select s.id src, t.scheme cand_scheme, min(t.id) partner from told s join (select told.*, scheme from told join terms using (id)) t on lower(t.label) = lower(s.label) and t.id <> s.id group by s.id, t.scheme),
rows2 as (select r.*, partner, sum((not gone)::int) over (partition by r.src, via, r.cand_scheme) kept, count(*) over (partition by r.src, via) claims, exists (select 1 from links where a = partner and b = via) claims_via from rows1 r left join partner p on p.src = r.src and p.cand_scheme = r.cand_scheme),
ruled as (select src, cand, case when gone or not exempt and narrow or not exempt and partner is not null and partner <> cand and not claims_via then null else w end w, not exempt and (kept >= 2 or claims >= 2 or partner is not null and partner <> cand) demote, exempt and not matched weak from rows2),
ranked as (select src, cand dst, case when demote or weak or w = 1 then 4 else 3 end r from ruled where w is not null and not (demote and w = 1) union all select src, cand, case w when 2 then 3 else 4 end from pv where cand not in (select id from terms) union all select a, b, 3 - w from links union all select b, a, 3 - w from links where b in (select id from terms))"""


@query(f"with {PIVOTS} select src, dst, ['exact', 'close', 'pivot-exact', 'pivot-close'][min(r)::int] strength from ranked group by src, dst")
def guarded_equivalents(spark, d):
    p, number = table(spark, d, "part"), F.col("p_partkey")
    named = lambda k: F.concat(F.lit("urn:"), F.element_at(F.array(*map(F.lit, "abc")), (k % 3 + 1).cast("int")), F.lit(":"), k.cast("string"))
    terms = p.select(named(number).alias("id"), F.substring(named(number), 5, 1).alias("scheme"), number.alias("k"), "p_size", "p_name")
    word = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    plural = F.when(F.col("p_size") % 2 == 0, "s").otherwise("")
    labels = terms.select("id", F.concat(word(2), plural).alias("label"), F.lit(False).alias("alt")).unionAll(terms.select("id", word(1), F.lit(True)))
    last = terms.agg(F.max("k")).scalar()
    node = terms.select(F.col("id").alias("src"), F.concat(F.lit("n:"), F.floor(F.col("k") / 6).cast("string")).alias("dst"), F.when(F.col("p_size") % 4 == 0, "close").otherwise("exact").alias("rel"))
    links = node.unionAll(terms.where((F.col("k") % 10 == 0) & (F.col("k") < last)).select("id", named(F.col("k") + 1), F.lit("close")))
    edges = terms.where("k % 6 >= 3 and k % 5 <> 0").select(F.col("id").alias("child"), named(F.col("k") - 3).alias("parent"))
    return pivots.guarded_equivalents(terms, labels, links, edges, hub=None)


@query("""with pins as (select distinct l_partkey work_id, l_suppkey % 12 inst from lineitem where l_returnflag = 'R'), asked as (select distinct l_orderkey ask, l_suppkey % 12 inst from lineitem where l_returnflag <> 'R'),
w as (select s, min(work_id) work_id from (select work_id, list_sort(list(inst)) s from pins group by work_id) group by s), a as (select ask, list_sort(list(inst)) s from asked group by ask) select ask, work_id from a join w using (s)""")
def split_match(spark, d):
    """Orders ask with the suppliers of what wasn't returned, parts are pinned to the suppliers of what was."""
    line = table(spark, d, "lineitem").withColumn("instance_id", F.col("l_suppkey") % 12)
    returned = F.col("l_returnflag") == "R"
    return sets.split_match(line.where(returned).select("instance_id", F.col("l_partkey").alias("work_id")), line.where(~returned).select(F.col("l_orderkey").alias("ask"), "instance_id"))


@query(f"""with {QUADS_CTE}, hidden as (select distinct grain, s from quads where starts_with(s, '#') and (p = '{P.OWN}tombstoned' or p = '{P.OWN}suppressed' and o = 'true')),
shown as (select distinct grain from quads where p = '{P.RDF}type' and o = '{P.BF}Work' and starts_with(s, '#') and grain not in (select grain from hidden)),
named as (select * from quads where grain in (select grain from shown) and s not in (select s from hidden) and o not in (select s from hidden) and (not starts_with(p, '{P.OWN}extra/') or p in ('{P.OWN}extra/cover', '{P.OWN}extra/sources'))),
cut as (select grain, ord, s, p, case when p = '{P.OWN}extra/sources' then array_to_string(list_filter(list_transform(string_split(o, ','), lambda x: trim(x)), lambda x: x in ('beta', 'Brand#11')), ', ') else o end o from named)
select * from cut where p <> '{P.OWN}extra/sources' or o <> ''""")
def public_quads(spark, d):
    return exports.public_quads(quads(spark, d), extras=["cover"], sources=["beta", "Brand#11"]).select("grain", "ord", "s", "p", "o")

"""Identity of records across runs: which instance and which work each is, in order of the records, without going through them one by one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_key
from .graph import redirects
from .lineage import cut

SEP = "\x1f"


def language_set(langs: Column) -> Column:
    """Trimmed, lower-cased, distinct, sorted languages, joined by blanks."""
    clean = F.filter(F.transform(F.coalesce(langs, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.sort_array(F.array_distinct(clean)), " ")


def work_key(author: Column, title: Column, langs: Column) -> Column:
    """author, title and language set; '' without a title, which never clusters."""
    t = norm_key(F.coalesce(title, F.lit("")))
    return F.when(t == "", "").otherwise(F.concat_ws(SEP, norm_key(F.coalesce(author, F.lit(""))), t, language_set(langs)))


def scoped_anchors(anchors: Column, langs: Column) -> Column:
    """Anchors that hold within one language set."""
    return F.transform(F.coalesce(anchors, F.array().cast("array<string>")), lambda a: F.concat(a, F.lit(SEP), language_set(langs)))


@dataclass
class Prior:
    """What earlier runs have settled, each with `ord`, the order in which it was recorded.

    instances: (ord, instance_id, work_id, keys); works: (ord, work_id,
    cluster_key); anchors: (ord, anchor, work_id); merges: (ord, from_id, to_id);
    pins: (ord, instance_id, work_id).
    """

    instances: DataFrame
    works: DataFrame
    anchors: DataFrame
    merges: DataFrame
    pins: DataFrame

    @staticmethod
    def empty(spark) -> Prior:
        none = lambda schema: spark.createDataFrame([], schema)
        return Prior(none("ord long, instance_id string, work_id string, keys array<string>"), none("ord long, work_id string, cluster_key string"), none("ord long, anchor string, work_id string"), none("ord long, from_id string, to_id string"), none("ord long, instance_id string, work_id string"))

    def key_instances(self) -> DataFrame:
        """(key, instance_id): the last instance recorded with a key."""
        rows = self.instances.select("ord", "instance_id", F.posexplode("keys").alias("pos", "key"))
        return rows.groupBy("key").agg(F.max_by("instance_id", F.struct("ord", "pos")).alias("instance_id"))

    def linked(self) -> DataFrame:
        """(instance_id, work_id): the last work recorded of an instance."""
        return self.instances.groupBy("instance_id").agg(F.max_by("work_id", "ord").alias("work_id"))

    def pinned(self) -> DataFrame:
        """(instance_id, work_id): the first pin of an instance."""
        return self.pins.groupBy("instance_id").agg(F.min_by("work_id", "ord").alias("work_id"))

    def canonical(self) -> DataFrame:
        """(from_id, to_id): merged works and the end of their chain."""
        last = self.merges.where("to_id <> ''").groupBy("from_id").agg(F.max_by("to_id", "ord").alias("to_id"))
        return redirects(last, cycles=True)

    def used(self) -> DataFrame:
        """(id): every id that was ever given."""
        ids = [self.instances.select(F.col("instance_id").alias("id")), self.instances.select("work_id"), self.works.select("work_id"), self.anchors.select("work_id"), self.pinned().select("work_id")]
        out = ids[0]
        for x in ids[1:]:
            out = out.union(x)
        return out.distinct()


def first_known(rows: DataFrame, seeds: DataFrame, seed: str) -> DataFrame:
    """(ord, seed, to) of rows (ord, pos, key): of the keys known before a row, the one of the least pos: a seed's value, or the first row that has it.

    seeds: (key, seed). A key is known to a row if a seed has it or a row of
    smaller ord; who has it first never depends on who comes later, so all rows
    are looked up at once.
    """
    holders = rows.groupBy("key").agg(F.min("ord").alias("holder"))
    known = rows.join(seeds, "key", "left").join(holders, "key").where(F.col(seed).isNotNull() | (F.col("holder") < F.col("ord")))
    best = known.groupBy("ord").agg(F.min_by(F.struct(F.col(seed), F.when(F.col(seed).isNull(), F.col("holder")).alias("to")), "pos").alias("x"))
    return best.select("ord", f"x.{seed}", "x.to")


def roots_of(pointers: DataFrame) -> DataFrame:
    """(ord, root) of pointers (ord, to) that all lead to smaller ords; without a pointer: itself. Chains halve a round."""
    moved = redirects(pointers.where("to is not null").select(F.col("ord").alias("from_id"), F.col("to").alias("to_id")))
    return pointers.join(moved, F.col("ord") == F.col("from_id"), "left").select("ord", F.coalesce("to_id", "ord").alias("root"))


def minted(rows: DataFrame, prefix: str, run: str, used: DataFrame) -> DataFrame:
    """(ord, id): for each ord an id that follows from it and the run, so that a lost task gives it again; one that is in use is drawn anew."""
    drawn = lambda df, n: df.select("ord", F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(SEP, F.lit(prefix), F.lit(run), F.col("ord").cast("string"), F.lit(str(n))), 256), 1, 16)).alias("id"))
    out, n = drawn(rows, 0), 0
    while True:
        clash = cut(out.join(used, "id", "left_semi"))
        if clash.isEmpty():
            return out
        n += 1
        out = out.join(clash.select("ord"), "ord", "left_anti").unionByName(drawn(clash, n))


def resolve(records: DataFrame, prior: Prior, run: str, instance_prefix: str = "i", work_prefix: str = "w") -> DataFrame:
    """(ord, instance_id, work_id, minted_instance, minted_work) of records (ord, keys, cluster_key, anchors).

    As if records came one after another by ord (unique): a record is the
    instance of its first key that is known by then, else a new one, and unknown
    keys are bound to it. An instance's work is its pin, else its recorded work,
    else that of the first anchor known by then, else that of its cluster key,
    else a new one; whatever it is, the instance's anchors not known yet are
    bound to it, its cluster key only to a new one. Merges come last.

    Each of these rules points from a record to an earlier one or to something
    recorded, and to which doesn't depend on ids; so the pointers come from joins
    with the first holders of keys, and chains of them are followed by doubling:
    no group of records is ever gone through in one task.

    Null or empty keys, cluster keys and anchors: as if not there. Null arrays:
    empty. Records without keys: a new instance each. Repeated keys count once.
    Empty table: no rows. Other columns are ignored.
    """
    filled = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    records = cut(records.select("ord", filled(F.col("keys")).alias("keys"), F.coalesce("cluster_key", F.lit("")).alias("cluster_key"), filled(F.col("anchors")).alias("anchors")))
    used = cut(prior.used())
    key_rows = records.select("ord", F.posexplode("keys").alias("pos", "key"))
    known = records.select("ord").join(first_known(key_rows, prior.key_instances(), "instance_id"), "ord", "left")
    known = cut(known.select("ord", "instance_id", "to"))
    fresh = known.where("instance_id is null and to is null")
    new = minted(fresh.select("ord"), instance_prefix, run, used)
    base = known.join(new, "ord", "left").select(F.col("ord").alias("root"), F.coalesce("instance_id", "id").alias("instance_id"), F.col("id").isNotNull().alias("is_new"))
    placed = roots_of(known).join(base, "root")
    placed = cut(placed.select("ord", "instance_id", (F.col("is_new") & (F.col("ord") == F.col("root"))).alias("minted_instance")))

    settled = prior.linked().withColumnRenamed("work_id", "linked").join(prior.pinned().withColumnRenamed("work_id", "pinned"), "instance_id", "full_outer")
    settled = settled.select("instance_id", F.coalesce("pinned", "linked").alias("work_id"))
    heads = placed.groupBy("instance_id").agg(F.min("ord").alias("ord")).join(settled, "instance_id", "left")
    heads = cut(heads.join(records.select("ord", "cluster_key", "anchors"), "ord"))
    open_ = heads.where("work_id is null")
    anchor_seeds = prior.anchors.where("anchor <> ''").groupBy(F.col("anchor").alias("key")).agg(F.min_by("work_id", "ord").alias("work_id"))
    anchored = first_known(open_.select("ord", F.posexplode("anchors").alias("pos", "key")), anchor_seeds, "work_id")
    anchored = cut(anchored)
    left = open_.select("ord", "cluster_key").join(anchored.select("ord"), "ord", "left_anti")
    key_seeds = prior.works.where("cluster_key <> ''").groupBy(F.col("cluster_key").alias("key")).agg(F.max_by("work_id", "ord").alias("work_id"))
    keyed = first_known(left.where("cluster_key <> ''").select("ord", F.lit(0).alias("pos"), F.col("cluster_key").alias("key")), key_seeds, "work_id")
    found = cut(open_.select("ord").join(anchored.unionByName(keyed), "ord", "left").select("ord", "work_id", "to"))
    new = minted(found.where("work_id is null and to is null").select("ord"), work_prefix, run, used)
    base = found.join(new, "ord", "left").select(F.col("ord").alias("root"), F.coalesce("work_id", "id").alias("work_id"), F.col("id").isNotNull().alias("is_new"))
    works = roots_of(found).join(base, "root").select("ord", "work_id", (F.col("is_new") & (F.col("ord") == F.col("root"))).alias("minted_work"))
    works = heads.where("work_id is not null").select("ord", "work_id", F.lit(False).alias("minted_work")).unionByName(works)
    of_instance = cut(heads.select("ord", "instance_id").join(works, "ord").withColumnRenamed("ord", "head"))
    out = placed.join(of_instance, "instance_id").join(prior.canonical(), F.col("work_id") == F.col("from_id"), "left")
    return out.select("ord", "instance_id", F.coalesce("to_id", "work_id").alias("work_id"), "minted_instance", (F.col("minted_work") & (F.col("ord") == F.col("head"))).alias("minted_work"))


def conflicts(records: DataFrame, prior: Prior, assigned: DataFrame) -> DataFrame:
    """(ord, key, kept, instance_id): keys of a record that belong to another instance than the record's."""
    rows = records.select("ord", F.explode(F.array_distinct("keys")).alias("key")).where("key <> ''")
    who = assigned.select("ord", "instance_id")
    first = rows.groupBy("key").agg(F.min("ord").alias("holder")).join(who.withColumnRenamed("instance_id", "of_holder"), F.col("holder") == F.col("ord")).select("key", "of_holder")
    seeds = prior.key_instances().withColumnRenamed("instance_id", "of_seed")
    kept = rows.join(who, "ord").join(first, "key").join(seeds, "key", "left").withColumn("kept", F.coalesce("of_seed", "of_holder"))
    return kept.where("kept <> instance_id").select("ord", "key", "kept", "instance_id")


def fold_groups(records: DataFrame, assigned: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(groups, members): a row a work with the fields of its first record and its counts; a row an instance with its first record.

    groups: (work_id, first_ord, fields, n_records, n_instances, minted);
    members: (work_id, instance_id, ord). Of records of one instance the first
    alone counts; no list of records is gathered.
    """
    rows = assigned.join(records.select("ord", *fields), "ord")
    members = assigned.groupBy("instance_id").agg(F.min_by(F.struct("work_id", "ord"), "ord").alias("x")).select("x.work_id", "instance_id", "x.ord")
    per = rows.groupBy("work_id").agg(F.min("ord").alias("first_ord"), *[F.min_by(f, "ord").alias(f) for f in fields], F.count("*").alias("n_records"), F.bool_or("minted_work").alias("minted"))
    return per.join(members.groupBy("work_id").agg(F.count("*").alias("n_instances")), "work_id"), members


def work_for_keys(asked: DataFrame, prior: Prior) -> DataFrame:
    """(key, work_id) of asked (key): the work of a provider key; of one that isn't recorded, that of the longer keys that begin with it and a colon, if they agree.

    Every recorded key stands for each of its beginnings before a colon, so that
    the search for beginnings is a join of equals. Keys that are split over works,
    or that nothing begins with, have no row.
    """
    works = prior.key_instances().join(prior.linked(), "instance_id").join(prior.canonical(), F.col("work_id") == F.col("from_id"), "left").select("key", F.coalesce("to_id", "work_id").alias("work_id"))
    works = cut(works)
    parts = F.split("key", ":")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), ":"))
    buckets = works.where(F.size(parts) > 1).select(F.explode(begins).alias("key"), "work_id").groupBy("key").agg(F.min("work_id").alias("work_id"), F.max("work_id").alias("other")).where("work_id = other")
    asked = asked.select("key").distinct()
    exact = asked.join(works, "key")
    rest = asked.join(works.select("key"), "key", "left_anti").join(buckets.select("key", "work_id"), "key")
    return exact.unionByName(rest)


def cross_feed_merges(matches: DataFrame, prior: Prior, feeds: DataFrame, feed: str) -> DataFrame:
    """(from_id, to_id): new works whose match key names one prior work of other feeds alone, and no other new work.

    matches: (work_id, match_key) of the run's new works; feeds: (work_id, feed) of
    prior works. Works that the run's feed contributes to are never a target.
    """
    canonical = cut(prior.canonical())
    one = matches.where("match_key <> ''").groupBy("match_key").agg(F.min("work_id").alias("from_id"), F.count("*").alias("n")).where("n = 1")
    others = prior.works.select("work_id", F.col("cluster_key").alias("match_key")).distinct().join(feeds.where(F.col("feed") == feed).select("work_id"), "work_id", "left_anti")
    target = others.join(canonical, F.col("work_id") == F.col("from_id"), "left").groupBy("match_key").agg(F.min(F.coalesce("to_id", "work_id")).alias("target"), F.max(F.coalesce("to_id", "work_id")).alias("other")).where("target = other")
    own = canonical.select(F.col("from_id").alias("x"), F.col("to_id").alias("end"))
    met = one.join(target, "match_key").join(own, F.col("from_id") == F.col("x"), "left")
    return met.where(F.col("target") != F.coalesce("end", "from_id")).select("from_id", F.col("target").alias("to_id"))

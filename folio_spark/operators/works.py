"""Works: near-duplicate tiers, facet predicate, pages, label search, categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_label
from .lineage import cut


def near_duplicates(works: DataFrame, work: str, tiers: Mapping[str, Column], differ: Mapping[str, Column] | None = None) -> DataFrame:
    """(tier, key, work): groups of works with one key, tier by tier; a group counts only if no earlier tier holds all its pairs.

    Each tier gives a work one key; null and empty keys group nothing. A tier
    in `differ` takes only groups that have more than one value of that column; null counts as ''.
    Pairs aren't formed: those that earlier tiers hold are counted from the
    sizes of the subgroups with keys in common, by inclusion and exclusion.
    """
    names, differ = list(tiers), dict(differ or {})
    keyed = works.select(F.col(work).alias("id"), *[F.nullif(tiers[t], F.lit("")).alias(f"k{i}") for i, t in enumerate(names)], *[F.coalesce(differ.get(t, F.lit(None)).cast("string"), F.lit("")).alias(f"d{i}") for i, t in enumerate(names)]).distinct()
    combos = keyed.groupBy(*[c for c in keyed.columns if c != "id"]).agg(F.count("*").alias("n"))
    subgroups = []
    for i in range(len(names)):
        for chosen in range(1 << i):
            shared = [F.col(f"k{j}") for j in range(i) if chosen >> j & 1]
            held = reduce(lambda a, b: a & b, [c.isNotNull() for c in (F.col(f"k{i}"), *shared)])
            over = F.array(*shared) if shared else F.array().cast("array<string>")
            parts = [F.lit(i).alias("tier"), F.col(f"k{i}").alias("key"), F.lit(chosen).alias("chosen"), over.alias("over"), F.lit(1 - 2 * (len(shared) % 2)).alias("sign"), F.col(f"d{i}").alias("d")]
            subgroups.append(F.when(held, F.struct(*parts)))
    every = combos.select("n", F.explode(F.array(*subgroups)).alias("x")).where("x is not null").select("n", "x.*")
    sizes = every.groupBy("tier", "key", "chosen", "over", "sign").agg(F.sum("n").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    groups = sizes.groupBy("tier", "key").agg(F.sum(F.expr("sign * n * (n - 1) div 2")).alias("fresh"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    alike = F.col("tier").isin([i for i, t in enumerate(names) if t in differ]) & (F.col("lo") == F.col("hi"))
    good = groups.where((F.col("fresh") > 0) & ~alike).select("tier", "key")
    members = keyed.select("id", F.posexplode(F.array(*[f"k{i}" for i in range(len(names))])).alias("tier", "key"))
    found = members.join(good, ["tier", "key"])
    return found.select(F.element_at(F.array(*[F.lit(t) for t in names]), F.col("tier") + 1).alias("tier"), "key", F.col("id").alias(work)).distinct()


def matches_facets(values: Mapping[str, Column], selected: Mapping[str, Sequence[str]], folded: Sequence[str] = ("tag",)) -> Column:
    """Whether array columns pass all groups' selections: any value within a group; an empty selection passes all; null values pass none.

    Groups in `folded` ignore case.
    """
    tests = []
    for group, wanted in selected.items():
        if wanted:
            fold = F.lower if group in folded else lambda c: c
            have = F.transform(F.coalesce(values[group], F.array().cast("array<string>")), fold)
            tests.append(F.coalesce(F.arrays_overlap(have, F.array(*[fold(F.lit(w)) for w in wanted])), F.lit(False)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def works_page(works: DataFrame, match: Column, tombstoned: Column, order: Sequence[str], mode: str = "exclude", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the matches, with total (works under the mode) and matched (those that match); a limit outside of 1 to 500 gives 50."""
    live = ~F.coalesce(tombstoned, F.lit(False))
    keep = {"exclude": live, "include": F.lit(True), "only": ~live}.get(mode)
    if keep is None:
        raise ValueError(f"mode must be exclude, include or only, not {mode!r}")
    n = works.agg(F.count_if(keep).alias("total"), F.count_if(keep & match).alias("matched")).first()
    page = works.where(keep & match).orderBy(*order).offset(max(offset, 0)).limit(limit if 1 <= limit <= 500 else 50)
    return page.withColumns({"total": F.lit(n.total).cast("long"), "matched": F.lit(n.matched).cast("long")})


def prefix_hits(labels: DataFrame, prefix: str, scheme: str = "", limit: int | None = None) -> DataFrame:
    """(uri, norm): terms with a label, in any language, that starts with the prefix; each once, by its smallest such label. A blank prefix finds nothing.

    With a scheme only its terms, from a column of that name; with a limit the
    first by label, then uri.
    """
    wanted = norm_label(F.lit(prefix))
    rows = labels.where(F.col("scheme") == scheme) if scheme else labels
    found = rows.select("uri", norm_label(F.col("label")).alias("norm")).where((wanted != "") & F.startswith("norm", wanted))
    best = found.groupBy("uri").agg(F.min("norm").alias("norm"))
    return best if limit is None else best.orderBy("norm", "uri").limit(limit)


def merge_hits(overlay: DataFrame, snapshot: DataFrame, limit: int) -> DataFrame:
    """(uri, norm, origin) of two hit lists by label and uri; a term that both hold is the overlay's."""
    rest = snapshot.join(overlay.select("uri"), "uri", "left_anti")
    both = overlay.withColumn("origin", F.lit("overlay")).unionByName(rest.withColumn("origin", F.lit("snapshot")))
    return both.orderBy("norm", "uri").limit(limit)


def category_members(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(category, uri): the roots (category, root) and all that is narrower, by edges (child, parent); cycles and several parents are fine.

    Walks down from the roots alone: a round joins only what the one before has found.
    """
    edges = cut(edges.select("child", "parent").distinct())
    seen = frontier = cut(roots.select("category", F.col("root").alias("uri")).distinct())
    while not frontier.isEmpty():
        step = frontier.join(edges, F.col("uri") == F.col("parent")).select("category", F.col("child").alias("uri")).distinct()
        frontier = cut(step.join(seen, ["category", "uri"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def usage_window(usage: DataFrame, scheme: str = "", least: int = 0, most: int = 0) -> DataFrame:
    """Authorities of a scheme (empty: all) with least to most works (most 0: no bound), from (scheme, term, works)."""
    kept = usage.where(F.col("works") >= least)
    kept = kept.where(F.col("scheme") == scheme) if scheme else kept
    return kept.where(F.col("works") <= most) if most > 0 else kept

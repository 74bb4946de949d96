"""Line dedup: a suffix array over line ids by prefix doubling, LCP intervals, later copies deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACES, Scratch, unused


def line_id(line: Column) -> Column:
    """128 bits: lines are deleted by it, so even 10^12 of them must not collide."""
    return F.unhex(F.md5(line))


def line_table(docs: DataFrame) -> DataFrame:
    """(doc, pos, id, n_words, at, words) of every line that isn't blank.

    pos counts all lines of a document from 0, at those that aren't blank; words
    is the number of words up to the line's end. Equal lines have equal ids.
    """
    lines = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.btrim("line", F.lit(SPACES))
    lines = lines.where(line != "").select("doc", "pos", line_id(F.col("line")).alias("id"), F.size(F.split(line, SPACE)).cast("long").alias("n_words"))
    # Repeated rows have the same lines in the same places: they count once.
    lines = lines.repartition("doc").dropDuplicates(["doc", "pos", "id"])
    order = Window.partitionBy("doc").orderBy("pos", "id")
    return lines.withColumns({"at": (F.row_number().over(order) - 1).cast("long"), "words": F.sum("n_words").over(order.rowsBetween(Window.unboundedPreceding, 0))})


def key_of(*parts: Column) -> Column:
    """128 bits for a tuple of numbers or keys."""
    return F.unhex(F.md5(F.concat_ws(":", *parts)))


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that sorts both sides: tables of the loops below grow with the input, so none is ever broadcast."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def doubled(scratch: Scratch, lines: DataFrame) -> list[DataFrame]:
    """Level k: (doc, at, name, first) of positions whose next 2^k lines occur twice or more.

    name orders those stretches lexicographically by line id, as the ranks of a
    suffix array after k rounds of prefix doubling do; stretches that occur once
    are discarded, as their suffixes are sorted. first: the earliest (doc, at)
    with the same name. Lines are numbered without blank ones. Each level is one
    saved plan.
    """
    level = lines.select("doc", "at", F.col("id").alias("x"), F.lit(0).cast("long").alias("y"))
    out: list[DataFrame] = []
    while True:
        k = len(out)
        groups = level.groupBy("x", "y").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at")).alias("first")).where("n > 1")
        # A range-partitioned sort, and ids that grow along it: one row a key, so the order is the same whenever it runs.
        names = groups.orderBy("x", "y").select("x", "y", F.monotonically_increasing_id().alias("name"), "first")
        found = scratch.save(merged(level, names, ["x", "y"]).select("doc", "at", "name", "first"), f"level{k}")
        if found.isEmpty():
            return out
        out.append(found)
        # The stretch behind starts 2^k lines further on; without a name there, the longer stretch occurs once.
        w = Window.partitionBy("doc").orderBy("at").rangeBetween(1 << k, 1 << k)
        level = found.withColumn("y", F.first("name").over(w)).where("y is not null").select("doc", "at", F.col("name").alias("x"), "y")


def previous_factors(scratch: Scratch, levels: list[DataFrame]) -> DataFrame:
    """(doc, at, n): the longest run of n lines from a position on that also starts at an earlier one.

    This resolves the LCP intervals of the suffix array from the longest to the
    shortest: each interval passes only its earliest suffix on, and every other
    suffix in it has found its n. Intervals are refined by steps of 2^m lines;
    a problem is a set of suffixes with l lines in common, in which all but the
    earliest look for a longer match. Each step is one saved plan.
    """
    here = F.struct("doc", "at")
    problems = None
    for m in range(len(levels) - 1, -1, -1):
        parts = []
        if problems is not None:
            ahead = levels[m].select(F.col("doc").alias("d2"), F.col("at").alias("a2"), F.col("name").alias("y"))
            near = merged(problems, ahead, (F.col("doc") == F.col("d2")) & (F.col("at") + F.col("l") == F.col("a2")), "left").select("g", "l", "doc", "at", "lead", "y")
            heads = near.where("y is not null").groupBy("g", "y").agg(F.min(here).alias("head"), F.count("*").alias("n"))
            near = merged(near, heads, ["g", "y"], "left")
            # Longer by 2^m: all of the same stretch behind. As long as before: its first, and those alone.
            parts.append(near.where("n > 1").select(key_of(F.hex("g"), F.col("y").cast("string"), F.lit(str(m))).alias("g"), (F.col("l") + (1 << m)).alias("l"), "doc", "at", (F.col("head") == here).alias("lead")))
            parts.append(near.where(F.col("y").isNull() | (F.col("head") == here)).select("g", "l", "doc", "at", "lead"))
        # New: suffixes that share 2^m lines; of those that share more, the earliest stands for all.
        new = levels[m].select("doc", "at", "name", "first")
        if m + 1 < len(levels):
            later = levels[m + 1].where(F.col("first") != here).select("doc", "at")
            new = merged(new, later, ["doc", "at"], "left_anti")
        parts.append(new.select(key_of(F.lit(str(m)), F.col("name").cast("string")).alias("g"), F.lit(1 << m).cast("long").alias("l"), "doc", "at", (F.col("first") == here).alias("lead")))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        problems = scratch.save(every, f"problems{m}")
        if m + 1 < len(levels):
            scratch.drop(f"problems{m + 1}", f"level{m + 1}")
    return problems.where("not lead").select("doc", "at", F.col("l").alias("n"))


def repeated_lines(docs: DataFrame, *, min_words: int = 50) -> DataFrame:
    """(doc, pos, id) of the lines to delete; doc is doc_id.

    Suffixes run to the end of a document, so the suffix array is over the
    sequences of line ids with an end mark behind each. A run of lines that also
    starts earlier, by (doc_id, line), is a later copy; it counts if it has
    min_words words. Every line keeps its first occurrence: a run that covers it
    would have an earlier copy, and that one the line.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.save(line_table(docs.where("doc_id is not null")), "lines")
    levels = doubled(scratch, lines)
    if not levels:
        return lines.select("doc", "pos", "id").limit(0)
    runs = previous_factors(scratch, levels).withColumn("stop", F.col("at") + F.col("n"))
    # The words of a run: from the running sums at its last line and at its first.
    starts = merged(lines, runs, ["doc", "at"]).select("doc", "at", "stop", (F.col("words") - F.col("n_words")).alias("before"))
    ends = lines.select("doc", (F.col("at") + 1).alias("stop"), F.col("words").alias("upto"))
    good = merged(starts, ends, ["doc", "stop"]).where(F.col("upto") - F.col("before") >= min_words).select("doc", "at", "stop")
    marked = merged(lines.select("doc", "pos", "id", "at"), good, ["doc", "at"], "left")
    reach = F.max("stop").over(Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return marked.select("doc", "pos", "id", (F.coalesce(reach, F.lit(0)) > F.col("at")).alias("out")).where("out").select("doc", "pos", "id")


def dedup_lines(docs: DataFrame, *, min_words: int = 50) -> DataFrame:
    """docs with text freed of later copies of line runs, and n_removed (lines deleted); all other columns stay as they are.

    The first copy by (doc_id, line number) stays whole. Lines are compared
    exactly (by a 128-bit hash); blank lines neither break a run nor count in it,
    and stay. min_words is the least number of words of a run.

    Null doc_id or null text: the row stays as it is, n_removed 0. Empty text:
    stays. A text of which all lines go: empty text; the row stays. Very long
    texts: time and memory grow with the number of lines. Repeated rows: one
    document, so none loses a line to another; rows with the same doc_id and
    different texts: one document in which equally numbered lines follow one
    another. Empty table: no rows. A column n_removed of docs is replaced;
    others stay, whatever their names.
    """
    rest = [c for c in docs.columns if c.lower() != "n_removed"]
    doc, gone, lines = unused(rest, "doc", "gone", "lines")
    place = lambda pos, id_: F.concat(pos.cast("string"), F.lit(":"), F.hex(id_))
    marked = repeated_lines(docs, min_words=min_words).groupBy(F.col("doc").alias(doc)).agg(F.collect_set(place(F.col("pos"), F.col("id"))).alias(gone))
    joined = merged(docs.drop("n_removed"), marked, F.col("doc_id") == F.col(doc), "left")
    joined = joined.withColumn(lines, F.when(F.col(gone).isNotNull(), F.split("text", "\n")))
    # The difference of two sets of places keeps the order of the first; it takes one look-up a line.
    places = F.transform(lines, lambda x, i: place(i, line_id(x)))
    left = F.transform(F.array_except(places, F.col(gone)), lambda p: F.get(F.col(lines), F.substring_index(p, ":", 1).cast("int")))
    joined = joined.withColumn(gone, left)
    n = F.when(F.col(gone).isNotNull(), F.size(lines) - F.size(gone)).otherwise(0)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(gone, "\n"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in rest], n.alias("n_removed"))

"""Quality rules: fixed base rules, then a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, Scratch, let, unused, words

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEATED_PERCENT = 20, 8, 30
# Log ratios are added up as whole numbers of this unit, so that no order of adding changes a sum.
UNIT = 1e-4
# One document in SAMPLE is looked at for frequent buckets; the others' counts are summed in PARTS tasks.
# Both change the cost, no result: a document's sum leaves each of the PARTS once.
SAMPLE, PARTS = 8, 24


def pairs(hashes: Column, step: int) -> Column:
    """The hashes of each element with the one `step` further on."""
    n = F.size(hashes) - step
    return F.when(n > 0, F.zip_with(F.slice(hashes, 1, F.greatest(n, F.lit(0))), F.slice(hashes, step + 1, F.greatest(n, F.lit(0))), lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast("array<bigint>"))


def runs(hashes: Column, k: int) -> Column:
    """The hash of each k elements in a row, in one pass."""
    return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - k + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, k)]))


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of so many words (an even number) found twice or more in the text."""

    def covered(h: Column) -> Column:
        def by_place(s: Column) -> Column:
            same = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
            return let(same, lambda e: F.filter(s, lambda x, i: F.get(e, i) | ((i > 0) & F.coalesce(F.get(e, i - 1), F.lit(False)))))

        def union(p: Column) -> Column:
            steps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda x, y: F.least(F.coalesce(y - x, F.lit(window)), F.lit(window)))
            return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

        s = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(s, lambda s: let(F.sort_array(F.transform(by_place(s), lambda x: x["i"])), union))

    # Texts in which no half window is found twice, most of them, end there.
    half, once = window // 2, lambda a: F.size(F.array_distinct(a)) == F.size(a)
    found = lambda b: F.when(once(b), 0).otherwise(let(pairs(b, half), lambda a: F.when(once(a), 0).otherwise(covered(a))))
    return let(hashes, lambda h: F.when(F.size(h) < window, 0).otherwise(let(runs(h, half), found))).cast("long")


def grams(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, gram) from rows (keys, w: words): the 64-bit hash of every word and of every word with the next one."""
    each = rows.select(*keys, "w", F.posexplode("w").alias("i", "x")).select(*keys, F.xxhash64("x").alias("one"), F.get("w", F.col("i") + 1).alias("next"))
    two = F.when(F.col("next").isNotNull(), F.xxhash64("one", F.xxhash64("next")))
    return each.select(*keys, F.explode(F.array("one", two)).alias("gram")).where("gram is not null")


def bucket_of(gram: Column, n_buckets: int) -> Column:
    return F.pmod(gram, F.lit(n_buckets)).cast("int" if n_buckets <= 1 << 31 else "bigint")


def n_buckets_of(docs: DataFrame, least: int, bucket_bytes: int) -> int:
    """The power of two, `least` or more, that leaves at most bucket_bytes bytes of text a bucket: they get no fuller as the corpus grows."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(least, 1 << max(0, -(-size // bucket_bytes) - 1).bit_length())


def frequent(scratch: Scratch, sample: DataFrame, slots: int) -> DataFrame:
    """(bucket): about `slots` buckets, those found most often in a sample of rows (bucket); of the last step as many as there is room for."""
    seen = sample.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    # Steps of about 4 % hold the number of distinct steps, which the driver reads, under 1,100.
    seen = scratch.save_alone(seen.select("bucket", F.floor(16 * F.log2("n")).cast("int").alias("step")), "seen")
    least, share, room = 0, 1.0, slots
    for step, n in seen.groupBy("step").count().orderBy(F.desc("step")).collect():
        least, share, room = step, room / n, room - n
        if room <= 0:
            break
    lot = F.pmod(F.xxhash64("bucket"), F.lit(1 << 20)) < int(min(share, 1.0) * (1 << 20))
    return seen.where((F.col("step") > least) | ((F.col("step") == least) & lot)).select("bucket")


def log_ratio(raw: Column, aim: Column, raws: int, aims: int, alpha: float, n_buckets: int) -> Column:
    """log p(bucket | trusted) - log p(bucket | corpus) in units of UNIT, of a bucket with raw n-grams, aim of them trusted."""
    add = alpha * n_buckets
    ratio = F.log((aim + alpha) / (aims + add)) - F.log((raw + alpha) / (raws + add)) if aims else F.lit(0.0)
    return F.round(ratio / UNIT).cast("int")


def score(scratch: Scratch, marked: DataFrame, n_buckets: int, alpha: float, slots: int) -> tuple[DataFrame, DataFrame]:
    """(key, near: struct of sum and n) and (key, far) from rows (key, hit, w): sums of log ratios over frequent and other n-grams, and how many n-grams there are.

    Both sides count every n-gram. The counts of about `slots` frequent
    buckets are a table that goes to all tasks. Any other n-gram is shuffled
    once, with its document, to where its bucket is counted; its ratio is added
    up there.
    """

    def each(rows: DataFrame) -> DataFrame:
        return grams(rows, "key", "hit").select("key", "hit", bucket_of(F.col("gram"), n_buckets).alias("bucket"))

    common = frequent(scratch, each(marked.where(F.pmod("key", F.lit(SAMPLE)) == 0)).select("bucket"), slots)
    found = each(marked).join(F.broadcast(common.select("bucket", F.col("bucket").alias("known"))), "bucket", "left")
    counts = scratch.save_alone(found.groupBy("known").agg(F.count("*").alias("raw"), F.sum("hit").alias("aim")), "counts")
    scratch.drop("seen")
    raws, aims = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("aim"), F.lit(0))).first()
    ratio = log_ratio(F.col("raw"), F.col("aim"), raws, aims, alpha, n_buckets)
    common = F.broadcast(counts.where("known is not null").select(F.col("known").alias("bucket"), ratio.alias("ratio")))
    found = each(marked).join(common, "bucket", "left")
    near = found.groupBy("key").agg(F.struct(F.coalesce(F.sum("ratio"), F.lit(0)).alias("sum"), F.count("*").alias("n")).alias("near"))
    same = Window.partitionBy("bucket")
    code = F.col("bucket").cast("bigint") * 2 + F.col("hit")  # one number instead of two: smaller shuffles
    rest = found.where("ratio is null").select("key", code.alias("code")).repartition(PARTS, F.shiftright("code", 1))
    rest = rest.select("key", F.shiftright("code", 1).alias("bucket"), F.col("code").bitwiseAND(F.lit(1)).alias("hit"))
    rest = rest.select("key", F.count("*").over(same).alias("raw"), F.sum("hit").over(same).alias("aim"))
    return near, rest.groupBy("key").agg(F.sum(ratio).alias("far"))


def quality_rules(docs: DataFrame, labels: DataFrame, *, n_buckets: int = 1 << 16, bucket_bytes: int = 32, slots: int = 1_000_000, alpha: float = 1.0, min_score: float = -0.25, max_trusted: int = 50_000) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept.

    Method: words and word pairs are hashed into n_buckets, or into as many more
    as leave bucket_bytes of text a bucket, so that a verdict doesn't fade with
    the size of the corpus; llr is the mean over a document's n-grams of
    log p(trusted) - log p(corpus) under two smoothed multinomials, so it doesn't
    depend on length. The ratios of about `slots` frequent buckets are looked
    up in place; the other n-grams meet by bucket, are counted and summed there
    (`slots` changes the cost, no result). The trusted one is fit on at
    most max_trusted documents with label quality = 1 (those with the smallest
    hash of doc_id); the corpus one counts all documents. Every document gets
    the same threshold: kept if no base rule fails and llr >= min_score.

    Null text: as empty. Empty or blank text: no words, base_failed, not kept.
    Very long texts: whole. Null doc_id: judged, never trusted. Repeated rows:
    each judged alone (and counted each time). No trusted document, or an empty
    table: llr is 0 for all, so the base rules decide. Columns of docs with the
    names of results are replaced; all others stay, whatever their names.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    own = [c for c in docs.columns if c.lower() not in added]
    w, h, key, near, far = unused([*own, *added], "w", "h", "key", "near", "far")
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)
    row_key = F.xxhash64("doc_id", "text")  # equal rows add up to the mean that each of them has
    marked = docs.select("doc_id", "text").join(F.broadcast(trusted.select("doc_id", F.lit(1).alias("hit"))), "doc_id", "left")
    marked = marked.select(row_key.alias("key"), F.coalesce("hit", F.lit(0)).alias("hit"), words(F.col("text")).alias("w"))
    n_buckets = n_buckets_of(docs, n_buckets, bucket_bytes)
    sums, rest = score(Scratch(docs.sparkSession, "quality"), marked, n_buckets, alpha, slots)
    sums = sums.join(rest, "key", "left").select(F.col("key").alias(key), F.col("near").alias(near), F.col("far").alias(far))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = docs.select(*own, words(F.col("text")).alias(w)).withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    out = out.withColumns(
        {
            "n_words": F.size(h).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),  # translate looks up every character as a string
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_words(F.col(h)),
            key: row_key,
        }
    ).drop(w, h)
    llr = (F.col(near)["sum"] + F.coalesce(F.col(far), F.lit(0))) * UNIT / F.col(near)["n"]
    out = out.join(sums, key, "left").withColumn("llr", F.coalesce(llr, F.lit(0.0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= min_score)).select(*own, *added)

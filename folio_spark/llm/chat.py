"""Chat formatting: token-budgeted, turn-aligned windows with a reversible template and a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template: a turn is BEGIN role BREAK text END. Texts and
# roles never hold these characters: each has an escape of two others.
BEGIN, BREAK, END = "<s>[", "]\n", "</s>\n"
ESCAPES = [("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\d")]


def escape(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    """Every backslash of an escaped text starts an escape, so the backslash's own comes last."""
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), escape(role), F.lit(BREAK), escape(text), F.lit(END))


def tokens(text: Column) -> Column:
    """Estimated tokens of a turn: a quarter of its bytes, and 8 for the marks."""
    return F.ceil(F.octet_length(text) / 4).cast("long") + 8


def prefix_sums(turns: DataFrame, span: int) -> DataFrame:
    """turns with ord (from 1) and before (tokens of earlier turns) by conversation.

    Sums of chunks of `span` turn numbers are added up first, so that the rows
    of one long conversation are sorted and numbered in many tasks.
    """
    rows = turns.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / span), F.lit(-1)).cast("long"))
    order = ["turn", "role", "text"]
    sums = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("rows"), F.sum("cost").alias("sum"))
    ahead = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows"), F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("sum"))
    within = Window.partitionBy("conv_id", "chunk").orderBy(*order)
    rows = rows.withColumns({"nth": F.row_number().over(within), "run": F.sum("cost").over(within.rowsBetween(Window.unboundedPreceding, 0))})
    joined = rows.join(sums, rows.conv_id.eqNullSafe(sums.c) & (rows.chunk == sums.k))
    return joined.select("conv_id", "turn", "role", "text", "cost", (F.col("rows") + F.col("nth")).alias("ord"), (F.col("sum") + F.col("run") - F.col("cost")).alias("before"))


def format_chat(conversations: DataFrame, *, budget: int = 1024, history: int = 2, history_budget: int = 256, least: int = 128, span: int = 256) -> DataFrame:
    """One row a window: conv_id, window_id, n_context, n_fresh, formatted, loss_spans, tokens, over_budget.

    Turns get the token prefix sums of their conversation; new turns are cut
    into spans where the prefix sum passes a multiple of half the room that the
    conversation's own system turn and the history leave in the budget. As a turn
    of at most that half may start before the cut, a span never exceeds the room;
    a longer turn is never cut but has a window of its own. Every window holds the
    conversation's first turn if it's a system turn, however long: its tokens are
    taken from the room, of which `least` tokens stay in any case. A window also
    repeats up to `history` turns of the window before it that together have at
    most history_budget tokens. over_budget marks the windows that a long turn or
    a long system turn takes beyond the budget. loss_spans (start from 1, length, in code points of
    formatted) mark the text of fresh assistant turns only: repeats are masked.

    Turns are ordered by (turn, role, text), nulls first. Null role or text: empty.
    Repeated rows: turns of their own. Null conv_id: one conversation. Empty
    table: no rows. Other columns are ignored.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    turns = prefix_sums(turns.withColumn("cost", tokens(F.col("text"))), span)
    part = F.struct("ord", "role", "text", "cost")
    leads = (F.col("ord") == 1) & (F.col("role") == "system")
    system = turns.where(leads).select(F.col("conv_id").alias("c"), part.alias("lead"))
    # The system turn is in every window, so it takes from the room of all and counts in none's span.
    turns = turns.join(system.select("c", F.col("lead.cost").alias("lead")), F.col("conv_id").eqNullSafe(F.col("c")), "left").withColumn("lead", F.coalesce("lead", F.lit(0))).drop("c")
    half = F.greatest(F.floor((F.lit(budget - history_budget) - F.col("lead")) / 2), F.lit(least // 2))
    turns = turns.withColumns({"half": half, "before": F.when(F.col("ord") > 1, F.col("before") - F.col("lead")).otherwise(F.col("before"))})
    # A turn over half the room stands alone: the count of such turns so far keeps its neighbours apart.
    long = turns.withColumn("long", (~leads & (F.col("cost") > F.col("half"))).cast("int"))
    by_half = F.floor(F.col("before") / F.col("half")).cast("long")
    spans = long.withColumn("slot", F.when(F.col("long") == 1, F.struct(by_half.alias("s"), F.col("ord").alias("o"))).otherwise(F.struct(by_half.alias("s"), F.lit(0).cast("long").alias("o"))))
    # Within a slot, short turns behind a long one form a run of their own: the long one has ended the slot, since it's longer than a slot.
    w = Window.partitionBy("conv_id", "slot")
    fresh = spans.withColumns({"first_ord": F.min("ord").over(w), "last_ord": F.max("ord").over(w)})
    key = ["conv_id", "first_ord"]
    # The last turns of a window are history of the one that starts behind it.
    back = fresh.where(F.col("last_ord") - F.col("ord") < history)
    tail = Window.partitionBy("conv_id", "first_ord").orderBy(F.desc("ord"))
    back = back.withColumn("sum", F.sum("cost").over(tail)).where((F.col("sum") <= history_budget) & ~leads)
    repeats = back.select("conv_id", (F.col("last_ord") + 1).alias("first_ord"), part.alias("part"))
    starts = fresh.where(F.col("ord") == F.col("first_ord")).select(*key)
    again = starts.where("first_ord > 1").join(system, F.col("conv_id").eqNullSafe(F.col("c"))).select(*key, F.col("lead").alias("part"))
    every = fresh.select(*key, part.alias("part"), F.lit(1).alias("new")).unionByName(repeats.unionByName(again).withColumn("new", F.lit(0)))
    windows = every.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("new"), F.col("part.ord").alias("ord"), F.col("part.role").alias("role"), F.col("part.text").alias("text"), F.col("part.cost").alias("cost")))).alias("parts"))
    windows = windows.where(F.exists("parts", lambda p: p["new"] == 1))  # a last window has no successor to repeat its turns in
    pieces = F.transform("parts", lambda p: F.struct(p["new"].alias("new"), p["role"].alias("role"), escape(p["role"]).alias("r"), escape(p["text"]).alias("t"), p["cost"].alias("cost")))
    windows = windows.withColumn("pieces", pieces)
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(F.lit(BEGIN), p["r"], F.lit(BREAK), p["t"], F.lit(END))), "")
    state = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def mask(s: Column, p: Column) -> Column:
        start = s["at"] + len(BEGIN) + F.length(p["r"]) + len(BREAK)
        target = (p["new"] == 1) & (p["role"] == "assistant") & (F.length(p["t"]) > 0)
        spans = F.when(target, F.concat(s["spans"], F.array(F.struct(start.alias("start"), F.length(p["t"]).alias("length"))))).otherwise(s["spans"])
        return F.struct((start + F.length(p["t"]) + len(END)).alias("at"), spans.alias("spans"))

    total = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + p["cost"])
    return windows.select(
        "conv_id",
        F.col("first_ord").alias("window_id"),
        F.size(F.filter("pieces", lambda p: p["new"] == 0)).alias("n_context"),
        F.size(F.filter("pieces", lambda p: p["new"] == 1)).alias("n_fresh"),
        formatted.alias("formatted"),
        F.aggregate("pieces", state, mask, lambda s: s["spans"]).alias("loss_spans"),
        total.alias("tokens"),
        (total > budget).alias("over_budget"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from formatted texts and masks alone.

    A digest runs over a whole conversation, so its turns meet here and only here.
    """
    cut = F.split("formatted", END)
    turns = F.slice(cut, F.col("n_context") + 1, F.size(cut) - 1 - F.col("n_context"))
    head = lambda t: F.substring_index(t, BREAK, 1)

    def plain(t: Column) -> Column:
        role = F.substr(head(t), F.lit(len(BEGIN) + 1))
        return F.concat(unescape(role), F.lit("\n"), unescape(F.substr(t, F.length(head(t)) + len(BREAK) + 1)), F.lit("\n"))

    parsed = windows.select(
        "conv_id",
        "window_id",
        F.size(turns).alias("n"),
        F.array_join(F.transform(turns, plain), "").alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"], s["length"]))), "").alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = parsed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window_id", "turns", "loss"))).alias("w"), F.sum("n").cast("long").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    text = lambda f: F.array_join(F.transform("w", lambda x: x[f]), "")
    return whole.select("conv_id", "n_turns", F.sha2(text("turns"), 256).alias("turns_sha256"), F.length(text("loss")).cast("long").alias("loss_chars"), F.sha2(text("loss"), 256).alias("loss_sha256"), "formatted_chars")

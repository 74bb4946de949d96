"""Benchmark decontamination: word-pair seeds, then Smith-Waterman alignment of word sequences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
FOUND = "doc_id long, item_id long, score double, n_seeds int, start_word long, n_words long"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def align(passage: list[str], item: list[str], match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int]:
    """(score, end) of the best local alignment; end: words of the passage up to where it stops."""
    code = {w: i for i, w in enumerate(dict.fromkeys(item))}
    p = np.fromiter(map(code.get, passage, repeat(-1)), dtype=np.int64, count=len(passage))
    # Cells carry the gaps to their left, so that gaps in the item are a running maximum; a zero cell holds those gaps alone.
    zero = np.arange(len(p) + 1) * -gap
    pay = np.where(p == np.arange(len(code))[:, None], match, mismatch) - gap
    row, new, plain, best, end = zero.copy(), zero.copy(), np.zeros_like(zero), 0, 0
    for w in item:
        np.add(row[:-1], pay[code[w]], out=new[1:])
        row += gap
        np.maximum(new[1:], row[1:], out=new[1:])
        np.maximum(new, zero, out=new)
        np.maximum.accumulate(new, out=new)
        row, new = new, row
        new[0] = 0
        if (top := int(np.subtract(row, zero, out=plain).max())) > best:
            best, end = top, int(plain.argmax())
    return best, end


class Seeds:
    """Finds the items that a text can hold a copy of; of at least half the points, none is missed.

    The seeds of an item are its pairs of words next to each other or one word
    apart, found in the text next to each other or one word apart. An alignment
    of L words with m matches and e edits has 2m - e >= L points. Between its
    matches are m - 1 gaps, of which at most e / 2 <= (2m - L) / 2 have two edits
    or more, so L/2 - 1 or more have one at most, and such a gap is a seed; each
    starts at another place. As m <= L, e <= L: all lie within 2L words. Items of
    1 to 3 words have too few gaps and are searched as whole sequences.
    """

    def __init__(self, items: list[list[str]]):
        self.items = items
        self.length = np.array([len(w) for w in items], dtype=np.int64)
        self.need = (self.length + 1) // 2 - 1
        self.code: dict[str, int] = {}
        for w in items:
            for x in w:
                self.code.setdefault(x, len(self.code))
        self.short = [i for i, w in enumerate(items) if len(w) < 4]
        v = len(self.code)
        pairs = {(self.code[w[k]] * v + self.code[w[k + d]], i) for i, w in enumerate(items) if len(w) > 3 for d in (1, 2) for k in range(len(w) - d)}
        held = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.pairs, self.first = np.unique(held[:, 0], return_index=True)
        self.count, self.of = np.diff(np.append(self.first, len(held))), held[:, 1]
        self.may = np.zeros(1 << 20, dtype=bool)  # by the low bits of a pair: most pairs of a text aren't looked up
        self.may[self.pairs & (len(self.may) - 1)] = True

    def hits(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place) of all seeds in coded words, sorted, each place once an item."""
        v, places, pairs = len(self.code), [], []
        for d in (1, 2):
            a, b = p[:-d], p[d:]
            at = np.flatnonzero((a >= 0) & (b >= 0))
            places.append(at)
            pairs.append(a[at] * v + b[at])
        place, pair = np.concatenate(places), np.concatenate(pairs)
        likely = self.may[pair & (len(self.may) - 1)]
        place, pair = place[likely], pair[likely]
        if not len(pair) or not len(self.pairs):
            return place[:0], place[:0]
        k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        known = self.pairs[k] == pair
        place, k = place[known], k[known]
        n = self.count[k]
        flat = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, place = self.of[flat], np.repeat(place, n)
        enough = np.bincount(item, minlength=len(self.items)) >= self.need
        item, place = item[enough[item]], place[enough[item]]
        both = np.unique(item * (len(p) + 1) + place)
        return both // (len(p) + 1), both % (len(p) + 1)

    def stretches(self, w: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(item, seeds, first word, end) of the parts of a text to align."""
        p = np.fromiter(map(self.code.get, w, repeat(-1)), dtype=np.int64, count=len(w))
        for i in self.short:
            x = self.items[i]
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    yield i, 1, k, k + len(x)
        if len(p) < 2:
            return
        items, places = self.hits(p)
        cuts = np.flatnonzero(np.diff(items)) + 1
        for at, i in zip(np.split(places, cuts), items[np.append(0, cuts)] if len(items) else (), strict=False):
            size, need = int(self.length[i]), max(1, int(self.need[i]))
            if len(at) < need:
                continue
            dense = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] <= 2 * size)
            # Dense windows whose surroundings touch are one stretch.
            for group in np.split(dense, np.flatnonzero(at[dense[1:]] - at[dense[:-1] + need - 1] > 4 * size) + 1) if len(dense) else ():
                first, last = int(at[group[0]]), int(at[group[-1] + need - 1])
                yield int(i), int(((at >= first) & (at <= last)).sum()), max(0, first - 2 * size), last + 2 * size + 3


def contaminated(docs: DataFrame, benchmark: DataFrame, *, min_score: float = 0.5, block_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, start_word, n_words): documents that hold a copy of a test item, edited or not.

    Words are compared lower-cased, without punctuation. A stretch of a document
    with enough seeds of an item (see Seeds) is aligned with it (match 2, mismatch
    and gap -1); score is the alignment's share of a full match. Pairs of
    min_score (0.5 at least) or more are returned, with the best stretch of each.
    For items of four words and more the seeds miss none of them; shorter items
    are found whole. A document's verdict depends on its own text and the items.

    The test items are taken in blocks of block_chars, each sent to all tasks;
    documents are never joined with one another. Null or empty texts and items:
    match nothing. Null doc_id: left out. Repeated rows: one result per doc_id
    and item. Equal items: one result each. Empty tables: no rows. Other columns
    are ignored.
    """
    if min_score < 0.5:
        raise ValueError("seeds are complete for a min_score of 0.5 or more")
    spark = docs.sparkSession
    rows = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, ceil(total / block_chars))
    results = [spark.createDataFrame([], FOUND)]
    for k in range(n_blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k)
        items = sorted((r["item_id"], w) for r in block.collect() if (w := words(r["text"])))
        if not items:
            continue

        def score(batches: Iterator[pd.DataFrame], items=items) -> Iterator[pd.DataFrame]:
            seeds = Seeds([w for _, w in items])
            for b in batches:
                out = []
                for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                    all_words = words(text)
                    for i, hits, first, stop in seeds.stretches(all_words):
                        (item_id, w), p = items[i], all_words[first:stop]
                        points, end = align(p, w)
                        if points >= min_score * 2 * len(w):
                            back, length = align(p[:end][::-1], w[::-1])
                            length = length if back == points else min(end, len(w))
                            out.append((doc_id, item_id, points / (2 * len(w)), hits, first + end - length, length))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])

        results.append(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(score, FOUND))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    best = F.max_by(F.struct("score", "n_seeds", "start_word", "n_words"), F.struct("score", -F.col("start_word"), -F.col("n_words"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", "b.n_seeds", "b.start_word", "b.n_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, without the documents that contaminated() finds; rows without doc_id stay."""
    return docs.join(contaminated(docs, benchmark, **options).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)

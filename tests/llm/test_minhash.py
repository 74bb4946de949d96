"""b-bit MinHash against all pairs of whole sets."""

import random
import re

import numpy as np
import pytest

from folio_spark.llm.minhash import Sketcher, keep_first, minhash_components, most_mismatches

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORDS.findall((text or "").encode().lower())
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute(rows, threshold=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return [(d, len(s), least.get(top(i)), d == least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed, n):
    """Copies with few and many edits, chains of edits, shared passages, tiny sets."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    text = lambda k: [r.choice(vocab) for _ in range(k)]
    base = [text(r.randint(10, 160)) for _ in range(8)]
    passage, out = text(80), [None, "", " \n\t ", "one two", "ONE two", "x", "a b c d e f", "a b c d e f g", "b c d e f g"]
    chain = text(90)
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.2:
            w += passage + text(r.randint(0, 25))
        out.append(" ".join(w))
        chain[r.randrange(len(chain))] = r.choice(vocab)
        out.append(" ".join(chain))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_all_pairs(spark, seed):
    rows = list(enumerate(corpus(seed, 120)))
    rows += [(None, rows[20][1]), (None, None), (None, "alone and without id here"), (7, rows[20][1]), (7, rows[20][1])]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, node int, sig string")
    assert order(minhash_components(docs).collect()) == order(brute(rows))


def test_keep_first(spark):
    rows = [(3, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert order(keep_first(docs).collect()) == order([(2, "A b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (5, None), (6, "")])
    assert keep_first(docs.limit(0)).count() == 0


def test_long_text(spark):
    long = " ".join(f"q{i}" for i in range(150_000))
    rows = [(1, long), (2, long.replace("q77 ", "z ")), (3, "q1 q2 q3 q4 q5 q6")]
    assert order(minhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == order(brute(rows))


def test_bits_estimate_similarity():
    """The estimate from two low bits, corrected for chance, lies within five standard deviations of the similarity."""
    r = np.random.default_rng(3)
    sketch, k = Sketcher(6, 48), 288
    for share in (0.2, 0.5, 0.85, 0.95):
        x = r.integers(-(1 << 63), 1 << 63, 4000, dtype=np.int64)
        n = round(2000 * 2 * share / (1 + share))
        a, b = np.sort(x[:2000]), np.sort(np.concatenate([x[:n], x[2000 : 4000 - n]]))
        true = n / (4000 - n)
        _, bits = sketch([a, b])
        low = [[int(v) >> 2 * j & 3 for v in row for j in range(32)][:k] for row in bits]
        p = np.mean([u == v for u, v in zip(*low, strict=True)])
        assert abs((p - 0.25) / 0.75 - true) < 5 * np.sqrt(0.25 / k) / 0.75
    assert most_mismatches(85, k, 6.0) < k * 0.75 * (1 - 0.65)

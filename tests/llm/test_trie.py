"""The prefix trie against one built turn by turn."""

import hashlib
import random
import re
import zlib

import pytest

from folio_spark.llm import trie
from folio_spark.llm.trie import prefix_trie

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth int, owner string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - (abs(c) % 20) * (1 if c > 0 else -1), [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    kids = {p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in members}
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(WORDS.findall(q[-1][1])) for q in below if q)
        ids = ",".join(map(str, ends.get(p, [])))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], sum(kids[q] == 0 for q in below), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows):
    return sorted(map(tuple, prefix_trie(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()), key=repr)


def talks(seed, n):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-30, 200), n):
        for t in range(r.choice([1, 2, 3, 5, 9])):
            rows.append((c, t, r.choice(["user", "assistant"]) if t else "system", r.choice(["a", "a b", "x y  z", ""])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_turn_by_turn(spark, seed):
    rows = talks(seed, 70)
    rows += [(None, 0, "user", "gone"), (7, None, None, None), (7, None, "user", None), (40, 0, "system", "a"), (41, 5, "user", "late"), (41, 5, "user", "late"), (41, 5, "assistant", "b")]
    assert found(spark, rows) == brute(rows)


def test_blocks_and_ranges(spark, monkeypatch):
    """Long conversations in blocks of three turns; nested ones hang in a long line of chains."""
    monkeypatch.setattr(trie, "BLOCK", 3)
    rows = [(c, t, "user", f"t{t} w") for c in range(20, 40) for t in range(c - 15)] + [(c, t, "user", f"t{t} w") for c in (100, 103) for t in range(40)]
    assert found(spark, rows) == brute(rows)


def test_conversations_without_turns_left(spark):
    rows = [(c, 0, "user", "only") for c in range(1, 60) if c % 20] + [(80, 0, None, "x"), (81, 0, "user", "y")]
    assert found(spark, rows) == brute(rows)
    assert any(d == 0 and n > 1 for _, d, _, n, *_ in brute(rows))


def test_runs_of_members(spark):
    """Many conversations end at one node; the runs of their ids join to one hash."""
    rows = [(c, "n", 5) for c in range(1000, 1040)] + [(3, "o", 5)]
    ends = spark.createDataFrame([(1, 2, m) for m, *_ in rows], "conv_id long, depth long, member long").repartition(5)
    got = trie.end_digests(ends, most=7).collect()
    want = ",".join(map(str, sorted(m for m, *_ in rows)))
    assert [tuple(r) for r in got] == [(1, 2, hashlib.sha256(want.encode()).hexdigest())]


def test_empty_and_long(spark):
    assert found(spark, []) == []
    rows = [(40, 0, "user", "w " * 100_000), (43, 0, "user", "w " * 100_000), (43, 1, "user", "end")]
    assert found(spark, rows) == brute(rows)

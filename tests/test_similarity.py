"""Similar works against scores of all pairs."""

import math
import random

import pytest

from folio_spark.operators.similarity import Options, similar_works

ATTRS = "work_id string, rel string, value string"


def frames(spark, attrs, languages=(), held=(), edges=()):
    return spark.createDataFrame(attrs, ATTRS), {
        "languages": spark.createDataFrame(list(languages), "work_id string, language string"),
        "held": spark.createDataFrame([(h,) for h in held], "work_id string"),
        "edges": spark.createDataFrame(list(edges), "child string, parent string"),
    }


def all_pairs(attrs, languages=(), held=(), edges=(), k=8, o=Options()):
    attrs = {a for a in attrs if a[2]}
    works = {w for w, *_ in attrs}
    post = {}
    for w, rel, v in attrs:
        post.setdefault((rel, v), set()).add(w)
    most = max(2, math.floor(o.max_share * len(works)))
    weight = {key: o.weights.get(key[0], 1.0) / math.log2(len(ws) + 2) for key, ws in post.items() if len(ws) <= most}
    out = {}
    for w in works:
        asks = {(rel, v): 1.0 for x, rel, v in attrs if x == w}
        start = {v for rel, v in asks if rel == "subject"}
        near, step = {}, start
        for hop in range(1, o.depth + 1):
            step = {p for c, p in edges if c in step}
            for v in step:
                near[v] = max(near.get(v, 0), o.decay**hop)
        for c, p in edges:
            if p in start and o.depth:
                near[c] = max(near.get(c, 0), o.decay)
        for v, h in near.items():
            asks["subject", v] = max(asks.get(("subject", v), 0), h)
        score, shared = {}, {}
        for key, hop in asks.items():
            for other in post.get(key, ()) if key in weight else ():
                if other != w:
                    score[other] = score.get(other, 0) + weight[key] * hop
                    have = shared.setdefault(other, {})
                    have[key[1]] = max(have.get(key[1], 0), weight[key] * hop)
        mine = {x for y, x in languages if y == w}
        for other in score:
            score[other] = round(score[other] + o.language * bool(mine & {x for y, x in languages if y == other}) + o.held * (other in held), 6)
        best = sorted(score, key=lambda x: (-score[x], x))[:k]
        out[w] = [(x, score[x], sorted(shared[x], key=lambda v: (-shared[x][v], v))[:5]) for x in best]
    return {w: b for w, b in out.items() if b}


def found(df):
    out = {}
    for r in df.orderBy("rank").collect():
        out.setdefault(r.work_id, []).append((r.other_id, r.score, r.shared))
    return out


def close(got, want):
    assert got.keys() == want.keys()
    for w in want:
        assert [(x, s) for x, _, s in got[w]] == [(x, s) for x, _, s in want[w]], w
        assert [s for _, s, _ in got[w]] == pytest.approx([s for _, s, _ in want[w]], abs=2e-6)


@pytest.mark.parametrize("block_rows", [60, 100_000])
def test_same_as_all_pairs(spark, block_rows):
    r = random.Random(block_rows)
    works = [f"w{i}" for i in range(70)]
    attrs = list({(w, rel, f"{rel[0]}{r.randrange(n)}") for w in works for rel, n in (("series", 30), ("contributor", 25), ("tag", 9), ("subject", 14)) for _ in range(r.randint(0, 3))})
    attrs += [("w1", "tag", ""), ("w2", "tag", None)]
    edges = [(f"s{i}", f"s{(i * 3 + 1) % 14}") for i in range(14)] + [("s1", "top"), ("top", "s0")]
    more = {"languages": [(w, r.choice(["en", "de", ""])) for w in works if r.random() < 0.8], "held": r.sample(works, 20), "edges": edges}
    df, side = frames(spark, attrs, **more)
    close(found(similar_works(df, 4, block_rows=block_rows, explain=5, **side)), all_pairs([a for a in attrs if a[2]], [x for x in more["languages"] if x[1]], more["held"], edges, 4))


def test_series_outweighs_subject(spark):
    attrs = [("a", "series", "s"), ("b", "series", "s"), ("a", "subject", "x"), ("c", "subject", "x"), *[(f"z{i}", "tag", f"t{i}") for i in range(12)]]
    df, _ = frames(spark, attrs)
    assert [x for x, *_ in found(similar_works(df, explain=5))["a"]] == ["b", "c"]


def test_tree_hops_decay(spark):
    """Its own place, one hop up, two hops up, one hop down; three hops up is too far."""
    edges = [("x", "up"), ("up", "upper"), ("upper", "top"), ("below", "x")]
    attrs = [("a", "subject", "x"), *[(v, "subject", v) for v in ("up", "upper", "top", "below")], ("same", "subject", "x"), *[(f"z{i}", "tag", f"t{i}") for i in range(12)]]
    df, side = frames(spark, attrs, edges=edges)
    got = found(similar_works(df, edges=side["edges"], explain=5))["a"]
    assert [x for x, *_ in got] == ["same", "below", "up", "upper"] and got[1][1] == got[2][1] == pytest.approx(2 * got[3][1], abs=2e-6)


def test_language_is_no_edge(spark):
    attrs = [("a", "tag", "t"), ("b", "tag", "t"), ("c", "tag", "u"), *[(f"z{i}", "tag", f"t{i}") for i in range(12)]]
    df, side = frames(spark, attrs, languages=[("a", "en"), ("b", "en"), ("c", "en")])
    got = found(similar_works(df, languages=side["languages"], explain=5))
    assert [x for x, *_ in got["a"]] == ["b"] and got["a"][0][1] > 20 and "c" not in got


def test_common_values_and_ties(spark):
    """A value of over a fifth of the works counts nothing; equal scores go by id."""
    attrs = [(f"w{i}", "tag", "all") for i in range(20)] + [(f"w{i}", "tag", "few") for i in (3, 1, 2)]
    df, _ = frames(spark, attrs)
    got = found(similar_works(df, explain=5))
    assert got.keys() == {"w1", "w2", "w3"} and [x for x, *_ in got["w3"]] == ["w1", "w2"]


def test_empty(spark):
    df, side = frames(spark, [])
    assert similar_works(df, **side).collect() == []


def test_copies_are_one_class(spark, monkeypatch):
    """Works with equal attributes meet others as one; each has its own list, and ties go by id."""
    from folio_spark.operators import similarity

    seen, real = [], similarity.classes
    monkeypatch.setattr(similarity, "classes", lambda *a: seen.append(real(*a)) or seen[-1])
    kinds = [[("tag", "a"), ("tag", "b")], [("tag", "b"), ("contributor", "c")], [("contributor", "c"), ("tag", "a")], [("tag", "z")]]
    attrs = [(f"w{i:02}", rel, v) for i in range(40) for rel, v in kinds[i % 4]]
    languages, held = [(f"w{i:02}", "en") for i in range(0, 40, 4)], [f"w{i:02}" for i in range(1, 40, 8)]
    o = Options(max_share=0.9)
    rows, more = frames(spark, attrs, languages, held)
    del more["edges"]
    close(found(similar_works(rows, options=o, block_rows=4, explain=5, **more)), all_pairs(attrs, languages, held, o=o))
    members, reps = seen[0]
    assert (members.count(), reps.count()) == (40, 5)


@pytest.mark.parametrize("hits", [7, 250_000])
def test_blocks_meet_without_a_shuffle(spark, monkeypatch, hits):
    """Many blocks that share all their values, in several tasks: as all pairs, and the only exchange deals the blocks that ask."""
    from folio_spark.operators import lineage, similarity

    plans, save, best = [], lineage.Rounds.save, similarity.best_of_blocks
    monkeypatch.setattr(lineage.Rounds, "save", lambda self, df, **conf: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(self, df, **conf))
    monkeypatch.setattr(similarity, "best_of_blocks", lambda k, bonus, held: best(k, bonus, held, hits))
    r = random.Random(hits)
    works = [f"w{i:03}" for i in range(150)]
    attrs = list({(w, rel, f"{rel[0]}{r.randrange(n)}") for w in works for rel, n in (("contributor", 9), ("tag", 12), ("subject", 12)) for _ in range(r.randint(1, 3))})
    edges = [(f"s{i}", f"s{(i * 5 + 1) % 12}") for i in range(12)]
    languages, held = [(w, f"l{r.randrange(90)}") for w in works for _ in range(3)], r.sample(works, 50)
    df, side = frames(spark, attrs, languages, held, edges)
    close(found(similar_works(df, 4, block_rows=10, task_rows=300, explain=5, **side)), all_pairs(attrs, languages, held, edges, 4))
    meeting = [p for p in plans if "CartesianProduct" in p]
    assert len(meeting) == 1 and meeting[0].count("Exchange") == 1


def test_too_common_values_are_counted_exactly(spark):
    from folio_spark.operators.similarity import too_common

    attrs = [(f"w{i}", rel, v) for i in range(9) for rel, v in (("tag", "all"), ("subject", "all"), ("tag", f"t{i // 3}"), ("tag", f"u{i}"))] + [("w9", "tag", "all")]
    df = spark.createDataFrame(attrs, ATTRS)
    for most in (0, 1, 2, 3, 8, 9, 10):
        want = {k for k in {a[1:] for a in attrs} if sum(a[1:] == k for a in attrs) > most}
        assert {tuple(r) for r in too_common(df, most).collect()} == want

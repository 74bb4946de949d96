"""Seeds of test items: what of a text is looked up, and what an alignment is."""

import random

import numpy as np

from folio_spark.llm import decontaminate as D


def test_pairs_that_no_item_has_are_not_looked_up(monkeypatch):
    r = random.Random(3)
    items = [[f"x{r.randrange(2000)}" for _ in range(40)] for _ in range(20)]
    seeds, looked, search = D.Seeds(items), [], np.searchsorted
    monkeypatch.setattr(D.np, "searchsorted", lambda a, v, *rest: looked.append(len(v)) or search(a, v, *rest))
    text = r.choices(list(seeds.code), k=2000) + items[5]
    found = list(seeds.stretches(text))
    assert any(i == 5 for i, *_ in found) and sum(looked) < 400


def test_alignment_is_that_of_the_whole_table():
    r = random.Random(5)
    for _ in range(200):
        p, w = ([str(r.randrange(4)) for _ in range(r.randrange(n))] for n in (20, 12))
        h, best, end = np.zeros((len(w) + 1, len(p) + 1), dtype=int), 0, 0
        for i, x in enumerate(w, 1):
            for k, y in enumerate(p, 1):
                h[i, k] = max(0, h[i - 1, k - 1] + (2 if x == y else -1), h[i - 1, k] - 1, h[i, k - 1] - 1)
            if h[i].max() > best:
                best, end = int(h[i].max()), int(h[i].argmax())
        assert D.align(p, w) == (best, end)

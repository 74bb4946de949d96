"""Cross-tokenizer alignment against whole texts tokenized and aligned one by one."""

import collections
import hashlib
import itertools

import public_tokenizers
import pytest

from folio_spark.llm.alignment import Aligner, align, splitter, unsafe_before_space

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", "a  b ", "x▁ y z", "a▁", "\n  a\n b<|endoftext|></s><s> \x00 　 c\x1c d", "don't  'll  \t x 日本語 語 😀 é",
    "a " * 300 + "  z", "tab\there", "line\n\n  next", "x" * 5000, "no\xa0 break", "the cat\r\n the cat", "1 2 33  444", "... !!  ??", "  a b", "é e ́",
]


def brute(rows):
    """Whole texts, no segments."""
    whole, counts = Aligner(A, B), collections.Counter()

    def aligned(text):
        x, y = whole.a.encode(f" {text}", add_special_tokens=False).ids, whole.b.encode(text)
        parts = [whole.bytes_a[i] for i in x], [whole.bytes_b[i] for i in y]
        if any(b"".join(p) != f" {text}".encode() for p in parts):
            return False, 0, 0, "", [], []
        ends = [[sum(map(len, p[: k + 1])) for k in range(len(p))] if len(p) < 500 else list(itertools.accumulate(map(len, p))) for p in parts]
        both = sorted(set(ends[0]) & set(ends[1]))
        i, j = ([e.index(v) for v in both] for e in ends)
        groups = ";".join(",".join(map(str, x[p + 1 : k + 1])) + "|" + ",".join(map(str, y[q + 1 : m + 1])) for p, k, q, m in zip([-1, *i], i, [-1, *j], j, strict=False))
        return True, len(x), len(y), groups, [x[k] for k in i], [y[k] for k in j]

    found = [aligned(t) if t else (False, 0, 0, "", [], []) for _, t in rows]
    for f in found:
        counts.update(zip(f[4], f[5], strict=True))
    best = collections.defaultdict(int)
    for (_, b), c in counts.items():
        best[b] = max(best[b], c)
    out = []
    for (doc_id, _), (valid, n_a, n_b, groups, la, lb) in zip(rows, found, strict=True):
        pairs = list(zip(la, lb, strict=True))
        sums = (sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs))
        out.append((doc_id, n_a, n_b, len(la), len(pairs), *sums, hashlib.sha256(groups.encode()).hexdigest() if valid else ""))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("block_bytes", [1, 400, 4_000_000])
def test_same_as_whole_texts(spark, block_bytes):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "the cat sat"), (None, None), (3, "a"), (3, "a"), (90, "the cat sat on  the mat"), (91, "the▁cat sat on the mat")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block int, segment string")
    assert order(align(docs, block_bytes=block_bytes).collect()) == order(brute(rows))


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert order(align(docs).collect()) == order(brute([tuple(r) for r in docs.collect()]))


def test_empty_table(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_segments_give_the_text_back():
    split = splitter(unsafe_before_space(A, B))
    for t in ODD[1:]:
        assert "".join(f" {s}" for s in split(t)) == f" {t}"


def test_unsafe_characters_are_not_split_behind():
    assert splitter(")")("a) b c") == ["a) b", "c"]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        unsafe_before_space(public_tokenizers.path("word_bpe_49k.json"), B)

"""Cross-tokenizer alignment: distinct segments are tokenized and aligned once, their alignments joined back, documents composed of them."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MARK = "▁"  # the second vocabulary's sign for a space
SPLIT = "block long, doc_id long, seq binary, idx int, segment string, n long"
KNOWN = "block long, idx int, code binary, a int, b int, c long"
PAIRS = "a int, b int, c long"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
# Signs in the code of a segment, a row of numbers: its groups are a,a BAR b,b and lie between SEMIs. In 16 bits their low halves stand for them.
BAR, SEMI = (1 << 32) - 1, (1 << 32) - 2
NARROW, WIDE = "<u2", "<u4"


def unsafe_before_space(path_a: str, path_b: str) -> str:
    """The characters behind which a text must not be split before a space, as the two vocabularies tell; an error if they don't tell it.

    First vocabulary: its pre-tokenizer is the byte-level pattern, in which no
    alternative takes white space behind anything else, and nothing rewrites the
    text before. Second: merges only ever make pieces of its vocabulary, so none
    crosses from x to a space unless a piece has x before a space within.
    """
    with open(path_a, encoding="utf-8") as f:
        a = json.load(f)
    pre = a.get("pre_tokenizer") or {}
    if a.get("normalizer") or a.get("post_processor") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
        raise ValueError(f"no byte-level vocabulary that splits before white space: {path_a}")
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(path_b, "rb") as f:
        spec.ParseFromString(f.read())
    rules = spec.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix or spec.trainer_spec.model_type != 2:
        raise ValueError(f"no vocabulary of merges over unchanged text: {path_b}")
    b = SentencePieceProcessor(model_file=path_b)
    if b.is_unknown(b.piece_to_id(MARK)):
        raise ValueError(f"no piece for a space alone: {path_b}")
    return "".join(sorted({x for p in spec.pieces for x, y in zip(p.piece, p.piece[1:], strict=False) if y == MARK and x != MARK}))


def splitter(unsafe: str) -> Callable[[str], list[str]]:
    """text -> the segments of a space and the text, each without the space that it begins with."""
    odd = re.compile(rf"[\s{re.escape(unsafe)}] ")
    cut = re.compile(rf"(?<=[^\s{re.escape(unsafe)}])(?= )")

    def split(text: str) -> list[str]:
        if text[:1] != " " and odd.search(text) is None:
            return text.split(" ")
        return [s[1:] for s in cut.split(f" {text}")]

    return split


def batch(schema: str, **columns) -> pa.RecordBatch:
    """A batch of the schema; columns that aren't given are null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    size = len(next(iter(columns.values())))
    named = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[t]) if n in columns else pa.nulls(size, kinds[t]) for n, t in named], names=[n for n, _ in named])


def pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers in few bytes: their four bytes apart, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def split_documents(docs: DataFrame, unsafe: str, block_bytes: int) -> DataFrame:
    """SPLIT rows: of each document its segments by number, of each block of documents its distinct segments and their counts.

    A block is a run of one task's documents; a segment, however frequent, leaves
    its task once a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, base, blocks = splitter(unsafe), TaskContext.get().partitionId() << 32, 0
        known: dict[str, int] = {}
        ids: list[int | None] = []
        seqs: list[bytes] = []
        counts = np.zeros(1 << 16, dtype=np.int64)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal blocks, size
            block = base + blocks
            for at in range(0, len(ids), 1024):
                part = seqs[at : at + 1024]
                yield batch(SPLIT, block=[block] * len(part), doc_id=ids[at : at + 1024], seq=part)
            texts = list(known)
            for at in range(0, len(texts), 8192):
                part = texts[at : at + 8192]
                yield batch(SPLIT, block=[block] * len(part), idx=np.arange(at, at + len(part), dtype=np.int32), segment=part, n=counts[at : at + len(part)])
            blocks += 1
            size = 0
            counts[:] = 0
            known.clear(), ids.clear(), seqs.clear()

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                t = text.as_py() or ""
                ids.append(doc_id.as_py())
                s = np.array([known.setdefault(x, len(known)) for x in split(t)] if t else [], dtype=np.int64)
                if len(known) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(known), dtype=np.int64)])
                np.add.at(counts, s, 1)
                seqs.append(pack(s))
                size += len(t) + 64
                if size >= block_bytes:
                    yield from flush()
        if ids:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPLIT)


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Aligner:
    """Tokenizes segments with both vocabularies and cuts their tokens into groups at common byte offsets."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        values = byte_values()
        size = self.a.get_vocab_size(with_added_tokens=False)
        self.bytes_a = [bytes(values.get(c, 0) for c in self.a.id_to_token(i)) for i in range(size)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(MARK)
        self.kind = NARROW if max(len(self.bytes_a), len(self.bytes_b)) < 0xFFFE else WIDE

    def __call__(self, segments: list[str]) -> list[list[int] | None]:
        """The code of each segment (given without the space that it begins with); None if a vocabulary doesn't give it back."""
        left = self.a.encode_batch_fast([f" {s}" for s in segments], add_special_tokens=False)
        right = self.b.encode(segments, num_threads=1)
        bytes_a, bytes_b = self.bytes_a, self.bytes_b
        out = []
        for s, e, y in zip(segments, left, right, strict=True):
            x, whole = e.ids, f" {s}".encode()
            y = y if s else [self.space]  # an empty text gets no space of its own there
            parts_a, parts_b = [bytes_a[i] for i in x], [bytes_b[i] for i in y]
            if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
                out.append(None)
                continue
            code, p, u, v, at, j = [], 0, 0, 0, 0, 0
            for i, t in enumerate(parts_a, 1):
                u += len(t)
                while v < u:
                    v += len(parts_b[j])
                    j += 1
                if u == v:
                    code += [SEMI, *x[p:i], BAR, *y[at:j]] if p else [*x[:i], BAR, *y[:j]]
                    p, at = i, j
            out.append(code)
        return out


class Codes:
    """The codes of segments as one array, and what follows from them a segment; codes of no length are invalid."""

    def __init__(self, codes: pa.Array, kind: str):
        codes = codes.cast(pa.large_binary())
        offsets = np.frombuffer(codes.buffers()[1], dtype=np.int64)[codes.offset : codes.offset + len(codes) + 1] if len(codes) else np.zeros(1, dtype=np.int64)
        data, size = codes.buffers()[2], np.dtype(kind).itemsize
        raw = np.frombuffer(data, dtype=kind)[offsets[0] // size : offsets[-1] // size] if data is not None and offsets[-1] else np.zeros(0, dtype=kind)
        x = raw.astype(np.uint32)
        for sign in (BAR, SEMI):
            x[raw == sign & (256**size - 1)] = sign
        self.x, self.at = x, (offsets - offsets[0]) // size
        lengths = np.diff(self.at)
        self.valid = lengths > 0
        ends = np.zeros(len(x), dtype=bool)
        ends[self.at[1:][self.valid] - 1] = True
        self.bar, semi = x == BAR, x == SEMI
        self.is_id, self.last = x < SEMI, ends | np.append(semi[1:], False)
        # Behind the bar of its group, an id is of the second vocabulary.
        second = np.cumsum(self.bar) - np.cumsum(semi) - np.repeat(np.arange(int(self.valid.sum())), lengths[self.valid]) == 1
        self.goes_on = self.is_id & ~np.append(self.bar[1:], False) & ~self.last
        self.a, self.b = x[np.flatnonzero(self.bar) - 1].astype(np.int64), x[self.last].astype(np.int64)
        self.n_a, self.n_b, self.n_groups = (self.sums(v) for v in (self.is_id & ~second, self.is_id & second, self.bar))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of each segment the sum of values, one for each number of its code."""
        return self.over(values, self.at[:-1][self.valid])

    def over(self, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.valid), dtype=np.int64)
        if len(starts):
            out[self.valid] = np.add.reduceat(values.astype(np.int64), starts)
        return out

    def over_links(self, values: np.ndarray) -> np.ndarray:
        """Of each segment the sum of values, one for each link."""
        n = self.n_groups[self.valid]
        return self.over(values, np.cumsum(n) - n)

    def texts(self, most: int = 16_384) -> list[str]:
        """Of each segment its groups as text; `most` segments at a time."""
        ids = self.x[self.is_id]
        names = [str(i) for i in range(int(ids.max()) + 1 if len(ids) else 0)]
        before = [f"{n}," for n in names]  # an id that others of its part follow
        signs, out = {BAR: "|", SEMI: ";"}, []
        for k in range(0, len(self.valid), most):
            at = self.at[k : k + most + 1]
            x, more = self.x[at[0] : at[-1]].tolist(), self.goes_on[at[0] : at[-1]].tolist()
            parts = [before[v] if m else signs.get(v) or names[v] for v, m in zip(x, more, strict=True)]
            ends = (at - at[0]).tolist()
            out += ["".join(parts[i:j]) for i, j in zip(ends, ends[1:], strict=False)]
        return out


def pair_counts(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (a << 32 | b) and their summed weights."""
    keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([w for _, w in held]), minlength=len(keys)).astype(np.int64)


def weighted(codes: Codes, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return codes.a << 32 | codes.b, np.repeat(n, codes.n_groups)


def align_segments(segments: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """KNOWN rows: each row (segment, n, block, idx) with the code of its segment, and how often each pair of ids is linked.

    Rows of a segment come one after another, so that it is tokenized once and its
    code joined to all of them as they stream by. A task's pair counts are no more
    than the vocabularies allow: of two tokens that end together one ends the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, last, code = Aligner(path_a, path_b), None, None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            texts = b.column(0).to_pylist()
            new = [t for t, before in zip(texts, [last, *texts], strict=False) if t != before]
            fresh = iter(align(new))
            codes = []
            for t in texts:
                if t != last:
                    found = next(fresh)
                    last, code = t, None if found is None else np.array(found, dtype="<u4").astype(align.kind).tobytes()
                codes.append(code)
            held.append(weighted(Codes(pa.array(codes, pa.binary()), align.kind), b.column(1).to_numpy()))
            if len(held) >= 64:
                held = [pair_counts(held)]
            yield batch(KNOWN, block=b.column(2), idx=b.column(3), code=codes)
        if held:
            keys, counts = pair_counts(held)
            yield batch(KNOWN, a=(keys >> 32).astype(np.int32), b=(keys & BAR).astype(np.int32), c=counts)

    return segments.select("segment", "n", "block", "idx").repartition("segment").sortWithinPartitions("segment").mapInArrow(run, KNOWN)


def of_lost(scratch: Scratch, whole: DataFrame, known: DataFrame, kind: str) -> DataFrame | None:
    """PAIRS rows: the links, taken off, of documents with a segment that isn't given back; None if there is none.

    Such segments are rare. They are saved by themselves, so that the joins know
    their size: where it is small, neither documents nor segments are shuffled.
    """
    saved = lambda df, name: df.sparkSession.read.schema(scratch.save(df, name).schema).parquet(f"{scratch.root}/{name}")
    bad = saved(known.where("code is null").groupBy("block").agg(F.collect_set("idx").alias("bad")), "bad")
    if bad.isEmpty():
        return None

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, seq, ids in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                idx, k = np.unique(unpack(seq), return_counts=True)
                if np.isin(idx, ids).any():
                    yield batch("block long, idx int, k long", block=[block] * len(idx), idx=idx.astype(np.int32), k=k)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, counts = pair_counts([weighted(Codes(b.column(0), kind), b.column(1).to_numpy())])
            yield batch(PAIRS, a=(keys >> 32).astype(np.int32), b=(keys & BAR).astype(np.int32), c=-counts)

    lost = whole.join(bad, "block").select("block", "seq", "bad").mapInArrow(segments, "block long, idx int, k long")
    lost = saved(lost.groupBy("block", "idx").agg(F.sum("k").alias("k")), "lost")
    return known.join(lost, ["block", "idx"]).select("code", "k").mapInArrow(links, PAIRS)


def composer(pairs: list, kind: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(documents, known segments) of a block -> RESULT rows; pairs: rows (a, b, c)."""
    keys = np.array([r["a"] << 32 | r["b"] for r in pairs], dtype=np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], np.array([r["c"] for r in pairs], dtype=np.int64)[order]
    most = np.zeros(int((keys & BAR).max()) + 1 if len(keys) else 1, dtype=np.int64)
    np.maximum.at(most, keys & BAR, counts)
    best = counts == most[keys & BAR]

    def compose(docs: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known.column("idx").to_numpy())
        codes = Codes(known.column("code").combine_chunks().take(pa.array(order)) if len(order) else pa.array([], pa.binary()), kind)
        # A pair that only documents without tokens have isn't there; whatever stands in its place is never summed.
        at = np.minimum(np.searchsorted(keys, codes.a << 32 | codes.b), max(0, len(keys) - 1))
        c, b = (counts[at], best[at]) if len(keys) else (np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=bool))
        sums = np.stack([codes.n_a, codes.n_b, codes.n_groups, codes.n_groups, codes.over_links(b), codes.over_links(c)])
        texts, columns = codes.texts(), [c.split()[0] for c in RESULT.split(", ")]
        rows = []
        for doc_id, packed in zip(docs.column("doc_id").to_pylist(), docs.column("seq").to_pylist(), strict=True):
            s = unpack(packed)
            if len(s) and codes.valid[s].all():
                rows.append((doc_id, *sums[:, s].sum(axis=1).tolist(), hashlib.sha256(";".join([texts[k] for k in s.tolist()]).encode()).hexdigest()))
            else:
                rows.append((doc_id, *[0] * len(sums), ""))
        return pa.Table.from_batches([batch(RESULT, **dict(zip(columns, zip(*rows, strict=True) if rows else [[]] * len(columns), strict=True)))])

    return compose


def align_documents(docs: DataFrame, path_a: str, path_b: str, *, block_bytes: int = 16_000_000) -> DataFrame:
    """RESULT rows, one for each document: its tokens under two vocabularies, aligned at common byte offsets.

    path_a: a byte-level vocabulary, given a space and the text; path_b: a
    vocabulary of merges with byte fallback, which adds the space itself. Neither
    sees special tokens in a text. Texts are split before spaces where neither
    vocabulary can merge across (unsafe_before_space()), so a document's tokens
    and groups are those of its segments in a row. A distinct segment is
    tokenized and aligned once; blocks of about block_bytes of text bring their
    distinct segments and get the alignments back, and documents are composed
    block by block.

    A link is a pair of tokens that end together; a pair of ids counts as often
    as links hold it in all documents. Of two such tokens one ends the other, so
    the vocabularies bound the pairs, whatever the corpus: they go to all tasks.
    n_best: links whose pair is the commonest of its second id (ties included);
    count_sum: the sum of the counts over links.

    Null or empty text, or one that a vocabulary doesn't give back byte by byte
    (as those with U+2581): zeros and '', and no part in any count. Null doc_id:
    kept as null. Repeated rows: one result each, each counted. Long texts: whole,
    a block of their own at most. Empty table: no rows. Other columns are ignored.
    """
    unsafe, kind = unsafe_before_space(path_a, path_b), Aligner(path_a, path_b).kind
    scratch = Scratch(docs.sparkSession, "alignment")
    split = scratch.save(split_documents(docs, unsafe, block_bytes), "split", compression="zstd")
    read = lambda name, schema: docs.sparkSession.read.schema(schema).parquet(f"{scratch.root}/{name}")
    known = scratch.save(align_segments(split.where("idx is not null"), path_a, path_b), "known", compression="zstd")
    whole = read("split", split.schema).where("seq is not null").select("block", "doc_id", "seq")
    codes = read("known", known.schema).where("idx is not null").select("block", "idx", "code")
    pairs, lost = known.where("a is not null").select("a", "b", "c"), of_lost(scratch, whole, codes, kind)
    pairs = pairs if lost is None else pairs.unionByName(lost)
    counts = pairs.groupBy("a", "b").agg(F.sum("c").alias("c")).where("c > 0").collect()  # bounded by the vocabularies
    return whole.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(composer(counts, kind), RESULT)


def align(docs: DataFrame, name_a: str = "byte_bpe_50k.json", name_b: str = "piece_bpe_32k.model", **options) -> DataFrame:
    """align_documents() with vocabularies of the installed public tokenizers."""
    import public_tokenizers

    return align_documents(docs, public_tokenizers.path(name_a), public_tokenizers.path(name_b), **options)

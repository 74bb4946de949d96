"""Packing: documents cut and assigned to sequences of balanced attention cost."""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END_OF_TEXT = "<|endoftext|>"


def tokenizer(path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """text -> ids (uint32) and a 0 behind them, under the byte-level vocabulary of ranks at `path`.

    The same ids as the tokenizer that the vocabulary belongs to; the special
    token's string gives its id, which is the first behind the ranks.
    """
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})

    def ids(text: str) -> np.ndarray:
        found = own.encode(text, allowed_special="all") if END_OF_TEXT in text else own.encode_ordinary(text)
        return np.frombuffer(array("I", [*found, 0]), dtype=np.uint32)

    return ids


def assign(lengths: list[int], capacity: list[int], linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """(document, start, length, sequence): descending documents, each to the cheapest sequence with room for it.

    A document that fits nowhere is cut over the sequences with the most room.
    The capacities add up to the lengths at least.
    """
    room, cost = np.array(capacity), np.zeros(len(capacity))
    out = []
    for d in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        start, left = 0, lengths[d]
        while left:
            fits = room >= left
            s = int(np.where(fits, cost, np.inf).argmin()) if fits.any() else int(room.argmax())
            n = min(left, int(room[s]))
            out.append((d, start, n, s))
            room[s] -= n
            cost[s] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return out


def pack_group(lengths: list[int], limit: int, linear: float = 1.0, quadratic: float = 1 / 512) -> tuple[list[tuple[int, int, int, int]], int]:
    """(pieces, number of sequences) of a group of documents.

    Whole sequences are cut off long documents. What is left over fills whole
    sequences, and at the end sequences of powers of two: none needs padding.
    """
    out, rest, n = [], [], 0
    for d, k in enumerate(lengths):
        whole = k // limit
        out += [(d, i * limit, limit, n + i) for i in range(whole)]
        n += whole
        rest.append(k - whole * limit)
    total = sum(rest)
    capacity = [limit] * (total // limit) + [1 << b for b in range(limit.bit_length(), -1, -1) if (total % limit) >> b & 1]
    if total:
        out += [(d, lengths[d] - rest[d] + start, k, n + s) for d, start, k, s in assign(rest, capacity, linear, quadratic)]
    return out, n + len(capacity)


def pack(docs: DataFrame, vocabulary: str, pattern: str, *, limit: int = 1024, group_tokens: int = 1 << 20, linear: float = 1.0, quadratic: float = 1 / 512) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; limit is a power of two.

    Each task tokenizes its rows (whole texts, then id 0) and packs them in
    groups of group_tokens, so ids never leave the task and nothing is shuffled.
    The cost of a piece is linear * n + quadratic * n^2 (token layers, attention);
    documents in descending order go to the sequence of lowest cost with room.
    sequence_id is the input partition << 32 plus a counter: a task that runs
    again on the same partition gives the same result.

    Null or empty text: one token, the id 0. Null doc_id: kept as null. Repeated
    rows: packed like others. Long texts are cut. Empty table: no rows. Other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = tokenizer(vocabulary, pattern), TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        size = done = 0

        def flush() -> pa.RecordBatch:
            nonlocal done, size
            pieces, n = pack_group([len(x) for x in ids], limit, linear, quadratic)
            pieces.sort(key=lambda p: (p[3], p[0], p[1]))
            rows, at = [], {}
            for d, start, k, s in pieces:
                rows.append((names[d], start, k, zlib.crc32(ids[d][start : start + k].tobytes()), len(ids[d]), base + done + s, at.get(s, 0)))
                at[s] = at.get(s, 0) + k
            done += n
            ids.clear(), names.clear()
            size = 0
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            return pa.RecordBatch.from_pandas(out, preserve_index=False)

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                t = encode(text.as_py() or "")
                ids.append(t), names.append(doc_id.as_py())
                size += len(t)
                if size >= group_tokens:
                    yield flush()
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def pack_documents(docs: DataFrame, name: str = "byte_bpe_50k", **options) -> DataFrame:
    """pack() with a vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN, **options)

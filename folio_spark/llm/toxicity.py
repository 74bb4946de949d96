"""Toxicity by compression distance: two zstandard dictionaries, window lengths, calibrated thresholds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, score double, predicted int, n_windows int, n_hits int"


def windows(text: str, size: int) -> list[bytes]:
    """Consecutive windows of `size` lower-cased words; the last may be shorter.

    A word's bytes are shifted by their place in it (up to the 16th), so a match
    starts where a word does: the same letters further inside a word are others.
    """
    raw = np.frombuffer("".join(f" {w}" for w in text.lower().split()).encode("utf-8", "replace"), dtype=np.uint8)
    starts = np.flatnonzero(raw == 32)
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    shifted = (raw + 37 * np.minimum(place, 15)).astype(np.uint8).tobytes()
    cuts = [*starts[::size].tolist(), len(raw)]
    return [shifted[i:j] for i, j in zip(cuts, cuts[1:])]


def coder(first: bytes, ordinary: bytes) -> zstandard.ZstdCompressor:
    """Compresses with the content of both: what `ordinary` holds is equally far away whatever `first` is."""
    d = zstandard.ZstdCompressionDict(first + ordinary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    # Matches of 5 bytes at least: shorter ones are chance.
    params = zstandard.ZstdCompressionParameters.from_level(6, min_match=5, write_content_size=False, write_checksum=False, write_dict_id=False)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


def coders(model: dict) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    """(toxic, plain): the toxic dictionary stands where the plain one has as many bytes that match nothing."""
    return coder(model["toxic"], model["plain"]), coder(b"\0" * len(model["toxic"]), model["plain"])


def gains(parts: list[bytes], toxic: zstandard.ZstdCompressor, plain: zstandard.ZstdCompressor) -> np.ndarray:
    """By how many bytes the toxic dictionary codes each window shorter than the ordinary one."""
    t, p = toxic.compress, plain.compress
    return np.array([len(p(x)) - len(t(x)) for x in parts], dtype=np.int32)


def features(gain: np.ndarray, hit: int) -> np.ndarray:
    """Of a document: its hits (windows that gain at least `hit`) as a log count and a share, its best gain, its mean gain."""
    if not len(gain):
        return np.zeros(4)
    hits = (gain >= hit).sum()
    return np.array([np.log1p(hits), min(1.0, hits / len(gain)) * 10, gain.max() / 4, gain.mean()])


def dictionary(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary that zstandard trains on the samples, of `size` bytes at most.

    Training needs several samples and more bytes than it keeps; where there are
    too few, the size is halved, and at last the samples stand for themselves.
    """
    samples = [x for x in samples if x]
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()[-size:]
        except zstandard.ZstdError:
            size //= 2
    return b"".join(dict.fromkeys(samples))[-4096:] or b" "


def residue(texts: list[str], other: list[str], ratio: float = 10.0, least: int = 3) -> list[str]:
    """What is left of each text without the words that other texts use as well.

    Uses of a word are counted by the distinct words before it, so that what
    copies repeat, whole or edited, counts once, and only the first use stays. A
    word stays if it has `least` uses and `ratio` times as large a share of all
    uses as in the other texts. The training decides what is worth a place.
    """

    def uses(side: list[str]) -> tuple[list[list[str]], Counter]:
        seen: set[tuple[str, str]] = set()
        out = []
        for t in dict.fromkeys(side):
            w = [x.strip(".,;:!?") for x in t.lower().split()]
            new = [p for p in dict.fromkeys(zip(["", *w], w)) if p[1] and p not in seen]
            seen.update(new)
            out.append([x for _, x in new])
        return out, Counter(x for _, x in seen)

    (mine, here), (_, there) = uses(texts), uses(other)
    share = ratio * sum(here.values()) / max(1, sum(there.values()))
    return [" ".join(w for w in t if here[w] >= least and here[w] >= share * there[w]) for t in mine]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Newton's method on standardised features; the result applies to raw features plus a constant.

    No weight is negative, as more gain never speaks for an ordinary text:
    features that would get one are left out, and the rest is fit again.
    """
    mean, sd = x.mean(0), x.std(0) + 1e-9
    keep = list(range(x.shape[1]))
    penalty = ridge * len(x) ** 0.5
    while True:
        z = np.c_[((x - mean) / sd)[:, keep], np.ones(len(x))]
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([penalty] * len(keep) + [1e-6])
            step = np.linalg.solve(h, z.T @ (p - y) + np.r_[w[:-1] * penalty, 0])
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        if not len(keep) or w[:-1].min() >= 0:
            break
        keep = [k for k, v in zip(keep, w[:-1], strict=True) if v > 0]
    full = np.zeros(x.shape[1])
    full[keep] = w[:-1] / sd[keep]
    return np.r_[full, w[-1] - (full * mean).sum()]


def fit(texts: list[str], toxic: list[int], size: int, dict_size: int) -> dict:
    """The model: two dictionaries, the hit threshold, the calibrated weights. Deterministic in its input."""
    y = np.array(toxic, dtype=float)
    if not len(y) or y.min() == y.max():  # nothing to tell apart: the base rate for all
        rate = float(y.mean()) if len(y) else 0.0
        return {"toxic": b" ", "plain": b" ", "hit": 1 << 20, "weights": [0.0] * 4 + [float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))], "size": size}
    # Dictionaries are trained on one half of the labelled documents, thresholds on the other half, so that lengths of unseen text calibrate them.
    half = np.arange(len(y)) % 2 == 0
    if len(set(y[half])) < 2:
        half[:] = True
    of = lambda k: [t or "" for t, z, h in zip(texts, y, half, strict=True) if h and z == k]
    ordinary, marked = of(0), of(1)
    # Most of a toxic document is ordinary, so its dictionary is trained on what ordinary text doesn't share with it.
    rest = residue(marked, ordinary)
    foreign = {w for t in rest for w in t.split()}
    usual = [" ".join(w for w in t.lower().split() if w.strip(".,;:!?") not in foreign) for t in ordinary]
    plain = dictionary([w for t in usual for w in windows(t, size)], dict_size)
    samples = [w for t in rest for w in windows(t, 3)]
    held = ~half if (~half).any() and len(set(y[~half])) == 2 else half
    parts, yh = [windows(t or "", size) for t, h in zip(texts, held, strict=True) if h], y[held]
    best = None
    for part in (64, 32, 16):  # a large dictionary takes in what a few texts repeat; lengths of unseen text tell how much is too much
        model = {"toxic": dictionary(samples, dict_size // part), "plain": plain, "size": size}
        ct, cp = coders(model)
        g = [gains(w, ct, cp) for w in parts]
        for hit in range(1, 25):  # the threshold whose calibrated scores explain the labels best
            x = np.array([features(v, hit) for v in g])
            w = logistic(x, yh)
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            loss = -(yh * np.log(p + 1e-9) + (1 - yh) * np.log(1 - p + 1e-9)).mean()
            if best is None or loss < best[0] - 1e-12:
                best = (loss, model | {"hit": hit, "weights": [float(v) for v in w]})
    return best[1]


def score_documents(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted, n_windows, n_hits) of every row, from its whole text and nothing else."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, plain = coders(model)
        w = np.array(model["weights"])
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                g = gains(windows(text or "", model["size"]), toxic, plain)
                x = features(g, model["hit"])
                s = float(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))
                rows.append((doc_id, s, int(s >= threshold), len(g), int((g >= model["hit"]).sum())))
            yield pd.DataFrame(rows, columns=["doc_id", "score", "predicted", "n_windows", "n_hits"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, *, window: int = 12, dict_size: int = 32_768, max_toxic: int = 1500, max_plain: int = 3000, max_chars: int = 8_000, threshold: float = 0.3) -> DataFrame:
    """Scores every whole text; learns from labelled rows that aren't held out (crc32(doc_id) mod 4 = 2 is held out).

    The model is fit on a bounded sample of labelled rows: at most max_toxic
    toxic and max_plain ordinary ones (those with the smallest hash of doc_id),
    of at most max_chars each from a place that the hash chooses; scoring has no
    bounds. Windows of `window` words are compressed with a dictionary that
    zstandard trains on what toxic windows don't share with ordinary text, and
    with one it trains on ordinary windows; windows that get shorter by a
    calibrated threshold are hits, and a logistic calibration of hits and gains
    gives the score.

    Null or empty text: no windows, the score of a text without hits. Very long
    texts: all windows. Null doc_id: kept, not held out. Repeated rows: scored
    alike; repeated labels: toxic if one is. Ties of the sample's order: by
    doc_id. No usable labels: the base rate (0 without labels) for all. Empty
    table: no rows. Columns of docs other than doc_id and text are ignored,
    whatever their names.
    """
    docs = docs.select("doc_id", "text")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    known = labels.where("toxic is not null and doc_id is not null").where(~held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda k, n: known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = pick(1, max_toxic).unionAll(pick(0, max_plain))
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - max_chars + 1, F.lit(1))).cast("int")
    rows = docs.where("doc_id is not null").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", F.substr("text", place + 1, F.lit(max_chars)).alias("text"))
    found = sorted({(r["doc_id"], r["toxic"], r["text"] or "") for r in rows.dropDuplicates(["doc_id"]).collect()})
    model = fit([t for _, _, t in found], [y for _, y, _ in found], window, dict_size)
    out = score_documents(docs, model, threshold)
    return out.withColumn("held_out", F.coalesce(held, F.lit(False)))

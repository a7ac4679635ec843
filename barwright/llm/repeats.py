"""Exact removal of long repeated passages by run-length indexes (operator 3).

Every byte that a string of ``length`` bytes covers goes, if the string also
starts in a document with a lower id.  So that no task needs the whole
corpus, each string of that length is dealt out by its minimizer: of the
shorter strings inside it the one with the lowest hash.  Equal strings have
equal minimizers, so comparing within a minimizer's bucket loses nothing.
Documents lie in chunks and minimizers in buckets, both of some megabytes
at any size of the corpus:

1. chunks send the minimizers they have to the buckets, each once;
2. buckets answer which ones more than one document has;
3. chunks send the stretches of text around those, each different one once
   with its lowest document (copies within the chunk are settled by that);
4. buckets index the different stretches that share a minimizer as a
   run-compressed Burrows-Wheeler transform with a sampled position a run, and
   follow those that aren't the lowest document's through it, which marks each
   place where a lower document has ``length`` bytes;
5. chunks cut out what is covered.

Stretches are told apart by 128 bits of hashes, strings by their bytes.  A
stretch is at most two strings long, and a passage that very many documents
share is one stretch of each chunk, however often it occurs there.

Null texts are empty; texts shorter than a string are unchanged.  Ids that
are equal aren't lower than each other, and a null id counts as higher than
all others.  Repeated rows are treated alike.  A very long text is one row of
its chunk and hashed a slab at a time.  Empty tables give empty tables.  Only
doc_id and text are read; other columns can't clash.  Ids must be integers;
strings may have any length from 16 bytes up, also longer than all texts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .run_index import RunIndex

#: Text bytes behind one chunk of documents and one bucket of minimizers.
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
_SLAB = 1 << 20
_LAST = np.iinfo(np.int64).max
_B, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_POS = np.uint64((1 << 28) - 1)


def _gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """Mixed polynomial hash of every k bytes, put together from powers of two."""
    size, part, power, out, out_size = 1, x.astype(np.uint64) + np.uint64(1), _B, None, 0
    while True:
        if k & size:
            if out is None:
                out, out_size = part, size
            else:  # the part comes after what is there already
                m = len(x) - out_size - size + 1
                out = out[:m] * power + part[out_size : out_size + m]
                out_size += size
        if size * 2 > k:
            break
        m = len(x) - 2 * size + 1
        part = part[:m] * power + part[size : size + m]
        size, power = size * 2, power * power
    h = (out ^ (out >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _window_min(key: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        key, size = np.minimum(key[: len(key) - size], key[size:]), size * 2
    rest = w - size
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


def _stretch_hashes(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of x[start:end], by sums up to each byte."""
    n = len(x)
    up = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, _B)))
    down = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, _INVERSE)))
    sums = np.append(np.uint64(0), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * down[:-1]))
    return (sums[end] - sums[start]) * up[start]


def minimizers(texts: list[bytes], length: int, k: int):
    """Yields slabs: (first text, bytes, hashes, first start, last start, text number), a row for each stretch of strings with one minimizer."""
    at = 0
    while at < len(texts):
        to, total = at, 0
        while to < len(texts) and (to == at or total + len(texts[to]) <= _SLAB):
            total += len(texts[to])
            to += 1
        sizes = np.array([len(t) for t in texts[at:to]], np.int64)
        x = np.frombuffer(b"".join(texts[at:to]), np.uint8)
        if len(x) >= length:
            with np.errstate(over="ignore"):
                h = _gram_hashes(x, k)
            low = _window_min((h & ~_POS) | np.arange(len(h), dtype=np.uint64), length - k + 1)
            owner = (low & _POS).astype(np.int64)
            text = np.repeat(np.arange(len(sizes)), sizes)[: len(owner)]
            start = np.arange(len(owner))
            inside = start + length <= np.cumsum(sizes)[text]
            begin = inside & np.append(True, (owner[1:] != owner[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1])
            s0 = np.flatnonzero(begin)
            end = inside & np.append(begin[1:] | ~inside[1:], True)
            s1 = np.flatnonzero(end)
            yield at, x, h[owner[s0]], s0, s1, text[s0] + at
        at = to


def _split(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32 further bits of each hash."""
    return (hashes % np.uint64(buckets)).astype(np.int64), ((hashes // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _chunk(b: pd.DataFrame) -> tuple[pd.DataFrame, list[bytes]]:
    """The chunk's rows in a fixed order, so that a row's number means the same in every step."""
    b = b.assign(text=[t if t is not None else b"" for t in b["text"]], order=b["doc_id"].astype("Int64").fillna(_LAST).astype("int64"))
    b = b.sort_values(["order", "text"], ignore_index=True)
    return b, b["text"].tolist()


def _by_bucket(bucket: np.ndarray, *columns: np.ndarray):
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for a, z in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
        yield int(bucket[a]), order[a:z], [c[order[a:z]] for c in columns]


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _stretches(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return x[at].tobytes()


def _firsts(keys: np.ndarray, hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches: order by (key, hash), where a different one begins in it, and each different one's lowest id."""
    order = np.lexsort((hashes, keys))
    k, h = keys[order], hashes[order]
    begin = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (h[1:] != h[:-1]))) if len(k) else np.zeros(0, np.int64)
    return order, begin, np.minimum.reduceat(ids[order], begin) if len(k) else ids[:0]


def _covered(keys: np.ndarray, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's stretches: number, first and last covered start (relative) of each covered run."""
    order, begin, low = _firsts(keys, hashes, ids)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(order)))
    later = np.flatnonzero(ids > low[kind])  # a lower document has the whole stretch
    out_n, out_a, out_b = [later], [np.zeros(len(later), np.int64)], [sizes[later] - length]
    # A kind that is alone with its minimizer has no other to share strings with.
    group = keys[order[begin]]
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    times = np.diff(starts, append=len(group))
    lowest = np.repeat(np.minimum.reduceat(low, starts), times)
    among = np.flatnonzero(np.repeat(times, times) > 1)
    if not len(among):
        return later, out_a[0], out_b[0]
    one = order[begin[among]]  # a stretch of each kind
    # All kinds, each with a zero byte behind it; zero bytes inside are moved to one that UTF-8 never has.
    size = sizes[one] + 1
    to = np.cumsum(size)
    text = np.zeros(to[-1], np.uint8)
    inside = np.ones(len(text), bool)
    inside[to - 1] = False
    first = np.cumsum(sizes) - sizes
    piece = data[np.repeat(first[one] - (np.cumsum(sizes[one]) - sizes[one]), sizes[one]) + np.arange(sizes[one].sum())]
    text[inside] = np.where(piece == 0, np.uint8(255), piece)
    index = RunIndex(text, size, low[among], length)
    ask = np.flatnonzero(low[among] > lowest[among])  # nothing covers the lowest document's own
    hit = index.stream(ask)
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    which, a = np.nonzero(edge == 1)
    b = np.nonzero(edge == -1)[1] - 1
    # They hold for the stretch in all chunks where its lowest document is.
    firsts = np.flatnonzero(ids == low[kind])
    runs = pd.DataFrame({"kind": among[ask[which]], "a": a, "b": b}).merge(pd.DataFrame({"kind": kind[firsts], "n": firsts}), on="kind")
    out_n, out_a, out_b = out_n + [runs["n"].to_numpy()], out_a + [runs["a"].to_numpy()], out_b + [runs["b"].to_numpy()]
    return np.concatenate(out_n), np.concatenate(out_a), np.concatenate(out_b)


def _joined(t: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs by text and start, those that touch put together; ends ascend with starts."""
    begin = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (a[1:] > z[:-1]))) if len(t) else np.zeros(0, np.int64)
    return t[begin], a[begin], z[np.append(begin[1:], len(t)) - 1] if len(t) else z


def remove_repeats(docs: DataFrame, length: int = 50, gram: int | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of each removed run) and kept (the other bytes) for each row of docs."""
    if length < 16:
        raise ValueError("strings have 16 bytes or more")
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer column")
    small_batches(docs.sparkSession)
    k = gram or length // 2 + 1
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = -(-total // CHUNK_BYTES) or 1, -(-total // BUCKET_BYTES) or 1
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), "doc_id", F.col("text").cast("binary").alias("text"))
    u4 = np.uint32

    def offer(b: pd.DataFrame) -> pd.DataFrame:
        chunk, (b, texts) = int(b["chunk"].iloc[0]), _chunk(b)
        found = [(h, t) for _, _, h, _, _, t in minimizers(texts, length, k)]
        if not found:
            return pd.DataFrame({"bucket": [], "chunk": [], "once": [], "often": []})
        h, t = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        order = np.argsort(h)
        h, ids = h[order], b["order"].to_numpy()[t[order]]
        first = np.append(True, h[1:] != h[:-1])
        begin = np.flatnonzero(first)
        several = np.minimum.reduceat(ids, begin) < np.maximum.reduceat(ids, begin)
        bucket, bits = _split(h[first], buckets)
        out = [(n, chunk, _bytes(x[~m]), _bytes(x[m])) for n, _, (x, m) in _by_bucket(bucket, bits, several)]
        return pd.DataFrame(out, columns=["bucket", "chunk", "once", "often"])

    def answer(b: pd.DataFrame) -> pd.DataFrame:
        parts = [(c, np.frombuffer(o, u4), np.frombuffer(m, u4)) for c, o, m in zip(b["chunk"], b["once"], b["often"], strict=True)]
        every = np.sort(np.concatenate([x for p in parts for x in p[1:]]))
        shared = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *(p[2] for p in parts)]))
        out = []
        for c, o, m in parts:
            if len(shared):
                has = np.concatenate([o[shared[np.minimum(np.searchsorted(shared, o), len(shared) - 1)] == o], m])
                if len(has):
                    out.append((int(c), int(b["bucket"].iloc[0]), _bytes(has)))
        return pd.DataFrame(out, columns=["chunk", "bucket", "shared"])

    def send(b: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """A row for each bucket with what it needs, and one for the chunk itself (a bucket under 0) with where it has it."""
        if not len(b) or not len(asked):
            return pd.DataFrame({"bucket": [], "chunk": [], "meta": [], "data": []})
        chunk, (b, texts) = int(b["chunk"].iloc[0]), _chunk(b)
        want = np.sort(np.concatenate([(np.int64(n) << 32) | np.frombuffer(s, u4).astype(np.int64) for n, s in zip(asked["bucket"], asked["shared"], strict=True)]))
        order_of = b["order"].to_numpy()
        begun = np.cumsum([0] + [len(t) for t in texts])
        kept = []
        for at, x, h, s0, s1, t in minimizers(texts, length, k):
            bucket, bits = _split(h, buckets)
            key = (bucket << 32) | bits.astype(np.int64)
            ok = want[np.minimum(np.searchsorted(want, key), len(want) - 1)] == key
            t, s0, s1 = t[ok], s0[ok], s1[ok]
            with np.errstate(over="ignore"):
                stretch = _stretch_hashes(x, s0, s1 + length)
            kept.append((key[ok], stretch, t, s0 - (begun[t] - begun[at]), s1 - s0 + length))
        key, stretch, t, start, size = (np.concatenate(c) for c in zip(*kept, strict=True))
        if not len(key):
            return pd.DataFrame({"bucket": [], "chunk": [], "meta": [], "data": []})
        ids = order_of[t]
        order, begin, low = _firsts(key, stretch, ids)
        kind = np.empty(len(order), np.int64)
        kind[order] = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(order)))
        one = order[begin]
        copy = ids > low[kind]
        gone = _joined(t[copy], start[copy], (start + size)[copy])
        first = np.flatnonzero(~copy)
        bucket, number = np.unique(key[one] >> 32, return_counts=True)
        own = [np.array([len(bucket), len(first), len(gone[0])]), bucket, number, kind[first], t[first], start[first], *gone]
        out = [(-1 - chunk, chunk, zlib.compress(_bytes(np.concatenate(own).astype("<i8")), 1), None)]
        whole = np.frombuffer(b"".join(texts), np.uint8)
        at = begun[t[one]] + start[one]
        to = np.cumsum(number)
        for n, a, z in zip(bucket.tolist(), (to - number).tolist(), to.tolist(), strict=True):
            r = one[a:z]
            meta = low[a:z].astype("<i8").tobytes() + size[r].astype("<u4").tobytes() + key[r].astype(u4).tobytes()
            out.append((n, chunk, zlib.compress(meta, 1), zlib.compress(_stretches(whole, at[a:z], size[r]), 1)))
        return pd.DataFrame(out, columns=["bucket", "chunk", "meta", "data"])

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        """For each chunk, runs in its different stretches for this bucket."""
        if b["bucket"].iloc[0] < 0:
            return b.rename(columns={"meta": "runs"})[["chunk", "bucket", "runs"]]
        metas = [zlib.decompress(m) for m in b["meta"]]
        many = np.array([len(m) // 16 for m in metas])
        part = lambda kind, a, z: np.concatenate([np.frombuffer(m[a * n : z * n], kind) for m, n in zip(metas, many, strict=True)]).astype(np.int64)
        ids, size, key = part("<i8", 0, 8), part("<u4", 8, 12), part(u4, 12, 16)
        data = np.frombuffer(b"".join(zlib.decompress(x) for x in b["data"]), np.uint8)
        to = np.cumsum(size)
        with np.errstate(over="ignore"):
            stretch = _stretch_hashes(data, to - size, to)
        row = np.repeat(np.arange(len(b)), many)
        n, first, last = _covered(key, stretch, ids, size, data, length)
        own = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        out = []
        for r, _, (i, a, z) in _by_bucket(row[n], own[n], first, last + length):
            out.append((int(b["chunk"].iloc[r]), int(b["bucket"].iloc[r]), zlib.compress(_bytes(np.concatenate([i, a, z]).astype("<i8")), 1)))
        return pd.DataFrame(out, columns=["chunk", "bucket", "runs"])

    def cut_out(b: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        if not len(b):
            return pd.DataFrame({"doc_id": [], "n_bytes": [], "spans": [], "kept": []})
        b, texts = _chunk(b)
        parts = [np.zeros((3, 0), np.int64)]
        for own in runs.loc[runs["bucket"] < 0, "runs"]:  # one, if the chunk shares anything
            own = np.frombuffer(zlib.decompress(own), "<i8")
            (n, f, g), own = own[:3], own[3:]
            bucket, number, own = own[:n], own[n : 2 * n], own[2 * n :]
            kind, t, start = own[: 3 * f].reshape(3, -1)
            parts.append(own[3 * f :].reshape(3, g))
            base = dict(zip(bucket.tolist(), (np.cumsum(number) - number).tolist(), strict=True))
            found = [
                np.frombuffer(zlib.decompress(r), "<i8").reshape(3, -1) + np.array([[base[n]], [0], [0]])
                for n, r in zip(runs["bucket"], runs["runs"], strict=True) if n >= 0
            ]
            if found:
                of, a, z = np.concatenate(found, axis=1)
                m = pd.DataFrame({"kind": of, "a": a, "z": z}).merge(pd.DataFrame({"kind": kind, "t": t, "start": start}), on="kind")
                parts.append(np.stack([m["t"], m["start"] + m["a"], m["start"] + m["z"]]))
        t, a, z = np.concatenate(parts, axis=1)
        order = np.argsort(t, kind="stable")
        t, a, z = t[order], a[order], z[order]
        bounds = np.searchsorted(t, np.arange(len(texts) + 1))
        out = []
        for i, text in enumerate(texts):
            lo, hi = bounds[i], bounds[i + 1]
            spans, kept = [], text
            if hi > lo:
                step = np.zeros(len(text) + 1, np.int32)
                np.add.at(step, a[lo:hi], 1)
                np.add.at(step, z[lo:hi], -1)
                gone = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                spans = edge.reshape(-1, 2).tolist()
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out.append((b["doc_id"].iloc[i], len(text), [{"start": s, "end": e} for s, e in spans], kept))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "kept"]).astype({"doc_id": b["doc_id"].dtype})

    offered = rows.groupBy("chunk").applyInPandas(offer, "bucket long, chunk long, once binary, often binary")
    shared = offered.groupBy("bucket").applyInPandas(answer, "chunk long, bucket long, shared binary")
    sent = rows.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(send, "bucket long, chunk long, meta binary, data binary")
    runs = sent.groupBy("bucket").applyInPandas(compare, "chunk long, bucket long, runs binary")
    out = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    return rows.groupBy("chunk").cogroup(runs.groupBy("chunk")).applyInPandas(cut_out, out)

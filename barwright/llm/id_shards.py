"""Token ids in raw binary shards with keyed access (operator 13).

Documents are ordered by id and dealt out by ranges into shards.  The task of
a shard encodes its documents one after another, each closed by an end id,
and writes two files:

* the payload: ids as little-endian unsigned integers of 16 bits, or of 32
  where the vocabulary is larger, and nothing else;
* the index: a minimal perfect hash of the shard's document keys, for each
  number a fingerprint of its key, which document it is and how many follow
  under the same key, and where each document begins in the payload.

So a key leads to its ids by a fixed number of reads.  Only the files that
finished tasks name are in the manifest; what a lost task wrote is in no row
of it, and the task writes anew under another name.  Texts are encoded a
chunk between ASCII blanks at a time, each different chunk by the library
once; the vocabulary's patterns match no blank, so the ids are those of the
whole text (tests hold them equal).

A null text is empty: its document is the end id alone.  A null doc_id comes
first and is a key like others.  Repeated rows and several texts of one id
are documents of their own, next to each other, by a hash of their text; the
key gives all of them.  Ranges are of (id, text hash), so an id that very
many texts share spreads over shards.  A very long text is one row of its
task.  Empty tables give an empty manifest.  Only doc_id and text are read;
other columns can't clash.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, scratch, small_batches
from .perfect_hash import PerfectHash, key_hashes

#: Text bytes and documents behind one shard.
SHARD_BYTES, SHARD_DOCS = 32 << 20, 100_000
#: Shards whose bounds (some 30 bytes each) readers hold; with the sizes above 64 TB of text.
MAX_SHARDS = 2_000_000
#: Chunks and parts that a task remembers; chunks of more bytes aren't; what one read takes.
_KNOWN, _PARTS, _LONG, _READ = 500_000, 300_000, 64, 8 << 20
_MAGIC = b"bwids\0\0\1"


class Coder:
    """Encodes texts through a vocabulary file of the tokenizers library.

    A chunk between blanks goes to the library whole when it is new, unless
    all of it is plain (printable ASCII and Latin letters) and the file's
    steps are the usual ones: composed form, lower case, splitting by the
    file's pattern, bytes as characters.  Plain characters are composed
    already, so such a chunk is lowered and split here, and the library's
    model gets its different parts.
    """

    def __init__(self, path: str, end: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if max(self.lib.get_vocab_size(), end + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end], self.kind).tobytes()
        self.known = _Chunks(self)
        self.parts: dict[str, bytes] = {}
        given = json.loads(self.lib.to_str())
        self.pattern = _plain_pattern(given)
        self.special = [t["content"] for t in given["added_tokens"]]
        signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {chr(c): signs.pre_tokenize_str(chr(c))[0][0] for c in range(0x21, 0x180) if c < 0x7F or c >= 0xC0}

    def _bytes(self, ids: list[int]) -> bytes:
        made = array("H" if self.kind.itemsize == 2 else "I", ids)
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            given = part if part.isascii() else "".join([self.signs[c] for c in part])
            found = self.parts[part] = self._bytes([t.id for t in self.lib.model.tokenize(given)])
        return found

    def chunk(self, w: bytes) -> bytes:
        """The ids of a text without ASCII blanks."""
        text = w.decode()
        if self.pattern and text.isascii() and text.isalpha():  # one part, as most are
            return self._part(text.lower())
        if self.pattern and _PLAIN.fullmatch(text) and not ("<" in text and any(x in text for x in self.special)):
            return b"".join([self._part(p) for p in self.pattern.findall(text.lower())])
        return self._bytes(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text and the end id, as bytes."""
        for cache, limit in ((self.known, _KNOWN), (self.parts, _PARTS)):
            if len(cache) > limit:
                cache.clear()
        of = self.known.__getitem__
        return [b"".join(map(of, t.split())) + self.end if t else self.end for t in texts]


class _Chunks(dict):
    """Chunks met so far, and their ids; new ones are encoded when they are looked up."""

    def __init__(self, coder: Coder):
        self.coder = coder

    def __missing__(self, w: bytes) -> bytes:
        ids = self.coder.chunk(w)
        if len(w) <= _LONG:
            self[w] = ids
        return ids


#: Printable ASCII, and Latin letters whose lower case is one letter and that composing leaves alone.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")


def _plain_pattern(given: dict):
    """The splitting pattern of a file whose steps do to plain text what Coder does; else None."""
    steps = (given.get("normalizer") or {}).get("normalizers", [])
    split, signs = ((given.get("pre_tokenizer") or {}).get("pretokenizers", []) + [{}, {}])[:2]
    usual = (
        [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and not steps[1]["content"].strip()
        and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and "Regex" in split.get("pattern", {})
        and signs.get("type") == "ByteLevel" and not signs["add_prefix_space"] and not signs["use_regex"]
    )
    return regex.compile(split["pattern"]["Regex"]) if usual else None


@functools.lru_cache(maxsize=1)
def coder(path: str, end: int) -> Coder:
    return Coder(path, end)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def pack_index(keys: list, starts: np.ndarray) -> bytes:
    """The index file of documents in order: their keys, and where each begins in the payload, with the end of the last."""
    h = key_hashes(keys)
    first = np.flatnonzero(np.append(True, (h[:, 1:] != h[:, :-1]).any(axis=0))) if len(keys) else np.zeros(0, np.int64)
    by = PerfectHash.of(h[:, first])
    at = by(h[:, first])
    prints, doc, many = np.empty(len(first), "<u8"), np.empty(len(first), "<u4"), np.empty(len(first), "<u4")
    prints[at], doc[at], many[at] = h[0, first], first, np.diff(first, append=len(keys))
    head = np.array([len(by.sizes), len(by.words), len(first), len(keys)], "<i8")
    parts = [head, by.sizes.astype("<i8"), by.words.astype("<u8"), prints, doc, many, starts.astype("<i8")]
    return _MAGIC + b"".join(p.tobytes() for p in parts)


class Index:
    """An index file, read."""

    def __init__(self, raw: bytes):
        if raw[:8] != _MAGIC:
            raise ValueError("not an index of id shards")
        at = 8

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        levels, words, keys, docs = take("<i8", 4).tolist()
        sizes, bits = take("<i8", levels), take("<u8", words)
        self.hash = PerfectHash(sizes, bits)
        self.prints, self.doc, self.many, self.starts = take("<u8", keys), take("<u4", keys), take("<u4", keys), take("<i8", docs + 1)

    def find(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """First document and how many of each key; 0 documents where the fingerprint differs."""
        h = key_hashes(keys)
        at = self.hash(h)
        if not len(self.prints):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        ok = (at >= 0) & (self.prints[at] == h[0])
        return np.where(ok, self.doc[at], 0).astype(np.int64), np.where(ok, self.many[at], 0).astype(np.int64)


def write_shards(docs: DataFrame, tokenizer: str, end: int, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encodes docs into shards.  A row for each, in the order of ids: shard, base (ids before it), n_docs, n_tokens, low, high (ids), width, payload, index."""
    spark = docs.sparkSession
    small_batches(spark, 500, 4)
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(-(-size // shard_bytes), -(-n // shard_docs), 1)
    if shards > MAX_SHARDS:
        raise ValueError(f"{shards} shards; take larger ones")
    folder = scratch(spark, "id-shards")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, ends, at, out, paths = [], [0], [], 0, None, []
        encoder = coder(tokenizer, end)
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                store, where = _open(folder)
                store.create_dir(where, recursive=True)
                name = uuid.uuid4().hex
                paths = [f"{folder}/{name}.ids", f"{folder}/{name}.index"]
                out = store.open_output_stream(f"{where}/{name}.ids")
            ids, hashes, texts = (b.column(k).to_pylist() for k in range(3))
            made = encoder.encode(texts)
            out.write(b"".join(made))
            sizes += [len(m) // encoder.kind.itemsize for m in made]
            keys += ids
            ends = [ends[0] if ends else (ids[0], hashes[0]), (ids[-1], hashes[-1])]
        if out is None:
            return
        out.close()
        starts = np.cumsum(np.array(sizes, np.int64))
        with store.open_output_stream(f"{where}/{name}.index") as f:
            f.write(pack_index(keys, starts))
        (low, low_hash), (high, _) = ends
        row = [[low], [low_hash], [high], [len(keys)], [int(starts[-1])], [encoder.kind.itemsize], [paths[0]], [paths[1]]]
        kinds = [b.schema[0].type, pa.int64(), b.schema[0].type, pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
        names = ["low", "low_hash", "high", "n_docs", "n_tokens", "width", "payload", "index"]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("hash"), F.col("text").cast("binary").alias("text"))
    rows = rows.repartitionByRange(shards, "doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    done = cut(rows.mapInArrow(write, f"low {kind}, low_hash long, high {kind}, n_docs long, n_tokens long, width int, payload string, index string"), "manifest")
    order = W.orderBy("low", "low_hash")  # of shards, not of documents
    base = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = done.select((F.row_number().over(order) - 1).cast("long").alias("shard"), base.alias("base"), "*").drop("low_hash")
    return cut(numbered, "manifest")


def _ranges(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows (in order of place) whose bytes one read takes."""
    a = 0
    for z in range(1, len(start) + 1):
        if z == len(start) or end[z] - start[a] > _READ or start[z] > end[z - 1] + 4096:
            yield a, z
            a = z


def _route(bounds: pa.Table):
    """For keys, the first and last shard that may hold each."""
    low, high = bounds.column("low").to_pylist(), bounds.column("high").to_pylist()
    null_low, null_high = sum(x is None for x in low), sum(x is None for x in high)  # null ids come first
    lows, highs = np.array(low[null_low:]), np.array(high[null_high:])

    def of(keys: list) -> tuple[np.ndarray, np.ndarray]:
        none = np.array([k is None for k in keys], bool)
        first, last = np.zeros(len(keys), np.int64), np.full(len(keys), null_low - 1)
        if (~none).any():
            some = np.array([k for k in keys if k is not None])
            first[~none] = null_high + np.searchsorted(highs, some, "left") if len(highs) else len(low)
            last[~none] = null_low + np.searchsorted(lows, some, "right") - 1 if len(lows) else null_low - 1
        return first, last

    return of


def lookup(manifest: DataFrame, keys: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of 32-bit ids) and ids of all documents of each different key; keys that aren't there have no row."""
    spark = manifest.sparkSession
    if manifest.count() > MAX_SHARDS:
        raise ValueError("too many shards to hold their bounds")
    bounds = manifest.orderBy("shard").select("low", "high").toArrow()
    kind = manifest.schema["low"].dataType.simpleString()
    given = spark.sparkContext.broadcast(bounds)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route = _route(given.value)
        for b in batches:
            first, last = route(b.column(0).to_pylist())
            many = np.maximum(last - first + 1, 0)
            at = np.repeat(np.arange(len(many)), many)
            shard = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), b.column(0).take(pa.array(at))], ["shard", "doc_id"])

    def read(asked: pa.Table, about: pa.Table) -> pa.Table:
        made: list[tuple] = []
        if asked.num_rows and about.num_rows:
            one = about.to_pylist()[0]
            ids = np.dtype(f"<u{one['width']}")
            store, where = _open(one["index"])
            with store.open_input_stream(where) as f:
                index = Index(f.read())
            keys = asked.column("doc_id").to_pylist()
            doc, many = index.find(keys)
            of = np.repeat(np.arange(len(keys)), many)
            doc = np.repeat(doc - (np.cumsum(many) - many), many) + np.arange(len(of))
            order = np.argsort(doc, kind="stable")
            of, doc = of[order], doc[order]
            a, z = index.starts[doc] * ids.itemsize, index.starts[doc + 1] * ids.itemsize
            store, where = _open(one["payload"])
            with store.open_input_file(where) as f:
                for lo, hi in _ranges(a, z):
                    f.seek(int(a[lo]))
                    raw = memoryview(f.read(int(z[hi - 1] - a[lo])))
                    for i in range(lo, hi):
                        part = np.frombuffer(raw[a[i] - a[lo] : z[i] - a[lo]], ids)
                        made.append((keys[of[i]], one["base"] + int(a[i]) // ids.itemsize, len(part), zlib.crc32(part.astype("<u4")), part.tolist() if with_ids else None))
        columns = list(zip(*made, strict=True)) or [[]] * 5
        kinds = [asked.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: 4 + with_ids], names=names[: 4 + with_ids])

    dealt = keys.select(F.col("doc_id").cast(kind)).distinct().mapInArrow(send, f"shard long, doc_id {kind}")
    out = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return dealt.groupBy("shard").cogroup(manifest.groupBy("shard")).applyInArrow(read, out)

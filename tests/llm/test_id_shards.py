"""Id shards against the library's ids of whole texts, and the perfect hash by itself."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from barwright.llm import id_shards, queries
from barwright.llm.perfect_hash import PerfectHash, key_hashes

PATH = f"{queries.TOKENIZERS}/word_bpe_49k.json"
ODD = [
    None, "", " \n", "İstanbul ΣΑΣ Σ'S don't DON'T 'tis", "á ́b é́", "x y z\u0085w\x1cv", "<|endoftext|> and a<|startoftext|>b < |endoftext|>",
    "12 345 ٣٤ ½ ⅷ", "日本語のテキスト 한국어 текст", "😀😃 👨‍👩‍👧 #*$%&", "tab\tnew\r\nline\x0bvertical\x0cfeed", "ﬁ ﬀ ẞ ß Å K", "가 ᆨ", "w" * 5000, "long row " * 20_000,
]


def expected(rows):
    lib, start, out = Tokenizer.from_file(PATH), 0, []
    for key, text in rows:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def found(spark, rows, **how):
    docs = spark.createDataFrame([(k, t, 1, "p") for k, t in rows], "doc_id long, text string, shard int, payload string")
    manifest = id_shards.write_shards(docs, PATH, 2, **how)
    got = id_shards.lookup(manifest, docs.select("doc_id"))
    return manifest, sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in got.collect()), key=lambda r: r[1])


@pytest.mark.parametrize("shard_docs", [1000, 4])
def test_ids_equal_the_library(spark, shard_docs):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcd'é1 .\n　") for _ in range(rng.randrange(0, 80))) for _ in range(40)]
    rows = [(3 * k - 20, t) for k, t in enumerate(ODD + pool)]
    shuffled = rng.sample(rows, len(rows))
    manifest, got = found(spark, shuffled, shard_docs=shard_docs)
    assert got == expected(sorted(rows))
    parts = manifest.orderBy("shard").collect()
    assert sum(p.n_docs for p in parts) == len(rows) and parts[0].base == 0 and (len(parts) > 5) == (shard_docs == 4)


def test_plain_chunks_equal_the_library():
    rng = random.Random(9)
    signs = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA0, 0x250), 0x301, 0x3A3, 0x1E9E, 0x212B, 0xFB01, 0x3042)]
    usual = "aeiouAEIOUnst'',.#1éÉİıŉǅ" + "<|endoftext|>"
    chunks = ["".join(rng.choice(usual if rng.random() < 0.7 else signs) for _ in range(rng.randrange(1, 12))) for _ in range(20_000)]
    chunks += signs + [f"'{x}'" for x in ("S", "ll", "RE", "d", "x")] + ["x<|endoftext|>y", "<|endoftext|", "I'LL'VE", "ÀÖØöøÿ", "a" * 300]
    coder = id_shards.Coder(PATH, 2)
    assert coder.pattern
    lib = Tokenizer.from_file(PATH)
    for c, made in zip(chunks, coder.encode([c.encode() for c in chunks]), strict=True):
        assert np.frombuffer(made, coder.kind).tolist() == [*lib.encode(c, add_special_tokens=False).ids, 2], c


def test_other_vocabularies_go_through_the_library_whole():
    path = f"{queries.TOKENIZERS}/byte_bpe_50k.json"
    coder = id_shards.Coder(path, 50256)
    assert coder.pattern is None


def test_null_and_repeated_keys(spark):
    rows = [(None, "no key"), (7, "one"), (7, "one"), (7, "other text"), (7, None), (1, "first")]
    for shard_docs in (100, 2):
        _, got = found(spark, rows, shard_docs=shard_docs)
        assert [r[0] for r in got] == [None, 1, 7, 7, 7, 7]
        assert sorted((str(r[0]), r[4]) for r in got) == sorted((str(r[0]), r[4]) for r in expected(rows))
        assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1]]


def test_string_keys_and_absent_ones(spark):
    docs = spark.createDataFrame([(f"k{n:03}", f"text {n}") for n in range(50)], "doc_id string, text string")
    manifest = id_shards.write_shards(docs, PATH, 2, shard_docs=9)
    ask = spark.createDataFrame([("k007",), ("k049",), ("k050",), ("a",), (None,), ("k007",)], "doc_id string")
    lib = Tokenizer.from_file(PATH)
    got = {r.doc_id: r.ids for r in id_shards.lookup(manifest, ask).collect()}
    assert got == {k: [*lib.encode(f"text {int(k[1:])}", add_special_tokens=False).ids, 2] for k in ("k007", "k049")}


def test_empty_table(spark):
    _, got = found(spark, [])
    assert got == []


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_perfect_hash(n):
    keys = key_hashes(list(range(-(n // 2), n - n // 2)))
    by = PerfectHash.of(keys)
    assert sorted(by(keys).tolist()) == list(range(n))
    again = PerfectHash(by.sizes, by.words)
    assert (again(keys) == by(keys)).all() and sum(by.sizes) <= 6 * n + 64 * len(by.sizes)


def test_fingerprints_tell_absent_keys():
    index = id_shards.Index(id_shards.pack_index(list(range(0, 2000, 2)), np.arange(1001)))
    doc, many = index.find(list(range(2000)))
    assert (many == [1, 0] * 1000).all() and (doc[::2] == np.arange(1000)).all()

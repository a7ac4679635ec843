"""Vector codes against plain Python, and the tree of entries against comparing all."""

import math
import random

import numpy as np
import pytest

from barwright.llm import queries, vector_codes
from barwright.llm.neighbour_tree import NeighbourTree, largest_component, squared

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"


def plain(rows, parts, entries, rounds):
    kept = sorted(((i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0], r[1]))
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in kept]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[cut(v, p) for i, v, _ in kept if i is not None][:entries] for p in range(parts)]
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (dist(cut(v, p), books[p][e]), e)) for p in range(parts)] for _, v, _ in kept]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), c in zip(kept, codes, strict=True) if c[p] == e]
                if mine:
                    books[p][e] = tuple(sum(xs) // len(mine) for xs in zip(*mine, strict=True))
    codes = assign()
    return [(i, label, c, sum(dist(cut(v, p), books[p][c[p]]) for p in range(parts))) for (i, v, label), c in zip(kept, codes, strict=True)], books


def rows_of(n, rng, dims=8, ids=None):
    grid = [k / 64 for k in range(-3, 4)]
    return [((ids or list(range(n)))[k], [rng.choice(grid) for _ in range(dims)], rng.choice([None, 1, 2])) for k in range(n)]


@pytest.mark.parametrize("n,entries", [(300, 16), (5, 16), (120, 40)])
def test_codes_equal_plain_python(spark, n, entries):
    rng = random.Random(n)
    rows = rows_of(n, rng)
    bad = [(1000, None, 1), (1001, [], 1), (1002, [None] + [0.0] * 7, 1), (1003, [math.nan] * 8, 2), (-5, [math.inf] + [0.0] * 7, None)]
    given = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rng.sample(rows + bad, n + 5)], SCHEMA).repartition(3)
    coded, books = vector_codes.encode(given, 4, entries, 4)
    expected, want = plain(rows, 4, entries, 4)
    assert books.tolist() == [[list(e) for e in b] for b in want]
    got = vector_codes.with_label_error(coded).collect()
    assert sorted((r.vec_id, r.label, r.code, r.error) for r in got if r.vec_id is not None) == sorted(expected)
    for r in got:
        assert r.label_error == sum(e for _, label, _, e in expected if label == r.label)


def test_null_and_repeated_ids_and_other_lengths(spark):
    rng = random.Random(1)
    rows = rows_of(40, rng, ids=[None, None, 3, 3, 3, *range(4, 39)])
    odd = [(100, [0.5] * 4, 1), (101, [0.5] * 9, 1)]
    coded, books = vector_codes.encode(spark.createDataFrame([(i, v, label, "", 0) for i, v, label in rows + odd], SCHEMA), 2, 8, 2)
    expected, want = plain(rows, 2, 8, 2)
    assert books.tolist() == [[list(e) for e in b] for b in want]
    key = lambda r: (str(r[0]), str(r[1]), r[2], r[3])
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in coded.collect()), key=key) == sorted(expected, key=key)
    lens = {len(v) for v in vector_codes.decode(np.array([r.code for r in coded.collect()]), books).tolist()}
    assert lens == {8}


def test_empty_and_too_large(spark):
    for rows in ([], [(1, None, 1, "", 0)], [(1, [1.0] * 7, 1, "", 0)]):
        coded, _ = vector_codes.encode(spark.createDataFrame(rows, SCHEMA))
        assert coded.collect() == []
    with pytest.raises(ValueError, match="beyond"):
        vector_codes.encode(spark.createDataFrame([(1, [1e30] * 8, 1, "", 0)], SCHEMA))


@pytest.mark.parametrize("degree", [2, 5, 16])
@pytest.mark.parametrize("spread", [2, 50, largest_component(6)])
def test_tree_equals_all(degree, spread):
    rng = np.random.default_rng(degree * 7 + spread % 1000)
    entries = rng.integers(-spread, spread + 1, (200, 6))
    entries[150:] = entries[:50]  # equal entries: the lower number
    queries_ = np.concatenate([rng.integers(-spread, spread + 1, (500, 6)), entries, (entries[:-1] + entries[1:]) // 2])
    tree = NeighbourTree(entries, degree)
    at, d = tree.nearest(queries_)
    full = squared(queries_, entries)
    assert (at == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()


def test_tree_drops_subtrees():
    rng = np.random.default_rng(2)
    centres = rng.integers(-100_000, 100_000, (16, 16))
    entries = (centres[:, None, :] + rng.integers(-900, 900, (16, 16, 16))).reshape(256, 16)
    tree = NeighbourTree(entries)
    near = entries[rng.integers(0, 256, 1000)] + rng.integers(-50, 50, (1000, 16))
    assert (tree.nearest(near)[0] == squared(near, entries).argmin(axis=1)).all()
    assert tree.compared < 1000 * 256 / 4


def test_query_has_all_kept_vectors(spark, sf):
    got = queries.op11_vector_codes(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/embeddings.parquet").count() and len({r.codebooks_sha256 for r in got}) == 1

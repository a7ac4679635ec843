"""The audit of filters against a walk through all orders, over files in any order, again after a stop, and on hard rows."""

import itertools
import random
import re

import pytest

from barwright.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, n long, mask int, part string"


def walk(rows, labels):
    """(part, order, step) -> counts, by applying the filters one after another."""
    low = {}
    for i, text, _ in rows:
        if i is not None:
            low[text or ""] = min(low.get(text or "", i), i)
    marks = {}
    for i, q, t in labels:
        g = marks.setdefault(i, [False, False])
        marks[i] = [g[0] or q == 1, g[1] or t == 1]
    docs = {}
    for i, text, source in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > low[text],
        }
        docs.setdefault(source or "", []).append((fails, *(marks.get(i, [False, False]) if i is not None else [False, False])))
    out, shapley = {}, {}
    for part, own in docs.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                failing = [d for d in own if d[0][f]]
                alone = sum(sum(d[0].values()) == 1 for d in failing)
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def some_rows(rng, n):
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5))) for _ in range(400)] + ["X", "Big", "a#b", "$", "CAPS"]
    texts = [" ".join(rng.choice(words[: rng.choice([20, 400, 405])]) for _ in range(rng.choice([0, 3, 150, 250]))) for _ in range(n // 3)]
    texts += [None, "", " \n\t", "\x1fodd\x0bblank", "one word"]
    rows = [(k, rng.choice(texts), rng.choice(["a", "b", None, ""])) for k in range(n)]
    return rows + [(None, rng.choice(texts), "a"), (None, "", None), rows[0], (rows[1][0], rows[1][1], "b"), (-7, rows[2][1], "a")]


def write(spark, rows, path, mode="append"):
    spark.createDataFrame([(i, t, s, 1, 3, "x") for i, t, s in rows], SCHEMA).coalesce(1).write.mode(mode).parquet(path)


@pytest.mark.parametrize("batches", [1, 3, 20])
def test_audit_equals_a_walk(spark, tmp_path, batches):
    rng = random.Random(batches)
    rows = some_rows(rng, 90)
    rng.shuffle(rows)
    for k in range(0, len(rows), 20):
        write(spark, rows[k : k + 20], str(tmp_path / "docs"))
    labels = [(rng.choice([-7, *range(90)]), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(60)] + [(None, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert got(filter_audit.audit(spark, str(tmp_path / "docs"), marks, batches=batches)) == walk(rows, labels)


def test_smaller_ids_retract_and_a_stopped_stream_goes_on(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    docs, folder, rows = str(tmp_path / "docs"), str(tmp_path / "state"), []
    for ids in ([9, 30], [30], [5, 9], [1], [40]):
        more = [(i, "same text", f"s{i}") for i in ids]
        rows += more
        write(spark, more, docs)
        expected = walk(rows, [(1, 1, 0), (9, 0, 1)])
        assert got(filter_audit.audit(spark, docs, labels, folder=folder)) == expected
        holder = min(i for i, _, _ in rows)
        assert [r[1] for k, r in expected.items() if k[1:] == ("EABCD", 1) and k[0] == f"s{holder}"] == [0]
    # A batch that runs once more changes nothing.
    again = filter_audit.Audit(spark, labels, folder=folder)
    again.batch(spark.read.parquet(docs).where("doc_id = 40"), 4)
    assert got(filter_audit.interactions(again.counters())) == expected


def test_single_file_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    write(spark, [], str(tmp_path / "none"))
    assert filter_audit.audit(spark, str(tmp_path / "none"), labels).collect() == []
    rows = [(1, "long word " * 30_000, "a"), (2, "x" * 20_000, None)]
    write(spark, rows, str(tmp_path / "d"))
    one = next((tmp_path / "d").glob("part-*.parquet"))
    assert got(filter_audit.audit(spark, str(one), labels)) == walk(rows, [])

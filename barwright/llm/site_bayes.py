"""Quality classifier with hierarchical empirical Bayes over sites (operator 6).

A classifier over words and their beginnings gives every document a
log-likelihood ratio for each target, such as low quality or toxic.  Hosts and paths get posterior
rates from grouped sums of the documents' probabilities: a host's rate is
shrunk towards the global one and a path's towards its host's, by prior
strengths that the method of moments estimates from the spread between hosts
and between paths.  A document's own share is taken out of its site's sums;
the rate that is left is its prior, which the document's evidence updates.

Words are runs of anything but ASCII blanks and punctuation after A-Z are
lowered; a document's features are its distinct words and some coarse
statistics.  Null texts have no words; a null host or path is a site of its
own.  Unlabelled and null-labelled rows don't train, repeated labels of a
document count once by their highest value, repeated rows each count for
their site.  Without both classes of a target its evidence is 0 and the
prior decides.  Ties in the order of labelled documents go by hash of id and
text.  A very long text is read whole, one text at a time.  Empty tables give
empty tables.  Only doc_id, text and the site columns are read; others can't
clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrays, cut, small_batches

_PUNCT = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_CLEAN = bytes.maketrans(bytes(range(65, 91)) + _PUNCT, bytes(range(97, 123)) + b" " * len(_PUNCT))
_UP, _LOW = bytes(range(65, 91)), bytes(range(97, 123))
#: Sites (some 50 bytes each) up to which their rates are broadcast; beyond it the join is salted.
MAX_BROADCAST_SITES = 200_000
SALTS = 32


def _level(x: float) -> int:
    """Share in ten steps."""
    return min(int(10 * x), 9)


def parts(text: bytes | None) -> tuple[set[bytes], list[bytes]]:
    """Distinct words, and levels of statistics with a leading blank that no word has."""
    text = text or b""
    words = text.translate(_CLEAN).split()
    out = set(words)
    n, letters = max(len(words), 1), len(text) - len(text.translate(None, _UP + _LOW))
    upper = len(text) - len(text.translate(None, _UP))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    shown = (("distinct", len(out) / n), ("upper", upper / max(letters, 1)), ("symbols", symbols / n), ("short", 1 / (1 + len(words) / 50)))
    return out, [b" %s %d" % (k.encode(), _level(v)) for k, v in shown]


def word_features(word: bytes) -> list[bytes]:
    """The word and its beginnings of 4 to 8 bytes."""
    return [word, *(b"^" + word[:k] for k in range(4, 9) if len(word) > k)]


def features(text: bytes | None) -> set[bytes]:
    words, levels = parts(text)
    return {f for w in words for f in word_features(w)}.union(levels)


def _hashes(names) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), np.uint64, len(names)).view(np.int64)


@dataclass(frozen=True)
class Evidence:
    """Chosen features by hash and, for each target, their weights; ``offset`` and ``prior`` are log odds."""

    keys: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    prior: np.ndarray

    def finder(self) -> "_Finder":
        return _Finder({k: i for i, k in enumerate(self.keys.tolist())})


class _Finder(dict):
    """Numbers of the chosen features by word, found once for each word."""

    def __init__(self, number: dict[int, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        names = [word] if word.startswith(b" ") else word_features(word)
        found = self[word] = tuple(self.number[h] for h in _hashes(names).tolist() if h in self.number)
        return found

    def of(self, text: bytes | None) -> list[int]:
        if len(self) > 100_000:
            self.clear()
        words, levels = parts(text)
        return sorted({i for w in words for i in self[w]}.union(i for x in levels for i in self[x]))


def _logistic(col: np.ndarray, first: np.ndarray, k: int, y: np.ndarray, ridge: float, steps: int = 60, memory: int = 8, some: int = 1 << 19) -> tuple[np.ndarray, float]:
    """Weights and offset of a ridge-penalised logistic regression on k 0/1 features, by limited-memory quasi-Newton steps.

    col: the features of one row after the other; first: where each row
    begins, and the end.  Some entries are in work at once.
    """
    n = len(y)
    penalty = np.append(np.full(k, ridge), 1e-6)
    blocks = np.unique(np.append(np.searchsorted(first, np.arange(0, len(col) + 1, some)), n))
    blocks = np.unique(np.append(0, blocks))

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, slope = 0.5 * float((penalty * w * w).sum()), penalty * w
        for a, b in zip(blocks[:-1].tolist(), blocks[1:].tolist(), strict=True):
            at, size = col[first[a] : first[b]], np.diff(first[a : b + 1])
            z = np.full(b - a, w[-1])
            some_rows = size > 0
            if some_rows.any():
                z[some_rows] += np.add.reduceat(w[at], (first[a:b] - first[a])[some_rows])
            off = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[a:b]
            slope[:-1] += np.bincount(at, np.repeat(off, size), k)
            slope[-1] += off.sum()
            loss += float((np.logaddexp(0, z) - y[a:b] * z).sum())
        return loss, slope

    w = np.append(np.zeros(k), np.log((y.sum() + 1) / (n - y.sum() + 1)))
    scale = 1 / (np.append(np.bincount(col, minlength=k), n) * y.mean() * (1 - y.mean()) + penalty)  # the curvature's diagonal at the start
    now, slope = value(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        step, kept = -slope, []
        for s, g in reversed(past):
            kept.append((s @ step) / (s @ g))
            step = step - kept[-1] * g
        step = step * scale
        for (s, g), a in zip(past, reversed(kept), strict=True):
            step = step + (a - (g @ step) / (s @ g)) * s
        size, down = 1.0, float(slope @ step)
        while (found := value(w + size * step))[0] > now + 1e-4 * size * down and size > 1e-6:
            size /= 2
        s, g = size * step, found[1] - slope
        if found[0] > now or now - found[0] < 1e-6 * max(abs(now), 1):
            break
        w, now, slope = w + s, *found
        if s @ g > 1e-12:
            past = [*past[1 - memory :], (s, g)]
    return w[:-1], float(w[-1])


def learn_evidence(
    docs: DataFrame, targets: DataFrame, names: list[str], max_labelled: int = 20_000,
    z: float = 4.0, least_share: float = 0.02, least: int = 5, ridge: float = 1.0,
) -> Evidence:
    """Chooses features by how far their counts in a class are from chance, then weighs them by logistic regression.

    Trains on at most ``max_labelled`` labelled documents, those of the
    lowest hashed ids.  A feature must be in ``least_share`` of the smaller
    class's documents, so that the words of one text and its copies don't
    pass for signs of the class; every feature that passes is used.  What
    comes to the driver is those documents' passing features as numbers, which
    ``max_labelled`` bounds: some tens of MB.  ``targets`` has doc_id and a
    0/1 column for each name.
    """
    small_batches(docs.sparkSession)
    sample = (
        targets.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(F.col(t).cast("int")).alias(t) for t in names))
        .dropna(subset=names).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(sample), "doc_id")
    # Repeated rows of a labelled document count towards the bound, too.
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(max_labelled).select("text", *names)
    rows = cut(rows.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism), "labelled")
    k = len(names)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[bytes, np.ndarray] = {}
        for b in batches:
            for t, m in zip(b["text"], b[names].to_numpy(np.int64), strict=True):
                m = np.append(m, 1)
                for f in (*features(t), b""):  # the empty name: every document
                    if f in sums:
                        sums[f] += m
                    else:
                        sums[f] = m.copy()
        if sums:
            keys = np.where([f == b"" for f in sums], 0, _hashes(list(sums)))
            yield pd.DataFrame(np.stack(list(sums.values())), columns=[*names, "n"]).assign(key=keys)[["key", "n", *names]]

    counts = rows.mapInPandas(count, "key long, n long, " + ", ".join(f"{t} long" for t in names))
    counts = cut(counts.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", *names))), "features")
    every = counts.where("key = 0").first()
    if every is None:
        return Evidence(np.zeros(0, np.int64), np.zeros((0, k)), np.zeros(k), np.zeros(k))
    total, positives = every["n"], np.array([every[t] for t in names], float)
    test = F.lit(0.0)
    for t, pos in zip(names, positives, strict=True):
        p, n = pos / total, F.col("n")
        if 0 < pos < total:
            often = n >= max(least, least_share * min(pos, total - pos))
            test = F.greatest(test, F.when(often & (n < total), F.abs(F.col(t) - n * p) / F.sqrt(n * (p * (1 - p)))).otherwise(0.0))
    chosen = counts.where("key != 0").withColumn("_z", test).where(F.col("_z") >= z).orderBy("key")
    keys = arrays(chosen.select("key"))[0]
    found = Evidence(keys, np.zeros((len(keys), k)), np.zeros(k), np.log((positives + 1) / (total - positives + 1)))
    held = rows.select(*names, _present(F.col("text"), found).alias("_at")).toArrow()
    ys = {t: held.column(t).to_numpy().astype(float) for t in names}
    first = np.append(0, np.cumsum(pc.list_value_length(held.column("_at")).to_numpy())).astype(np.int64)
    col = pc.list_flatten(held.column("_at")).to_numpy()
    del held
    weights, offset = np.zeros((len(keys), k)), found.prior.copy()
    for j, t in enumerate(names):
        y = ys[t]
        if len(keys) and 0 < y.sum() < len(y):
            weights[:, j], offset[j] = _logistic(col, first, len(keys), y, ridge)
    return Evidence(keys, weights, offset, found.prior)


def _present(text: Column, e: Evidence) -> Column:
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = e.finder()
        for texts in batches:
            yield pd.Series([f.of(t) for t in texts], dtype=object)

    return F.pandas_udf(find, "array<int>")(text)


def evidence(text: Column, e: Evidence, names: list[str]) -> Column:
    """Struct of each target's log-likelihood ratio: log odds given the text, less those of the prior."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = e.finder()
        for texts in batches:
            out = np.array([e.weights[f.of(t)].sum(axis=0) for t in texts]).reshape(len(texts), len(names))
            yield pd.DataFrame(out + (e.offset - e.prior), columns=names)

    return F.pandas_udf(score, ", ".join(f"{t} double" for t in names))(text.cast("binary"))


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _strength(groups: DataFrame, n: str, s: str, mean: Column) -> float:
    """Strength of a beta prior around ``mean``, by moments: the spread of the groups' rates without what sampling adds."""
    off = F.col(s) / F.col(n) - mean
    x = groups.agg(
        F.sum(F.col(n) * off * off).alias("spread"), F.sum(mean * (1 - mean)).alias("sampling"), F.sum(n).alias("n"), F.count("*").alias("k")
    ).first()
    if not x["k"] or x["spread"] <= x["sampling"]:
        return 1e6
    between = (x["spread"] - x["sampling"]) / x["n"]
    return min(max(x["sampling"] / x["k"] / between - 1, 1.0), 1e6)


def _with_sites(df: DataFrame, sites: DataFrame) -> DataFrame:
    if sites.count() <= MAX_BROADCAST_SITES:
        return df.join(F.broadcast(sites), ["_host", "_path"])
    salted = sites.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_path", "_salt"]).drop("_salt")


def classify(
    docs: DataFrame, targets: DataFrame, names: list[str], host: Column, path: Column, threshold: float = 0.5, **how
) -> DataFrame:
    """doc_id, host, path, and for each target: evidence_, host_rate_, path_rate_, p_; kept if all p_ are under ``threshold``."""
    learned = learn_evidence(docs, targets, names, **how)
    site = lambda c: F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("-"))
    scored = docs.select(
        "doc_id", host.alias("host"), path.alias("path"), site(host).alias("_host"), site(path).alias("_path"),
        evidence(F.col("text"), learned, names).alias("e"),
    )
    scored = cut(scored.select("doc_id", "host", "path", "_host", "_path", *(F.col(f"e.{t}").alias(f"evidence_{t}") for t in names)), "evidence")
    first = {t: _sigmoid(F.col(f"evidence_{t}") + F.lit(float(p))) for t, p in zip(names, learned.prior, strict=True)}
    paths = cut(
        scored.groupBy("_host", "_path").agg(F.count("*").alias("n_path"), *(F.sum(c).alias(f"path_{t}") for t, c in first.items())), "paths"
    )
    hosts = paths.groupBy("_host").agg(F.sum("n_path").alias("n_host"), *(F.sum(f"path_{t}").alias(f"host_{t}") for t in names))
    hosts = cut(hosts, "hosts")
    every = hosts.agg(F.sum("n_host").alias("n"), *(F.sum(f"host_{t}").alias(t) for t in names)).first()
    rate = {t: (every[t] + 1) / (every["n"] + 2) if every["n"] else 0.5 for t in names}
    joined = paths.join(hosts, "_host")
    outer = {t: _strength(hosts, "n_host", f"host_{t}", F.lit(rate[t])) for t in names}
    inner = {t: _strength(joined, "n_path", f"path_{t}", F.col(f"host_{t}") / F.col("n_host")) for t in names}
    df = _with_sites(scored, joined)
    out = {}
    for t in names:
        own, mg, mh = first[t], outer[t], inner[t]
        host_rate = (F.col(f"host_{t}") - own + mg * rate[t]) / (F.col("n_host") - 1 + mg)
        path_rate = (F.col(f"path_{t}") - own + mh * host_rate) / (F.col("n_path") - 1 + mh)
        path_rate = F.least(F.greatest(path_rate, F.lit(1e-6)), F.lit(1 - 1e-6))
        out[f"host_rate_{t}"], out[f"path_rate_{t}"] = host_rate, path_rate
        out[f"p_{t}"] = _sigmoid(F.col(f"evidence_{t}") + F.log(path_rate / (1 - path_rate)))
    df = df.withColumns(out)
    kept = F.lit(True)
    for t in names:
        kept = kept & (F.col(f"p_{t}") < threshold)
    return df.select("doc_id", "host", "path", *(f"{c}_{t}" for t in names for c in ("evidence", "host_rate", "path_rate", "p")), kept.alias("kept"))

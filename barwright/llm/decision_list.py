"""Quality rules learned as a decision list (operator 5).

Every text gets statistics; from labelled ones sequential covering learns an
ordered list of threshold conjunctions for the rejected class.  Each rule is
grown on one part of the labelled rows by information gain, pruned on the
other, and kept if precise enough there.  The list becomes one Spark
conditional expression, so judging costs a pass over the texts and no shuffle.

Words are maximal runs of anything but space, tab, newline, vertical tab,
form feed and carriage return.  Null texts count as empty: all statistics 0,
base_failed true.  Ties between thresholds go to the earlier statistic, then
the lower threshold.  Repeated rows are judged alike, labels repeated for a
document count once by their lowest value, unlabelled and null-labelled
documents don't train, and without labelled rows of both classes the list is
empty and only the base rule rejects.  Empty tables give empty tables, and a
very long text is counted whole, one text at a time.  Columns of the input
named like an output column are replaced (``keep_good`` adds none); others
pass unchanged, as long as none is called _barwright_stats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

RESERVED = "_barwright_stats"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_digits", "n_punct", "n_distinct_words", "n_lines")
STATS_SCHEMA = ", ".join(f"{c} long" for c in COUNTS)
_UP, _LOW, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_SYMBOL, _PUNCT, _SPACE = b"#*$%&|<>", b"!?.,;:", b" \t\n\v\f\r"


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeated_positions(ids: np.ndarray, width: int = 3) -> int:
    """Words inside any window of ``width`` words that occurs twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key = ids[:n].astype(np.int64)
    for k in range(1, width):  # pairs are numbered anew each time, so keys stay under n * n
        key = np.unique(key, return_inverse=True)[1] * (int(ids.max()) + 1) + ids[k : k + n]
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(times[inverse] > 1)
    np.add.at(hit, starts, 1)
    np.add.at(hit, starts + width, -1)
    return int((np.cumsum(hit)[:-1] > 0).sum())


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """COUNTS of one UTF-8 text; null is empty."""
    text = text or b""
    words = text.split()  # bytes.split() cuts at exactly the six ASCII blanks
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup += line in seen
            seen.add(line)
    code_points = len(text) - _count(text, bytes(range(128, 192)))  # without continuation bytes
    upper = _count(text, _UP)
    return (
        len(words), code_points - _count(text, _SPACE), _count(text, _SYMBOL), dup, repeated_positions(ids), upper,
        upper + _count(text, _LOW), _count(text, _DIGIT), _count(text, _PUNCT), len(number), lines,
    )


def _stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([text_counts(t) for t in texts], columns=list(COUNTS), dtype="int64")


def text_stats(text: Column) -> Column:
    """Struct of COUNTS."""
    return F.pandas_udf(_stats, STATS_SCHEMA)(text.cast("binary"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def features(s: Column) -> dict[str, Column]:
    """What rules may test, from a struct of COUNTS."""
    share = lambda a, b: F.coalesce(F.try_divide(s[a].cast("double"), s[b].cast("double")), F.lit(0.0))
    return {
        "n_words": s["n_words"].cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "n_letters"),
        "digit_share": share("n_digits", "word_chars"),
        "punct_share": share("n_punct", "word_chars"),
        "distinct_share": share("n_distinct_words", "n_words"),
        "line_words": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Rule:
    """All of (feature, '>' or '<=', threshold) hold; the share is its precision on the pruning part."""

    terms: tuple[tuple[str, str, float], ...]
    precision: float

    def column(self, s: Column) -> Column:
        cols, out = features(s), F.lit(True)
        for name, op, t in self.terms:
            out = out & (cols[name] > t if op == ">" else cols[name] <= t)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {o} {t:.6g}" for n, o, t in self.terms)


def verdict(rules: list[Rule], s: Column) -> Column:
    """From a struct of COUNTS, the number of the first rule that fires, from 1; 0 if none does."""
    out = F.when(F.lit(False), F.lit(0))
    for k, r in enumerate(rules, 1):
        out = out.when(r.column(s), F.lit(k))
    return out.otherwise(F.lit(0))


def _covers(x: np.ndarray, names: list[str], terms) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for name, op, t in terms:
        v = x[:, names.index(name)]
        hit &= v > t if op == ">" else v <= t
    return hit


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], cuts: list[np.ndarray], max_terms: int) -> list:
    """Adds the term of the highest first-order gain until only positives are covered or nothing is gained."""
    terms: list = []
    hit = np.ones(len(x), bool)
    while len(terms) < max_terms:
        p, n = int(y[hit].sum()), int((~y[hit]).sum())
        if n == 0 or p == 0:
            break
        before, best = np.log2(p / (p + n)), (1e-9, None)
        for j, name in enumerate(names):
            v, pos = x[hit, j], y[hit]
            at = np.searchsorted(cuts[j], v, side="left")  # v <= cuts[k] for k >= at
            low_p = np.cumsum(np.bincount(at[pos], minlength=len(cuts[j]) + 1))[:-1]
            low_n = np.cumsum(np.bincount(at[~pos], minlength=len(cuts[j]) + 1))[:-1]
            for op, cp, cn in (("<=", low_p, low_n), (">", p - low_p, n - low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(cp > 0, cp * (np.log2(cp / (cp + cn)) - before), -np.inf)
                if len(gain) and gain[k := int(np.argmax(gain))] > best[0]:
                    best = (float(gain[k]), (name, op, float(cuts[j][k])))
        if best[1] is None:
            break
        terms.append(best[1])
        hit &= _covers(x, names, [best[1]])
    return terms


def learn_rules(
    x: np.ndarray, bad: np.ndarray, names: list[str], max_rules: int = 12, max_terms: int = 4, bins: int = 64,
    min_precision: float = 0.9, min_covered: int = 5, grow_share: float = 2 / 3,
) -> list[Rule]:
    """Sequential covering for the rows marked bad; rows come in a fixed random order."""
    if not len(x) or not bad.any() or bad.all():
        return []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins), method="lower")) for j in range(x.shape[1])]
    cuts = [np.unique(np.concatenate([c, np.quantile(x[bad, j], np.linspace(0, 1, bins), method="lower")])) for j, c in enumerate(cuts)]
    part = np.arange(len(x)) % 3 < round(3 * grow_share)
    left, rules = np.ones(len(x), bool), []
    while len(rules) < max_rules:
        g, h = left & part, left & ~part
        if not bad[g].any() or not bad[h].any():
            break
        terms = _grow(x[g], bad[g], names, cuts, max_terms)
        if not terms:
            break

        def worth(ts) -> tuple[float, float, int]:
            hit = _covers(x[h], names, ts)
            p, n = int(bad[h][hit].sum()), int((~bad[h][hit]).sum())
            return ((p - n) / max(p + n, 1), p / max(p + n, 1), p)

        while len(terms) > 1 and worth(terms[:-1])[0] >= worth(terms)[0]:
            terms = terms[:-1]
        _, precision, p = worth(terms)
        if precision < min_precision or p < min_covered:
            break
        rules.append(Rule(tuple(terms), precision))
        left &= ~_covers(x, names, terms)
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, **how) -> list[Rule]:
    """Learns from at most ``max_labelled`` labelled documents, those of the lowest hashed ids.

    Only their ids are broadcast and only their statistics (some numbers a
    row) come to the driver, so both are bounded by the parameter.
    """
    small_batches(docs.sparkSession)
    sample = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id").agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    named = features(F.col("s"))
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
        .select("doc_id", "_quality", text_stats(F.col("text")).alias("s"))
        .select("doc_id", "_quality", *(c.alias(f"f_{n}") for n, c in named.items()))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).toPandas()
    )
    x = rows[[f"f_{n}" for n in named]].to_numpy(dtype=float)
    return learn_rules(x, rows["_quality"].to_numpy() == 0, list(named), **how)


def _judged(docs: DataFrame, rules: list[Rule], text: str) -> tuple[DataFrame, Column, Column]:
    """docs with a struct of COUNTS in a reserved column, base_failed and rule_no."""
    small_batches(docs.sparkSession)
    # A Python result that several columns use must be made once: the counts are read from one struct.
    df, s = docs.withColumn(RESERVED, text_stats(F.col(text))), F.col(RESERVED)
    return df, base_failed(s["n_words"], s["n_repeat_words"]), verdict(rules, s)


def with_quality(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Adds COUNTS, base_failed, rule_no (0: none) and kept."""
    df, failed, number = _judged(docs, rules, text)
    made = {c: F.col(RESERVED)[c] for c in COUNTS} | {"base_failed": failed, "rule_no": number, "kept": ~failed & (number == 0)}
    return df.withColumns(made).drop(RESERVED)


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of docs that with_quality would keep, with docs' own columns."""
    df, failed, number = _judged(docs, rules, text)
    return df.where(~failed & (number == 0)).drop(RESERVED)

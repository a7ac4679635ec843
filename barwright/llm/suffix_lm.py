"""Language-model scores from a probabilistic suffix tree over words (operator 10).

The root is the smoothed unigram distribution.  A context of one or more
words that occurs ``least_context`` times is a candidate; it becomes a node if
its next-word distribution diverges enough from that of its longest proper
suffix (count times Kullback-Leibler divergence, and the divergence itself).
Next words that follow it ``least_pair`` times keep a discounted probability
of their own; the rest of the mass goes to the suffix's distribution over the
other words, so each node's distribution sums to one.  A token is scored by
the longest suffix of its history that is a node.

The thresholds are absolute counts, so the tree grows with the corpus.  Words
are numbered by falling count and each text is kept as its numbers; contexts
and pairs are counted by Spark.  A subtree is what ends in one word, so the
tree falls into as many classes of subtrees as are needed to keep each under
``max_pairs`` entries, which is what driver and tasks hold of it at once: with
more classes there are more passes over the numbers, and the same scores.
The list of frequent words is broadcast up to ``max_words``; beyond it tokens
get their numbers by a join.  Counts of rarer words are joined to the
documents that hold them.

Null and empty texts are just the end token.  A null doc_id counts as the
empty string when documents are dealt to training and held-out part.
Repeated rows count and are scored each.  Ties between equally frequent words
go by their hashes and change no score.  Very long texts are one row of
numbers.  With no training document every count is 0 and the root is all
there is.  Empty tables give empty tables.  Only doc_id and text are read;
other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrays, cut, small_batches

#: No word holds a blank, so this is no word's hash.
END = int(np.array(xxhash.xxh3_64_intdigest(b" end"), np.uint64).view(np.int64))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def tokens(texts, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens in a row, ends included; token counts."""
    if len(hashes) > 200_000:
        hashes.clear()
    parts, sizes = [], []
    end = np.array([END], np.int64)
    for t in texts:
        words = t.lower().split() if t else []  # bytes: A-Z only, six ASCII blanks
        parts += [np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)).view(np.int64), end]
        sizes.append(len(words) + 1)
    return (np.concatenate(parts) if parts else end[:0]), np.array(sizes, np.int64)


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in found])
    many = np.concatenate([c for _, c in found])
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, many, len(keys)).astype(np.int64)


def _added_up(keys: Iterator[np.ndarray], flush: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Counts of keys, added up in a task before they are dealt out."""
    found, held = [], 0
    for k in keys:
        found.append(np.unique(k, return_counts=True))
        held += len(found[-1][0])
        if held > flush:
            k, c = _merged(found)
            found, held = [(k, c)], len(k)
            if held > flush // 2:
                yield pd.DataFrame({"key": k, "n": c})
                found, held = [], 0
    if found:
        k, c = _merged(found)
        yield pd.DataFrame({"key": k, "n": c})


def word_counts(docs: DataFrame) -> DataFrame:
    """key (a word's hash), n: over all tokens of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        return _added_up(tokens(b["text"], hashes)[0] for b in batches)

    return docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """Contexts of one depth, as children of those one word shorter (the root: 0)."""

    child: np.ndarray  # sorted keys: number of the context without its first word * number of words + first word
    log_other: np.ndarray  # log10 of what multiplies the suffix's probability of a word not kept; 0 if the context is no node
    pair: np.ndarray  # sorted keys of nodes' kept words: context number * number of words + word
    gain: np.ndarray  # their log10 probability less that at the root


def _at(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in sorted keys; -1 for others."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class SuffixTree:
    n_words: int
    levels: list[Level] = field(default_factory=list)

    def walk(self, ids: np.ndarray, sizes: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each depth up to ``depth``, the tokens whose history has a context there, and the contexts' numbers."""
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at, context = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for d, level in enumerate(self.levels[:depth], 1):
            ok = place[at] >= d
            at, context = at[ok], context[ok]
            word = ids[at - d].astype(np.int64)
            found = np.where(word >= 0, _at(level.child, context * self.n_words + word), -1)
            at, context = at[found >= 0], found[found >= 0]
            yield at, context

    def gains(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What the tree adds to each token's log10 probability at the root; ids: -1 for words without a number."""
        out = np.zeros(len(ids))
        for level, (at, context) in zip(self.levels, self.walk(ids, sizes, len(self.levels)), strict=True):  # from short to long: a node refers to its suffix's value
            word = ids[at].astype(np.int64)
            kept = np.where(word >= 0, _at(level.pair, context * self.n_words + word), -1)
            out[at] += level.log_other[context]
            out[at[kept >= 0]] = level.gain[kept[kept >= 0]]
        return out

    def _suffix_gain(self, depth: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """What contexts of that depth (0: the root) add to words."""
        chain = []
        for level in reversed(self.levels[:depth]):
            chain.append(context)
            context = level.child[context] // self.n_words
        out = np.zeros(len(word))
        for level, c in zip(self.levels[:depth], reversed(chain), strict=True):
            kept = _at(level.pair, c * self.n_words + word)
            out = np.where(kept >= 0, level.gain[np.maximum(kept, 0)] if len(level.gain) else 0.0, out + level.log_other[c])
        return out

    def grow(self, child: np.ndarray, size: np.ndarray, key: np.ndarray, many: np.ndarray, log_p_of, p: "Plan", some: int = 1 << 17) -> None:
        """Adds a level.  child, size: candidates and their counts; key, many: pairs in order and their counts; log_p_of(words) at the root.

        A context's test needs nothing of others, so ``some`` pairs are in work at once.
        """
        log_other, pairs, gains = np.zeros(len(child)), [key[:0]], [np.zeros(0)]
        context = key // self.n_words
        cuts = np.unique(np.searchsorted(context, context[::some])) if len(key) else key[:0]
        for a, z in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
            own = slice(a, z)
            kept, gain, node, other = self._tested(child, size, context[own], key[own] % self.n_words, many[own], log_p_of, p)
            log_other[node] = other
            pairs.append(key[own][kept])
            gains.append(gain)
        self.levels.append(Level(child, log_other, np.concatenate(pairs), np.concatenate(gains)))

    def _tested(self, child, size, context, word, many, log_p_of, p):
        """Of whole contexts' pairs: which belong to nodes and what they gain, the nodes and their factors for other words."""
        base = log_p_of(word)
        q = 10.0 ** (base + self._suffix_gain(len(self.levels), child[context] // self.n_words, word))
        listed, at = np.unique(context, return_inverse=True)
        n = size[listed]
        total = lambda x: np.bincount(at, x, len(listed))
        share, own = many / n[at], np.maximum(many - p.discount, 0) / n[at]
        q_sum = np.minimum(total(q), 1 - 1e-12)
        # Divergence over the kept words and, as one class, all others.
        gone = np.maximum(1 - total(share), 0)
        kl = total(share * np.log(share / q)) + np.where(gone > 0, gone * np.log(np.maximum(gone, 1e-300) / (1 - q_sum)), 0)
        node = (kl >= p.divergence) & (n * kl >= p.evidence * np.bincount(at, minlength=len(listed)))
        kept = node[at]
        other = np.log10(np.maximum(1 - total(own), 1e-12) / (1 - q_sum))
        return kept, np.log10(own[kept]) - base[kept], listed[node], other[node]


@dataclass(frozen=True)
class Plan:
    """Thresholds of the tree, and what may be held in memory at once."""

    depth: int = 3
    least_word: int = 32
    least_context: int = 256
    least_pair: int = 8
    discount: float = 0.75
    divergence: float = 1e-3
    evidence: float = 2.0
    max_words: int = 4_000_000
    max_pairs: int = 4_000_000


def numbered_words(counts: DataFrame, least: int) -> DataFrame:
    """key, n, id: words that occur ``least`` times, numbered by falling count."""
    parts = cut(counts.where(F.col("n") >= least).orderBy(F.desc("n"), "key").withColumn("part", F.spark_partition_id()), "words-sorted")
    sizes = parts.groupBy("part").count()
    offset = sizes.select("part", (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("offset"))  # a row for each partition
    place = F.row_number().over(W.partitionBy("part").orderBy(F.desc("n"), "key"))
    return parts.join(F.broadcast(offset), "part").select("key", "n", (F.col("offset") + place - 1).cast("int").alias("id"))


NUMBERED = "n_tokens long, n_frequent long, base double, ids array<int>, rare array<long>, times array<long>"


def _numbered_by_broadcast(docs: DataFrame, words: DataFrame, log_count, low: float) -> DataFrame:
    key, ident, n = arrays(words.select("key", "id", "n"))  # max_words at most
    order = np.argsort(key)
    given = docs.sparkSession.sparkContext.broadcast((key[order], ident[order], log_count(n[order].astype(np.float64))))

    class Numbers(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = k = len(self.hash)
            self.hash.append(xxhash.xxh3_64_intdigest(word))
            return k

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        keys, ids, log_p = given.value
        numbers = Numbers()
        numbers.hash = []
        end = np.array([END], np.int64)
        for texts in batches:
            if len(numbers) > 200_000:
                numbers.clear()
                numbers.hash = []
            local = [np.fromiter(map(numbers.__getitem__, w := (t.lower().split() if t else [])), np.int64, len(w)) for t in texts]
            known = np.append(np.array(numbers.hash, np.uint64).view(np.int64), end)
            at = _at(keys, known)
            id_of, p_of = np.where(at >= 0, ids[at], -1).astype(np.int32) if len(ids) else np.full(len(known), -1, np.int32), np.where(at >= 0, log_p[at], low) if len(ids) else np.full(len(known), low)
            rows = []
            for words in local:
                k = np.append(words, len(known) - 1)
                i = id_of[k]
                rare, times = np.unique(known[k[i < 0]], return_counts=True)
                rows.append((len(k), int((i >= 0).sum()), float(p_of[k].sum()), i, rare, times))
            yield pd.DataFrame(rows, columns=["n_tokens", "n_frequent", "base", "ids", "rare", "times"])

    made = docs.select("doc_id", "held_out", F.pandas_udf(run, NUMBERED)(F.col("text").cast("binary")).alias("s"))
    return made.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "s.*")


def _numbered_by_join(docs: DataFrame, words: DataFrame, log_count: Column, low: float) -> DataFrame:
    """The same for any number of frequent words: tokens meet them by their hashes."""
    docs = cut(docs.withColumn("row", F.monotonically_increasing_id()), "rows")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for b in batches:
            h, sizes = tokens(b["text"], hashes)
            yield pd.DataFrame({"row": np.repeat(b["row"].to_numpy(), sizes), "place": np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes), "key": h})

    every = cut(docs.select("row", F.col("text").cast("binary").alias("text")).mapInPandas(run, "row long, place int, key long"), "tokens")
    met = every.join(words.withColumn("p", log_count), "key", "left")
    rare = met.where("id IS NULL").groupBy("row", "key").agg(F.count("*").alias("t")).groupBy("row").agg(F.collect_list("key").alias("rare"), F.collect_list("t").alias("times"))
    ids = met.groupBy("row").agg(
        F.count("*").alias("n_tokens"), F.count("id").alias("n_frequent"), F.sum(F.coalesce("p", F.lit(low))).alias("base"),
        F.sort_array(F.collect_list(F.struct("place", F.coalesce("id", F.lit(-1)).alias("id")))).getField("id").alias("ids"),
    )
    none = F.array().cast("array<long>")
    out = docs.select("row", "doc_id", "held_out").join(ids, "row").join(rare, "row", "left")
    return out.withColumns({"rare": F.coalesce("rare", none), "times": F.coalesce("times", none)})


def _flat(ids: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.int32), *ids]), np.array([len(x) for x in ids], np.int64)


def _counted(texts: DataFrame, keys_of) -> DataFrame:
    """Counts of keys_of(ids, sizes) over all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _added_up(keys_of(*_flat(b["ids"])) for b in batches)

    return texts.select("ids").mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def first_pairs(texts: DataFrame, n_words: int, n_contexts: int, least_pair: int) -> DataFrame:
    """key (word before * n_words + word), n: pairs whose first word is one of the ``n_contexts`` most frequent."""

    def keys_of(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        inside = np.ones(len(ids), bool)
        inside[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
        at = np.flatnonzero(inside & (ids >= 0))
        before = ids[at - 1].astype(np.int64)
        ok = (before >= 0) & (before < n_contexts)
        return before[ok] * n_words + ids[at[ok]]

    return _counted(texts, keys_of).where(F.col("n") >= least_pair)


def _columns(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two whole-number columns, by the first."""
    a, b = arrays(df)
    order = np.argsort(a)
    return a[order], b[order]


def grow_class(texts: DataFrame, pairs: DataFrame, words: DataFrame, n_words: int, own: int, classes: int, log_count, p: Plan) -> SuffixTree:
    """The subtrees of the contexts whose last word is of class ``own`` of ``classes``; each depth is one pass over the numbers."""
    of = lambda c: F.pmod(c, F.lit(classes)) == own
    before, word = F.floor(F.col("key") / n_words).cast("long"), F.pmod("key", F.lit(n_words)).cast("long")
    mine = pairs.where(of(before))
    tree = SuffixTree(n_words)
    key, many = _columns(mine.select("key", "n"))
    if not len(key):
        return tree
    used = mine.select(before.alias("id")).unionByName(mine.select(word.alias("id"))).distinct()
    ids, counts = _columns(words.select(F.col("id").cast("long").alias("id"), "n").join(used, "id"))
    log_p_of = lambda w: log_count(counts[np.searchsorted(ids, w)].astype(np.float64))
    first = np.unique(key // n_words)  # the contexts of one word
    child, size = first, counts[np.searchsorted(ids, first)].astype(np.float64)
    # Contexts of two words: pairs whose second word is of this class.
    long_key, long_n = _columns(pairs.where(of(word) & (F.col("n") >= p.least_context)).select("key", "n"))
    at = _at(first, long_key % n_words)
    long_key, long_n = (at * n_words + long_key // n_words)[at >= 0], long_n[at >= 0]
    key = np.searchsorted(first, key // n_words) * n_words + key % n_words
    tree.grow(child, size, key, many, log_p_of, p)
    for depth in range(2, p.depth + 1):
        order = np.argsort(long_key)
        child, size = long_key[order], long_n[order].astype(np.float64)
        if not len(child):
            break
        trial = SuffixTree(n_words, [*tree.levels, Level(child, np.zeros(len(child)), child[:0], size[:0])])
        given = texts.sparkSession.sparkContext.broadcast(trial)

        def keys_of(ids: np.ndarray, sizes: np.ndarray, depth=depth, given=given) -> np.ndarray:
            """Pairs as keys from 0 on, contexts of one word more as negative ones."""
            for at, context in given.value.walk(ids, sizes, depth):
                pass
            word = ids[at].astype(np.int64)
            pair = (context * n_words + word)[word >= 0]
            far = (np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[at] > depth
            first = ids[at[far] - depth - 1].astype(np.int64)
            return np.concatenate([pair, (-1 - (context[far] * n_words + first))[first >= 0]])

        enough = F.when(F.col("key") < 0, F.lit(p.least_context)).otherwise(F.lit(p.least_pair))
        key, many = _columns(_counted(texts, keys_of).where(F.col("n") >= enough))
        long_key, long_n = -1 - key[key < 0], many[key < 0]
        tree.grow(child, size, key[key >= 0], many[key >= 0], log_p_of, p)
    return tree


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def score_documents(docs: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_node_tokens.  how: see Plan."""
    p = Plan(**how)
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    counts = cut(word_counts(docs.where("NOT held_out")), "words")
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
    floor = float(np.log10(total + 0.5 * (distinct + 1)))
    log_count = lambda n: np.log10(n + 0.5) - floor
    low = float(log_count(0.0))
    words = cut(numbered_words(counts, p.least_word), "numbered-words")
    n_words, n_contexts = (int(x or 0) for x in words.agg(F.count("*"), F.count_if(F.col("n") >= p.least_context)).first())
    if n_words <= p.max_words:
        made = _numbered_by_broadcast(docs, words, log_count, low)
    else:
        made = _numbered_by_join(docs, words, F.log10(F.col("n") + 0.5) - F.lit(floor), low)
    made = cut(made, "numbers")
    texts = made.where("NOT held_out")
    pairs = cut(first_pairs(texts, max(n_words, 1), n_contexts, p.least_pair), "pairs")
    classes = max(1, -(-pairs.count() // p.max_pairs))
    gains = None
    for own in range(classes):
        tree = grow_class(texts, pairs, words, max(n_words, 1), own, classes, log_count, p)
        shared = spark.sparkContext.broadcast(tree)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                ids, sizes = _flat(b["ids"])
                more = shared.value.gains(ids, sizes)
                first = np.cumsum(sizes) - sizes  # no text is without its end token
                yield pd.DataFrame({"row": b["row"], "more": np.add.reduceat(more, first), "in_tree": np.add.reduceat((more != 0).astype(np.int64), first)})

        part = cut(made.select("row", "ids").mapInPandas(run, "row long, more double, in_tree long"), "gains")
        gains = part if gains is None else gains.unionByName(part)
    rare = made.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("key"), F.col("r.times").alias("times"))
    # In ``base`` each rare word stands as one with count 0.
    up = F.log10(F.col("n") + 0.5) - F.log10(F.lit(0.5))
    known = rare.join(counts, "key").select("row", F.col("times").alias("known"), (up * F.col("times")).alias("up"), F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("in_tree"))
    none = gains.select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("up"), "more", "in_tree")
    sums = known.unionByName(none).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("known", "up", "more", "in_tree")))
    out = made.select("row", "doc_id", "held_out", "n_tokens", "n_frequent", "base").join(sums, "row")
    base = F.col("base") + F.col("up")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_frequent") + F.col("known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + F.col("more")).alias("score"), F.col("in_tree").alias("n_node_tokens"),
    )

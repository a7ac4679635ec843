"""SentencePiece encoding and decoding by suffix-array matching (operator 8).

Two characters that stand side by side in no piece never end up in one piece,
so a text falls into chunks between such characters, which are encoded on
their own.  The chunks of a batch not yet known are joined into one text and
its suffixes sorted as far as the longest piece; every piece is found by
binary search as a range of suffixes; the ranges' members are edges (start,
end, piece), sorted by end and relaxed from left to right.  A chunk longer
than a batch is indexed a window at a time, and relaxing goes on across the
windows' borders.

The sum of scores doesn't decide in a BPE model, so relaxing asks instead
whether the merges, done in order of score, would leave the edge's piece
beside the last piece of the best path to its start.  That holds for exactly
one edge into each position, and its path is what merging pair by pair
gives.  Characters that no piece has become one byte piece for each byte.

Null texts have null ids, empty ones no ids.  Ties in the merge order go to
the left.  A literal U+2581 is decoded as a blank, as the format has it; all
other texts come back unchanged.  Very long texts take some bytes a character
beyond the text itself, whether or not they can be cut.  Repeated rows are
encoded alike, empty tables give empty tables, and as everything here is a
column expression, other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import give_back

_BLANK = "▁"
_STEP = 3  # characters of 21 bits in a search key
#: Characters of the chunks that a task keeps encoded (some 20 bytes each), the longest such chunk, and characters indexed at once.
KNOWN_CHARS, KNOWN_LENGTH, BATCH_CHARS = 1 << 21, 64, 1 << 17


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _merged_run(length: int, sizes: set[int]) -> list[int]:
    """What a run of blanks becomes if the leftmost pair that has a piece always merges first."""
    parts = [1] * length
    while (k := next((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in sizes), None)) is not None:
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


def check_model(serialized: bytes) -> None:
    """Raises ValueError for a model whose ids this module wouldn't give: not BPE with bytes for what no piece covers, texts changed first, or pieces of the user's own."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto.FromString(serialized)
    kind, norm = m.trainer_spec, m.normalizer_spec
    wrong = [
        name for name, bad in (
            ("model isn't BPE", kind.model_type != proto.TrainerSpec.BPE), ("no byte fallback", not kind.byte_fallback),
            ("texts are normalised", bool(norm.precompiled_charsmap)), ("blanks are removed", norm.remove_extra_whitespaces),
            ("no blank is put first", not norm.add_dummy_prefix), ("blanks aren't marked", not norm.escape_whitespaces),
            ("blanks come last in pieces", kind.treat_whitespace_as_suffix), ("pieces of the user's own", any(p.type == p.USER_DEFINED for p in m.pieces)),
        ) if bad
    ]
    if wrong:
        raise ValueError(f"this model can't be reproduced: {', '.join(wrong)}")


class Pieces:
    """What encoding needs of a model, as arrays."""

    def __init__(self, model: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model)
        check_model(m.serialized_model_proto())
        n = m.vocab_size()
        text = [m.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int32)
        self.out: list[bytes] = [b""] * n
        usable = []
        for i, p in enumerate(text):
            if m.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.out[i] = bytes([int(p[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                usable.append(i)
                self.out[i] = p.replace(_BLANK, " ").encode()
        self._borders([text[i] for i in usable])
        self.ids = np.array(usable, np.int32)
        self.length = np.array([len(text[i]) for i in usable], np.int64)
        self.codes = [_codes(text[i]) for i in usable]
        self.longest = int(self.length.max())
        self._merges(text, [m.get_score(i) for i in range(n)], usable, n)

    def _borders(self, pieces: list[str]) -> None:
        """Classes of characters, and which classes stand side by side in a piece: others never meet in one."""
        usual = sorted({c for p in pieces for c in p if ord(c) < 0x250} | {_BLANK})
        self.kind = np.zeros(0x110000, np.int16)  # 0: in no piece
        self.kind[[ord(c) for p in pieces for c in p]] = 1  # 1: all others
        self.kind[[ord(c) for c in usual]] = np.arange(2, len(usual) + 2)
        self.kinds = len(usual) + 2
        self.meet = np.zeros(self.kinds * self.kinds, bool)
        for p in pieces:
            k = self.kind[_codes(p)].astype(np.int64)
            self.meet[k[:-1] * self.kinds + k[1:]] = True

    def starts(self, codes: np.ndarray) -> np.ndarray:
        """Whether no piece can reach across the border before each character."""
        k = self.kind[codes].astype(np.int32)
        return np.append(True, ~self.meet[k[:-1] * self.kinds + k[1:]]) if len(k) else np.zeros(0, bool)

    def _merges(self, text: list[str], score: list[float], usable: list[int], n: int) -> None:
        """rank: order of merging (0: single characters); parts: the two pieces last merged; joined: all pairs that may merge."""
        order = sorted((i for i in usable if len(text[i]) > 1), key=lambda i: (-score[i], len(text[i]), i))
        number = {text[i]: i for i in usable}
        self.rank = np.zeros(n, np.int64)
        self.rank[order] = np.arange(1, len(order) + 1)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        pairs: dict[int, int] = {}
        for i in order:
            p = text[i]
            for k in range(1, len(p)):
                a, b = number.get(p[:k]), number.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
            # The last merge of the piece's own encoding.
            symbols = [number.get(c, -1) for c in p]
            while len(symbols) > 2:
                found = [(self.rank[number[text[a] + text[b]]], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a >= 0 and b >= 0 and text[a] + text[b] in number]
                if not found:
                    break
                k = min(found)[1]
                symbols[k : k + 2] = [number[text[symbols[k]] + text[symbols[k + 1]]]]
            if len(symbols) == 2 and min(symbols) >= 0:
                self.left[i], self.right[i] = symbols
        self.n = n
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = self.rank[[pairs[k] for k in self.pair_keys.tolist()]] if pairs else np.zeros(0, np.int64)
        # Runs of blanks whose pieces all have one score merge from the left.
        runs = {len(text[i]): i for i in usable if not text[i].strip(_BLANK)}
        self.run = np.zeros(n, np.int64)
        size = max(runs, default=0) + 1
        self.run_ok = np.zeros((size, size), bool)
        if len({score[i] for k, i in runs.items() if k > 1}) == 1:
            self.run[list(runs.values())] = list(runs)
            for a in runs:
                for b in runs:
                    self.run_ok[a, b] = _merged_run(a + b, set(runs)) == [a, b]
        # Verdicts by pair, in slots that later pairs may take.
        self.slot_key, self.slot_ok = np.full(1 << 21, -1, np.int32 if n * n < 1 << 31 else np.int64), np.zeros(1 << 21, bool)

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging in order leaves piece a beside piece b."""
        key = a * self.n + b
        slot = (a * 1_000_003 + b * 7919) & (len(self.slot_key) - 1)
        ok = self.slot_ok[slot]
        new = np.flatnonzero(self.slot_key[slot] != key)
        if len(new):
            ok[new] = self._apart(a[new], b[new])
            self.slot_key[slot[new]], self.slot_ok[slot[new]] = key[new], ok[new]
        return ok

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undoes the later of both pieces' last merges, as long as no merge across the border would have come before it."""
        a, b = a.copy(), b.copy()
        ok = (self.run[a] == 0) | (self.run[b] == 0) | self.run_ok[self.run[a], self.run[b]]
        limit = np.full(len(a), np.iinfo(np.int64).max)
        at = np.flatnonzero((self.run[a] == 0) | (self.run[b] == 0))
        a, b, limit = a[at], b[at], limit[at]
        while len(at):
            key = a * self.n + b
            k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            # A merge across the border has its own rank; at equal rank the one further left comes first.
            clash = (self.pair_keys[k] == key) & (self.pair_rank[k] < limit)
            ok[at[clash]] = False
            go = ~clash
            a, b, at, limit = a[go], b[go], at[go], limit[go]
            ra, rb = self.rank[a], self.rank[b]
            undo_a = (ra > rb) & (ra > 0)
            undo_b = ~undo_a & (rb > 0)
            limit = np.where(undo_a, ra, np.where(undo_b, rb + 1, limit))
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            go = (undo_a | undo_b) & (a >= 0) & (b >= 0)
            a, b, at, limit = a[go], b[go], at[go], limit[go]
        return ok

    # --- the batch's text ------------------------------------------------

    def _suffixes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in order of the following characters, as many as the longest piece; keys of _STEP characters by position."""
        n = len(codes)
        padded = np.concatenate([codes + 1, np.zeros(_STEP, np.int64)])
        key = padded[:n]
        for k in range(1, _STEP):
            key = (key << 21) | padded[k : n + k]
        distinct, rank = np.unique(key, return_inverse=True)
        size = _STEP
        while size < self.longest and len(distinct) < n:
            after = np.zeros(n, np.int64)
            after[: n - size] = rank[size:] + 1
            distinct, rank = np.unique(rank * np.int64(n + 1) + after, return_inverse=True)
            size *= 2
        return np.argsort(rank, kind="stable"), key

    def _ranges(self, order: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece, the suffixes in ``order`` that start with it: by binary search, _STEP characters at a time."""
        n = len(order)
        lo, hi = np.zeros(len(self.codes), np.int64), np.full(len(self.codes), n, np.int64)
        key = np.concatenate([key, [0]])
        for depth in range(0, self.longest, _STEP):
            live = np.flatnonzero((self.length > depth) & (lo < hi))
            if not len(live):
                break
            low, high = self._search[depth // _STEP]
            lo[live], hi[live] = (
                self._bisect(order, key, depth, lo[live], hi[live], target[live]) for target in (low, high)
            )
        return lo, hi

    @staticmethod
    def _bisect(order: np.ndarray, key: np.ndarray, depth: int, lo: np.ndarray, hi: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First suffix of each range whose key at that depth isn't under the target."""
        lo, hi, n = lo.copy(), hi.copy(), len(order)
        while (searching := lo < hi).any():
            mid = (lo + hi) >> 1
            under = key[np.minimum(order[np.minimum(mid, n - 1)] + depth, n)] < target
            lo = np.where(searching & under, mid + 1, lo)
            hi = np.where(searching & ~under, mid, hi)
        return lo

    @property
    def _search(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Lowest key, and lowest key beyond, of what each piece has at each depth."""
        if not hasattr(self, "_keys"):
            self._keys = []
            for depth in range(0, self.longest, _STEP):
                low, high = [], []
                for c in self.codes:
                    if len(c) <= depth:
                        low.append(0)
                        high.append(0)
                        continue
                    part = (c[depth : depth + _STEP] + 1).tolist()
                    free = 21 * (_STEP - len(part))
                    value = 0
                    for x in part:
                        value = (value << 21) | x
                    low.append(value << free)
                    high.append((value + 1) << free)
                self._keys.append((np.array(low, np.int64), np.array(high, np.int64)))
        return self._keys

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and id of every occurrence of a piece; id -1 for a character that no piece is, which stands for its bytes."""
        order, key = self._suffixes(codes)
        lo, hi = self._ranges(order, key)
        many = np.maximum(hi - lo, 0)
        # There are several times as many edges as characters, so their columns are narrow.
        piece = np.repeat(np.arange(len(many), dtype=np.int32), many)
        spot = np.repeat((lo - np.cumsum(many) + many).astype(np.int32), many)
        spot += np.arange(len(spot), dtype=np.int32)
        start = order.astype(np.int32)[spot]
        size = self.length.astype(np.int32)[piece]
        known = np.zeros(len(codes), bool)
        known[start[size == 1]] = True
        lone = np.flatnonzero(~known).astype(np.int32)
        return (
            np.concatenate([start, lone]), np.concatenate([size, np.ones(len(lone), np.int32)]),
            np.concatenate([self.ids[piece], np.full(len(lone), -1, np.int32)]),
        )

    def _relax(self, start: np.ndarray, end: np.ndarray, ident: np.ndarray, level: np.ndarray, first: np.ndarray, last: np.ndarray, begun: np.ndarray) -> None:
        """Goes through the edges by ``level`` (their ends); first: whether an edge starts its chunk.  Fills last and begun, the piece that ends at a position and its length."""
        by_end = np.lexsort((start, level))
        start, end, ident, level, first = start[by_end], end[by_end], ident[by_end], level[by_end], first[by_end]
        borders = np.flatnonzero(np.diff(level, prepend=level.dtype.type(-1)))
        for a, b in zip(borders.tolist(), [*borders[1:].tolist(), len(level)], strict=True):
            s, e, p, fresh = start[a:b], end[a:b], ident[a:b], first[a:b]
            before = np.where(fresh, -1, last[s])
            ok = fresh | (before > -2)
            # Nothing merges with a character that has no piece.
            test = np.flatnonzero(ok & ~fresh & (before >= 0) & (p >= 0))
            ok[test] = self.stay_apart(before[test].astype(np.int64), p[test].astype(np.int64))
            last[e[ok]], begun[e[ok]] = p[ok], (e - s)[ok]

    def encode_chunks(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of each chunk, blanks given as U+2581."""
        size = np.array([len(c) for c in chunks], np.int64)
        codes = _codes("".join(chunks))
        first = np.cumsum(size) - size
        last, begun = np.full(len(codes) + 1, -2, np.int32), np.zeros(len(codes) + 1, np.int32)
        if len(chunks) == 1 and len(codes) > BATCH_CHARS:
            for w in range(0, len(codes), BATCH_CHARS):
                start, length, ident = self._edges(codes[w : w + BATCH_CHARS + self.longest])
                own = (start < BATCH_CHARS) & (start + length <= len(codes) - w)
                start, end = w + start[own].astype(np.int64), w + (start + length)[own].astype(np.int64)
                self._relax(start, end, ident[own], end, start == 0, last, begun)
        else:
            chunk = np.repeat(np.arange(len(chunks), dtype=np.int32), size)
            start, length, ident = self._edges(codes)
            begin, stop = first.astype(np.int32), (first + size).astype(np.int32)
            end, of = start + length, chunk[start]
            inside = end <= stop[of]  # suffixes run on into the next chunk
            start, end, ident, of = start[inside], end[inside], ident[inside], of[inside]
            self._relax(start, end, ident, end - begin[of], start == begin[of], last, begun)
        return self._paths(codes, first, size, last, begun)

    def _paths(self, codes, first, size, last, begun) -> list[np.ndarray]:
        """Follows all chunks' edges back from their ends at once."""
        used = np.zeros(len(codes) + 1, bool)
        at = (first + size)[size > 0]
        floor = first[size > 0]
        while len(at):
            used[at] = True
            at = at - begun[at]
            go = at > floor
            at, floor = at[go], floor[go]
        ends = np.flatnonzero(used)
        ids = last[ends]
        width = np.ones(len(ends), np.int64)
        lone = np.flatnonzero(ids < 0)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes[ends[lone] - 1].tolist()]
        width[lone] = [len(x) for x in raw]
        flat = np.repeat(ids, width)
        spot = np.cumsum(width) - width
        for k, x in zip(lone.tolist(), raw, strict=True):
            flat[spot[k] : spot[k] + len(x)] = self.byte_id[list(x)]
        bounds = np.append(spot, len(flat))[np.searchsorted(ends, first + size, side="right")]
        return np.split(flat, bounds[:-1])

    # --- texts -----------------------------------------------------------

    def encoder(self) -> "Encoder":
        return Encoder(self)

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        return Encoder(self).encode(texts)

    def decode(self, ids) -> str:
        return text_of(ids, self.out)


class Encoder:
    """Encodes texts; short chunks met before aren't indexed again."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, bytes] = {}  # ids as bytes, as an array object is several times as large
        self.chars = 0

    def _add(self, fresh: list[str], into: dict[str, bytes]) -> None:
        at = 0
        while at < len(fresh):
            to, chars = at, 0
            while to < len(fresh) and (to == at or chars + len(fresh[to]) <= BATCH_CHARS):
                chars += len(fresh[to])
                to += 1
            made = self.pieces.encode_chunks(fresh[at:to])
            into.update(zip(fresh[at:to], (ids.tobytes() for ids in made), strict=True))
            at = to

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        out: list[np.ndarray | None] = []
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to] or "") <= 4 * BATCH_CHARS):
                chars += len(texts[to] or "")
                to += 1
            out += self._some(texts[at:to])
            at = to
            give_back()
        return out

    def _some(self, texts: list[str | None]) -> list[np.ndarray | None]:
        whole = [_BLANK + t.replace(" ", _BLANK) if t else "" for t in texts]
        text = "".join(whole)
        starts = np.cumsum([0] + [len(t) for t in whole])
        begins = np.append(self.pieces.starts(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)), True)
        begins[starts] = True
        bounds = np.flatnonzero(begins)
        ends = bounds.tolist()
        if self.chars > KNOWN_CHARS:
            self._forget()
        cut = [text[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        found = list(map(self.known.get, cut))
        fresh = {c for c, f in zip(cut, found, strict=True) if f is None}
        short, long = [c for c in fresh if len(c) <= KNOWN_LENGTH], {}
        self._add(short, self.known)
        self._add([c for c in fresh if len(c) > KNOWN_LENGTH], long)
        self.chars += sum(map(len, short))
        if fresh:
            found = [f if f is not None else self.known[c] if c in self.known else long[c] for c, f in zip(cut, found, strict=True)]
        borders = np.searchsorted(bounds, starts).tolist()
        return [None if t is None else np.frombuffer(b"".join(found[a:b]), np.int32) for t, a, b in zip(texts, borders, borders[1:], strict=False)]


def load(model: str) -> Pieces:
    """Made anew for each task (a second), so that idle workers don't hold it."""
    return Pieces(model)


def outputs(model: str) -> list[bytes]:
    """What each piece decodes to."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    silent = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_unused(i)
    piece = lambda i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(_BLANK, " ").encode()
    return [b"" if silent(i) else piece(i) for i in range(m.vocab_size())]


def text_of(ids, out: list[bytes]) -> str:
    return b"".join([out[i] for i in ids]).decode("utf-8", "replace")[1:]


def encode(text: Column, model: str) -> Column:
    """array<int> of piece ids."""

    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(load(model))
        give_back()
        for texts in batches:
            yield pd.Series(encoder.encode(texts.tolist()), dtype=object)
        del encoder
        give_back()

    return F.pandas_udf(make, "array<int>")(text)


def decode(ids: Column, model: str) -> Column:
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        out = outputs(model)
        for rows in batches:
            yield pd.Series([None if r is None else text_of(r.tolist(), out) for r in rows], dtype=object)

    return F.pandas_udf(make, "string")(ids)


def encode_checked(text: Column, model: str) -> Column:
    """Struct of ids and round_trip: whether they decode to the text, blanks for U+2581.  One Python worker does both."""

    def make(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(load(model))
        out = encoder.pieces.out
        give_back()
        for texts in batches:
            ids = encoder.encode(texts.tolist())
            same = [t is None if i is None else text_of(i.tolist(), out) == t.replace(_BLANK, " ") for t, i in zip(texts, ids, strict=True)]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "round_trip": pd.Series(same, dtype=bool)})
            del texts, ids, same
        del encoder, out
        give_back()

    return F.pandas_udf(make, "ids array<int>, round_trip boolean")(text)

"""SentencePiece encoding and decoding with suffix-array matching.

The distinct units of a batch (a run of spaces with what follows up to the next space) are
joined to one text, whose suffix array is searched for every piece of the vocabulary; a piece's
range gives all places where it occurs.  These occurrences are the edges of a lattice.  Sorted by
the position where they end, they are relaxed one position at a time for all units at once.

For a unigram model the relaxation keeps the best sum of scores.  For a BPE model the greatest
sum is not what merging gives, so it keeps the one edge that merging could have made: with l the
last piece of the best segmentation up to an edge's start, the edge's piece r holds if merging
"lr" by itself gives just (l, r).  That is decided from the order of merges, and by induction the
result is the segmentation that merging in order of scores makes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import release, ship
from .suffixes import lookup, order_of, per_number, rolling, rolling_rows, spread_ranges
from .textcodes import U64

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: A vocabulary file above this isn't broadcast but refused.
MODEL_BYTES = 64 << 20
SPACE = "▁"
#: Characters of text handled at once, of new units in one suffix array, of a stretch of a long unit.
BATCH, SLICE, STRETCH = 1 << 20, 1 << 19, 1 << 18
#: Units above this many characters are relaxed one by one.
SHORT = 256
#: Units whose ids a worker keeps (twice as many at most), and verdicts on pairs of pieces.
KEEP, VERDICTS = 1 << 17, 1 << 17
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    """pieces: (text, score, type) by id."""

    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    dummy_prefix: bool = True
    surface: list[bytes] = field(default_factory=list)

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, kind, dummy = [], UNIGRAM, True
        for number, value in _fields(data):
            if number == 1:
                p = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0], p[3]))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                dummy = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models with the identity normalizer that keep white space are supported")
        if kind not in (UNIGRAM, BPE) or any(t == USER for _, _, t in pieces):
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        return cls(pieces, kind, dummy)


class Tokenizer:
    """Tables of a model.  Inside, pieces have ranks: single characters first, then longer pieces
    from the highest score down; ``ids`` leads back."""

    def __init__(self, model: Model):
        self.model = model
        usable = [(t, s, i) for i, (t, s, k) in enumerate(model.pieces) if k == NORMAL and t]
        single = [p for p in usable if len(p[0]) == 1]
        longer = sorted((p for p in usable if len(p[0]) > 1), key=lambda p: (-p[1], p[2]))
        every = single + longer
        self.n_single = len(single)
        self.text = [t for t, _, _ in every]
        self.ids = np.array([i for _, _, i in every], np.int32)
        self.scores = np.array([s for _, s, _ in every])
        self.lengths = np.array([len(t) for t in self.text], np.int64)
        self.rank = {t: r for r, t in enumerate(self.text)}
        self.bytes_of = {int(t[3:5], 16): i for i, (t, _, k) in enumerate(model.pieces) if k == BYTE}
        self.unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
        n = len(every)
        self.left = np.arange(n)
        self.right = np.arange(n)
        reachable = np.ones(n, np.bool_)
        self.bpe = model.kind == BPE
        self.runs_last = False
        if self.bpe:
            for r in range(self.n_single, n):
                parts = self.merge(self.text[r], r)
                reachable[r] = len(parts) == 2
                if len(parts) == 2:
                    self.left[r], self.right[r] = parts
            # Pieces that are runs of spaces only: where all merge after any other piece, they are
            # left out of the lattice and made of the single spaces that remain.
            spaces = np.array([set(t) == {SPACE} for t in self.text]) & (self.lengths > 1)
            others = self.scores[(self.lengths > 1) & ~spaces]
            if spaces.any() and (not len(others) or self.scores[spaces].max() < others.min()) and not any(SPACE * 2 in t for t in (self.text[i] for i in np.flatnonzero(~spaces))):
                self.runs_last = True
                reachable &= ~spaces
            whole = np.flatnonzero(reachable & (np.arange(n) >= self.n_single))
            pair = self.left[whole] * n + self.right[whole]
            order = np.argsort(pair)
            self.pairs, self.pair_rank = pair[order], whole[order]
            self.pair_of = dict(zip(self.pairs.tolist(), self.pair_rank.tolist(), strict=True))
            self.maybe = np.zeros(1 << 20, np.bool_)  # most pairs are no piece: asked first
            self.maybe[self._slot(self.pairs)] = True
        points = np.array([ord(c) for t in self.text for c in t], np.int64)
        self.alphabet, code = np.unique(points, return_inverse=True)
        # Pieces in the order of their texts, which is also that of their codes in any batch.
        self.sorted = np.array(sorted(np.flatnonzero(reachable).tolist(), key=self.text.__getitem__), np.int64)
        self.longest = int(self.lengths[self.sorted].max(initial=1))
        self.piece_codes = np.zeros((len(self.sorted), self.longest), np.int32)  # 0: past the end
        start = np.cumsum(self.lengths) - self.lengths
        for i in range(self.longest):
            has = self.lengths[self.sorted] > i
            self.piece_codes[has, i] = code[start[self.sorted[has]] + i] + 1
        mergeable = {c for t in self.text[self.n_single :] for c in t}
        # A unit is a run of spaces and what follows; a newline that no longer piece holds ends one too.
        self.unit = re.compile(" *[^ ]+| +" if "\n" in mergeable else " *[^ \n]+| +|\n+")
        self.code_of: np.ndarray | None = None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.space_runs: dict[int, list[int]] = {}
        self.verdicts: dict[int, bool] = {}

    def merge(self, text: str, below: int | None = None) -> list[int]:
        """Ranks of the pieces that merging makes of a text, best score first, then leftmost.
        Characters that are no piece have rank -1 - code point.  ``below``: merge only to lower ranks."""
        parts = [self.rank.get(c, -1 - ord(c)) for c in text]
        limit = len(self.text) if below is None else below
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and parts[i] >= 0 and parts[j] >= 0:
                r = self.rank.get(self.text[parts[i]] + self.text[parts[j]])
                if r is not None and r < limit:
                    heapq.heappush(heap, (-self.scores[r], i, r, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        gone = -(1 << 40)
        while heap:
            _, i, r, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = r, gone
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p != gone]

    @staticmethod
    def _slot(pair: np.ndarray) -> np.ndarray:
        return ((pair * 0x9E3779B1) >> 12) & 0xFFFFF

    def _holds(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the two pieces' joined text gives just the two."""
        n = len(self.text)
        out = np.ones(len(left), np.bool_)
        live = np.flatnonzero((left >= 0) & (left < n) & (right < n))
        a, b, limit = left[live].astype(np.int64), right[live].astype(np.int64), np.full(len(live), n, np.int64)
        while len(live) and len(self.pairs):
            key = a * n + b
            some = np.flatnonzero(self.maybe[self._slot(key)])
            at = np.minimum(np.searchsorted(self.pairs, key[some]), len(self.pairs) - 1)
            bad = some[(self.pairs[at] == key[some]) & (self.pair_rank[at] < limit[some])]
            out[live[bad]] = False
            # Undo the later of the two merges; single characters can't be undone.
            can_a, can_b = a >= self.n_single, b >= self.n_single
            undo_a = can_a & ((a > b) | ~can_b)
            keep = can_a | can_b
            keep[bad] = False
            limit = np.where(undo_a, a, b + 1)[keep]
            a, b = np.where(undo_a, self.right[a], a)[keep], np.where(undo_a, b, self.left[b])[keep]
            live = live[keep]
        return out

    def _hold(self, a: int, b: int) -> bool:
        """:func:`_holds` of one pair, remembered."""
        n = len(self.text)
        if a < 0 or a >= n or b >= n:
            return True
        known = self.verdicts.get(a * n + b)
        if known is not None:
            return known
        key, limit, good = a * n + b, n, True
        while True:
            if self.pair_of.get(a * n + b, n) < limit:
                good = False
                break
            if a >= self.n_single and (a > b or b < self.n_single):
                limit, a = a, int(self.right[a])
            elif b >= self.n_single:
                limit, b = b + 1, int(self.left[b])
            else:
                break
        if len(self.verdicts) >= VERDICTS:
            self.verdicts.clear()
        self.verdicts[key] = good
        return good

    def _codes(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """(code points, codes in the alphabet: 0 for what no piece holds)."""
        if self.code_of is None:
            self.code_of = np.zeros(0x110000, np.int32)
            self.code_of[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
            self.code_of[32] = self.code_of[ord(SPACE)]
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        return points, self.code_of[points]

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, pieces) of every occurrence of a piece in the coded text, by its suffix array;
        no piece holds code 0, so none crosses a separator.  Characters without a piece get the
        piece number n."""
        n, size = len(self.text), len(codes)
        shared = np.flatnonzero(np.bincount(codes, minlength=len(self.alphabet) + 1))
        own = np.zeros(len(self.alphabet) + 1, np.int64)
        own[shared] = np.arange(len(shared)) + (shared[0] > 0 if len(shared) else 0)
        own[0] = 0
        usable = np.flatnonzero(((own[self.piece_codes] > 0) | (self.piece_codes == 0)).all(axis=1))
        pieces, lengths = self.sorted[usable], self.lengths[self.sorted[usable]]
        bits = max(1, int(own.max(initial=1)).bit_length())
        per = per_number(bits)
        suffix = np.flatnonzero(codes).astype(np.int32)
        if len(pieces) and len(suffix):
            depth = int(lengths.max())
            text = np.zeros(size + per * (-(-depth // per)), U64)
            text[:size] = own[codes]
            window = rolling(text, per, bits)
            keys = [window[suffix + lo] for lo in range(0, depth, per)]
            order = order_of(keys)
            keys, suffix = [k[order] for k in keys], suffix[order]
            wanted = [rolling_rows(own[self.piece_codes[usable, lo : lo + per]], per, bits) for lo in range(0, depth, per)]
            low, high = lookup(keys, wanted, lengths, bits)
            which, where = spread_ranges(low, high)
            at, piece = suffix[where], pieces[which].astype(np.int32)
        else:
            at, piece = np.zeros(0, np.int32), np.zeros(0, np.int32)
        single = np.zeros(size, np.bool_)
        single[at[piece < self.n_single]] = True
        strange = np.flatnonzero(~single).astype(np.int32)
        return np.concatenate((at, strange)), np.concatenate((piece, np.full(len(strange), n, np.int32)))

    def _short(self, units: list[str]) -> list[bytes]:
        """Ids of units, all relaxed side by side: by the place inside a unit where edges end."""
        n = len(self.text)
        joined = "\0".join(units) + "\0"
        points, codes = self._codes(joined)
        length = np.fromiter(map(len, units), np.int64, len(units))
        stop = np.cumsum(length + 1) - 1  # the separator after each unit
        codes = codes.copy()
        codes[stop] = 0
        inside = np.ones(len(points), np.bool_)
        inside[stop] = False
        base = np.repeat(stop - length, length + 1).astype(np.int32)
        at, piece = self._edges(codes)
        real = inside[at]
        at, piece = at[real], piece[real]
        to = at + np.concatenate((self.lengths, [1])).astype(np.int32)[piece]
        end = to - base[at]
        order = np.argsort(end.astype(np.int16), kind="stable")
        at, piece, to = at[order], piece[order], to[order]
        limits = np.concatenate(([0], np.cumsum(np.bincount(end, minlength=1))))
        last = np.full(len(points) + 1, -1, np.int32)  # the piece that ends before a place
        first = np.zeros(len(points) + 1, np.bool_)
        first[stop - length] = True
        score = np.zeros(0 if self.bpe else len(points) + 1)
        for p in range(1, len(limits) - 1):
            s = slice(limits[p], limits[p + 1])
            a, r, t = at[s], piece[s], to[s]
            if self.bpe:
                good = first[a] | self._holds(last[a], r)
                last[t[good]] = r[good]
            else:
                gain = np.where(first[a], 0.0, score[a]) + self._gain(r)
                by = np.lexsort((gain, t))
                best = by[np.concatenate((t[by][1:] != t[by][:-1], [True]))] if len(by) else by
                last[t[best]], score[t[best]] = r[best], gain[best]
        # From the end of each unit back to its start.
        widths = np.concatenate((self.lengths, [1]))
        is_end = np.zeros(len(points) + 1, np.bool_)
        back = stop[length > 0]
        while len(back):
            is_end[back] = True
            back = back - widths[last[back]]
            back = back[~first[back]]
        ends = np.flatnonzero(is_end)
        counts = np.add.reduceat(is_end[1:], stop - length, dtype=np.int64) if len(units) else length
        return self._spell(last[ends], points[ends - 1], counts, units)

    def _gain(self, pieces: np.ndarray) -> np.ndarray:
        n = len(self.text)
        return np.where(pieces < n, self.scores[np.minimum(pieces, n - 1)], self.scores.min(initial=0) - 10)

    def _long(self, units: list[str]) -> list[bytes]:
        """Ids of units of any length, in time that grows with it: edges are found for stretches of
        a fixed size, several to a suffix array, and relaxed one after another."""
        n, context = len(self.text), self.longest
        widths = np.concatenate((self.lengths, [1]))
        stretches = [(u, lo, min(lo + STRETCH, len(t))) for u, t in enumerate(units) for lo in range(0, len(t), STRETCH)]
        last = [np.full(len(t) + 1, -1, np.int32) for t in units]
        score = [np.zeros(0 if self.bpe else len(t) + 1) for t in units]
        i = 0
        while i < len(stretches):
            j, size = i, 0
            while j < len(stretches) and (j == i or size + stretches[j][2] - stretches[j][1] <= SLICE):
                size += stretches[j][2] - stretches[j][1]
                j += 1
            parts = [units[u][max(0, lo - context) : hi] for u, lo, hi in stretches[i:j]]
            _, codes = self._codes("\0".join(parts) + "\0")
            codes = codes.copy()
            stops = np.cumsum([len(x) + 1 for x in parts]) - 1
            codes[stops] = 0
            at, piece = self._edges(codes)
            to = at + widths[piece]
            order = np.lexsort((at, to))
            at, piece, to = at[order], piece[order], to[order]
            limits = np.searchsorted(to, stops, "right")
            begin = 0
            for (u, lo, _), x, stop, limit in zip(stretches[i:j], parts, stops.tolist(), limits.tolist(), strict=True):
                origin, shift = stop - len(x), max(0, lo - context)
                least = origin + lo - shift  # what ends up to here was relaxed with the stretch before
                begin += int(np.searchsorted(to[begin:limit], least, "right"))
                row, gains = last[u][shift : shift + len(x) + 1].tolist(), score[u][shift : shift + len(x) + 1].tolist()
                done = least - origin
                for k in range(begin, limit, 1 << 16):
                    s = slice(k, min(limit, k + (1 << 16)))
                    worth = self._gain(piece[s]).tolist() if not self.bpe else []
                    for e, (a, r, t) in enumerate(zip((at[s] - origin).tolist(), piece[s].tolist(), (to[s] - origin).tolist(), strict=True)):
                        if a < 0:
                            continue
                        before = row[a]
                        if self.bpe:
                            if self._hold(before, r):
                                row[t] = r
                        else:
                            gain = gains[a] + worth[e]
                            if row[t] < 0 or gain >= gains[t]:
                                row[t], gains[t] = r, gain
                last[u][shift + done : shift + len(x) + 1] = row[done:]
                if not self.bpe:
                    score[u][shift + done : shift + len(x) + 1] = gains[done:]
                begin = limit
            i = j
        out = []
        for u, text in enumerate(units):
            points, _ = self._codes(text)
            ends, at = [], len(text)
            while at:
                ends.append(at)
                at -= int(widths[last[u][at]])
            ends = np.array(ends[::-1])
            out += self._spell(last[u][ends], points[ends - 1], np.array([len(ends)]), [text])
        return out

    def _spell(self, ranks: np.ndarray, points: np.ndarray, counts: np.ndarray, units: list[str]) -> list[bytes]:
        """The ids of each unit as bytes; characters without a piece become bytes or the unknown
        piece, single spaces that begin a unit the pieces that merging makes of their run."""
        n = len(self.text)
        ids = np.concatenate((self.ids, np.array([self.unknown], np.int32)))[ranks]
        odd = np.flatnonzero(ranks == n) if self.bytes_of else np.zeros(0, np.int64)
        width = np.ones(len(ids), np.int64)
        if len(odd):
            coded = [(SPACE if c == 32 else chr(c)).encode("utf-8", "surrogatepass") for c in points[odd].tolist()]
            width[odd] = [len(c) for c in coded]
            out = np.repeat(ids, width)
            begin = np.cumsum(width) - width
            for i, c in zip(begin[odd].tolist(), coded, strict=True):
                out[i : i + len(c)] = [self.bytes_of[x] for x in c]
            ids = out
        stop = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(counts)))] * 4
        data, stop = ids.astype("<i4").tobytes(), stop.tolist()
        found = [data[lo:hi] for lo, hi in zip(stop[:-1], stop[1:], strict=True)]
        if self.bpe:
            alone = struct.pack("<i", self.ids[self.rank[SPACE]]) if SPACE in self.rank else b""
            for i, u in enumerate(units):
                if u[:2] != "  ":
                    continue
                if self.runs_last and alone:
                    k, most = 0, len(found[i]) // 4
                    while k < most and found[i][4 * k : 4 * k + 4] == alone:
                        k += 1
                    if k > 1:
                        found[i] = self._run_of_spaces(k) + found[i][4 * k :]
                elif not self.runs_last:  # pieces of spaces in the midst of others: merged directly
                    found[i] = np.array([x for r in self.merge(u.replace(" ", SPACE)) for x in self._outer(r)], "<i4").tobytes()
        return found

    def _run_of_spaces(self, k: int) -> bytes:
        if k not in self.space_runs:
            if len(self.space_runs) > 1024:
                self.space_runs.clear()
            self.space_runs[k] = [int(self.ids[r]) for r in self.merge(SPACE * k)]
        return np.array(self.space_runs[k], "<i4").tobytes()

    def _outer(self, r: int) -> list[int]:
        if r >= 0:
            return [int(self.ids[r])]
        coded = chr(-1 - r).encode("utf-8", "surrogatepass")
        return [self.bytes_of[x] for x in coded] if self.bytes_of else [self.unknown]

    def _learn(self, units: list[str]) -> None:
        """Encode new units, some at a time, into ``young``."""
        short = [u for u in units if len(u) <= SHORT]
        for few, each in ((short, self._short), ([u for u in units if len(u) > SHORT], self._long)):
            lo = size = 0
            for i, u in enumerate(few):
                size += len(u) + 1
                if size >= SLICE or i == len(few) - 1:
                    part = few[lo : i + 1]
                    self.young.update(zip(part, each(part), strict=True))
                    lo, size = i + 1, 0

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null or empty text has none.

        Units met before keep their ids, in two generations of a bounded size."""
        if len(self.young) > KEEP or sum(map(len, self.young)) > KEEP * 16:
            self.old, self.young = self.young, {}
        units = []
        for t in texts:
            text = (t or "").replace(SPACE, " ")
            units.append(self.unit.findall(" " + text if self.model.dummy_prefix else text) if text else [])
        fresh: set[str] = set()
        fresh.update(*units)
        new = []
        for u in fresh.difference(self.young):
            known = self.old.get(u)
            if known is None:
                new.append(u)
            else:
                self.young[u] = known
        self._learn(new)
        spelled = self.young.__getitem__
        return [np.frombuffer(b"".join(map(spelled, x)), "<i4") for x in units]

    def decode(self, ids: np.ndarray) -> str:
        if not self.model.surface:
            self.model.surface = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else t.replace(SPACE, " ").encode() for t, _, k in self.model.pieces]
        table = self.model.surface
        text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def load(path: str = MODEL_PATH) -> Tokenizer:
    with open(path, "rb") as f:
        data = f.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError("the vocabulary file is larger than what may be broadcast")
    return Tokenizer(Model.parse(data))


def encode(docs: DataFrame, *, model_path: str = MODEL_PATH) -> DataFrame:
    """Input: doc_id, text and any other columns.  Result for each row: doc_id, ids, n_tokens,
    ids_sha256 (of the ids as little-endian 32-bit numbers), decoded and round_trip (whether
    decoding gives the text again, with U+2581 read as a space).  A null or empty text has no ids
    and decodes to the empty text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared.value
        for batch in batches:
            column, texts = batch.column(0), batch.column(1).to_pylist()
            lo = size = 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size < BATCH and i < len(texts) - 1:
                    continue
                part = texts[lo : i + 1]
                ids = tokenizer.encode(part)
                counts = np.fromiter(map(len, ids), np.int64, len(ids))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                decoded = [tokenizer.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        column.slice(lo, len(part)), lists, pa.array(counts), pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array(decoded), pa.array([d == (t or "").replace(SPACE, " ") for d, t in zip(decoded, part, strict=True)]),
                    ],
                    names=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded", "round_trip"],
                )
                release()
                lo, size = i + 1, 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded string, round_trip boolean")


def decode(tokens: DataFrame, *, model_path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give the empty text."""
    spark = tokens.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tokenizer.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

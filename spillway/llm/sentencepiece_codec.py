"""Operator 4: SentencePiece encoding and decoding of a BPE model by suffix-array matching.

Texts are cut at blanks and line feeds, which no merge crosses. The parts that are new are laid one
behind the other; a suffix array of that text, ordered by as many characters as a piece can have, is
searched for every piece of the vocabulary by bisection, which gives the ranges of its
occurrences. Occurrences are edges between characters. Sorted by the place where they end they are
relaxed in that order: of the edges that end at a place, one follows the last piece of the text
before it as the merges would have it, and that one is kept. Whether two pieces can stand side
by side is found by undoing their merges, latest first, and kept for later. Characters without a piece
become their UTF-8 bytes; runs of blank pieces are joined from the left at the end.

Ids equal the library's, which serves here only to read the model's pieces. Decoding joins the
pieces; a text comes back as it was but for U+2581, which the model takes for a blank.

Defined results: a null or empty text has no ids and decodes to an empty text; a null doc_id stays null;
repeated rows are encoded as often as they occur; very long texts are read whole, one without blanks as one part; of merges of equal
rank the leftmost goes first, as in the library; an empty table gives no rows; other columns are ignored. A model with
pieces that cross a blank or a line feed is refused, as texts are cut there.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim
from .tokens import batches

#: Fixed value: the model's sign for a blank.
BLANK = "▁"

MEMO = 300_000
ROWS = "doc_id long, n_ids long, ids array<int>, decoded string"


def refuse_crossing(pieces) -> None:
    """Texts are cut before blanks, but for runs of them, and around line feeds; so no piece may lie across one."""
    for t in pieces:
        if BLANK in t[1:] or "\n" in t and t != "\n":
            raise ValueError(f"the piece {t!r} crosses a blank or a line feed")


class Pieces:
    """The model's pieces, ranks of merges, and each piece's last merge. Made once, on the driver."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.texts = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_of = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.raw = [bytes([int(t[3:5], 16)]) if sp.is_byte(i) else b"" if special[i] else t.replace(BLANK, " ").encode() for i, t in enumerate(self.texts)]
        self.ids = {t: i for i, t in enumerate(self.texts) if not special[i] and (t == BLANK or set(t) != {BLANK})}
        refuse_crossing(self.ids)
        self.runs = {len(t): i for i, t in enumerate(self.texts) if not special[i] and set(t) == {BLANK}}
        merged = sorted((i for t, i in self.ids.items() if len(t) > 1), key=lambda i: (-sp.get_score(i), i))
        self.rank = np.full(n + 1, -1, np.int64)
        self.rank[merged] = np.arange(len(merged))
        self.left, self.right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        self.own = np.zeros(n + 1, bool)
        for t, i in self.ids.items():
            parts = self.merges(t)
            self.own[i] = parts is not None
            if parts and len(t) > 1:
                self.left[i], self.right[i] = parts
        pairs = sorted((self.ids[t[:k]] * n + self.ids[t[k:]], i) for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids)
        self.pairs, self.joined = np.array([p for p, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int64)
        self.n = n

    def merges(self, text: str) -> tuple | None:
        """The last two parts that merge into this piece; (): it is one character; None: merging its text gives another result."""
        parts = [self.ids.get(c) for c in text]
        if None in parts:
            return None
        last: tuple = ()
        while len(parts) > 1:
            best = min(((self.rank[j], k, j) for k in range(len(parts) - 1) if (j := self.ids.get(self.texts[parts[k]] + self.texts[parts[k + 1]])) is not None), default=None)
            if best is None:
                return None
            _, k, j = best
            last = parts[k], parts[k + 1]
            parts[k : k + 2] = [j]
        return last if parts[0] == self.ids[text] else None

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges of two pieces' joint text end at the two pieces."""
        a, b = a.copy(), b.copy()
        out = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.n + y
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            rank = np.where(self.pairs[at] == key, self.rank[self.joined[at]], np.iinfo(np.int64).max)
            bad = rank < limit[live]
            out[live[bad]] = False
            first = self.rank[x] > self.rank[y]
            done = bad | ~first & (self.rank[y] < 0)
            go_a, go_b = live[first & ~done], live[~first & ~done]
            limit[go_a], limit[go_b] = self.rank[a[go_a]], self.rank[b[go_b]] + 1
            a[go_a], b[go_b] = self.right[a[go_a]], self.left[b[go_b]]
            live = live[~done]
        return out


class Codec:
    """Encodes and decodes with Pieces; keeps the ids of parts and the pairs of pieces that it has met."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        texts = sorted((t, i) for t, i in pieces.ids.items() if pieces.own[i])
        self.span = max(len(t) for t, _ in texts)
        letters = sorted({c for t, _ in texts for c in t})
        self.code = np.full(0x110000, 0xFFFF, np.uint16)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.words = -(-self.span // 4)
        self.piece = np.array([i for _, i in texts], np.int64)
        self.length = np.array([len(t) for t, _ in texts], np.int64)
        grid = np.zeros((len(texts), 4 * self.words), np.uint16)
        full = np.full_like(grid, 0xFFFF)
        for k, (t, _) in enumerate(texts):
            grid[k, : len(t)] = full[k, : len(t)] = self.code[[ord(c) for c in t]]
        self.low, self.high = self._keys(grid), self._keys(full)
        self.memo: dict[str, bytes] = {}
        self.known, self.good = np.zeros(0, np.int64), np.zeros(0, bool)

    def _keys(self, grid: np.ndarray) -> list[np.ndarray]:
        g = grid.astype(np.uint64)
        return [g[:, 4 * k] << np.uint64(48) | g[:, 4 * k + 1] << np.uint64(32) | g[:, 4 * k + 2] << np.uint64(16) | g[:, 4 * k + 3] for k in range(self.words)]

    def _suffixes(self, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Places in the order of the characters from there on, and these characters, four in a number."""
        n = len(codes)
        wide = np.r_[codes, np.zeros(4 * self.words + 4, np.uint16)].astype(np.uint64)
        four = wide[:-3] << np.uint64(48) | wide[1:-2] << np.uint64(32) | wide[2:-1] << np.uint64(16) | wide[3:]
        keys = [four[4 * k : 4 * k + n] for k in range(self.words)]
        order = np.lexsort(keys[::-1])
        order = order[codes[order] != 0]
        return order, [k[order] for k in keys]

    @staticmethod
    def _bisect(keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
        """Where each wanted key belongs among the sorted keys: before, or after, those equal to it."""
        low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            at = np.minimum(mid, len(keys[0]) - 1)
            less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for k, w in zip(keys, wanted, strict=True):
                x = k[at]
                less |= same & (x < w)
                same &= x == w
            right = open_ & (less | same if after else less)
            low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
        return low

    def _beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.p.n + b
        at = np.searchsorted(self.known, key)
        hit = np.zeros(len(key), bool)
        inside = at < len(self.known)
        hit[inside] = self.known[at[inside]] == key[inside]
        out = np.zeros(len(key), bool)
        out[hit] = self.good[at[hit]]
        if not hit.all():
            new, back = np.unique(key[~hit], return_inverse=True)
            found = self.p.beside(new // self.p.n, new % self.p.n)
            out[~hit] = found[back]
            self.new.append((new, found))
        return out

    def _keep(self) -> None:
        if self.new:
            keys = np.concatenate([self.known, *[k for k, _ in self.new]])
            good = np.concatenate([self.good, *[g for _, g in self.new]])
            self.known, first = np.unique(keys, return_index=True)
            self.good = good[first]
            if len(self.known) > 4_000_000:
                self.known, self.good = np.zeros(0, np.int64), np.zeros(0, bool)

    def learn(self, parts: list[str]) -> None:
        """Put the ids of new parts, none empty, into the memo."""
        flat = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        size = np.array([len(x) for x in parts], np.int64)
        start = np.cumsum(size + 1) - size - 1
        total = int(size.sum()) + len(parts)
        of = np.repeat(np.arange(len(parts)), size)
        place = np.arange(len(flat)) + of
        codes = np.zeros(total, np.uint16)
        codes[place] = self.code[flat]
        order, keys = self._suffixes(codes)
        first, last = self._bisect(keys, self.low, False), self._bisect(keys, self.high, True)
        count = last - first
        ends = np.cumsum(count)
        begin = order[np.arange(int(count.sum())) + np.repeat(first - (ends - count), count)]
        piece, length = np.repeat(self.piece, count), np.repeat(self.length, count)
        odd = np.flatnonzero(codes == 0xFFFF)
        unknown = self.p.n
        begin, piece, length = np.r_[begin, odd], np.r_[piece, np.full(len(odd), unknown)], np.r_[length, np.ones(len(odd), np.int64)]
        owner = np.zeros(total + 1, np.int64)
        owner[place] = of
        step = begin - start[owner[begin]] + length
        by_end = np.argsort(step.astype(np.uint16) if step.max(initial=0) < 65536 else step, kind="stable")
        begin, piece, length, step = begin[by_end], piece[by_end], length[by_end], step[by_end]
        held, came = np.full(total + 1, -1, np.int64), np.zeros(total + 1, np.int64)
        bounds = np.searchsorted(step, np.arange(1, int(size.max()) + 2))
        self.new: list = []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            b, t = begin[i:j], piece[i:j]
            before = held[b]
            free = (before < 0) | (before == unknown) | (t == unknown)
            free[~free] = self._beside(before[~free], t[~free])
            b, t = b[free], t[free]
            e = b + length[i:j][free]
            held[e], came[e] = t, b
        self._keep()
        token = np.full(total, -1, np.int64)
        at, low = start + size, start
        while len(at):
            back = came[at]
            token[back] = held[at]
            more = back > low
            at, low = back[more], low[more]
        used = np.flatnonzero(token >= 0)
        ids = token[used]
        many = np.ones(len(ids), np.int64)
        strange = np.flatnonzero(ids == unknown)
        spelled = [chr(flat[p - owner[p]]).encode() for p in used[strange].tolist()]
        many[strange] = [len(x) for x in spelled]
        out = np.repeat(ids, many).astype("<i4")
        where = np.cumsum(many) - many
        for k, x in zip(strange.tolist(), spelled, strict=True):
            out[where[k] : where[k] + len(x)] = self.p.bytes_of[list(x)]
        cut = np.r_[np.searchsorted(used, start), len(used)]
        edge = (np.r_[where, len(out)][cut] * 4).tolist()
        raw = out.tobytes()
        self.memo.update(zip(parts, [raw[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)], strict=True))

    def _parts(self, text: str) -> list[str]:
        if not text:
            return []
        lines = [x.split(" ") for x in text.replace(BLANK, " ").split("\n")]
        out = []
        for k, (head, *rest) in enumerate(lines):
            if k:
                out.append("\n")
                if head:
                    out.append(head)
            else:
                out.append(BLANK + head)
            out += [BLANK + x for x in rest]
        return out

    def _join_blanks(self, ids: bytes) -> bytes:
        """Blank pieces in a row become pieces of as many blanks as there are, from the left."""
        x = np.frombuffer(ids, "<i4")
        blank = x == self.p.runs[1]
        edge = np.flatnonzero(np.diff(np.r_[False, blank, False].astype(np.int8)))
        out, at, most = [], 0, max(self.p.runs)
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if j - i > 1:
                n = j - i
                out += [x[at:i], np.array([self.p.runs[most]] * (n // most) + ([self.p.runs[n % most]] if n % most else []), "<i4")]
                at = j
        return np.concatenate([*out, x[at:]]).astype("<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids as int32 bytes."""
        claim(self.memo, self.memo.clear)
        if len(self.memo) > MEMO:
            self.memo.clear()
        parts = [self._parts(t) for t in texts]
        new = list(set(chain.from_iterable(parts)).difference(self.memo))
        for i in range(0, len(new), 100_000):
            self.learn(new[i : i + 100_000])
        found = self.memo.__getitem__
        coded = [b"".join(map(found, x)) for x in parts]
        return [self._join_blanks(c) if c and ("  " in t or t[0] in " " + BLANK or BLANK in t) else c for c, t in zip(coded, texts, strict=True)]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.p.raw.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_CODECS: dict = {}


def sentencepiece_round_trip(docs: DataFrame, model: str) -> DataFrame:
    """One row a document: doc_id, n_ids, its ids, and the text decoded from them."""
    key = model
    held = docs.sparkSession.sparkContext.broadcast(Pieces(model))

    def apply(it):
        if key not in _CODECS:
            _CODECS[key] = Codec(held.value)
        codec = _CODECS[key]
        for batch, first, last, texts in batches(it, rows=4000, chars=8 << 20):
            coded = codec.encode(texts)
            size = np.array([len(x) // 4 for x in coded], np.int64)
            flat = pa.array(np.frombuffer(b"".join(coded), "<i4"), pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:last], pa.array(size), ids, pa.array([codec.decode(x) for x in coded], pa.string())], [x.split()[0] for x in ROWS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(apply, ROWS)

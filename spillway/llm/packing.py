"""Operator 5: best-fit packing of documents into sequences, improved by a local search of swaps.

Documents are tokenized, ended and, where longer than a sequence, cut; a full piece is a sequence
of its own. The other pieces are dealt into shards of about SHARD pieces by a hash of a row number,
and each shard is packed alone: pieces go to the bin with the least room that holds them, in the order in which they
come. Then the local search moves pieces and swaps them one for one, two for one and one for two between underfull
bins, as long as that raises the sum of squared fills, until bins empty. All underfull bins are partners. Where no
bin has a step left above the lower bound, the search opens full bins too, those of most pieces first and twice as many
each time: their pieces and those of the underfull bins are put back by best fit in descending order, and the search
goes on from there. A result with more bins is taken back. It ends at the lower bound, or once all bins have been opened
without gain. Only lengths enter the shards, so a shard's size has a bound; a shard's last bin is its only loss.

Defined results: a null or empty text is a document of the end id alone; a null doc_id stays null;
repeated rows and rows that share a doc_id are documents of their own; a very long text is cut into full pieces, the
first one shorter; of pieces of one length the earlier goes first, and of bins with equal room any; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import batches, encoder

#: Pieces in a shard, on average.
SHARD = 10_000

#: Full bins that the search opens first when it is stuck.
OPENED = 16

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long, ids binary"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, moves long, swaps long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full but for the first."""
    if n <= size:
        return [(0, n)]
    head = n % size
    return ([(0, head)] if head else []) + [(i, size) for i in range(head, n, size)]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, blank: bool, with_ids: bool = False) -> DataFrame:
    """The pieces of docs (doc_id, text), each with a row number that is its own."""

    def make(it):
        from pyspark import TaskContext

        enc, uid = encoder(tokenizer, blank, 4), TaskContext.get().partitionId() << 40
        end = end_id.to_bytes(4, "little")
        for batch, first, last, texts in batches(it):
            rows = []
            for key, raw in zip(batch.column("doc_id")[first:last].to_pylist(), enc.encode(texts), strict=True):
                raw += end
                for k, (a, n) in enumerate(cut(len(raw) // 4, size)):
                    part = raw[4 * a : 4 * (a + n)]
                    rows.append((key, k, a, n, zlib.crc32(part), uid, part if with_ids else None))
                    uid += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, PIECES)


class Bins:
    """Bins of one size while they are filled and improved. Items are positions in `lengths`."""

    def __init__(self, lengths, size: int):
        self.lengths, self.size = [int(x) for x in lengths], size
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: dict[int, set[int]] = defaultdict(set)
        self.mask = 0
        self.takes: dict[int, tuple[int, int]] = {}
        self.room_takes: dict[int, tuple[int, int]] = {}
        self.moves = self.swaps = 0

    def bound(self) -> int:
        return -(-sum(self.lengths) // self.size)

    def used(self) -> int:
        return sum(1 for x in self.items if x)

    def _set(self, b: int, room: int) -> None:
        old = self.room[b]
        self.takes.pop(b, None)
        self.room_takes.pop(old, None)
        self.room_takes.pop(room, None)
        self.by_room[old].discard(b)
        if not self.by_room[old]:
            self.mask &= ~(1 << old)
        self.room[b] = room
        if self.items[b]:
            self.by_room[room].add(b)
            self.mask |= 1 << room

    def _fit(self, n: int) -> int | None:
        """A bin with the least room for n."""
        if not (m := self.mask >> n):
            return None
        return next(iter(self.by_room[n + (m & -m).bit_length() - 1]))

    def place(self, order) -> None:
        """Items, in the given order, into the bin with the least room that holds each, or a new one."""
        for i in order:
            n = self.lengths[i]
            b = self._fit(n)
            if b is None:
                b = len(self.items)
                self.items.append([])
                self.room.append(self.size)
            self.items[b].append(i)
            self._set(b, self.room[b] - n)

    def _clear(self, b: int) -> list[int]:
        held, self.items[b] = self.items[b], []
        self._set(b, self.size)
        return held

    def _exchange(self, a: int, out: list[int], b: int, into: list[int]) -> None:
        """Items `out` of bin a go to bin b, items `into` of b to a."""
        d = sum(self.lengths[i] for i in out) - sum(self.lengths[i] for i in into)
        self.items[a] = [i for i in self.items[a] if i not in out] + into
        self.items[b] = [i for i in self.items[b] if i not in into] + out
        self._set(a, self.room[a] + d)
        self._set(b, self.room[b] - d)

    def _takes(self, b: int) -> tuple[int, int]:
        """Bits of the lengths that bin b can give back: none or one of its items, and two of them."""
        if b not in self.takes:
            ones, twos = 0, 0
            for i in self.items[b]:
                twos |= ones << self.lengths[i]
                ones |= 1 << self.lengths[i]
            self.takes[b] = (ones | 1, twos)
        return self.takes[b]

    def _room_takes(self, room: int, but: int) -> tuple[int, int]:
        """The same of all bins with that room, without bin `but`."""
        if room not in self.room_takes or room == self.room[but]:
            ones, twos, takes = 0, 0, self.takes
            for b in self.by_room[room]:
                if b != but:
                    one, two = takes.get(b) or self._takes(b)
                    ones |= one
                    twos |= two
            if room == self.room[but]:
                return ones, twos
            self.room_takes[room] = (ones, twos)
        return self.room_takes[room]

    def _find(self, b: int, n: int) -> list[int] | None:
        """One or two items of bin b of length n together."""
        if not n:
            return []
        seen: dict[int, int] = {}
        for i in self.items[b]:
            if self.lengths[i] == n:
                return [i]
        for i in self.items[b]:
            if n - self.lengths[i] in seen:
                return [i, seen[n - self.lengths[i]]]
            seen[self.lengths[i]] = i
        return None

    def _improve(self, a: int) -> bool:
        """One step that takes length out of bin a, the emptier one, into a fuller one: the sum of squares grows.
        All underfull bins are partners, by their room and the lengths that they can give back."""
        one = {self.lengths[i]: [i] for i in self.items[a]}
        two: dict[int, list[int]] = {}
        mine = self.items[a]
        for k, i in enumerate(mine):
            for j in mine[k + 1 :]:
                two.setdefault(self.lengths[i] + self.lengths[j], [i, j])
        gain, best, whole, mask = 0, (0, 0, [], True), self.size - self.room[a], self.mask & ((2 << self.room[a]) - 2)
        while mask:
            room = mask.bit_length() - 1
            mask ^= 1 << room
            if gain >= room or gain >= whole:
                break
            ones, twos = self._room_takes(room, a)
            for outs, give in ((one, ones | twos), (two, ones)):
                for n, out in outs.items():
                    if n <= gain:
                        continue
                    least = n - room if n > room else 0
                    # only what is given back for less than n - gain is of use
                    m = (give >> least) & ((1 << (n - gain - least)) - 1) if n - gain > least else 0
                    if m:
                        least += (m & -m).bit_length() - 1
                        gain, best = n - least, (room, least, out, outs is one)
        room, m, out, both = best
        if gain <= 0:
            return False
        for b in self.by_room[room]:
            ones, twos = self._takes(b)
            if b != a and ((ones | twos if both else ones) >> m) & 1:
                self._exchange(a, out, b, self._find(b, m))
                self.moves, self.swaps = self.moves + (not m), self.swaps + bool(m)
                return True
        raise AssertionError("the index names a bin that has no such items")

    def search(self) -> None:
        """Empty the emptiest bins into underfull ones until the lower bound is met, or no bin has a step left:
        bins that could not be emptied are tried again as long as a round changes something."""
        need, left, changed = self.bound(), self.used(), True
        while changed and left > need:
            changed = False
            for a in sorted((b for r, bs in self.by_room.items() if r for b in bs), key=lambda b: (-self.room[b], b)):
                before = bool(self.items[a])
                while self.items[a] and self._improve(a):
                    changed = True
                if before and not self.items[a]:
                    left -= 1
                    if left <= need:
                        return

    def open_up(self, opened: int = OPENED) -> None:
        """The search where it is stuck above the bound: with full bins opened, twice as many each time, up to all."""
        while self.used() > self.bound():
            full = sorted((b for b, held in enumerate(self.items) if held and not self.room[b]), key=lambda b: (-len(self.items[b]), b))
            under = [b for b, held in enumerate(self.items) if held and self.room[b]]
            before, was = [list(x) for x in self.items], self.used()
            loose = [i for b in under + full[:opened] for i in self._clear(b)]
            self.place(sorted(loose, key=lambda i: (-self.lengths[i], i)))
            self.search()
            if self.used() > was:
                for b in range(len(self.items)):
                    self.items[b] = before[b] if b < len(before) else []
                    self._set(b, self.size - sum(self.lengths[i] for i in self.items[b]))
            if opened >= len(full):
                return
            opened *= 2


def pack(lengths, size: int) -> tuple[np.ndarray, np.ndarray, Bins]:
    """(bin, offset) of each length, bins numbered from 0, and the bins."""
    bins = Bins(lengths, size)
    bins.place(range(len(bins.lengths)))
    bins.search()
    bins.open_up()
    where, offset, k = np.zeros(len(bins.lengths), np.int64), np.zeros(len(bins.lengths), np.int64), 0
    for held in bins.items:
        at = 0
        for i in held:
            where[i], offset[i] = k, at
            at += bins.lengths[i]
        k += bool(held)
    return where, offset, bins


def best_fit_packing(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048, blank: bool = True, with_ids: bool = False) -> DataFrame:
    """One row a piece, with its sequence and its place there, and the moves and swaps of its shard's search; with_ids adds the ids, as uint32 bytes."""
    scratch = Scratch(docs.sparkSession, "packing")
    cuts = scratch.save(pieces(docs, tokenizer, end_id, size, blank, with_ids), "pieces")
    n = cuts.filter(F.col("length") < size).count()
    shards = max(1, round(n / SHARD))
    extra = ["ids"] if with_ids else []
    schema = PACKED + ", ids binary" * with_ids

    def shard(group: pa.Table) -> pa.Table:
        group = group.sort_by("uid")
        where, offset, bins = pack(group.column("length").to_numpy(), size)
        base = group.column("shard")[0].as_py() << 40
        kept = group.select([x.split()[0] for x in schema.split(", ") if x.split()[0] in group.column_names and x.split()[0] != "ids"])
        steps = [(k, pa.array(np.full(len(where), v, np.int64))) for k, v in (("moves", bins.moves), ("swaps", bins.swaps))]
        for name, column in [("sequence_id", pa.array(where + base)), ("offset", pa.array(offset)), *steps]:
            kept = kept.append_column(name, column)
        return kept.append_column("ids", group.column("ids")) if with_ids else kept

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "uid", *extra]
    short = cuts.filter(F.col("length") < size).select(*columns, F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"))
    packed = short.groupBy("shard").applyInArrow(shard, schema)
    full = cuts.filter(F.col("length") == size).select(*columns[:5], (-1 - F.col("uid")).alias("sequence_id"), *[F.lit(0).cast("long").alias(c) for c in ("offset", "moves", "swaps")], *extra)
    return packed.unionByName(full)

"""Operator 2: n-gram Jaccard join by vertical partitioning.

Documents become sets of hashed shingles, and equal sets one class. The global order of n-grams is
that of their hashes, cut into fragments. A first pass gives each fragment the parts of all sets
that fall into it, counts for each document how many of its n-grams another class has too, and
sums these partial counts per document: a document can only link if they make up the wanted part of its
set. For the classes that remain, n-grams are ordered rarest first, and classes that share one in their
prefixes may link unless their sizes, places or bitmaps rule it out.

Such pairs are never listed. Each prefix list first meets one member of its own choice; then lists whose
other members are still apart meet in blocks of BLOCK members, where a union-find keeps only edges
that join two parts, so a block gives fewer edges than it has members. That makes groups that all links
lie in. The classes of a group then meet each other in blocks of about SETS, their overlaps are
counted, and each class of a block gives one row: the documents that it links with, and the least class
that the block's links join it to. So rows grow with the classes, while all links are counted.
`jaccard_links` lists the pairs instead.

Defined results: null and empty texts have no n-grams and link with nothing; a null doc_id links
with nothing and has a null component; repeated rows are in one component, rows that share a
doc_id only where their texts link; very long texts are read whole, their sets met in blocks of SHINGLES
n-grams at least; of tied places in the order the smaller hash comes first; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, shuffle_partitions, skew_lookup
from .components import joined
from .shingles import digest, fragment_of, shingle_hashes, words_of
from .tokens import batches

WORDS = 5
PERCENT = 80

#: Bytes of text whose n-grams make up a fragment of the first pass.
FRAGMENT_BYTES = 32 << 20

#: Fragments in which a candidate pair's overlap is counted.
PARTS = 4

#: Longs of a set's bitmap: the parity of its n-grams' number in each of 64 * BITS cells.
BITS = 8

#: Members of a prefix list that meet as many others in one go.
BLOCK = 4_096

#: Classes of a group that meet as many others in one go, and their n-grams.
SETS = 1_024
SHINGLES = 1 << 19

#: Rows, and n-grams, that one call of a worker gets; a list's or group's block is never cut.
LIST_ROWS = 50_000
CALL_SHINGLES = 1 << 20

_CELLS = [f"b{i}" for i in range(BITS)]
_DEALT = "fragment int, batch long, ids binary, sizes binary, classes binary, docs binary, counts binary, hashes binary"
_SUMMED = "batch long, ids binary, sizes binary, classes binary, docs binary, counts binary"
_DOCS = "doc_id long, text_key long, n_shingles long, class binary, able boolean"


def _deal(docs: DataFrame, fragments: int, words: int) -> DataFrame:
    """A row for each batch of documents, and one for each batch and fragment with the parts of its sets."""

    def make(it):
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 32
        names = [x.split()[0] for x in _DEALT.split(", ")]
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
        for batch, first, last, texts in batches(it, rows=20_000, chars=3 << 20):
            sets = [shingle_hashes(words_of(t), words) for t in texts]
            sizes = np.array([len(s) for s in sets], "<u4")
            classes = [digest(s) for s in sets]
            ids = pa.array(batch.column("doc_id")[first:last])
            known = np.asarray(ids.is_valid())
            raw = b"".join([np.packbits(known).tobytes(), np.asarray(ids.fill_null(0), "<i8").tobytes(), np.asarray(batch.column("text_key")[first:last], "<i8").tobytes()])
            rows = [(-1 - key % 997, key, raw, sizes.tobytes(), b"".join(classes), None, None, None)]
            used = np.where(known, sizes, 0)
            flat = np.concatenate([s for s, k in zip(sets, known, strict=True) if k] or [np.zeros(0, np.uint64)])
            of = np.repeat(np.arange(len(sets)), used)
            part = fragment_of(flat, fragments)
            order = np.argsort(part, kind="stable")
            flat, of, part = flat[order], of[order], part[order]
            cuts = np.flatnonzero(np.diff(part)) + 1
            prints = np.frombuffer(b"".join(classes), "<u8").reshape(-1, 2)
            for hashes, own, f in zip(np.split(flat, cuts), np.split(of, cuts), part[np.r_[0, cuts]] if len(part) else [], strict=False):
                who, counts = np.unique(own, return_counts=True)
                rows.append((int(f), key, None, None, prints[who].tobytes(), who.astype("<u2").tobytes(), counts.astype("<u4").tobytes(), hashes.astype("<u4").tobytes()))
            key += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(make, _DEALT)


def _shared(group: pa.Table) -> pa.Table:
    """Of one fragment: for each batch, its documents and how many of their n-grams here another class has too."""
    names = [x.split()[0] for x in _SUMMED.split(", ")]
    if group.column("fragment")[0].as_py() < 0:
        return group.select(names)
    column = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in group.column(c)]
    docs, counts, prints, hashes = column("docs", "<u2"), column("counts", "<u4"), column("classes", "<u8"), column("hashes", "<u4")
    flat = np.concatenate(hashes)
    slots = np.concatenate(counts)
    owner = np.repeat(np.arange(len(slots), dtype=np.int32), slots)
    order = np.argsort(flat, kind="stable")
    owner = owner[order]
    value = flat[order]
    starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    other = np.zeros(len(starts), bool)
    for half in np.concatenate(prints).reshape(-1, 2).T:
        kind = half[owner]
        other |= np.minimum.reduceat(kind, starts) != np.maximum.reduceat(kind, starts)
    hit = np.repeat(other, np.diff(np.r_[starts, len(value)]))
    total = np.bincount(owner[hit], minlength=len(slots)).astype("<u4")
    out: list = []
    at = 0
    for key, who in zip(group.column("batch").to_pylist(), docs, strict=True):
        mine = total[at : at + len(who)]
        at += len(who)
        some = mine > 0
        if some.any():
            out.append((key, None, None, None, who[some].tobytes(), mine[some].tobytes()))
    kinds = [pa.int64(), *[pa.binary()] * 5]
    columns = zip(*out, strict=True) if out else [[]] * 6
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)


def document_table(docs: DataFrame, scratch: Scratch, words: int = WORDS, percent: int = PERCENT, fragment_bytes: int = FRAGMENT_BYTES) -> DataFrame:
    """One row a document: its set's size and digest, and whether it may link to another class."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    fragments = max(shuffle_partitions(spark), math.ceil(size / fragment_bytes))
    summed = scratch.save(_deal(docs, fragments, words).groupBy("fragment").applyInArrow(_shared, _SUMMED), "summed")

    def judge(group: pa.Table) -> pa.Table:
        head, total = None, None
        for row in group.select(["ids", "sizes", "classes"]).to_pylist():
            if row["ids"] is not None:
                head = row
        sizes = np.frombuffer(head["sizes"], "<u4").astype(np.int64)
        n = len(sizes)
        total = np.zeros(n, np.int64)
        for d, c in zip(group.column("docs"), group.column("counts"), strict=True):
            if d.is_valid:
                np.add.at(total, np.frombuffer(d.as_py(), "<u2").astype(np.int64), np.frombuffer(c.as_py(), "<u4").astype(np.int64))
        bits = -(-n // 8)
        known = np.unpackbits(np.frombuffer(head["ids"][:bits], np.uint8))[:n].astype(bool)
        ids, keys = np.split(np.frombuffer(head["ids"][bits:], "<i8"), 2)
        classes = [head["classes"][16 * i : 16 * i + 16] if sizes[i] else None for i in range(n)]
        able = known & (sizes > 0) & (100 * total >= percent * sizes)
        return pa.table([pa.array(ids, mask=~known), pa.array(keys), pa.array(sizes), pa.array(classes, pa.binary()), pa.array(able)], names=[x.split()[0] for x in _DOCS.split(", ")])

    judged = scratch.save(summed.groupBy("batch").applyInArrow(judge, _DOCS), "documents")
    scratch.drop("summed")
    return judged


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Two sets differ in at least as many n-grams as their bitmaps in cells."""
    odd = np.bincount((hashes % np.uint64(64 * BITS)).astype(np.int64), minlength=64 * BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _segments(docs: DataFrame, wanted: DataFrame, n_wanted: int, words: int) -> DataFrame:
    """(rid, n, part, hashes, bits): the sets of the wanted classes (rid, class, doc_id of one member) in PARTS ranges of the hash order; part 0 has the bitmap."""
    side = F.broadcast(wanted) if 48 * n_wanted <= BROADCAST_BYTES else wanted
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(side, "doc_id")

    def make(it):
        for batch, first, last, some in batches(it):
            rows: list = []
            for rid, cls, text in zip(batch.column("rid")[first:last].to_pylist(), batch.column("class")[first:last].to_pylist(), some, strict=True):
                s = shingle_hashes(words_of(text), words)
                if digest(s) != cls:
                    continue
                part = fragment_of(s, PARTS)
                rows += [(rid, len(s), k, s[part == k].view(np.int64), None if k else bitmap(s)) for k in range(PARTS)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["rid", "n", "part", "hashes", "bits"])

    return texts.mapInArrow(make, "rid long, n long, part int, hashes array<long>, bits array<long>").dropDuplicates(["rid", "part"])


def prefixes(segments: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(h, rid, n, pos, b0 ..): n-grams in the classes' prefixes that at least two of them hold, rarest first; pos: its place."""
    flat = segments.select("rid", "n", F.explode("hashes").alias("h"))
    counts = scratch.save(flat.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    held = flat.join(counts, "h").groupBy("rid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("own"))
    alone = F.col("n") - F.size("own")
    room = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    cut = held.filter(room > 0).select("rid", "n", alone.alias("alone"), F.slice("own", 1, F.least(room, F.size("own")).cast("int")).alias("own"))
    cells = segments.filter("part = 0").select("rid", *[F.col("bits")[i].alias(f"b{i}") for i in range(BITS)])
    rows = cut.join(cells, "rid").select("rid", "n", "alone", F.posexplode("own").alias("i", "x"), *_CELLS)
    return rows.select(F.col("x.h").alias("h"), "rid", "n", (F.col("alone") + F.col("i")).alias("pos"), *_CELLS)


def _possible(percent: int):
    """Sizes, places and bitmaps of (rid ..) and (rid2 ..) leave room for enough overlap: 100 (overlap) >= percent (union)."""
    both = F.col("n") + F.col("n2")
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}2"))) for b in _CELLS), F.lit(0))
    most = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    return ((100 + percent) * most >= percent * both) & ((100 + percent) * (both - apart) >= 2 * percent * both)


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of equal keys."""
    new = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    edge = [0, *(np.flatnonzero(new) + 1).tolist(), len(keys[0])]
    return list(zip(edge[:-1], edge[1:], strict=True)) if len(keys[0]) else []


def list_edges(n: np.ndarray, pos: np.ndarray, label: np.ndarray, cells: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, tile: int = 64) -> list[tuple[int, int]]:
    """Edges between members of one list, `left` ones with `right` ones, that may link: those that join two labels, or parts already joined, alone."""
    out, part = [], np.unique(label, return_inverse=True)[1]
    for at in range(0, len(left), tile):
        some = left[at : at + tile]
        if (part == part[0]).all():
            break
        both = n[some][:, None] + n[right][None]
        apart = np.zeros(both.shape, np.int64)
        for k in range(cells.shape[1]):
            apart += np.bitwise_count(cells[some, k][:, None] ^ cells[right, k][None])
        most = np.minimum((n - pos)[some][:, None], (n - pos)[right][None])
        near = ((100 + percent) * most >= percent * both) & ((100 + percent) * (both - apart) >= 2 * percent * both)
        near &= part[some][:, None] != part[right][None]
        for a, row in zip(some.tolist(), near, strict=True):
            if not row.any():
                continue
            other = right[row]
            parts, first = np.unique(part[other], return_index=True)
            for p, b in zip(parts.tolist(), other[first].tolist(), strict=True):
                if p != part[a]:
                    out.append((a, b))
                    part[part == p] = part[a]
    return out


def _meet_lists(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b) that join the parts of lists (h, rid, n, pos, label, b0 ..), fewer from each block of a list than it has members."""
    total = lists.count()
    sizes = lists.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = lists.join(sizes, "h").withColumn("s", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("s", "t")).withColumn("j", F.greatest("s", "t"))
    calls = max(shuffle_partitions(lists.sparkSession), math.ceil(total / LIST_ROWS))

    def meet(group: pa.Table) -> pa.Table:
        get = lambda c: group.column(c).to_numpy()
        h, i, j, rid = get("h"), get("i"), get("j"), get("rid")
        order = np.lexsort((rid, j, i, h))
        h, i, j, rid = h[order], i[order], j[order], rid[order]
        n, pos, label, s = get("n")[order], get("pos")[order], get("label")[order], get("s")[order]
        cells = np.stack([get(c) for c in _CELLS], axis=1)[order].view(np.uint64)
        a, b = [], []
        for x, y in _runs(h, i, j):
            every = np.arange(y - x)
            left, right = (every, every) if i[x] == j[x] else (every[s[x:y] == i[x]], every[s[x:y] == j[x]])
            for k, m in list_edges(n[x:y], pos[x:y], label[x:y], cells[x:y], left, right, percent):
                a.append(rid[x + k])
                b.append(rid[x + m])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    columns = ["h", "i", "j", "s", "rid", "n", "pos", "label", *_CELLS]
    return dealt.select(*columns, F.pmod(F.xxhash64("h", "i", "j"), F.lit(calls)).alias("call")).groupBy("call").applyInArrow(meet, "a long, b long")


def _groups(docs: DataFrame, table: DataFrame, scratch: Scratch, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The classes that may link (rid, class), their sets, and (u, label): groups that hold all links. rid: a row number, so no two classes share one."""
    able = table.filter("able").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    wanted = scratch.save(able.withColumn("rid", F.monotonically_increasing_id()), "wanted")
    segments = scratch.save(_segments(docs, wanted, wanted.count(), words), "segments")
    lists = scratch.save(prefixes(segments, percent, scratch), "lists")
    member = F.struct(F.xxhash64("rid", "h").alias("turn"), *["rid", "n", "pos", *_CELLS])
    hubs = lists.groupBy("h").agg(F.min(member).alias("x"), F.count("*").alias("members")).filter("members > 1")
    hubs = scratch.save(hubs.select("h", "members", *[F.col(f"x.{c}").alias(f"{c}2") for c in ("rid", "n", "pos", *_CELLS)]), "hubs")
    met = lists.join(hubs, "h").filter((F.col("rid") != F.col("rid2")) & _possible(percent))
    near = scratch.save(met.select(F.least("rid", "rid2").alias("a"), F.greatest("rid", "rid2").alias("b")).distinct(), "near")
    labels = joined(None, near, scratch, "hub")
    rest = lists.join(hubs.filter("members > 2").select("h", "rid2"), "h").filter("rid <> rid2").drop("rid2")
    rest = rest.join(labels.withColumnRenamed("u", "rid"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    rest = scratch.save(rest, "rest")
    apart = rest.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("h")
    left = scratch.save(rest.join(apart, "h", "left_semi"), "apart")
    more = scratch.save(_meet_lists(left, percent).distinct(), "nearer")
    labels = labels if more.isEmpty() else joined(labels, more, scratch, "group")
    scratch.drop("shared", "lists", "hubs", "near", "rest", "apart", "nearer")
    return wanted, segments, labels


def group_links(rid: np.ndarray, owner: np.ndarray, token: np.ndarray, n: np.ndarray, many: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, listed: bool) -> tuple[np.ndarray, np.ndarray, list]:
    """Of classes rid with n-grams (owner, token), `left` ones met with `right` ones: the documents (many a class) that each links with,
    the place of the first class that links join it to, and with listed the pairs."""
    same = left is right
    often = np.bincount(token)[token] > 1
    owner, token = owner[often], token[often]
    token = np.unique(token, return_inverse=True)[1]
    edge = np.searchsorted(owner, np.arange(len(rid) + 1))
    mark = np.zeros(int(token.max(initial=-1)) + 1, bool)
    others, part, pairs = np.zeros(len(rid), np.int64), np.arange(len(rid)), []
    beside = np.zeros(len(rid), bool)
    beside[right] = True
    for k in left.tolist():
        own = token[edge[k] : edge[k + 1]]
        if not len(own):
            continue
        mark[own] = True
        o = np.bincount(owner[mark[token]], minlength=len(rid))
        mark[own] = False
        link = beside & ((100 + percent) * o >= percent * (n + n[k]))
        link[k] = False
        hit = np.flatnonzero(link)
        if not len(hit):
            continue
        others[k] += many[hit].sum()
        if not same:
            others[hit] += many[k]
        if listed:
            more = hit[hit > k] if same else hit
            pairs.append((np.full(len(more), rid[k]), rid[more], np.full(len(more), n[k]), n[more], o[more]))
        parts = np.unique(np.append(part[hit], part[k]))
        if len(parts) > 1:
            part[np.isin(part, parts)] = parts[0]
    return others, part, pairs


def _meet(segments: DataFrame, groups: DataFrame, copies: DataFrame, percent: int, listed: bool) -> DataFrame:
    """All links of different classes: each pair (a, b, n_a, n_b, o); or a row for each class in each block: (u, others, root, whole):
    the documents that it links with, the class that links join it to, and whether the block is all of its group.

    A group's classes are dealt into blocks of about SETS and SHINGLES, and each two blocks meet once.
    copies (rid, copies): documents of a class.
    """
    sizes = segments.filter("part = 0").select("rid", "n")
    rows = groups.withColumnRenamed("u", "rid").join(copies, "rid").join(sizes, "rid")
    blocks = F.greatest(F.ceil(F.count("*") / SETS), F.ceil(F.sum("n") / SHINGLES)).cast("int")
    sized = rows.groupBy("label").agg(blocks.alias("blocks"))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = rows.join(sized, "label").withColumn("s", F.pmod(F.xxhash64("rid", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("rid", "label", "copies", "blocks", "s", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"))
    calls = max(shuffle_partitions(segments.sparkSession), math.ceil(total / CALL_SHINGLES))
    dealt = dealt.withColumn("call", F.pmod(F.xxhash64("label", "i", "j"), F.lit(calls)))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())

    def meet(group: pa.Table) -> pa.Table:
        get = lambda c: group.column(c).to_numpy()
        order = np.lexsort((get("rid"), get("j"), get("i"), get("label")))
        group = group.take(pa.array(order))
        label, i, j, rid, s, many, blocks = (get(c) for c in ("label", "i", "j", "rid", "s", "copies", "blocks"))
        hashes = group.column("hashes").combine_chunks()
        hashes = hashes.combine_chunks() if isinstance(hashes, pa.ChunkedArray) else hashes
        offsets, flat = hashes.offsets.to_numpy(), hashes.values.to_numpy()
        found: list = []
        for x, y in _runs(label, i, j):
            own, first, at = np.unique(rid[x:y], return_index=True, return_inverse=True)
            owner = np.repeat(at, np.diff(offsets[x : y + 1]))
            token = np.unique(flat[offsets[x] : offsets[y]], return_inverse=True)[1]
            n = np.bincount(owner, minlength=len(own))
            every, side = np.arange(len(own)), s[x:y][first]
            cross = i[x] != j[x]
            left, right = (every[side == i[x]], every[side == j[x]]) if cross else (every, every)
            others, part, pairs = group_links(own, owner, token, n, many[x:y][first], left, right, percent, listed)
            if listed:
                found += pairs
            else:
                some = np.flatnonzero(others)
                found.append((own[some], others[some], own[part[some]], np.full(len(some), blocks[x] == 1)))
        names = ["a", "b", "n_a", "n_b", "o"] if listed else ["u", "others", "root", "whole"]
        types = [pa.int64()] * 5 if listed else kinds
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[]] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=names)

    met = segments.select("rid", "hashes").join(dealt, "rid").groupBy("call")
    return met.applyInArrow(meet, "a long, b long, n_a long, n_b long, o long" if listed else "u long, others long, root long, whole boolean")


def _linked(docs: DataFrame, table: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """(class, label, others): the classes with links, their component, and the documents of other classes that they link with."""
    wanted, segments, groups = _groups(docs, table, scratch, words, percent)
    met = scratch.save(_meet(segments, groups, _copies(table, wanted), percent, False), "met")
    whole = met.filter("whole").select("u", "others", F.col("root").alias("label"))
    parts = met.filter("not whole")
    if not parts.isEmpty():
        labels = joined(None, parts.filter("u <> root").select(F.col("u").alias("a"), F.col("root").alias("b")), scratch, "parts")
        whole = whole.unionByName(parts.groupBy("u").agg(F.sum("others").alias("others")).join(labels, "u"))
    linked = scratch.save(whole.join(wanted.select(F.col("rid").alias("u"), "class"), "u").select("class", "label", "others"), "linked")
    scratch.drop("segments", "met")
    return linked


def _copies(table: DataFrame, wanted: DataFrame) -> DataFrame:
    counts = table.filter("class is not null and doc_id is not null").groupBy("class").agg(F.count("*").alias("copies"))
    return wanted.select("rid", "class").join(counts, "class").select("rid", "copies")


def _members(table: DataFrame, linked: DataFrame, scratch: Scratch) -> DataFrame:
    """One row a document: doc_id, text_key, n_shingles; first, the component's least (doc_id, text_key), and n_links; null where it is alone."""
    classes = table.filter("class is not null and doc_id is not null").groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.count("*").alias("copies"))
    classes = scratch.save(classes.join(linked, "class", "left").filter("copies > 1 or label is not null"), "classes")
    firsts = classes.filter("label is not null").groupBy("label").agg(F.min("least").alias("first"))
    known = classes.filter("label is not null").join(firsts, "label").unionByName(classes.filter("label is null").withColumn("first", F.col("least")))
    known = scratch.save(known.select("class", "copies", "first", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "known")
    n, total = known.count(), table.count()
    return skew_lookup(table.drop("able"), known, "class", ["first", "n_links"], "copies", total, F.col("doc_id"), size=96 * n)


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, fragment_bytes: int = FRAGMENT_BYTES) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, and n_links, the other rows that it links with."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    table = document_table(docs, scratch, words, percent, fragment_bytes)
    out = _members(table, _linked(docs, table, scratch, words, percent), scratch)
    known = F.col("doc_id").isNotNull()
    links = F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long")
    return out.select("doc_id", "n_shingles", F.when(known, F.coalesce("first.doc_id", "doc_id")).alias("component_id"), links.alias("n_links"))


def jaccard_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, fragment_bytes: int = FRAGMENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """All links: (class, class2, n_shingles, n_shingles2, shared), a row for each pair of different classes that links; and
    the membership (doc_id, class), a row for each document that can link. Documents of one class all link.
    Their rows grow with the square of a component's different texts."""
    scratch = Scratch(docs.sparkSession, "links")
    table = document_table(docs, scratch, words, percent, fragment_bytes)
    wanted, segments, groups = _groups(docs, table, scratch, words, percent)
    found = scratch.save(_meet(segments, groups, _copies(table, wanted), percent, True), "links")
    of = wanted.select("rid", "class")
    pairs = found.join(of.withColumnRenamed("rid", "a"), "a").join(of.select(F.col("rid").alias("b"), F.col("class").alias("class2")), "b")
    members = table.filter("class is not null and doc_id is not null").select("doc_id", "class")
    return pairs.select("class", "class2", F.col("n_a").alias("n_shingles"), F.col("n_b").alias("n_shingles2"), F.col("o").alias("shared")), members


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, fragment_bytes: int = FRAGMENT_BYTES) -> DataFrame:
    """docs with one document of each component: that with the least doc_id; of its repeated rows one stays.
    Documents without words or without a doc_id all stay."""
    scratch = Scratch(docs.sparkSession, "kept")
    work = Scratch(docs.sparkSession, "jaccard")
    table = document_table(docs, work, words, percent, fragment_bytes)
    linked = _linked(docs, table, work, words, percent)
    members = scratch.save(_members(table, linked, work).filter("first is not null and doc_id is not null").select("doc_id", "text_key", "first"), "members")
    work.drop()
    own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    out = scratch.save(members.filter(~own).select("doc_id", "text_key").distinct(), "out")
    again = scratch.save(members.filter(own).groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "text_key"), "again")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"))
    side = lambda df: F.broadcast(df) if 32 * df.count() <= BROADCAST_BYTES else df
    kept = rows.join(side(out), ["doc_id", "text_key"], "left_anti")
    if not again.isEmpty():
        # equal rows meet map-side first, so one that holds much of the table is no burden
        twice = kept.join(side(again), ["doc_id", "text_key"], "left_semi").groupBy("doc_id", "text_key").agg(F.first("_row").alias("_row"))
        kept = kept.join(side(again), ["doc_id", "text_key"], "left_anti").select("_row").unionByName(twice.select("_row"))
    return kept.select("_row.*")


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [words] ELSE list_transform(range(1, len(words) - 3), lambda i: words[i : i + 4]) END) AS gram FROM t),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.doc_id = d.doc_id
"""

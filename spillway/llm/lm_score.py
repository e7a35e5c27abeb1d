"""Operator 7: log probabilities of whole texts by a causal self-attention model of subword ids, beside a unigram base.

One pass encodes the documents, a row of ids a batch, and deals the batches' words into fragments
of the hash order. Each fragment counts its words over all training documents and sends back, for
each batch, the documents' partial sums of log10(c + 1) and of known tokens.

The model learns from all training documents. Counts of all their ids make the classes and the odds within them, and
counts of all pairs of classes that follow each other make the odds that the layer starts from. The layer's weights begin with a
few hundred steps on the driver over WARM batches; then PASSES passes over the id table share all training
documents among them: every task steps through its batches, every window of every document and every target in it once,
and the tasks' weights are averaged by their targets. So counts cover every training id, and steps grow with the corpus and see every training token. Then each batch is scored in overlapping windows,
every token once.

Defined results: null and empty texts have the end as their only token; without training
documents the base is that of no counts and the model that of its first weights; a null doc_id counts
as an empty text in the remainder and stays null; repeated rows count and score as often as they
occur; ids with tied counts are ranked by number; a very long text is a batch of its own and is scored whole, in windows as any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import Scratch, claim, doc_bucket
from .shingles import fragment_of
from .tokens import batches, encoder

#: Batches, of at most so many bytes of ids, that the driver starts the weights from.
WARM = 4
WARM_BYTES = 4 << 20

#: Rates of the passes over the corpus; each takes its share of the batches, and all are taken.
PASSES = (0.004, 0.002)

#: Characters of text in a batch, at most, but for a single text.
CHARS = 2 << 20

#: Fragment rows that a batch of documents sends at a time.
SENT = 8

FRAGMENT_BYTES = 48 << 20

#: Row groups of the dealt rows.
GROUP_BYTES = 8 << 20
MODULUS, HELD = 7, 2

_DEALT = "fragment int, batch long, doc_ids binary, lengths binary, words binary, ids binary, id_counts binary, hashes binary, counts binary, spread binary, docs binary, times binary"
_PARTS = "batch long, docs binary, sums binary, known binary, n double, v double"
_SCORED = "batch long, doc_ids binary, words binary, scores binary"
_LEARNT = "targets long, loss double, weights binary"
_ROWS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class _Places(dict):
    """Words by the order in which they are met first."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _joined(words: list[bytes], place: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts, from the ids of distinct words, the words' places and the texts' numbers of words; and the texts' numbers of ids."""
    flat = np.frombuffer(b"".join(words), "<u2")
    size = np.array([len(x) // 2 for x in words], np.int64)
    first = np.cumsum(size) - size
    each = size[place]
    ends = np.cumsum(each)
    at = np.arange(int(each.sum())) + np.repeat(first[place] - (ends - each), each)
    bounds = np.r_[0, ends][np.cumsum(sizes, dtype=np.int64)]
    return flat[at], np.diff(np.r_[0, bounds]).astype("<u4")


def _held(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % MODULUS == HELD for x in ids], bool)


def _batch(rows: list, schema: str, kinds: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])


def _dump(ids: list) -> bytes:
    return np.packbits([x is None for x in ids]).tobytes() + np.array([0 if x is None else x for x in ids], "<i8").tobytes()


def _load(raw: bytes, n: int) -> list:
    bits = -(-n // 8)
    null = np.unpackbits(np.frombuffer(raw[:bits], np.uint8))[:n]
    return [None if k else int(x) for x, k in zip(np.frombuffer(raw[bits:], "<i8"), null, strict=True)]


def deal(docs: DataFrame, tokenizer: str, fragments: int) -> DataFrame:
    """For each batch of documents a row with their ids, and a row for each fragment with their words."""

    def make(it):
        from pyspark import TaskContext

        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 10]
        enc = encoder(tokenizer, False, 2)
        key = TaskContext.get().partitionId() << 32
        for batch, first, last, texts in batches(it, rows=20_000, chars=CHARS):
            doc_ids = batch.column("doc_id")[first:last].to_pylist()
            train = ~_held(doc_ids)
            local = _Places()
            parts = [t.encode().lower().split() for t in texts]
            sizes = np.array([len(x) for x in parts], "<u4")
            place = np.fromiter(map(local.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
            del parts
            ids, lengths = _joined(enc.words(list(local)), place, sizes)
            counts = np.bincount(ids[np.repeat(train, lengths)], minlength=1)
            used = np.flatnonzero(counts)
            rows = [(-1, key, _dump(doc_ids), lengths.tobytes(), sizes.tobytes(), ids.tobytes(), used.astype("<u2").tobytes() + counts[used].astype("<u4").tobytes(), *[None] * 5)]
            if len(place):
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, local), np.uint64, len(local))
                pair, times = np.unique(place * len(texts) + np.repeat(np.arange(len(texts)), sizes), return_counts=True)
                word, doc = pair // len(texts), pair % len(texts)
                trained = np.bincount(word, times * train[doc], len(local)).astype("<u4")
                spread = np.bincount(word, minlength=len(local))
                part = fragment_of(hashes, fragments)
                by_word = np.argsort(part, kind="stable")
                by_pair = np.argsort(part[word], kind="stable")
                some, first_word = np.unique(part[by_word], return_index=True)
                word_cuts = np.r_[first_word, len(by_word)].tolist()
                pair_cuts = np.r_[np.searchsorted(part[word][by_pair], some), len(by_pair)].tolist()
                for k, f in enumerate(some.tolist()):
                    w, p = by_word[word_cuts[k] : word_cuts[k + 1]], by_pair[pair_cuts[k] : pair_cuts[k + 1]]
                    rows.append((f, key, *[None] * 5, hashes[w].astype("<u8").tobytes(), trained[w].tobytes(), spread[w].astype("<u2").tobytes(), doc[p].astype("<u2").tobytes(), times[p].astype("<u4").tobytes()))
                    if len(rows) >= SENT:
                        yield _batch(rows, _DEALT, kinds)
                        rows = []
            key += 1
            if rows:
                yield _batch(rows, _DEALT, kinds)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, _DEALT)


def _count(group: pa.Table) -> pa.Table:
    """Of one fragment: each batch's documents' sums of log10(c + 1) and known tokens; a row of batch -1 with N and V."""
    claim(_count, lambda: None)  # the encoder's memo goes
    column = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in group.column(c)]
    hashes, docs, times, spread = column("hashes", "<u8"), column("docs", "<u2"), column("times", "<u4"), column("spread", "<u2")
    _, same = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(same, np.concatenate(column("counts", "<u4")))
    value, known = np.log10(total + 1)[same], (total > 0)[same]
    out, at = [], 0
    for key, h, d, t, s in zip(group.column("batch").to_pylist(), hashes, docs, times, spread, strict=True):
        v, k = np.repeat(value[at : at + len(h)], s), np.repeat(known[at : at + len(h)], s)
        at += len(h)
        who, own = np.unique(d, return_inverse=True)
        out.append((key, who.tobytes(), np.bincount(own, v * t).astype("<f8").tobytes(), np.bincount(own, k * t).astype("<u4").tobytes(), None, None))
    out.append((-1, None, None, None, float(total.sum()), float((total > 0).sum())))
    return pa.Table.from_batches([_batch(out, _PARTS, [pa.int64(), *[pa.binary()] * 3, pa.float64(), pa.float64()])])


def _id_counts(heads: DataFrame) -> dict[int, int]:
    """Counts of the ids over all training documents; there are no more ids than the vocabulary has."""

    def add(it):
        total = np.zeros(1 << 16, np.int64)
        for batch in it:
            for raw in batch.column("id_counts"):
                raw = raw.as_py()
                n = len(raw) // 6
                np.add.at(total, np.frombuffer(raw[: 2 * n], "<u2"), np.frombuffer(raw[2 * n :], "<u4"))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = heads.select("id_counts").mapInArrow(add, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in rows.collect()}


def _word_ends(tokenizer: str) -> tuple[int, np.ndarray]:
    """The vocabulary's size, and whether each id, and the end after the last, ends a word."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(tokenizer).get_vocab()
    size = max(vocab.values()) + 1
    ends = np.zeros(size + 1, bool)
    ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
    ends[size] = True
    return size, ends


def _sequences(lengths: bytes, ids: bytes, end: int) -> tuple[np.ndarray, np.ndarray]:
    """A batch's documents with their ends: ids, and each document's number of them."""
    size = np.frombuffer(lengths, "<u4").astype(np.int64)
    full, own = np.full(int(size.sum()) + len(size), end, np.int32), np.ones(int(size.sum()) + len(size), bool)
    own[np.cumsum(size + 1) - 1] = False
    full[own] = np.frombuffer(ids, "<u2")
    return full, size + 1


def _training(batch: pa.RecordBatch, end: int):
    """Of each row of a batch: its key, and the ids and sizes of its training documents."""
    for key, doc_ids, lengths, ids in zip(*(batch.column(c) for c in ("batch", "doc_ids", "lengths", "ids")), strict=True):
        full, size = _sequences(lengths.as_py(), ids.as_py(), end)
        train = ~_held(_load(doc_ids.as_py(), len(size)))
        yield key.as_py(), full[np.repeat(train, size)], size[train]


_HEADS = ("batch", "doc_ids", "lengths", "ids")


def _pair_counts(heads: DataFrame, vocabulary: attention.Vocabulary, end: int) -> np.ndarray:
    """How often each class follows each class in all training documents; there are no more pairs than classes squared."""
    held = heads.sparkSession.sparkContext.broadcast(vocabulary)
    cells = (vocabulary.classes + 1) * vocabulary.classes

    def add(it):
        claim(attention, lambda: None)  # memos of earlier steps go
        total, v = np.zeros(cells, np.int64), held.value
        for batch in it:
            for _, ids, size in _training(batch, end):
                total += np.bincount(attention.pairs_of(ids, size, v), minlength=cells)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["pair", "n"])

    def dump(it):
        for batch in it:
            yield pa.RecordBatch.from_pydict({"pairs": [batch.column("pair").to_numpy().astype("<i4").tobytes()], "ns": [batch.column("n").to_numpy().astype("<i8").tobytes()]})

    counts = heads.select(*_HEADS).mapInArrow(add, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(cells, np.int64)
    for r in counts.mapInArrow(dump, "pairs binary, ns binary").collect():
        out[np.frombuffer(r["pairs"], "<i4")] = np.frombuffer(r["ns"], "<i8")
    return out.reshape(-1, vocabulary.classes)


def _pass(heads: DataFrame, scratch: Scratch, name: str, vocabulary: attention.Vocabulary, prior: attention.Prior, weights: np.ndarray, end: int, rate: float) -> tuple[np.ndarray, int]:
    """The mean of the weights to which the tasks come, each from `weights` on over its batches; and the targets. Sums of about the root of the tasks' number pass the driver."""
    spark = heads.sparkSession
    held = spark.sparkContext.broadcast((vocabulary, prior, weights))

    def learn(it):
        claim(attention, lambda: None)  # memos of earlier steps go
        vocabulary, prior, weights = held.value
        model = attention.Model(vocabulary.rows, vocabulary.classes)
        model.load(weights)
        adam, loss, seen = attention.Adam(model), 0.0, 0
        for batch in it:
            for key, ids, size in _training(batch, end):
                if len(size):
                    got, n = attention.learn(model, adam, ids, size, vocabulary, prior, rate, np.random.default_rng(key))
                    loss, seen = loss + got, seen + n
        if seen:
            yield pa.RecordBatch.from_pydict({"targets": [seen], "loss": [loss], "weights": [model.flat().astype("<f4").tobytes()]})

    learnt = scratch.save(heads.select(*_HEADS).mapInArrow(learn, _LEARNT), name)
    groups = max(1, math.isqrt(learnt.count()))

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(w.as_py(), "<f4").astype(np.float64) * n.as_py() for w, n in zip(group.column("weights"), group.column("targets"), strict=True))
        return pa.table({"targets": [sum(group.column("targets").to_pylist())], "loss": [sum(group.column("loss").to_pylist())], "weights": [total.astype("<f8").tobytes()]})

    sums = learnt.groupBy(F.pmod(F.xxhash64("loss", "targets"), F.lit(groups)).alias("g")).applyInArrow(add, _LEARNT).collect()
    held.unpersist()
    seen = sum(r["targets"] for r in sums)
    return (sum(np.frombuffer(r["weights"], "<f8") for r in sums) / seen).astype(np.float32) if seen else weights, seen


def fit(heads: DataFrame, tokenizer: str, scratch: Scratch, n_docs: int, steps: int = 900) -> tuple[attention.Vocabulary, attention.Prior, attention.Model]:
    """Classes and their odds from the counts of all training documents, and the layer's weights from passes over all of them."""
    size, ends = _word_ends(tokenizer)
    counts = np.zeros(size + 1, np.int64)
    for i, n in _id_counts(heads).items():
        counts[i] = n
    counts[size] = n_docs
    vocabulary = attention.Vocabulary(counts, ends)
    prior = attention.Prior(_pair_counts(heads, vocabulary, size))
    keys = [r["batch"] for r in heads.filter(F.octet_length("ids") <= WARM_BYTES).select("batch").orderBy(F.xxhash64("batch"), "batch").limit(WARM).collect()]
    few = sorted(heads.filter(F.col("batch").isin(keys)).select(*_HEADS).collect(), key=lambda r: r["batch"])
    some = list(_training(pa.RecordBatch.from_pydict({c: [r[c] for r in few] for c in _HEADS}), size)) if few else []
    join = lambda k, kind: np.concatenate([x[k] for x in some] or [np.zeros(0, kind)])
    model = attention.train(join(1, np.int32), join(2, np.int64), vocabulary, prior, steps=steps)
    for k, rate in enumerate(PASSES):
        share = heads.filter(F.pmod(F.xxhash64("batch", F.lit(1)), F.lit(len(PASSES))) == k)
        model.load(_pass(share, scratch, f"pass-{k}", vocabulary, prior, model.flat(), size, rate)[0])
    return vocabulary, prior, model


def lm_scores(docs: DataFrame, tokenizer: str, steps: int = 900, fragment_bytes: int = FRAGMENT_BYTES) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    size, n_docs = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum((doc_bucket(modulus=MODULUS) != HELD).cast("long")), F.lit(0))).first()
    dealt = scratch.save(deal(docs, tokenizer, max(1, math.ceil(size / fragment_bytes))), "dealt", GROUP_BYTES)
    parts = scratch.save(dealt.filter("fragment >= 0").select("fragment", "batch", "hashes", "counts", "spread", "docs", "times").groupBy("fragment").applyInArrow(_count, _PARTS), "parts")
    words, kinds = parts.filter("batch = -1").agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("v"), F.lit(0.0))).first()
    vocabulary, prior, model = fit(dealt.filter("fragment = -1"), tokenizer, scratch, n_docs, steps)
    end = len(vocabulary.of) - 1
    total, distinct = int(words) + n_docs, int(kinds) + (n_docs > 0)
    floor, end_value = math.log10(total + distinct + 1), math.log10(n_docs + 1)
    held = spark.sparkContext.broadcast((vocabulary, prior, model))

    def apply(it):
        claim(attention, lambda: None)  # memos of earlier steps go
        vocabulary, prior, model = held.value
        for batch in it:
            rows = []
            for key, doc_ids, lengths, sizes, ids in zip(*(batch.column(c) for c in ("batch", "doc_ids", "lengths", "words", "ids")), strict=True):
                full, size = _sequences(lengths.as_py(), ids.as_py(), end)
                score = attention.log_probabilities(model, full, size, vocabulary, prior) / math.log(10)
                rows.append((key.as_py(), doc_ids.as_py(), sizes.as_py(), score.astype("<f8").tobytes()))
            yield _batch(rows, _SCORED, [pa.int64(), *[pa.binary()] * 3])

    def merge(group: pa.Table) -> pa.Table:
        head = next(r for r in group.select(["doc_ids", "words", "scores"]).to_pylist() if r["scores"] is not None)
        n = np.frombuffer(head["words"], "<u4").astype(np.int64)
        sums, known = np.zeros(len(n)), np.zeros(len(n), np.int64)
        for d, s, k in zip(*(group.column(c) for c in ("docs", "sums", "known")), strict=True):
            if d.is_valid:
                who = np.frombuffer(d.as_py(), "<u2").astype(np.int64)
                sums[who] += np.frombuffer(s.as_py(), "<f8")
                known[who] += np.frombuffer(k.as_py(), "<u4")
        doc_ids = _load(head["doc_ids"], len(n))
        base = sums + end_value - (n + 1) * floor
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        columns = (doc_ids, _held(doc_ids), n + 1, known + (n_docs > 0), np.full(len(n), total), base, np.frombuffer(head["scores"], "<f8"))
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _ROWS.split(", ")])

    scored = scratch.save(dealt.filter("fragment = -1").select("batch", "doc_ids", "lengths", "words", "ids").mapInArrow(apply, _SCORED), "scored")
    both = scored.unionByName(parts.filter("batch >= 0").select("batch", "docs", "sums", "known"), allowMissingColumns=True)
    return both.groupBy("batch").applyInArrow(merge, _ROWS)

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spillway.llm import packing, token_file
from spillway.llm.eliasfano import EliasFano
from spillway.llm.queries import op1_token_file, op5_best_fit_packing
from spillway.llm.tokens import Encoder
from tests.oracle import DATA

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ENCODERS = {p: Encoder(p, p == BYTE, 4, memo_size=50) for p in (WORD, BYTE)}
PLAIN = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def ids_of(path, text):
    return PLAIN[path].encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab zİßé́.,'s \n\t ᾈ\x1c\x00<|>"), st.characters(exclude_categories=["Cs"])), max_size=25), max_size=4))
def test_encoder_equals_library(texts):
    for path, e in ENCODERS.items():
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [ids_of(path, t) for t in texts]


PARTS = st.text(st.sampled_from("abS09'.,!@<|>-_\x00\x7fstredvml"), min_size=1, max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(PARTS, st.sampled_from(["it's", "'re", "<|endoftext|>", "a<|endoftext|>b", "fnmi.24@mail4.example.com", "555-8176"])), min_size=1, max_size=5), st.sampled_from(" \n"))
def test_pieces_of_ascii_equal_library(parts, between):
    text = between.join(parts)
    assert np.frombuffer(ENCODERS[BYTE].encode([text])[0], "<u4").tolist() == ids_of(BYTE, text)


def test_ascii_needs_no_encode_of_single_parts(monkeypatch):
    e, asked = Encoder(BYTE, True, 4), []
    library = e._library
    monkeypatch.setattr(e, "_library", lambda texts: asked.extend(texts) or library(texts))
    text = "Call (716) 555-8176, or it's fnmi.24@mail4.example.com\nThe end!! 12.5%"
    assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == ids_of(BYTE, text)
    assert asked == ["\n"]


def test_new_parts_go_to_the_model_in_rows(monkeypatch):
    e, asked, alone = Encoder(BYTE, True, 4), [], []
    library, piece, after = e._library, e._piece, e._after_blank
    monkeypatch.setattr(e, "_library", lambda texts: asked.extend(texts) or library(texts))
    monkeypatch.setattr(e, "_piece", lambda p: alone.append(p) or piece(p))
    e.spaced.learn = lambda p: alone.append(p) or after(p)
    texts = [f"head {a} élan{b} (x{i}) zorb-7# café{b}, it's{b}" for i, (a, b) in enumerate(zip(("ardoga", "ntérat", "über"), ("$$$", "!!", "'"), strict=True))] * 90
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [ids_of(BYTE, t) for t in texts]
    assert asked == ["\n"] and all(not x[:1].isalpha() or x[-1] in "$!'," for x in alone)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=700))
def test_elias_fano(steps):
    values = np.cumsum(steps) if steps else np.zeros(0, np.int64)
    e = EliasFano.encode(values)
    assert e.values().tolist() == values.tolist()
    assert [e.select(i) for i in range(0, len(values), 37)] == values[::37].tolist()
    with pytest.raises(IndexError):
        e.select(len(values))
    if len(values) > 300:
        assert e.nbytes() < 8 * len(values) / 2


def test_select_needs_no_table():
    r = np.random.default_rng(0)
    for n, steps in ((200_000, r.integers(1, 900, 200_000)), (70_000, r.geometric(0.001, 70_000)), (9_000, r.integers(0, 2, 9_000) * r.integers(0, 1 << 40, 9_000))):
        values = np.cumsum(steps)
        e = EliasFano.encode(values)
        held = sum(x.nbytes for x in vars(e).values() if isinstance(x, np.ndarray))
        assert held == e.nbytes() and len(e.samples) <= 0.06 * (len(e.low) + len(e.high))
        assert 8 * e.nbytes() <= n * (2.2 + np.log2(max(2, values[-1] / n)))
        some = np.sort(r.integers(0, n, 50))
        assert [e.select(int(i)) for i in some] == values[some].tolist()
        assert np.concatenate(list(e.blocks(5000))).tolist() == values.tolist()
        assert [e.find(int(values[i])) for i in some[:9]] == [int(np.searchsorted(values, values[i], "right")) for i in some[:9]]
    far = np.array([0, 1, 1 << 63, (1 << 64) - 1], np.uint64)
    assert EliasFano.encode(far).values().tolist() == far.tolist()


def test_elias_fano_refuses():
    with pytest.raises(ValueError):
        EliasFano.encode([2, 1])


def _want(rows, end):
    out, at = [], 0
    for doc_id, text in rows:
        ids = [*ids_of(WORD, text), end]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_file(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted(tuple(r) for r in op1_token_file(spark, f"{DATA}/sf0.001").collect())
    assert got == _want(rows, 2)


def test_token_file_odd_rows(spark, odd, none, tmp_path):
    got = token_file.token_output(odd, WORD).collect()
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    by_start = sorted(got, key=lambda r: r["start"])
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == [(r["doc_id"] is not None, r["doc_id"] or 0) for r in by_start]
    assert [r["start"] for r in by_start] == [0, *np.cumsum([r["n_tokens"] for r in by_start])[:-1].tolist()]
    want = sorted((str(d), n, c) for d, t in texts for _, _, n, c in [_want([(d, t)], 2)[0]])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert token_file.token_output(none, WORD).count() == 0


def test_file_by_document(tmp_path):
    docs = [(None, np.array([1, 2], "<u2").tobytes()), (5, b""), (9, np.arange(700, dtype="<u2").tobytes())]
    path = f"file://{tmp_path}/t.bin"
    assert token_file.write_file(path, iter(docs), 2) == (3, 702)
    f = token_file.TokenFile(path)
    assert [(k, x.tobytes()) for k, _, x in f.documents(slab=1)] == docs
    assert [f.document(i).tobytes() for i in range(3)] == [d for _, d in docs]
    assert [f.document_at(p) for p in (0, 1, 2, 701)] == [0, 0, 2, 2]
    wide = [(k, b"ab" * (i % 3)) for i, k in enumerate([None, None, -(1 << 63), -5, -5, 0, (1 << 63) - 1] + [(1 << 63) - 1] * 9000)]
    token_file.write_file(f"file://{tmp_path}/w.bin", iter(wide), 2)
    w = token_file.TokenFile(f"file://{tmp_path}/w.bin")
    assert [(k, x.tobytes()) for k, _, x in w.documents()] == wide
    assert w.nbytes() == sum(x.nbytes for e in (w.bounds, w.keys) for x in vars(e).values() if isinstance(x, np.ndarray)) < 9007 * 9
    with pytest.raises(ValueError):
        token_file.write_file(f"file://{tmp_path}/x.bin", iter([(3, b""), (2, b"")]), 2)
    raw = (tmp_path / "t.bin").read_bytes()
    (tmp_path / "cut.bin").write_bytes(raw[:-3])
    with pytest.raises(ValueError):
        token_file.TokenFile(f"file://{tmp_path}/cut.bin")


def _check_pieces(rows, docs, size, end):
    ids = {}
    for d, t in docs:
        ids.setdefault(d, []).append([*ids_of(BYTE, t), end])
    want = sorted((str(d), k, a, n, zlib.crc32(np.array(x[a : a + n], "<u4").tobytes())) for d, xs in ids.items() for x in xs for k, (a, n) in enumerate(packing.cut(len(x), size)))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    return len(seqs)


def test_packing(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = op5_best_fit_packing(spark, f"{DATA}/sf0.001").collect()
    n = _check_pieces(rows, docs, 2048, 0)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) + 2
    assert {r["swaps"] > 0 for r in rows if r["length"] < 2048} == {True}


def test_packing_odd_rows(spark, odd, none, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    _check_pieces(packing.best_fit_packing(odd, BYTE, size=64).collect(), docs, 64, 0)
    monkeypatch.setattr(packing, "SHARD", 4)
    rows = packing.best_fit_packing(odd, BYTE, size=64, with_ids=True).collect()
    _check_pieces(rows, docs, 64, 0)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert packing.best_fit_packing(none, BYTE).count() == 0


def test_cut():
    assert packing.cut(2048, 2048) == [(0, 2048)]
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]
    assert packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_search_packs_whole(lengths):
    where, offset, bins = packing.pack(lengths, 100)
    n = bins.used()
    fill = np.bincount(where, lengths, n) if lengths else np.zeros(0)
    assert (fill <= 100).all() and (fill > 0).all()
    first = packing.Bins(lengths, 100)
    first.place(sorted(range(len(lengths)), key=lambda i: -lengths[i]))
    assert n <= first.used()


def test_search_empties_bins():
    lengths = [60, 50, 40, 30, 20] * 1
    bins = packing.Bins(lengths, 100)
    for i, group in enumerate([[0, 4], [1, 3], [2]]):
        bins.items.append(list(group))
        bins.room.append(100)
        bins._set(i, 100 - sum(lengths[k] for k in group))
    squares = lambda: sum((100 - r) ** 2 for r in bins.room)
    before = squares()
    bins.search()
    assert bins.used() == 2 and squares() > before


def test_the_search_decides():
    lengths = np.random.default_rng(1).choice([*range(5, 120), *range(300, 2000, 7)], 1500)
    bins = packing.pack(lengths, 2048)[2]
    start = packing.Bins(lengths, 2048)
    start.place(range(1500))
    falling = packing.Bins(lengths, 2048)
    falling.place(np.argsort(-lengths, kind="stable").tolist())
    assert start.used() > bins.used() <= falling.used() and bins.moves + bins.swaps > 100


def test_search_ends_where_no_bin_has_a_step():
    lengths = np.random.default_rng(0).integers(300, 901, 4000)
    bins = packing.Bins(lengths, 2048)
    bins.place(range(4000))
    start = bins.used()
    bins.search()
    assert bins.used() < start and bins.moves and bins.swaps
    fill = [sum(bins.lengths[i] for i in x) for x in bins.items]
    assert sorted(i for x in bins.items for i in x) == list(range(4000)) and max(fill) <= 2048
    assert all(2048 - f == r for f, r in zip(fill, bins.room, strict=True))
    assert bins.used() == bins.bound() or not any(bins._improve(a) for a in range(len(bins.items)) if bins.items[a] and bins.room[a])
    assert bins.used() <= 1195

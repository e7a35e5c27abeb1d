import base64
import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spillway.llm import ann, common, jaccard_join, warc
from spillway.llm.common import Scratch
from spillway.llm.components import components
from spillway.llm.queries import op2_jaccard_join, op8_warc, op10_nearest
from spillway.llm.shingles import shingle_hashes, words_of
from tests.oracle import DATA


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _set(text):
    w = _words(text)
    return frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _components(docs):
    """Brute force: every pair of documents."""
    sets = [(d, _set(t)) for d, t in docs]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for j in range(i):
            e, b = sets[j]
            if a and b and d is not None and e is not None and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: float("inf"))
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least[find(i)], d)
    return sorted((str(d), len(s), str(least[find(i)] if d is not None else None)) for i, (d, s) in enumerate(sets))


def _got(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def test_jaccard_join(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert _got(op2_jaccard_join(spark, f"{DATA}/sf0.001")) == _components(docs)


def _near(seed, groups=6, size=25):
    """Groups of near copies with one to many edits, and documents that only share a passage."""
    r = np.random.default_rng(seed)
    word = lambda: f"w{r.integers(0, 3000)}"
    out = []
    passage = [word() for _ in range(50)]
    for g in range(groups):
        base = [word() for _ in range(int(r.integers(5, 130)))]
        for k in range(size):
            w = list(base)
            for _ in range(int(r.integers(0, 5))):
                w[r.integers(0, len(w))] = word()
            out.append((1000 * g + k * 7 % 100, " ".join(w)))
    for k in range(40):
        out.append((9000 + k, " ".join([word() for _ in range(6)] + passage + [word() for _ in range(int(r.integers(0, 8)))])))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_near_copies(spark, seed, monkeypatch):
    docs = _near(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 7 + 2 * seed)
    monkeypatch.setattr(jaccard_join, "SETS", 6 + 100 * seed)
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", 50)
    monkeypatch.setattr(jaccard_join, "CALL_SHINGLES", 1000)
    want = _components(docs)
    assert _got(jaccard_join.jaccard_components(df, fragment_bytes=3000)) == want
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(jaccard_join, "BROADCAST_BYTES", -1)
    assert _got(jaccard_join.jaccard_components(df)) == want
    first = {int(c) for _, n, c in want}
    assert {r["doc_id"] for r in jaccard_join.keep_one(df).collect()} == first


def _borderline(size, seed=5):
    """One text with two edits a copy, so that copies link with a part of the others, between texts of their own."""
    r = np.random.default_rng(seed)
    base = [f"w{r.integers(0, 3000)}" for _ in range(120)]
    out = []
    for k in range(size):
        w = list(base)
        for i in r.integers(0, len(w), 2):
            w[i] = f"x{r.integers(0, 1 << 30)}"
        out.append((k, " ".join(w)))
    return out + [(10_000 + k, " ".join(f"v{r.integers(0, 1 << 30)}" for _ in range(60))) for k in range(20)]


@pytest.mark.parametrize("sets", [16, 1024])
def test_rows_grow_with_a_group_not_with_its_square(spark, monkeypatch, sets):
    monkeypatch.setattr(jaccard_join, "SETS", sets)
    edges = {}
    for size in (60, 120):
        docs = _borderline(size)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        scratch = Scratch(spark, "t")
        scratch.drop = lambda *names: None
        table = jaccard_join.document_table(df, scratch)
        jaccard_join._linked(df, table, scratch, 5, 80)
        rows = lambda name: spark.read.parquet(scratch.path(name)).count()
        lists, edges[size] = rows("lists"), rows("near") + rows("nearer")
        assert edges[size] <= lists and rows("met") <= size * -(-size // sets)
        assert _got(jaccard_join.jaccard_components(df)) == _components(docs)
    assert edges[120] <= 3 * edges[60]


def test_lists_and_groups_meet_in_full():
    r = np.random.default_rng(3)
    for trial in range(30):
        size = int(r.integers(2, 40))
        sets = [np.unique(r.integers(0, 30, int(r.integers(6, 24)))) for _ in range(size)]
        n = np.array(list(map(len, sets)))
        shared = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
        link = (180 * shared >= 80 * (n[:, None] + n[None])) & ~np.eye(size, dtype=bool)
        cells = np.stack([jaccard_join.bitmap(shingle_hashes([str(x).encode() for x in s], 1)).view(np.uint64) for s in sets])
        every, label = np.arange(size), r.integers(0, size, size)
        parts = [(every, every)] if trial % 2 else [(every[::2], every[::2]), (every[1::2], every[1::2]), (every[::2], every[1::2])]
        parent = {int(x): int(x) for x in label}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for left, right in parts:
            found = jaccard_join.list_edges(n, np.zeros(size, np.int64), label, cells, left, right, 80)
            assert len(found) < size
            for a, b in found:
                parent[find(int(label[a]))] = find(int(label[b]))
        for a, b in np.argwhere(link):
            assert find(int(label[a])) == find(int(label[b]))
        owner, token, many = np.repeat(every, n), np.concatenate(sets), r.integers(1, 4, size)
        others = np.zeros(size, np.int64)
        pairs = set()
        for left, right in parts:
            right = left if right is left else right
            got, part, listed = jaccard_join.group_links(every, owner, np.unique(token, return_inverse=True)[1], n, many, left, right, 80, True)
            others += got
            pairs |= {(min(a, b), max(a, b), o) for x in listed for a, b, _, _, o in zip(*(y.tolist() for y in x), strict=True)}
        assert (others == link @ many).all()
        assert pairs == {(int(a), int(b), int(shared[a, b])) for a, b in np.argwhere(link) if a < b}


def test_all_links_are_listed(spark, monkeypatch):
    docs = [(k, t) for k, (_, t) in enumerate(_near(4, groups=3, size=16))]
    docs += [(500 + k, t) for k, t in docs[:9]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard_join, "SETS", 5)
    sets = {d: _set(t) for d, t in docs}
    want = {(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    pairs, members = jaccard_join.jaccard_links(df, fragment_bytes=3000)
    of = {}
    for r in members.collect():
        of.setdefault(bytes(r["class"]), []).append(r["doc_id"])
    rows = [(bytes(r["class"]), bytes(r["class2"]), r["n_shingles"], r["n_shingles2"], r["shared"]) for r in pairs.collect()]
    for a, b, *sizes in rows:
        x, y = sets[of[a][0]], sets[of[b][0]]
        assert sizes == [len(x), len(y), len(x & y)]
    got = [(min(i, j), max(i, j)) for a, b, *_ in rows for i in of[a] for j in of[b]] + [(i, j) for x in of.values() for i in x for j in x if i < j]
    assert len(got) == len(set(got)) and set(got) == want
    n = {r["doc_id"]: r["n_links"] for r in jaccard_join.jaccard_components(df).collect()}
    assert n == {i: sum(i in p for p in want) for i in sets}


def test_jaccard_odd_rows(spark, odd, none):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert _got(jaccard_join.jaccard_components(odd)) == _components(docs)
    assert jaccard_join.jaccard_components(none).count() == 0
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and jaccard_join.keep_one(none).count() == 0
    ids = sorted((str(r["doc_id"]), (r["text"] or "")[:9]) for r in kept.collect())
    assert ids.count(("1", "a b c d e")) == 1 and ("6", "lorem ips") not in ids and ("5", "lorem ips") in ids
    assert ("2", "") in ids and ("None", "x y z") in ids and ("10", "A b c d e") not in ids and len(ids) == odd.count() - 3


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abAB É\t\n\x0b\x1c\x85"), max_size=40), st.text(st.sampled_from("abAB É\t\n"), max_size=40))
def test_hashed_sets(a, b):
    x, y = (set(shingle_hashes(words_of(t)).tolist()) for t in (a, b))
    assert len(x) == len(_set(a)) and len(x & y) == len(_set(a) & _set(b))
    apart = sum(bin(int(p) ^ int(q)).count("1") for p, q in zip(*(jaccard_join.bitmap(shingle_hashes(words_of(t))).view("<u8") for t in (a, b)), strict=True))
    assert apart <= len(x ^ y)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (5, 5), (7, 3)] + [(1000, 1000 + i) for i in range(1, 50)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["u"]: r["label"] for r in components(df, Scratch(spark, "c"), "x").collect()}
    assert {got[i] for i in range(41)} == {0} and got[300] == 100 and got[1049] == 1000 and len(got) == 41 + 3 + 50
    assert components(df.limit(0), Scratch(spark, "c"), "x").count() == 0


def _pages(rows):
    same = defaultdict(list)
    for i, _, h in rows:
        same[(h or "").encode()].append(i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        keep = max((x for x in same[raw] if x is not None), default=None)
        copy = keep is not None and i != keep
        out.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if copy else "response", str(keep if copy else None)))
    return sorted(out)


def _records(df):
    return sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in df.collect())


def test_warc(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    assert _records(op8_warc(spark, f"{DATA}/sf0.001")) == _pages(rows)


@pytest.mark.parametrize("compress", [True, False])
def test_warc_odd_rows(spark, compress, monkeypatch):
    rows = [(1, "http://a/\r\nx y", "é\r\n\r\nWARC/1.1\r\n"), (2, None, None), (3, "u", ""), (4, "u", "x" * 200_000), (5, "u", "same"), (6, "u", "same"), (None, "u", "same"), (None, None, "alone"), (7, "u", "same"), (7, "u", "same"), (8, "u", "\x1f\x8b\x08 \x00")]
    df = spark.createDataFrame([(*r, 1, 2, "p") for r in rows], "page_id long, url string, html string, copies int, keep int, path string").repartition(2)
    got = warc.warc_round_trip(df, compress=compress)
    assert _records(got) == _pages(rows)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert _records(warc.warc_round_trip(df, compress=compress)) == _pages(rows)
    assert warc.warc_round_trip(df.limit(0)).count() == 0
    least = _records(warc.warc_round_trip(df, least=5, compress=compress))
    assert len(least) == len(rows)
    assert {r[3] for r in least if r[1] < 5} == {"response"}


def _archive(compress, n=8):
    parts = []
    for i in range(n):
        body = (f"page {i} " * (20 + 400 * (i % 3))).encode()
        raw = warc.record(i, f"http://x/{i}", body, warc.base32_sha1(body), None)
        parts.append(warc.member(raw) if compress else raw)
    return parts


def _salvage(data, window=1 << 12):
    out = list(warc.Salvage(lambda n, at: data[at : at + n], len(data), window))
    place = 0
    for x in out:  # records and gaps cover the archive
        assert x.start == place
        place = x.end
    assert place == len(data)
    return [x.page() for x in out if isinstance(x, warc.Record)], [(x.start, x.end) for x in out if isinstance(x, warc.Gap)]


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    parts = _archive(compress)
    at = np.cumsum([0, *map(len, parts)]).tolist()
    whole = b"".join(parts)
    assert _salvage(whole) == (list(range(8)), [])
    hurt = bytearray(whole)
    hurt[at[4] - 20] ^= 0xFF  # in the block; a plain header has no check of its own
    ids, gaps = _salvage(bytes(hurt))
    assert ids == [0, 1, 2, 4, 5, 6, 7] and gaps == [(at[3], at[4])]
    ids, gaps = _salvage(whole[: at[2]] + b"\x1f\x8b\x08garbage WARC/ junk" * 9 + whole[at[2] :])
    assert ids == list(range(8)) and len(gaps) >= 1 and gaps[0][0] == at[2]
    ids, gaps = _salvage(whole[: at[4] + 10] + whole[at[5] :])
    assert ids == [0, 1, 2, 3, 5, 6, 7] and gaps == [(at[4], at[4] + 10)]
    ids, gaps = _salvage(whole[:-20])
    assert ids == list(range(7)) and gaps == [(at[7], len(whole) - 20)]
    assert _salvage(b"") == ([], []) and _salvage(b"none")[1] == [(0, 4)]


@pytest.mark.parametrize("compress", [True, False])
def test_long_headers(compress):
    url = "http://x/" + "a" * 100_000
    parts = [warc.record(i, url + str(i) if i % 2 else "u", b"x" * i, warc.base32_sha1(b"x" * i), None) for i in range(6)]
    parts = [warc.member(x) for x in parts] if compress else parts
    assert _salvage(b"".join(parts)) == (list(range(6)), [])
    junk = b"WARC/1.1\r\n" + b"j" * 50_000
    at = len(b"".join(parts[:3]))
    assert _salvage(b"".join(parts[:3]) + junk + b"".join(parts[3:])) == (list(range(6)), [(at, at + len(junk))])
    whole = b"".join(parts)
    assert _salvage(whole[:-60])[0] == list(range(5))


@pytest.mark.parametrize("compress", [True, False])
def test_query_salvages_damaged_archives(spark, monkeypatch, caplog, compress):
    pages = spark.createDataFrame([(i, f"http://x/{i}" + "y" * (100_000 if i == 3 else 0), f"page {i} " * 400) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    hurt = {}

    def damaged(files, n):
        path = files.first()["path"].removeprefix("file://")
        raw = bytearray(open(path, "rb").read())
        at = len(raw) // 2
        raw[at : at + 30] = b"\x00" * 30
        open(path, "wb").write(raw[:at] + b"junk" * 50 + raw[at:])
        return read(files, n)

    read = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", damaged)
    log = warc.salvage_log
    monkeypatch.setattr(warc, "salvage_log", lambda rows: hurt.update(gaps=log(rows).collect()))
    with caplog.at_level("WARNING"):
        got = _records(warc.warc_round_trip(pages, compress=compress))
    want = _pages([tuple(r) for r in pages.collect()])
    assert set(got) < set(want) and len(want) - 2 <= len(got) < 40
    assert hurt["gaps"] and sum(g["gap_end"] - g["gap_start"] for g in hurt["gaps"]) >= 230 and "gaps" in caplog.text


def test_gaps_are_reported(spark, tmp_path):
    parts = _archive(True)
    (tmp_path / "a.warc.gz").write_bytes(b"".join([*parts[:2], b"junk", *parts[2:]]))
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string")
    rows = warc.read_archives(files, 1).collect()
    gap = [r for r in rows if r["record_type"] == "gap"]
    n = len(parts[0]) + len(parts[1])
    assert len(rows) == 9 and [(r["gap_start"], r["gap_end"]) for r in gap] == [(n, n + 4)] and gap[0]["gap_reason"]


def _nearest(ids, vectors, k, every):
    out = {}
    for q, x in zip(ids, vectors, strict=True):
        if q % every == 0:
            s = [((x * y).sum(), v) for v, y in zip(ids, vectors, strict=True) if v != q]
            out[q] = [(v, p) for p, v in sorted(s, key=lambda t: (-t[0], t[1]))[:k]]
    return out


def test_nearest_recall(spark):
    df = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet")
    pdf = df.toPandas()
    want = _nearest(pdf.vec_id.tolist(), [np.asarray(v, float) for v in pdf.embedding], 20, 20)
    got = defaultdict(list)
    for r in op10_nearest(spark, f"{DATA}/sf0.01").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hit = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]
    assert np.mean(hit) >= 0.9


@pytest.mark.parametrize("block", [16_384, 40])
def test_nearest_ties_and_odd_vectors(spark, block):
    r = np.random.default_rng(2)
    rows = [(i, r.standard_normal(6).round(2).tolist()) for i in range(100)] + [(100 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.5]) for i in range(120)]
    bad = [(300, None), (320, []), (340, [0.0] * 6), (360, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (380, [float("nan")] * 6), (400, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (420, [1.0, 2.0])]
    twice = [(40, [5.0] * 6)]
    df = spark.createDataFrame([(i, v, 7, 1.0, "q") for i, v in rows + bad + twice], "vec_id long, embedding array<float>, dim int, score double, block string").repartition(3)
    good = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows + twice]
    got = defaultdict(list)
    for x in ann.nearest(df, k=5, every=20, block=block).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    want = _nearest([i for i, _ in rows], [v for i, v in good[:-1]], 5, 20)
    for q in want:
        if q != 40:
            cand = sorted(((-(dict(rows_)[q] * y).sum(), v) for v, y in good if v != q for rows_ in [dict(good[:-1])]), key=lambda t: t)[:5]
            assert [(v, pytest.approx(-s)) for s, v in cand] == got[q]
    assert set(got) - {420} == set(want) and 420 not in got
    assert ann.nearest(df.limit(0)).count() == 0


def _exact(ids, vectors, k, every):
    """Brute force by whole numbers: (query id, rank, vec id)."""
    v = np.array(vectors, np.int64)
    out = set()
    for i in range(len(ids)):
        if ids[i] % every == 0:
            s = v @ v[i]
            order = [j for j in np.lexsort((ids, -s)).tolist() if ids[j] != ids[i]][:k]
            out |= {(int(ids[i]), r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(order)}
    return out


@pytest.mark.parametrize("block", [16_384, 150])
def test_ties_of_different_vectors_go_to_the_smaller_id(spark, block):
    r = np.random.default_rng(9)
    ids = r.permutation(2000)
    vectors = r.integers(-2, 3, (2000, 4))
    vectors[(vectors == 0).all(axis=1)] = 1
    df = spark.createDataFrame([(int(i), v.astype(float).tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>").repartition(5)
    got = {(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in ann.nearest(df, k=20, every=20, block=block, sample=500).collect()}
    assert got == _exact(ids, vectors, 20, 20)


def test_recall_and_work_over_several_blocks(spark):
    df = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    pdf = df.toPandas()
    v = np.stack([np.asarray(x, float) for x in pdf.embedding])
    rows = ann.nearest(df, k=20, every=20, block=300, sample=700).collect()
    got = defaultdict(set)
    for x in rows:
        got[x["query_id"]].add(x["vec_id"])
    hit, ids = [], pdf.vec_id.to_numpy()
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        s[i] = -np.inf
        hit.append(len(set(ids[np.argsort(-s)[:20]].tolist()) & got[int(ids[i])]) / 20)
    done = np.mean([x["n_verified"] for x in rows if x["rank"] == 1]) / len(ids)
    assert np.mean(hit) >= 0.9 and done < 0.95


def test_clusters_leave_most_blocks_alone(spark):
    r = np.random.default_rng(4)
    centre = r.standard_normal((40, 32)) * 3
    x = centre[np.arange(4000) % 40] + 0.1 * r.standard_normal((4000, 32))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    rows = ann.nearest(df, k=10, every=200, block=200, sample=1000).collect()
    got = defaultdict(set)
    for y in rows:
        got[y["query_id"]].add(y["vec_id"])
    unit = x / 1
    hit = []
    for q in range(0, 4000, 200):
        s = unit @ unit[q]
        s[q] = -np.inf
        hit.append(len(set(np.argsort(-s)[:10].tolist()) & got[q]) / 10)
    assert np.mean(hit) >= 0.9 and np.mean([y["n_verified"] for y in rows if y["rank"] == 1]) < 2000


def test_stop_is_a_chi_square_test():
    assert ann.quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3) and ann.quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    r = np.random.default_rng(0)
    x = r.standard_normal((4000, 16)) * np.r_[5, 3, np.full(14, 0.3)]
    tree = ann.KdTree(x @ r.standard_normal((16, 8)))
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(4000)) and max(map(len, tree.leaves)) <= ann.LEAF


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(c.STAGES):
        docs = stage(spark, docs, d)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns and docs.count() <= before
            before = docs.count()
    got = sorted(tuple(r) for r in docs.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert got == sorted(tuple(r) for r in c.run(spark, d).select("doc_id", "piece", "start", "length", "ids_crc32").collect())


def test_pipeline_equals_plain_python(spark, tmp_path):
    """Each stage on all that its predecessor kept, against plain Python."""
    import corpus_pipeline as c
    from spillway.llm import quality, toxicity
    from tests.llm.test_text import _metrics

    d = f"{DATA}/sf0.001"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    step = {}
    for name, stage in c.STAGES:
        before, rows = docs, {r["doc_id"]: r for r in docs.collect()}
        docs = Scratch(spark, "t").save(stage(spark, docs, d), name)
        step[name] = rows, {r["doc_id"]: r for r in docs.collect()} if name != "best_fit_packing" else docs.collect()
        if name == "toxicity":
            machine = toxicity.fit(before, labels)
            assert set(step[name][1]) == {i for i, s in zip(rows, machine.scores([r["text"] or "" for r in rows.values()]), strict=True) if s < 0.3}
    rows, kept = step["quality_rules"]
    fails, hosts = {}, defaultdict(list)
    for i, r in rows.items():
        n, chars, symbols, dups, repeats = _metrics(r["text"])
        worded = [x for x in (r["text"] or "").split("\n") if _words(x)]
        fails[i] = [10 * symbols > n, 10 * dups > 3 * len(worded), chars < 3 * n or chars > 12 * n, n < 50 or 100 * repeats > 50 * n]
        hosts[r["source"] or ""].append(i)
    total, bad = len(rows), defaultdict(dict)
    for k, rule in enumerate([lambda f: f[0], lambda f: f[1], lambda f: f[2], any]):
        count = {h: sum(rule(fails[i]) for i in ids) for h, ids in hosts.items()}
        p = sum(count.values()) / total
        spread = sum(len(ids) * (count[h] / len(ids) - p) ** 2 for h, ids in hosts.items())
        m = quality.strength(p, spread, total, sum(len(x) ** 2 for x in hosts.values()), len(hosts))
        for h, ids in hosts.items():
            bad[h][k] = (count[h] + p * m) / (len(ids) + m) > (0.25 if k == 3 else 0.02)
    host = {i: h for h, ids in hosts.items() for i in ids}
    assert set(kept) == {i for i in rows if not fails[i][3] and not any(fails[i][k] and (bad[host[i]][k] or bad[host[i]][3]) for k in range(3))}
    rows, kept = step["line_dedup"]
    pages, holds = defaultdict(int), defaultdict(set)
    strip = " \t\n\x0b\x0c\r"
    for i, r in rows.items():
        pages[r["source"]] += 1
        for x in (r["text"] or "").split("\n"):
            if x.strip(strip):
                holds[r["source"], x.strip(strip)].add(i)
    for i, r in rows.items():
        gone = lambda x, h=r["source"]: len(holds[h, x.strip(strip)]) >= 3 and len(holds[h, x.strip(strip)]) > 0.1 * pages[h]
        assert kept[i]["text"] == "\n".join(x for x in r["text"].split("\n") if not gone(x)) and kept[i]["n_chars"] == len(kept[i]["text"])
    rows, kept = step["jaccard_join"]
    parts = _components([(i, r["text"]) for i, r in rows.items()])
    assert set(kept) == {int(first) for _, _, first in parts}
    rows, packed = step["best_fit_packing"]
    from tests.llm.test_tokens import _check_pieces

    assert _check_pieces(packed, [(i, r["text"]) for i, r in rows.items()], 2048, 0) <= -(-sum(r["length"] for r in packed) // 2048) + 1


def test_pipeline_odd_rows(spark, odd, none, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([(1, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, none):
        columns = docs.columns
        for k, (_, stage) in enumerate(c.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            assert k == 4 or docs.columns == columns
        assert docs.filter(F.col("length") < 1).count() == 0

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spillway.llm import common, lines, lm_score, quality, toxicity
from spillway.llm.common import Scratch
from spillway.llm.queries import ORACLES, QUERIES, op3_toxicity
from tests.oracle import DATA, connect, same
from tests.llm.test_tokens import WORD


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, name):
    same(QUERIES[name](spark, f"{DATA}/sf0.001"), connect("sf0.001"), ORACLES[name])


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _metrics(text):
    text = text or ""
    words = _words(text)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(wins)
    covered = {i + k for i, w in enumerate(wins) if count[w] > 1 for k in range(3)}
    own = [x for x in text.split("\n") if _words(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(own) - len(set(own)), len(covered)


def test_quality_metrics(spark, odd, none):
    extra = spark.createDataFrame([(20, "a b c a b c d", "s"), (21, "x x x x x", "s"), (22, " ".join(f"w{i} v u" for i in range(30)) + " w3 v u w4 v", "s"), (23, " ".join(f"{i} q {i}" for i in list(range(40)) * 2), "s"), (24, "#a|\n#a|\n<b>\n \n", None)], "doc_id long, text string, source string")
    docs = odd.unionByName(extra, allowMissingColumns=True)
    got = quality.quality_rules(docs)
    want = sorted((str(r["doc_id"]), *(m := _metrics(r["text"])), m[0] < 50 or 100 * m[4] > 50 * m[0]) for r in docs.collect())
    assert sorted((str(r["doc_id"]), *[r[c] for c in quality.METRICS], r["base_failed"]) for r in got.collect()) == want
    assert quality.quality_rules(none).count() == 0
    kept = quality.quality_filter(odd)
    assert kept.columns == odd.columns and quality.quality_filter(none).count() == 0


def test_bad_host_loses_its_failing_documents_only(spark):
    clean = " ".join(f"word{i} plain{i}" for i in range(60))
    rows = [(i, clean + f" {i}", "good") for i in range(30)] + [(100 + i, clean.replace(" ", " # ") + f" {i}", "bad") for i in range(20)]
    rows += [(200, clean + " clean page", "bad"), (201, clean.replace(" ", " # "), "good")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in quality.quality_filter(docs, limit=0.3).collect()}
    assert kept == {*range(30), 200, 201}


def test_host_verdicts_forgive_rare_failures(spark):
    clean = " ".join(f"word{i} plain{i}" for i in range(60))
    marked, short = clean.replace(" ", " # "), "too short"
    rows = [(i, clean + f" {i}", "clean") for i in range(300)] + [(300, marked, "clean")]
    rows += [(400 + i, clean + f" {i}", "mixed") for i in range(60)] + [(480 + i, marked + f" {i}", "mixed") for i in range(6)]
    rows += [(500 + i, short, "empty") for i in range(30)] + [(540, marked, "empty"), (541, clean, "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert {k for k, r in got.items() if r["host_rejected"]} == {*range(480, 486), 540}
    assert {k for k, r in got.items() if not r["kept"]} == {*range(480, 486), 540, *range(500, 530)}
    assert quality.strength(0.1, 0.0, 100.0, 5000.0, 2) == quality.STRONGEST and quality.strength(0.5, 25.0, 100.0, 5000.0, 2) == quality.WEAKEST


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_host_verdicts_fire_on_the_tables(spark, sf):
    got = QUERIES["op6_quality_rules"](spark, f"{DATA}/{sf}").agg(F.sum((F.col("host_rejected") & ~F.col("base_failed")).cast("int")), F.sum(F.col("base_failed").cast("int"))).first()
    assert got[0] > 50 and got[1] > 40


def test_lookups_by_shuffle_give_the_same(spark, odd, monkeypatch):
    docs = odd.select("doc_id", "text", "source")
    rules = lambda: sorted(map(str, quality.quality_rules(docs).select("doc_id", *quality.METRICS, "kept").collect()))
    less = lambda: sorted(map(str, lines.line_dedup(docs, ratio=0.2, min_pages=2, counts=True).collect()))
    before = rules(), less()
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert (rules(), less()) == before


def test_skew_lookup_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    big = spark.range(9000).select("id", F.when(F.col("id") < 5000, "hot").when(F.col("id") < 5100, None).otherwise(F.concat(F.lit("k"), F.col("id") % 300)).alias("k"))
    small = big.filter("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.concat(F.lit("v-"), "k")).filter("k <> 'k7'")
    out = common.skew_lookup(big, small, "k", ["v"], "n", 9000, F.col("id")).collect()
    assert len(out) == 9000 and sum(r["k"] == "hot" for r in out) == 5000
    assert all(r["v"] == (None if r["k"] in (None, "k7") else f"v-{r['k']}") for r in out)


def test_hot_keys_are_dealt_over_tasks(spark, monkeypatch, request):
    for name, value in (("BROADCAST_BYTES", -1), ("TASK_ROWS", 400), ("LEAST_ROWS", 100)):
        monkeypatch.setattr(common, name, value)
    for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.set(name, "false" if "adaptive" in name else "-1")
        request.addfinalizer(lambda name=name: spark.conf.unset(name))
    big = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"))
    small = big.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.concat(F.lit("v-"), "k"))
    out = common.skew_lookup(big, small, "k", ["v"], "n", 9000, F.col("id"))
    assert out.count() == 9000 and out.filter("v <> concat('v-', k)").isEmpty()
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.shuffle.partitions", "4"))
    parts = common.skew_lookup(big, small, "k", ["v"], "n", 9000, F.col("id")).filter("k = 'hot'").rdd.glom().map(len).collect()
    assert sum(parts) == 3000 and max(parts) < 1000


def test_line_dedup(spark, odd, none):
    rows = [(i, f"unique line {i}\nmenu | home\n\n  menu | home \nend {i}", "h1") for i in range(10)] + [(50, "menu | home\nother", "h2"), (51, "menu | home", None), (52, None, "h1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in lines.line_dedup(docs, counts=True).collect()}
    assert got[3] == ("unique line 3\n\nend 3", 4, 2)
    assert got[50] == ("menu | home\nother", 2, 0) and got[51] == ("menu | home", 1, 0) and got[52] == (None, 0, 0)
    out = lines.line_dedup(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert lines.line_dedup(none).count() == 0
    clash = lines.line_dedup(docs.withColumn("n_lines", F.lit(-1)).withColumn("over", F.lit(2)).withColumn("host_pages", F.lit(3)), counts=True)
    assert sorted(clash.columns) == sorted([*docs.columns, "over", "host_pages", "n_lines", "n_dropped"])
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in clash.collect()} == got


def test_kernel_tolerates_gaps():
    m = toxicity.Machine(["idiot"])
    near = {w: float(v[0]) for w, v in m.kernel(["idiot", "idxiot", "iddiot", "idiots", "table", "i"]).items()}
    assert near["idiot"] == pytest.approx(1, abs=1e-5)
    assert near["idxiot"] > 0.1 and near["iddiot"] > 0.1 and near["idiots"] > 0.3 and "table" not in near
    assert toxicity.fold("1d1.0t,") == "idiot" and toxicity.words_of("you i d i o t now") == ["you", "idiot", "now"]


def test_kernel_tells_words_of_other_scripts():
    for bad, near, clean in (("идиот", "иддиот", "собака"), ("ηλίθιος", "ηλίιθιος", "σκύλος")):
        m = toxicity.Machine([toxicity.fold(bad)])
        got = m.kernel([toxicity.fold(w) for w in (bad, near, clean)])
        assert got[toxicity.fold(bad)][0] == pytest.approx(1, abs=1e-4) and got[toxicity.fold(near)][0] > 0.1 and toxicity.fold(clean) not in got


def _kernel(a, b):
    def feats(w):
        c, out = toxicity._code(w), Counter()
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, min(len(c), i + toxicity.SPAN)):
                    out[c[i], c[j], c[k]] += toxicity.LAM ** (k - i - 2)
        return out

    x, y = feats(a), feats(b)
    dot = lambda p, q: sum(v * q[k] for k, v in p.items())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


def test_kernel_equals_brute_force():
    words = ["idiot", "idixot", "iidiioott", "moron", "mororon", "banana", "ananas", "chllave", "ßab"]
    m = toxicity.Machine(["idiot", "moron", "banana"])
    got = m.kernel(words)
    for w in words:
        want = [v if v >= toxicity.LEAST else 0 for v in (_kernel(w, z) for z in m.landmarks)]
        assert np.allclose(got.get(w, np.zeros(3)), np.array(want) ** toxicity.POWER, atol=1e-4)


def test_toxicity_held_out(spark):
    d = f"{DATA}/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels.select("doc_id"), "doc_id")
    got = toxicity.toxicity(docs, labels, sample=1500).join(labels, "doc_id").filter("held_out").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / (got.toxic == 1).sum() > 0.8 and hit / (got.predicted == 1).sum() > 0.6
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (8, 1), (None, 1), (10, None), (4, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == odd.count()
    assert {r["held_out"] for r in got.filter("doc_id = 1").collect()} == {zlib.crc32(b"1") % 4 == 2}
    assert toxicity.toxicity(none, labels).count() == 0
    zero = toxicity.toxicity(odd, labels.limit(0)).collect()
    assert all(r["score"] < 0.01 for r in zero)
    assert toxicity.toxicity_filter(odd, labels).columns == odd.columns


def _brute_scores(machine, texts):
    """The query's scores, from kernels of all pairs of words and landmarks."""
    feats = {}

    def vector(w):
        if w not in feats:
            c, out = toxicity._code(w), Counter()
            for i in range(len(c)):
                for j in range(i + 1, len(c)):
                    for k in range(j + 1, min(len(c), i + toxicity.SPAN)):
                        out[c[i], c[j], c[k]] += toxicity.LAM ** (k - i - 2)
            norm = math.sqrt(sum(v * v for v in out.values())) or 1.0
            feats[w] = {k: v / norm for k, v in out.items()}
        return feats[w]

    def values(word):
        f = toxicity.fold(word)
        half = toxicity.WINDOW // 2
        parts = [f] if len(f) <= toxicity.WINDOW else [f[i : i + toxicity.WINDOW] for i in range(0, len(f) - half, half)]
        rows = [[sum(v * vector(z).get(k, 0.0) for k, v in vector(p).items()) for z in machine.landmarks] for p in parts if len(p) > 1]
        rows = [[x**toxicity.POWER if x >= toxicity.LEAST else 0.0 for x in r] for r in rows]
        return np.max(rows, axis=0) if rows else np.zeros(len(machine.landmarks))

    a, b, c = machine.slope
    out = []
    for text in texts:
        sentences = [toxicity.words_of(s) for s in re.split(r"(?<=[.!?])\s+|\n+", text or "")]
        margin = max([0.0, *[float(np.max([values(w) for w in s], axis=0) @ machine.beta) for s in sentences if s]]) + machine.bias
        x = a * margin + b * math.log1p(sum(map(len, sentences))) + c
        out.append(1 / (1 + math.exp(-max(-50.0, min(50.0, x)))))
    return out


def test_toxicity_query_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "LANDMARKS", 8)
    clean = ["We saw a quiet river. It was long!", "tables and chairs\n\nare here", "", None, "the w0rd is fine, ok?", "Zürich ist schön", "x " * 300, "ab" * 40]
    rude = ["you are an idiot today.", "What an id.iot! Go.", "i d i o t s everywhere", "total iddiot and moron", "MORON of the year", "such a m0r0n here"]
    rows = [(i, (rude if i % 3 == 0 else clean)[i // 3 % (6 if i % 3 == 0 else 8)], i % 3 == 0) for i in range(150)]
    rows += [(i, (t or "") + f" extra {i}", bad) for i, t, bad in rows[:60] for i in [i + 1000]]
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[2])) for r in rows[:150]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("documents", "labels"))
    got = {r["doc_id"]: r for r in op3_toxicity(spark, str(tmp_path)).collect()}
    machine = toxicity.fit(docs, labels)
    assert machine.landmarks and len(got) == len(rows)
    for (i, _, bad), want in zip(rows, _brute_scores(machine, [t for _, t, _ in rows]), strict=True):
        assert got[i]["score"] == pytest.approx(want, abs=2e-3) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)
    assert np.mean([got[i]["predicted"] == bad for i, _, bad in rows]) > 0.8


def _base(docs):
    words = [t.encode().lower().split() if t else [] for _, t in docs]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for d, _ in docs]
    c = Counter(w for x, h in zip(words, held, strict=True) if not h for w in [*x, None])
    n, v = sum(c.values()), len(c)
    return [(str(d), h, len(x) + 1, sum(c[w] > 0 for w in [*x, None]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*x, None]), 6)) for (d, _), x, h in zip(docs, words, held, strict=True)]


@pytest.mark.parametrize("fragment_bytes", [1 << 30, 2000])
def test_lm_base(spark, odd, none, fragment_bytes):
    docs = odd
    got = lm_score.lm_scores(docs, WORD, steps=5, fragment_bytes=fragment_bytes).collect()
    key = lambda r: (str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
    assert sorted(map(key, got)) == sorted(_base([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm_score.lm_scores(none, WORD, steps=2).count() == 0


def test_lm_query_learns(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op7_lm_score"](spark, f"{DATA}/sf0.01").toPandas()
    key = lambda r: (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens)
    rows, want = sorted(got.itertuples(), key=key), sorted(_base(docs))
    assert list(map(key, rows)) == [x[:-1] for x in want]
    assert [r.base_score for r in rows] == pytest.approx([x[-1] for x in want], abs=1e-4)
    out = got[got.held_out]
    assert len(out) > 100 and out.score.sum() > out.base_score.sum()


def test_every_training_document_counts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lm_score, "CHARS", 20_000)
    one = lm_score._pass
    monkeypatch.setattr(lm_score, "_pass", lambda *x: seen.append(one(*x)) or seen[-1])
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    lm_score.lm_scores(docs, WORD, steps=3).count()
    few = sum(n for _, n in seen)
    seen.clear()
    lm_score.lm_scores(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000)), WORD, steps=3).count()
    assert len(seen) == 2 and sum(n for _, n in seen) > 1.6 * few > 0


@pytest.mark.parametrize("apart", [1, 3])
def test_a_pass_sees_every_document(apart):
    from spillway.llm import attention as a

    r = np.random.default_rng(0)
    v = a.Vocabulary(r.integers(1, 50, 41), r.random(41) < 0.5, singles=10, shared=4, inputs=16)
    lengths = np.array([1, 7, 30, 12, 200])
    ids = r.integers(0, 41, lengths.sum())
    prior = a.Prior(np.bincount(a.pairs_of(ids, lengths, v), minlength=15 * 14).reshape(15, 14), group=4)
    m, met = a.Model(v.rows, v.classes, dim=6, hidden=8, stride=5, context=3, group=4), []
    cut = a.Places.cut
    try:
        a.Places.cut = lambda self, some, begin, many: met.extend(some.tolist()) or cut(self, some, begin, many)
        before = m.flat()
        loss, n = a.learn(m, a.Adam(m), ids, lengths, v, prior, 0.01, r, many=2, together=4, apart=apart)
    finally:
        a.Places.cut = cut
    w = a.Windows(lengths, 5, 3)
    assert len(met) == len(set(met)) and set(w.doc[met]) == set(range(5)) and w.left.sum() == len(ids) and 0 < n <= 2 * len(met)
    assert apart > 1 or len(met) == len(w)
    assert np.bincount(w.doc[met], minlength=5).max() <= -(-np.bincount(w.doc).max() // apart)
    assert np.isfinite(loss) and not np.allclose(before, m.flat())
    assert np.allclose(np.exp(prior.group).sum(axis=1), 1, atol=1e-5) and np.allclose(np.exp(prior.inner).sum(axis=2), 1, atol=1e-5)


def test_the_passes_take_every_training_token(spark, odd, monkeypatch):
    seen = []
    one = lm_score._pass
    monkeypatch.setattr(lm_score, "CHARS", 20_000)
    monkeypatch.setattr(lm_score, "_pass", lambda *x: seen.append(one(*x)) or seen[-1])
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    lm_score.lm_scores(docs, WORD, steps=3).count()
    enc = Tokenizer.from_file(WORD)
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    assert sum(n for _, n in seen) == sum(len(enc.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect() if not held(r["doc_id"]))


def test_dealt_rows_lie_in_small_row_groups(spark, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    letters = np.random.default_rng(0).choice(list("abcdefghijklmnop     "), (12, 60_000))
    docs = spark.createDataFrame([(i, "".join(x)) for i, x in enumerate(letters)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(lm_score, "GROUP_BYTES", 50_000)
    monkeypatch.setattr(lm_score, "CHARS", 100_000)
    saved = []
    save = lm_score.Scratch.save
    monkeypatch.setattr(lm_score.Scratch, "save", lambda self, df, name, *a: saved.append((self.path(name), name)) or save(self, df, name, *a))
    lm_score.lm_scores(docs, WORD, steps=1).count()
    path = next(p for p, name in saved if name == "dealt").removeprefix("file://")
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in glob.glob(f"{path}/*.parquet")]
    assert max(groups) >= 6


def test_attention_scores_each_token_once():
    from spillway.llm import attention as a

    r = np.random.default_rng(0)
    counts = r.integers(0, 50, 41)
    v = a.Vocabulary(counts, r.random(41) < 0.5, singles=10, shared=4, inputs=16)
    assert np.allclose(np.bincount(v.of, np.exp(v.inner)), 1, atol=1e-4)
    lengths = np.array([1, 7, 30, 12])
    ids = r.integers(0, 41, lengths.sum())
    prior = a.Prior(np.bincount(a.pairs_of(ids, lengths, v), minlength=15 * 14).reshape(15, 14), group=4)
    m = a.train(ids, lengths, v, prior, steps=30, batch=4, dim=6, hidden=8, stride=5, context=3, group=4)
    got = a.log_probabilities(m, ids, lengths, v, prior, batch=2)
    at = 0
    for n, g in zip(lengths, got, strict=True):
        seq, total = ids[at : at + n], 0.0
        rows = np.r_[v.begin, v.row[seq[:-1]]]
        for t in range(n):
            w = t // 5
            u = np.full(8, v.begin)
            lo = max(0, 5 * w - 3)
            hi = min(n, 5 * w + 5)
            u[lo - (5 * w - 3) : hi - (5 * w - 3)] = rows[lo:hi]
            f = m.hidden(u[None], np.array([int(w == 0)]))[0][0, t - 5 * w]
            c, was = v.of[seq[t]], v.of[seq[t - 1]] if t else v.classes
            for x, i in ((f @ m.p["g"] + m.p["bg"] + prior.group[was], c // m.group), (f @ m.p["c"][c // m.group] + m.p["bc"][c // m.group] + prior.inner[was, c // m.group], c % m.group)):
                total += x[i] - x.max() - np.log(np.exp(x - x.max()).sum())
            total += v.inner[seq[t]]
        assert g == pytest.approx(total, abs=1e-3)
        at += n


@pytest.mark.parametrize("loud", [1, 1000])
def test_a_step_is_the_same_in_parts(monkeypatch, loud):
    from spillway.llm import attention as a

    r = np.random.default_rng(3)
    m = a.Model(41, 30, dim=6, hidden=8, stride=5, context=3, group=4)
    m.p["q"] *= loud  # exponentials overflow, and are taken again
    m.p["bg"] += loud - 1
    prior = a.Prior(r.integers(0, 9, (31, 30)), group=4)
    cut = (prior, r.integers(0, 41, (70, 8)), r.integers(0, 2, 70), r.integers(0, 31, (70, 5)), r.integers(0, 30, (70, 5)), r.random((70, 5)) < 0.8)
    monkeypatch.setattr(a, "PART", 70)
    loss, whole = m.step(*cut)
    monkeypatch.setattr(a, "PART", 16)
    again, parts = m.step(*cut)
    assert np.isfinite(loss) and again == pytest.approx(loss, rel=1e-5) and set(whole) == set(parts) == set(m.p)
    for k, x in whole.items():
        assert np.isfinite(x).all() and x.shape == m.p[k].shape and np.allclose(x, parts[k], atol=1e-5 * max(1, np.abs(x).max())), k


@pytest.mark.parametrize(("begin", "many"), [(0, 3), (1, 2), (2, 1)])
def test_gradient(begin, many):
    from spillway.llm import attention as a

    r = np.random.default_rng(1)
    m = a.Model(9, 5, dim=4, hidden=6, stride=3, context=2, group=2)
    prior = a.Prior(r.integers(0, 9, (6, 5)), group=2)
    u, first = r.integers(0, 9, (2, 5)), np.array([1, 0])
    y, was = r.integers(0, 5, (2, 2, 3))
    live = np.array([[True, True, False], [True, True, True]])
    cut = (prior, u, first, was[:, begin : begin + many], y[:, begin : begin + many], live[:, begin : begin + many], begin)
    m.p = {k: x.astype(np.float64) for k, x in m.p.items()}
    _, g = m.step(*cut)
    for k, x in m.p.items():
        i = tuple(r.integers(0, s) for s in x.shape)
        old, e = x[i], 1e-4
        x[i] = old + e
        up = m.step(*cut)[0]
        x[i] = old - e
        down = m.step(*cut)[0]
        x[i] = old
        assert g[k][i] == pytest.approx((up - down) / (2 * e), abs=2e-3), k

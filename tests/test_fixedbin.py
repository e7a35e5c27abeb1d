import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spillway.operators import generate, sort, verify
from spillway.sources import read_fixedbin, write_fixedbin
from spillway.types import DTYPES, Options, dtype


def _put(path, values, layout="<u4"):
    np.asarray(values, layout).tofile(path)
    return str(path)


def _read(path, layout="<u4"):
    return np.fromfile(path, layout).tolist()


PATTERNS = {
    "empty": [],
    "one": [7],
    "two": [2, 1],
    "three": [3, 1, 2],
    "equal": [7] * 5000,
    "two_values": [0, 4294967295] * 2500,
    "sorted": list(range(3000)),
    "reversed": list(range(3000))[::-1],
    "chunk": list(range(1024))[::-1],
    "chunk_less": list(range(1023))[::-1],
    "chunk_more": list(range(1025))[::-1],
}


@pytest.mark.parametrize("name", PATTERNS)
def test_sorts_files(spark, tmp_path, name):
    values = PATTERNS[name]
    source = _put(tmp_path / "input", values)
    before = hashlib.sha256(open(source, "rb").read()).hexdigest()
    sort.sort_file(spark, source, str(tmp_path / "output"), Options(memory_bytes=4096 * 8))
    assert _read(tmp_path / "output") == sorted(values)
    assert hashlib.sha256(open(source, "rb").read()).hexdigest() == before
    assert verify.check_file(spark, source, str(tmp_path / "output"))["ok"]


@pytest.mark.parametrize("name", DTYPES)
def test_types_round_trip(spark, tmp_path, name):
    kind = dtype(name)
    values = [kind.most, kind.least, 1, 0, 5, kind.least + 1, kind.most - 1]
    source = _put(tmp_path / "input", values, kind.layout)
    for algorithm in ("heap", "std", "radix"):
        sort.sort_file(spark, source, str(tmp_path / algorithm), Options(dtype=name, algorithm=algorithm))
        assert _read(tmp_path / algorithm, kind.layout) == sorted(values)
    assert spark.conf.get("spark.sql.sort.enableRadixSort") == "true"


def test_parts_and_positions(spark, tmp_path):
    values = np.random.default_rng(1).permutation(10_000)
    source = _put(tmp_path / "input", values)
    df = read_fixedbin(spark, source, chunk_bytes=4001, position=True)
    assert df.rdd.getNumPartitions() == 10
    assert [r["value"] for r in df.orderBy("pos").collect()] == values.tolist()
    write_fixedbin(sort.global_sort(df.select("value"), "value"), str(tmp_path / "parts"))
    names = sorted(os.listdir(tmp_path / "parts"))
    assert len([n for n in names if n.startswith("part-")]) >= 1 and not os.path.exists(f"{tmp_path}/parts.staged")
    back = read_fixedbin(spark, str(tmp_path / "parts"), position=True).orderBy("pos")
    assert [r["value"] for r in back.collect()] == list(range(10_000))
    with pytest.raises(Exception, match="exists"):
        write_fixedbin(df.select("value"), str(tmp_path / "parts"))
    write_fixedbin(df.select("value").limit(3), str(tmp_path / "parts"), mode="overwrite")
    assert read_fixedbin(spark, str(tmp_path / "parts")).count() == 3


def test_errors(spark, tmp_path):
    with pytest.raises(Exception, match="path not found"):
        read_fixedbin(spark, str(tmp_path / "none")).count()
    assert not (tmp_path / "none").exists()
    (tmp_path / "odd").write_bytes(b"0123456789")
    with pytest.raises(Exception, match="no multiple"):
        read_fixedbin(spark, str(tmp_path / "odd")).count()
    with pytest.raises(Exception, match="unknown dtype"):
        read_fixedbin(spark, str(tmp_path / "odd"), dtype="u3").count()
    with pytest.raises(Exception, match="does not fit"):
        write_fixedbin(spark.range(-1, 1).withColumnRenamed("id", "value"), str(tmp_path / "neg"))
    assert not (tmp_path / "neg").exists()
    with pytest.raises(ValueError, match="unknown algorithm"):
        Options(algorithm="bogo")


def test_verifier_sees_disorder(spark, tmp_path):
    source, bad = _put(tmp_path / "input", [1, 2, 3]), _put(tmp_path / "bad", [1, 3, 2])
    found = verify.check_file(spark, source, bad)
    assert not found["ok"] and found["inversions"] == 1
    assert not verify.check_file(spark, source, _put(tmp_path / "short", [1, 2]))["ok"]


def test_generate_sort_check(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("input", "output", "origin.hash")]
    crc = generate.write_test_data(spark, paths[0], 80_000, hash_path=paths[2], seed=3)
    assert crc == "b4a38509293b0599" and os.path.getsize(paths[2]) == 8
    sort.sort_file(spark, paths[0], paths[1])
    assert verify.check_file(spark, paths[0], paths[1], hash_path=paths[2])["ok"]
    assert not verify.check_file(spark, paths[0], paths[0], hash_path=paths[2])["ok"]
    generate.write_test_data(spark, str(tmp_path / "r"), 4000, kind="random")
    assert read_fixedbin(spark, str(tmp_path / "r")).count() == 1000
    with pytest.raises(ValueError):
        generate.sequence(spark, 2**32 + 1)
    with pytest.raises(ValueError):
        generate.write_test_data(spark, str(tmp_path / "x"), 40, kind="random", hash_path=paths[2])


def test_command_line(spark, tmp_path, monkeypatch):
    from spillway import cli, session

    monkeypatch.setattr(session, "local_session", lambda: spark)
    i, o, h = (str(tmp_path / x) for x in "ioh")
    assert cli.main(["generate", i, "--bytes", "4000", "--hash", h]) == 0
    assert cli.main(["--log", str(tmp_path / "log"), "sort", i, o]) == 0
    assert cli.main(["check", i, o]) == 0 and cli.main(["check", i, o, "--mode", "hash", "--hash", h]) == 0
    assert cli.main(["print", o, "-n", "3"]) == 0
    assert cli.main(["sort", str(tmp_path / "none"), o]) == 1
    assert "sort" in (tmp_path / "log").read_text()


def test_merges_sorted_files(spark, tmp_path):
    from spillway.operators import merge

    r = np.random.default_rng(2)
    for name in DTYPES:
        kind = dtype(name)
        runs = [np.sort(r.integers(kind.least, kind.most, n, dtype=kind.layout, endpoint=True)) for n in (0, 1, 700, 3000)]
        runs.append(np.full(4000, 7, kind.layout))  # one value that is half of all
        folder = tmp_path / name
        folder.mkdir()
        for i, x in enumerate(runs):
            x.tofile(folder / f"part-{i}")
        df = merge.merge_files(spark, [str(folder)], name, partitions=7)
        want = np.sort(np.concatenate(runs)).tolist()
        assert [int(x["value"]) for x in df.collect()] == want
        sizes = [x["count"] for x in df.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) - min(sizes) <= 1 and "Exchange" not in df._jdf.queryExecution().toString()
        got, levels = merge.merge_by_tree(spark, str(folder), str(tmp_path / f"{name}-tree"), 2, name)
        assert [int(x["value"]) for x in got.collect()] == want and levels == 2
        sort.sort_file(spark, str(folder), str(tmp_path / f"{name}-out"), Options(dtype=name, skip_sort=True))
        assert _read(tmp_path / f"{name}-out", kind.layout) == want
    (tmp_path / "none").mkdir()
    assert merge.merge_files(spark, [str(tmp_path / "none")]).count() == 0
    assert merge.merge_by_tree(spark, str(tmp_path / "none"), str(tmp_path / "t"), 2)[0].count() == 0


def test_ranks_are_cut_exactly(tmp_path):
    from pyarrow.fs import LocalFileSystem

    from spillway.operators import merge

    kind = dtype("i16")
    runs = [np.sort(np.random.default_rng(k).integers(-3, 4, 9 * k).astype("<i2")) for k in range(4)]
    files = []
    for i, x in enumerate(runs):
        x.tofile(tmp_path / str(i))
        files.append(merge._Sorted(str(tmp_path / str(i)), x.nbytes, kind, LocalFileSystem()))
    everything = np.sort(np.concatenate(runs))
    before = [0] * 4
    for rank in range(len(everything) + 1):
        places = merge.cut(files, rank, kind)
        assert sum(places) == rank and all(a <= b for a, b in zip(before, places, strict=True))
        assert sorted(v for x, n in zip(runs, places, strict=True) for v in x[:n].tolist()) == everything[:rank].tolist()
        before = places


def test_runs_of_a_stream(spark, tmp_path):
    from spillway.streaming import merge_runs, write_runs

    values = np.random.default_rng(3).integers(0, 1 << 32, 5000)
    spark.createDataFrame([(int(x),) for x in values], "value long").repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second start finds nothing new
        stream = spark.readStream.schema("value long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        write_runs(stream, str(tmp_path / "runs"), str(tmp_path / "state")).awaitTermination()
    assert len(list((tmp_path / "runs").iterdir())) == 3
    assert [r["value"] for r in merge_runs(spark, str(tmp_path / "runs")).collect()] == sorted(values.tolist())
    assert merge_runs(spark, str(tmp_path / "no")).count() == 0


def test_merges_spread_a_value_that_many_share(spark, request):
    from spillway.operators import merge

    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    request.addfinalizer(lambda: spark.conf.unset(name))
    a = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).cast("long").alias("value"))
    for df in (merge.two_way_merge(a, a.limit(100)), merge.kway_merge([a, a.limit(100)], "value", spread=True)):
        rows = df.collect()
        keys = [(r["value"], -r["src"]) if "src" in df.columns else r["value"] for r in rows]
        assert keys == sorted(keys) and len(keys) == 6100
        assert max(df.rdd.glom().map(len).collect()) < 2400

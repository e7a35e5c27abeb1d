import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spillway import functions as fn
from spillway.operators import crc64, merge, radix, sort, verify
from spillway.plans import planning
from spillway.types import MIB, Options


def _slow(data, crc=0):
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x95AC9329AC4BC9B5 if crc & 1 else 0)
    return crc


def test_crc_known_answers():
    assert crc64.hex64(crc64.crc64(b"123456789")) == "e9c6d914c4b8d9ca"
    assert crc64.hex64(crc64.crc64(np.arange(20_000, dtype="<u4").tobytes())) == "b4a38509293b0599"
    assert crc64.hex64(crc64.crc64(bytes(8))) == "0" * 16


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=400), st.integers(0, 400))
def test_crc_combines(data, cut):
    a, b = data[:cut], data[cut:]
    whole = _slow(data)
    assert crc64.crc64(data) == whole == crc64.combine(crc64.crc64(a), crc64.crc64(b), len(b))


def test_crc_blocks_and_hasher():
    data = np.random.default_rng(0).bytes(30_011)
    assert crc64.crc64(data) == _slow(data)
    h = crc64.Hasher().put("abc").put([1, 2]).put(3)
    assert h.crc == _slow(b"abc" + np.array([1, 2, 3], "<u4").tobytes())
    assert crc64.Hasher().put("ab").merge(crc64.Hasher().put("c")).hexdigest() == crc64.hex64(_slow(b"abc"))


def test_positions_with_equal_keys(spark):
    df = spark.range(20_000, numPartitions=4).select(F.lit(7).alias("value"), "id")
    spread = sort.global_sort(df, "value", spread=True).groupBy(F.spark_partition_id()).count().collect()
    got = sort.sort_with_position(df, "value", spread=True)
    assert sorted(r["pos"] for r in got.collect()) == list(range(20_000))
    assert max(r["count"] for r in spread) < 20_000 or len(spread) == 1
    assert sort.sort_with_position(df.limit(0), "value").count() == 0


def test_nulls_last_and_ties(spark):
    df = spark.createDataFrame([(None,), (2,), (1,), (2,)], "value int")
    assert [r["value"] for r in sort.sort_with_position(df, "value").orderBy("pos").collect()] == [1, 2, 2, None]
    a, b = (spark.createDataFrame([(x,) for x in v], "value long") for v in ([1, 2], [2, 3]))
    assert [tuple(r) for r in merge.two_way_merge(a, b).collect()] == [(1, 0), (2, 1), (2, 0), (3, 1)]
    assert [r["value"] for r in merge.kway_merge([a, b, a], "value").collect()] == [1, 1, 2, 2, 2, 3]
    with pytest.raises(ValueError):
        merge.kway_merge([])


def test_array_sort_by(spark):
    df = spark.createDataFrame([([3, 1, 2],)], "a array<int>")
    assert df.select(sort.array_sort_by(F.col("a"), lambda a, b: a > b)).first()[0] == [3, 2, 1]


@pytest.mark.parametrize(("chunks", "base"), [(0, 2), (1, 4), (10, 4), (17, 4), (399, 11), (5, 2)])
def test_merge_tree(spark, chunks, base):
    rows = merge.merge_tree(spark, chunks, base).collect()

    def groups(n):
        out, at = [], 0
        while at < n:
            size = min(base, n - at)
            if 0 < n - at - size < base:
                size = n - at
            out.append(size)
            at += size
        return out

    level, n = 0, chunks
    while n:
        own = [r for r in rows if r["lvl"] == level]
        assert sorted(r["id"] for r in own) == list(range(n))
        if n == 1 and level:
            assert own[0]["parent"] is None
            break
        sizes = groups(n)
        assert [r["parent"] for r in sorted(own, key=lambda r: r["id"])] == [i for i, k in enumerate(sizes) for _ in range(k)]
        n, level = len(sizes), level + 1
    assert len(rows) == 0 if not chunks else rows[-1]["parent"] is None


@pytest.mark.parametrize(("count", "span"), [(1, 0), (10, 4095), (5000, 4095), (60_000, 2**32 - 1), (1000, 2**32 - 1), (3, 2**20)])
def test_radix(count, span):
    shift = radix.log_divisor(count, span)
    assert 0 <= shift <= 40 and (span >> shift) < 2 << max(radix.MAX_SPLITS, radix.FINISHING)


def test_radix_bins(spark):
    values = [-5, -4, 0, 3, 9, 9]
    df = spark.createDataFrame([(v,) for v in values], "value long")
    sizes, shift, first = radix.bins(df)
    want = {}
    for v in values:
        want[(v >> shift) - first] = want.get((v >> shift) - first, 0) + 1
    assert {r["bin"]: r["n"] for r in sizes.collect()} == want
    starts = sorted((r["bin"], r["n"], r["start_pos"]) for r in radix.with_starts(sizes).collect())
    at = 0
    for _, n, s in starts:
        assert s == at
        at += n
    assert radix.bins(df.limit(0))[0].count() == 0
    assert [r[0] for r in spark.createDataFrame([(0,), (1,), (4095,), (4096,)], "x long").select(radix.bit_length(F.col("x"))).collect()] == [0, 1, 12, 13]


def test_is_sorted_over_partitions(spark):
    df = spark.range(1000, numPartitions=8).select(F.col("id").alias("p"), F.when(F.col("id") == 500, 0).otherwise(F.col("id")).alias("v"))
    assert tuple(verify.is_sorted(df, "p", "v").first()) == (1000, 1, False)
    assert tuple(verify.is_sorted(df.limit(0), "p", "v").first()) == (0, 0, True)


def test_functions(spark):
    df = spark.createDataFrame([(1023, 0), (1024, 1), (5 * MIB, 255), (3 << 30, 4294967295)], "b long, i long")
    b, i = F.col("b"), F.col("i")
    assert [r[0] for r in df.select(fn.size_format(b)).collect()] == ["1023Bytes", "1KiB", "5MiB", "3GiB"]
    assert [r[0] for r in df.select(fn.num_format(b)).collect()] == ["1K", "1K", "5M", "3221M"]
    names = df.select(fn.chunk_name(F.lit(1), i).alias("n"))
    assert [r[0] for r in names.collect()] == ["1_0", "1_1", "1_ff", "1_ffffffff"]
    assert [tuple(r[0]) for r in names.select(fn.parse_chunk_name(F.col("n"))).collect()] == [(1, 0), (1, 1), (1, 255), (1, 4294967295)]
    bad = spark.createDataFrame([("x_1",), ("1_",), ("1_2_3",), ("",)], "n string")
    assert [r[0] for r in bad.select(fn.parse_chunk_name(F.col("n"))).collect()] == [None] * 4
    row = df.limit(1).select(fn.div_up(b, 10), fn.round_up(b, 10), fn.round_down(b, 10), fn.round_down(F.lit(3), 10), fn.has_flags(b, 3), fn.clear_flags(b, 1023), fn.set_flags(i, 6), fn.quote(F.lit("a")), fn.power_root(F.lit(81.0), F.lit(1)), fn.to_hex(b, True)).first()
    assert tuple(row) == (103, 1030, 1020, 0, True, 0, 6, "'a'", 9.0, "3FF")


def test_plans():
    assert planning.chunk_bytes(1500 * MIB, 4, 4, 100 * MIB) == 25 * MIB
    assert planning.sort_plan(1500 * MIB, Options(threads=4)).chunks == 60
    assert planning.chunk_bytes(3, 4, 8, 100 * MIB) == 4 and planning.chunk_count(0, 4) == 0
    assert planning.fan_in(60, Options()) == 60 and planning.fan_in(60, Options(flat_merge=False)) == 8
    assert planning.fan_in(60, Options(flat_merge=False, fan_in=5)) == 5 and planning.fan_in(1, Options()) == 2
    with pytest.raises(ValueError):
        planning.sort_plan(1 << 20, Options(threads=4, memory_bytes=8))

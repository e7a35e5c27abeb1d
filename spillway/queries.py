"""The engine's queries over the driver's tables, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import chunk_full_name, div_up, num_format, round_down, round_up, size_format
from .operators import crc64, generate, merge, radix, sort, verify
from .plans import planning
from .scratch import Scratch
from .sources import read_fixedbin, write_fixedbin
from .streaming import merge_runs, write_runs
from .types import Options

MIB = 1 << 20

#: Records of a chunk of orders, and the tree's base.
CHUNK = 1024
BASE = 4


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys of lineitem, scattered over all 32-bit values."""
    return _table(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") * 2654435761) % 4294967296).alias("value"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = F.call_function("div", F.col("o_orderkey"), F.lit(CHUNK)).alias("chunk_id")
    return _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", chunk)


def sort_u32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort.sort_with_position(_keys(spark, sf_dir), "value", spread=True)


def sort_i32_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = _table(spark, sf_dir, "customer").select(F.round(F.col("c_acctbal") * 100).cast("long").alias("value"))
    return sort.sort_with_position(cents, "value", spread=True)


def sort_comparator_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort.sort_with_position(_keys(spark, sf_dir), "value", ascending=False, spread=True)


def sort_key_functor(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    placed = sort.with_position(sort.shifted_sort(orders, "o_custkey", 4, "o_orderkey"))
    return placed.select("pos", F.shiftright("o_custkey", 4).alias("shifted_key"), "o_orderkey")


def chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).groupBy("chunk_id").agg((F.min("o_orderkey") * 4).alias("byte_offset"), (F.count("*") * 4).alias("byte_size"), F.count("*").alias("n"))


def chunk_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _orders(spark, sf_dir).select("chunk_id", F.col("o_custkey").alias("value"))
    return sort.with_chunk_position(sort.chunk_sort(chunks, "chunk_id", "value"), "chunk_id", "value", name="pos_in_chunk")


def kway_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(F.col("o_custkey").alias("value"), F.col("chunk_id").alias("src_chunk"), "o_orderkey")
    chunks = [rows.filter(F.col("src_chunk") % BASE == k) for k in range(BASE)]
    return sort.with_position(merge.kway_merge(chunks, "value", "src_chunk", "o_orderkey")).drop("o_orderkey")


def two_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("value"))
    b = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("value"))
    return sort.with_position(merge.two_way_merge(a, b))


def merge_tree_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _orders(spark, sf_dir).select("chunk_id").distinct()
    return chunks.select("chunk_id", merge.tree_node(F.col("chunk_id"), F.lit(chunks.count()), BASE).alias("node_id"))


def is_sorted_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.is_sorted(_table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")


def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.extremes(_keys(spark, sf_dir))


def size_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(spark, sf_dir)
    return verify.size_check(spark, keys, sort.sort_with_position(keys, "value", spread=True), 4)


def radix_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.bins(_keys(spark, sf_dir))[0]


def radix_bin_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, _, first = radix.bins(_keys(spark, sf_dir))
    return radix.with_starts(sizes.withColumn("bin", F.col("bin") + first))


def seq_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.sequence(spark, _table(spark, sf_dir, "orders").count())


def shuffle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "orders").count()
    values = sort.global_sort(generate.shuffle(generate.sequence(spark, n), 7), "value")
    return values.agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_distinct"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def random_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.uniform(spark, _table(spark, sf_dir, "orders").count(), 11)


def _cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * F.col("p_partkey") * F.col("p_partkey")).alias("b"))


def fmt_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cubes(spark, sf_dir).select("p_partkey", size_format(F.col("b")).alias("size_fmt"))


def fmt_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cubes(spark, sf_dir).select("p_partkey", num_format(F.col("b")).alias("num_fmt"))


def chunk_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _orders(spark, sf_dir).select("chunk_id").distinct()
    return chunks.select("chunk_id", chunk_full_name(F.lit(0), F.col("chunk_id")).alias("full_name"))


def align(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(i.alias("i"), div_up(i, 4).alias("div_up4"), round_up(i, 4).alias("round_up4"), round_down(i, 4).alias("round_down4"))


def crc64_known_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = spark.range(1, 10, 1, 3).select((F.col("id") + 48).cast("smallint").alias("value"))
    return verify.crc_frame(digits, "value", "u8")


def crc64_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.crc_frame(sort.global_sort(_keys(spark, sf_dir), "value", spread=True), "value", "u32")


def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.chunk_plan(planning.grid(spark, [1, 2, 4, 6, 8, 16], [4 * MIB, 100 * MIB, 1500 * MIB]), 100 * MIB, 4)


def mem_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.memory_plan(planning.grid(spark, [1, 2, 4, 8, 16]), 100 * MIB, 0.5)


def file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' keys in the order of the orders, written as u32 records and read back in chunks with their places."""
    path = Scratch(spark, "file").path("orders.u32")
    write_fixedbin(_table(spark, sf_dir, "orders").orderBy("o_orderkey").select(F.col("o_custkey").alias("value")), path, assemble=True)
    return read_fixedbin(spark, path, chunk_bytes=4 * CHUNK, position=True)


def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks in which a reader takes a file: a partition each."""
    path = Scratch(spark, "file").path("orders.u32")
    write_fixedbin(_table(spark, sf_dir, "orders").orderBy("o_orderkey").select(F.col("o_custkey").alias("value")), path)
    rows = read_fixedbin(spark, _one_file(path), chunk_bytes=4 * CHUNK, position=True)
    read = rows.groupBy(F.spark_partition_id().cast("long").alias("chunk_id")).agg((F.min("pos") * 4).alias("byte_offset"), (F.count("*") * 4).alias("byte_size"), F.sum("value").alias("total"))
    return read


def _one_file(path: str) -> str:
    """The folder's records as one file beside it."""
    from pyspark.sql import SparkSession as S

    write_fixedbin(read_fixedbin(S.active(), path), f"{path}.one", assemble=True)
    return f"{path}.one"


def _unsorted_file(spark: SparkSession, sf_dir: str, scratch: Scratch) -> str:
    write_fixedbin(_keys(spark, sf_dir), scratch.path("input"), assemble=True)
    return scratch.path("input")


def sort_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of keys, sorted into another file, which is read back with its places."""
    scratch = Scratch(spark, "file")
    sort.sort_file(spark, _unsorted_file(spark, sf_dir, scratch), scratch.path("output"))
    return read_fixedbin(spark, scratch.path("output"), chunk_bytes=4 * 16 * CHUNK, position=True)


def check_sorted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan check of an input and its sorted parts, and of the input against itself, which is not sorted."""
    scratch = Scratch(spark, "file")
    source = _unsorted_file(spark, sf_dir, scratch)
    sort.sort_file(spark, source, scratch.path("output"), assemble=False)
    rows = []
    for name, target in (("sorted", scratch.path("output")), ("input", source)):
        found = verify.check_file(spark, source, target)
        rows.append((name, found["ok"], found["sizes"][0], found["sizes"][1]))
    return spark.createDataFrame(rows, "target string, ok boolean, input_bytes long, output_bytes long")


def hash_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shuffled sequence is generated with its checksum kept, sorted, and checked by that checksum."""
    scratch = Scratch(spark, "file")
    n = _table(spark, sf_dir, "orders").count()
    scratch.folder("")
    generate.write_test_data(spark, scratch.path("input"), 4 * n, "shuffle", "u32", 5, scratch.path("origin.hash"))
    sort.sort_file(spark, scratch.path("input"), scratch.path("output"))
    found = [verify.check_file(spark, scratch.path("input"), scratch.path(x), hash_path=scratch.path("origin.hash")) for x in ("output", "input")]
    return spark.createDataFrame([(found[0]["ok"], found[0]["actual"], found[1]["ok"])], "ok boolean, crc string, input_ok boolean")


def _sorted_chunks(spark: SparkSession, sf_dir: str, scratch: Scratch) -> str:
    """Sorted files of customers' keys, each of a range of the orders."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("value"))
    write_fixedbin(rows.repartitionByRange(11, "o_orderkey").sortWithinPartitions("value").select("value"), scratch.path("chunks"))
    return scratch.path("chunks")


def merge_sorted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted files merged without a sort or a shuffle."""
    scratch = Scratch(spark, "file")
    return sort.with_position(merge.merge_files(spark, [_sorted_chunks(spark, sf_dir, scratch)]))


def merge_tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the merge tree, level by level."""
    scratch = Scratch(spark, "file")
    return sort.with_position(merge.merge_by_tree(spark, _sorted_chunks(spark, sf_dir, scratch), scratch.path("tree"), BASE)[0])


def skip_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted files to one sorted file, with the sort left out."""
    scratch = Scratch(spark, "file")
    sort.sort_file(spark, _sorted_chunks(spark, sf_dir, scratch), scratch.path("output"), Options(skip_sort=True))
    return read_fixedbin(spark, scratch.path("output"), position=True)


def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys read as a stream, a sorted run for each micro-batch, and the runs merged."""
    scratch, path = Scratch(spark, "stream"), f"{sf_dir}/lineitem.parque[t]"  # a pattern, as a stream takes no single file
    stream = spark.readStream.schema(_table(spark, sf_dir, "lineitem").schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = write_runs(stream.select(((F.col("l_orderkey") * 2654435761) % 4294967296).alias("value")), scratch.path("runs"), scratch.path("state"))
    query.awaitTermination()
    return sort.with_position(merge_runs(spark, scratch.path("runs")))


def random_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is sure of uniform random values: their number and range, and that they are about uniform over eight ranges."""
    n = _table(spark, sf_dir, "orders").count()
    share = F.shiftright("value", 29)
    parts = generate.uniform(spark, n, 11).groupBy(share.alias("part")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return parts.agg(F.sum("n").alias("n"), ((F.min("low") >= 0) & (F.max("high") < 1 << 32)).alias("in_range"), (F.count("*") == 8).alias("all_parts"), F.max(F.abs(F.col("n") * 8 - n) < 0.3 * n).alias("about_uniform"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (sort_u32, sort_i32_signed, sort_comparator_desc, sort_key_functor, chunk_scan, chunk_sort, kway_merge, two_way_merge, merge_tree_l1, is_sorted_check, extremes, size_check, radix_bins, radix_bin_offsets, seq_generator, shuffle_roundtrip, random_generator, fmt_size, fmt_num, chunk_name, align, crc64_known_answer, crc64_of_keys, chunk_plan, mem_plan, file_roundtrip, file_chunks, sort_file, check_sorted_file, hash_check, merge_sorted_files, merge_tree_files, skip_sort, stream_merge, random_summary)
}


def crc64_sql(words: str, levels: int = 21) -> str:
    """SQL for the checksum of 32-bit words: words is a query of (q, x), q the place from the end, from 0, and x the word.

    The checksum is linear: m<k> holds what 2^k zero bits make of each single bit, each the square of the one before. A word's own
    checksum is 32 zero bits on it; two neighbours' is the later one's, combined with the earlier one's moved by the later one's bits.
    """
    bit, on = "CAST(i AS UBIGINT)", "((a.c >> b.i) & 1) = 1"
    out = [f"m0 AS MATERIALIZED (SELECT {bit} AS i, CASE WHEN i = 0 THEN CAST('{crc64.REFLECTED}' AS UBIGINT) ELSE CAST(1 AS UBIGINT) << CAST(greatest(i - 1, 0) AS UBIGINT) END AS c FROM range(64) t(i))"]
    for k in range(5 + levels):
        out.append(f"m{k + 1} AS MATERIALIZED (SELECT a.i, bit_xor(b.c) AS c FROM m{k} a JOIN m{k} b ON {on} GROUP BY a.i)")
    out.append(f"w AS MATERIALIZED ({words})")
    out.append("l0 AS MATERIALIZED (SELECT q, bit_xor(b.c) AS x FROM (SELECT q, CAST(x AS UBIGINT) AS c FROM w) a JOIN m5 b ON ((a.c >> b.i) & 1) = 1 GROUP BY q)")
    for k in range(levels):
        moved = f"SELECT q, bit_xor(b.c) AS x FROM (SELECT q, x AS c FROM l{k} WHERE q % 2 = 1) a JOIN m{5 + k} b ON {on} GROUP BY q"
        out.append(f"l{k + 1} AS MATERIALIZED (SELECT q // 2 AS q, bit_xor(x) AS x FROM (SELECT q, x FROM l{k} WHERE q % 2 = 0 UNION ALL {moved}) t GROUP BY q // 2)")
    return f"WITH {', '.join(out)} SELECT lpad(lower(to_hex(coalesce(bit_xor(x), CAST(0 AS UBIGINT)))), 16, '0') AS crc FROM l{levels}"


_BY_VALUE = """SELECT CAST(row_number() OVER (ORDER BY o_custkey) - 1 AS BIGINT) AS pos, o_custkey AS value FROM orders"""

ORACLES: dict[str, str] = {
    "sort_u32": """SELECT CAST(row_number() OVER (ORDER BY value) - 1 AS BIGINT) AS pos, value FROM (SELECT (l_orderkey * 2654435761) % 4294967296 AS value FROM lineitem) t""",
    "sort_i32_signed": """SELECT CAST(row_number() OVER (ORDER BY value) - 1 AS BIGINT) AS pos, value FROM (SELECT CAST(round(c_acctbal * 100) AS BIGINT) AS value FROM customer) t""",
    "sort_comparator_desc": """SELECT CAST(row_number() OVER (ORDER BY value DESC) - 1 AS BIGINT) AS pos, value FROM (SELECT (l_orderkey * 2654435761) % 4294967296 AS value FROM lineitem) t""",
    "sort_key_functor": """SELECT CAST(row_number() OVER (ORDER BY o_custkey // 16, o_orderkey) - 1 AS BIGINT) AS pos, o_custkey // 16 AS shifted_key, o_orderkey FROM orders""",
    "chunk_scan": """SELECT o_orderkey // 1024 AS chunk_id, CAST(min(o_orderkey) AS BIGINT) * 4 AS byte_offset, count(*) * 4 AS byte_size, count(*) AS n FROM orders GROUP BY o_orderkey // 1024""",
    "chunk_sort": """SELECT o_orderkey // 1024 AS chunk_id, CAST(row_number() OVER (PARTITION BY o_orderkey // 1024 ORDER BY o_custkey) - 1 AS BIGINT) AS pos_in_chunk, o_custkey AS value FROM orders""",
    "kway_merge": """SELECT CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey // 1024, o_orderkey) - 1 AS BIGINT) AS pos, o_custkey AS value, o_orderkey // 1024 AS src_chunk FROM orders""",
    "two_way_merge": """SELECT CAST(row_number() OVER (ORDER BY value, src DESC) - 1 AS BIGINT) AS pos, value, src FROM (SELECT o_custkey AS value, CAST(0 AS BIGINT) AS src FROM orders UNION ALL SELECT c_custkey AS value, CAST(1 AS BIGINT) AS src FROM customer) t""",
    "merge_tree_l1": """SELECT chunk_id, least(chunk_id // 4, greatest(q // 4, 1) - 1) AS node_id FROM (SELECT DISTINCT o_orderkey // 1024 AS chunk_id FROM orders) c CROSS JOIN (SELECT count(DISTINCT o_orderkey // 1024) AS q FROM orders) n""",
    "is_sorted_check": """SELECT count(*) AS n, CAST(sum(CASE WHEN o_custkey < prev THEN 1 ELSE 0 END) AS BIGINT) AS inversions, CAST(sum(CASE WHEN o_custkey < prev THEN 1 ELSE 0 END) AS BIGINT) = 0 AS is_sorted FROM (SELECT o_custkey, lag(o_custkey) OVER (ORDER BY o_orderkey) AS prev FROM orders) t""",
    "extremes": """SELECT min(value) AS min_value, max(value) AS max_value, count(*) AS n FROM (SELECT (l_orderkey * 2654435761) % 4294967296 AS value FROM lineitem) t""",
    "size_check": """SELECT count(*) * 4 AS input_bytes, count(*) * 4 AS output_bytes, true AS sizes_match FROM lineitem""",
    "radix_bins": """WITH d AS (SELECT (l_orderkey * 2654435761) % 4294967296 AS value FROM lineitem), s AS (SELECT min(value) AS mn, max(value) AS mx, length(bin(count(*))) AS lc, length(bin(max(value) - min(value))) AS lr FROM d), p AS (SELECT mn, CASE WHEN lr - lc <= 0 AND lr <= 12 THEN 0 WHEN lr - (lr - lc + 2) > 11 THEN lr - 11 ELSE lr - lc + 2 END AS ld FROM s) SELECT CAST(floor(value / pow(2, ld)) - floor(mn / pow(2, ld)) AS BIGINT) AS bin, count(*) AS n FROM d CROSS JOIN p GROUP BY 1""",
    "radix_bin_offsets": """WITH h AS (SELECT ((l_orderkey * 2654435761) % 4294967296) // 2097152 AS bin, count(*) AS n FROM lineitem GROUP BY 1) SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) - n AS BIGINT) AS start_pos FROM h""",
    "seq_generator": """SELECT CAST(o_orderkey AS BIGINT) AS value FROM orders""",
    "shuffle_roundtrip": """SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_distinct, min(o_orderkey) AS min_value, max(o_orderkey) AS max_value FROM orders""",
    "fmt_size": """SELECT p_partkey, CASE WHEN b < 1024 THEN concat(b, 'Bytes') WHEN b < 1048576 THEN concat(b // 1024, 'KiB') WHEN b < 1073741824 THEN concat(b // 1048576, 'MiB') ELSE concat(b // 1073741824, 'GiB') END AS size_fmt FROM (SELECT p_partkey, p_partkey * p_partkey * p_partkey AS b FROM part) t""",
    "fmt_num": """SELECT p_partkey, CASE WHEN b < 1000 THEN concat(b, '') WHEN b < 1000000 THEN concat(b // 1000, 'K') ELSE concat(b // 1000000, 'M') END AS num_fmt FROM (SELECT p_partkey, p_partkey * p_partkey * p_partkey AS b FROM part) t""",
    "chunk_name": """SELECT o_orderkey // 1024 AS chunk_id, concat('chunks/0_', lower(hex(o_orderkey // 1024))) AS full_name FROM orders GROUP BY o_orderkey // 1024""",
    "align": """SELECT p_partkey AS i, ((p_partkey + 3) // 4) AS div_up4, ((p_partkey + 3) // 4) * 4 AS round_up4, (p_partkey // 4) * 4 AS round_down4 FROM part""",
    "crc64_known_answer": """SELECT 'e9c6d914c4b8d9ca' AS crc""",
    "chunk_plan": """SELECT CAST(threads AS BIGINT) AS threads, CAST(sz AS BIGINT) AS input_bytes, CAST(l0 AS BIGINT) AS l0_bytes, CAST(sz // l0 AS BIGINT) AS chunk_number, CAST((l0 // 4) * 4 AS BIGINT) AS chunk_bytes FROM (SELECT threads, sz, CASE WHEN 104857600 >= sz THEN sz // (threads * 2) ELSE 104857600 // threads END AS l0 FROM (VALUES (1),(2),(4),(6),(8),(16)) a(threads) CROSS JOIN (VALUES (4194304),(104857600),(1572864000)) b(sz)) t""",
    "mem_plan": """SELECT CAST(threads AS BIGINT) AS threads, CAST(52428800 // threads AS BIGINT) AS imem, CAST(52428800 // threads AS BIGINT) AS omem, CAST(104857600 // threads AS BIGINT) AS tmem FROM (VALUES (1),(2),(4),(8),(16)) a(threads)""",
    "crc64_of_keys": crc64_sql("SELECT row_number() OVER (ORDER BY (l_orderkey * 2654435761) % 4294967296 DESC) - 1 AS q, (l_orderkey * 2654435761) % 4294967296 AS x FROM lineitem"),
    "file_roundtrip": """SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, o_custkey AS value FROM orders""",
    "file_chunks": """SELECT pos // 1024 AS chunk_id, min(pos) * 4 AS byte_offset, count(*) * 4 AS byte_size, CAST(sum(o_custkey) AS BIGINT) AS total FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_custkey FROM orders) t GROUP BY pos // 1024""",
    "sort_file": """SELECT CAST(row_number() OVER (ORDER BY value) - 1 AS BIGINT) AS pos, value FROM (SELECT (l_orderkey * 2654435761) % 4294967296 AS value FROM lineitem) t""",
    "check_sorted_file": """SELECT target, target = 'sorted' AS ok, n * 4 AS input_bytes, n * 4 AS output_bytes FROM (SELECT count(*) AS n FROM lineitem) c CROSS JOIN (VALUES ('sorted'), ('input')) t(target)""",
    "hash_check": f"""SELECT true AS ok, crc, false AS input_ok FROM ({crc64_sql("SELECT row_number() OVER (ORDER BY v DESC) - 1 AS q, v AS x FROM (SELECT row_number() OVER () - 1 AS v FROM orders) o")}) c""",
    "merge_sorted_files": _BY_VALUE,
    "merge_tree_files": _BY_VALUE,
    "skip_sort": _BY_VALUE,
    "stream_merge": """SELECT CAST(row_number() OVER (ORDER BY value) - 1 AS BIGINT) AS pos, value FROM (SELECT (l_orderkey * 2654435761) % 4294967296 AS value FROM lineitem) t""",
    "random_summary": """SELECT count(*) AS n, true AS in_range, true AS all_parts, true AS about_uniform FROM orders""",
}

"""Shards by a two-pass external shuffle, in DataFrame functions only.

Pass 1 counts rows and bytes, fixes the number of buckets so that one fits in memory, and scatters records uniformly by a seeded hash of
id, text length and checksum (one shuffle). Pass 2 sorts each bucket into a fixed order, applies Spark's seeded
shuffle(), which is Fisher-Yates, and writes it. A record's place in the whole is its bucket's offset plus its place in
the bucket; shard s gets the places from ceil(s * n / shards) on, so the law is `rows`: shards differ by one row at most.

Offsets are prefix sums of the buckets' counts, taken in two levels (within runs of BUCKETS_PER_RUN buckets, then over runs).

Defined results: null text has no bytes and checksum 0; size is the bytes plus 1; an empty table gives no rows; other
columns pass through. Rows that repeat in id and text share a bucket, so ids are assumed to be nearly unique; they are
ordered by their other columns (maps excepted). Spark's shuffle() draws by task, so another spark.sql.shuffle.partitions
gives other, equally lawful shards; the same one repeats them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import free_name, plain, stored

SEED, SHARDS = 29, 16
#: Bytes of text a bucket holds in the mean; a task keeps a few copies of one bucket at a time.
BUCKET_BYTES = 4 << 20
BUCKETS_PER_RUN = 4096


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, *, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with size, text_crc32, shard and slot (names get _ if taken), in shuffled order."""
    size, crc, shard, slot = (free_name(docs.columns, x) for x in ("size", "text_crc32", "shard", "slot"))
    given, name = plain(docs)
    text = F.coalesce(F.col(name[text_col]), F.lit("")).cast("binary")
    sized = given.withColumns({"size": (F.octet_length(text) + 1).cast("long"), "crc": F.crc32(text)})
    n, total = sized.agg(F.count("*"), F.sum("size")).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    keyed = sized.withColumn("h", F.xxhash64(F.lit(seed), name[id_col], "size", "crc")).withColumn("bucket", F.pmod("h", F.lit(buckets)))

    counts = keyed.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("bucket") / BUCKETS_PER_RUN))
    counts = stored(counts, "shard-counts")  # a row for each bucket, read twice
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("run").agg(F.sum("n").alias("rn"))
    runs = runs.withColumn("base", F.coalesce(F.sum("rn").over(before(Window.orderBy("run"))), F.lit(0)))
    within = F.coalesce(F.sum("n").over(before(Window.partitionBy("run").orderBy("bucket"))), F.lit(0))
    offsets = counts.join(runs, "run").select(F.col("bucket").alias("of"), (F.col("base") + within).alias("offset"))

    # Rows come in the order of hash and then all columns that have one, so the seeded shuffle repeats after a lost executor.
    rest = [c for c, f in zip(given.columns, given.schema) if "map<" not in f.dataType.simpleString()]
    maps = [c for c in given.columns if c not in rest]
    packed = keyed.groupBy("bucket").agg(F.collect_list(F.struct(F.struct("h", *rest).alias("r"), "size", "crc", *maps)).alias("a"))
    first = lambda x, y: F.when(x["r"] < y["r"], -1).when(x["r"] > y["r"], 1).otherwise(0)
    fixed = packed.withColumn("a", F.array_sort("a", first) if maps else F.array_sort("a"))
    mixed = fixed.sortWithinPartitions("bucket").withColumn("a", F.shuffle("a", F.lit(seed)))
    placed = mixed.join(offsets, F.col("bucket") == F.col("of")).select("offset", F.posexplode("a").alias("i", "x"))
    out = placed.withColumn("place", F.col("offset") + F.col("i")).withColumn("s", F.floor(F.col("place") * shards / F.lit(max(n, 1))).cast("long"))
    # The division is exact for the counts that doubles hold; the two corrections make it so beyond.
    begin = lambda s: F.floor((s * F.lit(n) + (shards - 1)) / shards)
    out = out.withColumn("s", F.col("s") - (F.col("place") < begin(F.col("s"))).cast("long"))
    out = out.withColumn("s", F.col("s") + (F.col("place") >= begin(F.col("s") + 1)).cast("long"))
    own = [(F.col(f"x.{c}") if c in maps else F.col(f"x.r.{c}")).alias(x) for x, c in name.items()]
    return out.select(*own, F.col("x.size").alias(size), F.col("x.crc").alias(crc), F.col("s").cast("int").alias(shard), (F.col("place") - begin(F.col("s"))).cast("long").alias(slot))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **options) -> DataFrame:
    """Writes the shuffled shards to path, a folder per shard, each file in order of slots; returns what was written, as read again."""
    out = shuffle_shards(docs, shards, **options)
    shard, slot = out.columns[-2:]
    out.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)

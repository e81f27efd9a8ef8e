"""Byte-balanced sharding by Karmarkar-Karp differencing (operator 9).

Documents with equal text are indivisible. Group sizes are summed in Spark; a
group larger than 1 / ``bundles`` of all bytes is an item of its own (there
are fewer than ``bundles`` of them), the others are bundled by a hash of their
text into at most ``bundles`` items. The differencing method then works on at
most twice ``bundles`` numbers, whatever the corpus: it repeatedly takes the
two partial partitions with the largest spread and adds them in opposite
order. Rows get their shard by two joins with tables of that bounded size, and
gapless slots from per-partition counts.

Law: ``bytes``. Defined results: a null text counts as empty (size 1, crc32 of
nothing); null and empty texts are one group. Rows with equal text, repeated
ids included, share a shard and have slots of their own. An empty table gives
no row. Only the named columns are read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizlens.llm.shared import read, stored

BUNDLES = 4096


def differencing(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item, by the multi-way Karmarkar-Karp method."""
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = []
    for k, size in enumerate(sizes):
        subsets = [(size, [k])] + [(0, []) for _ in range(shards - 1)]
        heap.append((-size if shards > 1 else 0, k, subsets))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # a is largest first, b smallest first
        merged = []
        for (sa, ia), (sb, ib) in zip(a, reversed(b)):
            if len(ia) < len(ib):
                ia, ib = ib, ia
            ia.extend(ib)
            merged.append((sa + sb, ia))
        merged.sort(key=lambda x: -x[0])
        low = merged[-1][0]
        merged = [(s - low, i) for s, i in merged]
        heapq.heappush(heap, (-merged[0][0], serial, merged))
        serial += 1
    out = [0] * len(sizes)
    for shard, (_, items) in enumerate(heap[0][2] if heap else []):
        for k in items:
            out[k] = shard
    return out


def with_slots(rows: DataFrame, shard: str, name: str) -> DataFrame:
    """Number the rows of each shard from 0 without gaps. Rows are counted in
    every (partition, shard); a window covers the rows of one such part only."""
    spare = ["__pid", "__uid", "__before"]
    tagged = stored(rows.select("*", F.spark_partition_id().alias("__pid"),
                                F.monotonically_increasing_id().alias("__uid")), "sharded")
    count = tagged.groupBy("__pid", shard).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(shard).orderBy("__pid")  # one row a partition
    start = count.select("__pid", shard, (F.sum("n").over(before) - F.col("n")).alias("__before"))
    local = Window.partitionBy("__pid", shard).orderBy("__uid")
    return (tagged.withColumn(name, F.row_number().over(local) - 1).join(start, ["__pid", shard])
            .withColumn(name, F.col(name) + F.col("__before")).drop(*spare))


def shard_by_bytes(docs: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text",
                   bundles: int = BUNDLES) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): near-equal bytes, equal texts together."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = stored(docs.select(F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"),
                              F.crc32(body).alias("text_crc32"), F.unhex(F.md5(body)).alias("group")), "sizes")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    bundle = F.pmod(F.xxhash64("group"), F.lit(bundles))
    large = F.col("bytes") * bundles > total
    items = (groups.groupBy(F.when(large, F.col("group")).alias("group"), F.when(~large, bundle).alias("bundle"))
             .agg(F.sum("bytes").alias("bytes")).orderBy("bundle", "group").collect())  # under 2 * bundles rows
    of = differencing([r["bytes"] for r in items], shards)
    alone = spark.createDataFrame([(bytes(r["group"]), s) for r, s in zip(items, of) if r["group"] is not None],
                                  "group binary, alone int")
    together = spark.createDataFrame([(r["bundle"], s) for r, s in zip(items, of) if r["group"] is None],
                                     "bundle long, together int")
    # both sides have at most ``bundles`` rows
    out = (rows.withColumn("bundle", bundle).join(F.broadcast(alone), "group", "left")
           .join(F.broadcast(together), "bundle", "left")
           .select("key", "size", "text_crc32", F.coalesce("alone", "together").alias("shard")))
    slots = with_slots(out, "shard", "slot")
    return slots.select(F.col("key").alias(key), "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(read(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))

"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets by a seeded hash; a bucket is small enough for a task's memory. Pass two puts
every bucket's records into one order, shuffles them with Fisher-Yates under a seed of the bucket, and numbers them after the
records of the buckets before. Record r of this whole order goes to shard r mod n, slot r div n, so shard sizes differ by one row
at most (the law ``rows``), whatever the buckets hold.

The number of buckets follows from the bytes of all texts (``BUCKET_BYTES`` each) and is ``LEAST_BUCKETS`` at least. Records are
hashed by id; those with a null id by their place in the input, so that they spread as well. A record that is
repeated with its id stays in the bucket of that id. Null text has no bytes. An empty table gives empty shards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T, Window as W

from nearpass.llm.common import unused

BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 256


def scatter(docs: DataFrame, text: str, doc_id: str, seed: int, bucket_bytes: int, bucket: str) -> DataFrame:
    """Pass one: add the bucket number."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")) + 1)).first()[0] or 0
    n = max(LEAST_BUCKETS, math.ceil(total / bucket_bytes))
    own = F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`").cast("string"))
    place = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    return docs.withColumn(bucket, F.pmod(F.when(F.col(f"`{doc_id}`").isNotNull(), own).otherwise(place), F.lit(n)).cast("int"))


def shards(docs: DataFrame, n_shards: int, text: str = "text", doc_id: str = "doc_id", seed: int = 1, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows with ``shard`` and ``slot`` (gapless from 0 in each shard); columns of those names are replaced."""
    src = docs.drop("shard", "slot")
    bucket, before, again = unused(src, "_bucket"), unused(src, "_before"), unused(src, "_again")
    scattered = scatter(src, text, doc_id, seed, bucket_bytes, bucket)
    # rows in the buckets before: one row per bucket, summed in blocks of buckets so that no task gets them all
    counts = scattered.groupBy(bucket).count()
    block = counts.withColumn("_block", F.floor(F.col(bucket) / 1024).cast("int"))
    sums = block.groupBy("_block").agg(F.sum("count").alias("_n"))
    ahead = sums.withColumn("_ahead", F.sum("_n").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1))).select("_block", "_ahead")
    start = block.join(ahead, "_block").select(
        F.col(bucket).alias(again), (F.coalesce("_ahead", F.lit(0)) + F.coalesce(F.sum("count").over(W.partitionBy("_block").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)),
                                                             F.lit(0))).alias(before))
    schema = T.StructType([*src.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    names = src.columns

    def fisher_yates(rows: pa.Table, starts: pa.Table) -> pa.Table:
        n = rows.num_rows
        first = starts.column(before)[0].as_py() if starts.num_rows else 0
        number = rows.column(bucket)[0].as_py() if n else 0
        keys = list(zip(rows.column(doc_id).to_pylist(), rows.column(text).to_pylist()))
        # one order whatever the tasks' order was; a null sorts before all values
        order = sorted(range(n), key=lambda i: [(v is not None, v) if v is not None else (False,) for v in keys[i]])
        for i, j in zip(range(n - 1, 0, -1), np.random.default_rng([seed, number]).integers(np.arange(n, 1, -1)).tolist() if n > 1 else []):
            order[i], order[j] = order[j], order[i]
        place = first + np.arange(n)
        out = rows.select(names).take(pa.array(order))
        return out.append_column("shard", pa.array((place % n_shards).astype(np.int32))).append_column("slot", pa.array((place // n_shards).astype(np.int64)))

    return scattered.groupBy(bucket).cogroup(start.groupBy(again)).applyInArrow(fisher_yates, schema)


def write_shards(docs: DataFrame, path: str, n_shards: int, **how) -> None:
    """Write the shuffled rows below ``path``, a folder for each shard. Files hold their rows by bucket; slot gives the order."""
    shards(docs, n_shards, **how).write.partitionBy("shard").parquet(path)

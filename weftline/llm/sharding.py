"""Uniform sharding by a hypergeometric communication matrix.

Rows are permuted locally, exchanged by exact counts drawn for each (partition, shard), and permuted
again inside their shard. The result is a uniform random permutation whose shards differ by one row
at most. Only one count for each partition reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, table, whole_text


def communication_matrix(sizes: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Counts of rows that each partition sends to each shard.

    Row sums are ``sizes``; column sums differ by one at most. Each row is drawn from the
    multivariate hypergeometric law of the room that is left, as a uniform shuffle would.
    """
    rng, total = np.random.default_rng(seed), int(sum(sizes))
    room = np.full(n_shards, total // n_shards, dtype=np.int64)
    room[: total % n_shards] += 1
    out = np.zeros((len(sizes), n_shards), dtype=np.int64)
    for i, n in enumerate(sizes):
        out[i] = rng.multivariate_hypergeometric(room, n, method="marginals")
        room -= out[i]
    return out


#: The matrix is broadcast up to so many entries (8 MB).
MOST_BOUNDS = 1_000_000


def shard(df: DataFrame, n_shards: int = 8, seed: int = 17, rows_per_block: int = 200_000) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    Nulls, ties and repeated rows are rows like any other; an empty table stays empty. Columns of
    ``df`` named shard or slot are replaced. The input is cut first, so partitions keep their rows
    when tasks run again. No partition is gathered: shards are cut into blocks of about
    ``rows_per_block`` rows (and at least as many as there are shuffle partitions).
    """
    spark = df.sparkSession
    keep = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    base = cut(df.select(F.struct(*keep).alias("_row"), F.monotonically_increasing_id().alias("_id")))
    sizes = {r["p"]: r["n"] for r in base.groupBy(F.shiftrightunsigned("_id", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = sorted(sizes)
    matrix = communication_matrix([sizes[p] for p in parts], n_shards, seed)
    bounds = spark.createDataFrame([(int(p), [int(x) for x in np.cumsum(m)]) for p, m in zip(parts, matrix, strict=True)], "_part long, _upto array<long>")
    if len(parts) * n_shards <= MOST_BOUNDS:  # else an exchange
        bounds = F.broadcast(bounds)
    # first permutation: sorted by a hash inside each partition, without an exchange; the position is the rank
    local = base.sortWithinPartitions(F.xxhash64(F.lit(seed), "_id"), "_id").select("_row", "_id", F.monotonically_increasing_id().alias("_at"))
    local = local.select("_row", "_id", F.shiftrightunsigned("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_rank"))
    sent = local.join(bounds, "_part").select("_row", "_id", F.size(F.filter("_upto", lambda x: x <= F.col("_rank"))).alias("shard"))
    # second permutation: by another hash, in blocks that are ranges of it
    total = sum(sizes.values())
    blocks = max(1, -(-total // (n_shards * rows_per_block)), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_shards))
    mixed = sent.withColumn("_mix", F.xxhash64(F.lit(seed + 1), "_id")).withColumn("_block", F.pmod(F.shiftright("_mix", 40), F.lit(blocks)).cast("int"))
    rank = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_mix", "_id")).cast("long")
    counts = mixed.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "_block", before.alias("_start"))
    out = mixed.withColumn("_slot", rank - 1).join(starts, ["shard", "_block"])
    return out.select("_row.*", "shard", (F.col("_slot") + F.col("_start")).alias("slot"))


def write_shards(df: DataFrame, path: str, n_shards: int = 8, seed: int = 17) -> None:
    """Writes ``df`` in shuffled order, a folder for each shard, its rows sorted by slot in files of about equal size."""
    out = shard(df, n_shards, seed)
    files = max(n_shards, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_sharding(spark, sf_dir):
    """All documents in shards 0 to 7 under law ``rows``. A null text has no bytes: size 1, crc 0."""
    text = whole_text(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Sharding by proportional stratified interleaving.

Rows of each source are ranked in a seeded shuffle; a row's fractional rank (2 * rank - 1) / (2 * rows of
its source) spreads every source evenly over 0..1. Sorting all rows by it and cutting the order into equal
runs gives shards whose row counts differ by one at most and whose mixture is the whole table's.

Ranks come without a task that sees a whole source: shuffled hashes fall into slices, slices are counted
per source (a small table), and a row's rank is its place in its slice plus the rows in the slices before.
The number of slices follows the row count, so a slice stays near SLICE_ROWS rows however large its source
is; places in the global order are found in the same way. Only the row count comes to the driver.

Cases: a null source is a stratum of its own; a null text has size 1 and the checksum of no bytes; repeated
rows and ids are rows like others (ties are broken by the row's own values, so equal rows may swap, which
leaves the result the same). An empty table gives an empty result; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

SEED = 20240521
SLICE_ROWS = 20_000
_STEPS = 1 << 31


def _numbered(df: DataFrame, group: list[str], slice_of: Column, order: list[str], name: str) -> DataFrame:
    """Adds the row's 1-based place in its group's order (slice, then order) as `name`."""
    df = df.withColumn("_slice", slice_of)
    counts = df.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    keys = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*group, "_slice")]
    place = F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order))
    joined = df.withColumn("_place", place).alias("l").join(counts.alias("r"), keys)
    return joined.select(*(F.col(f"l.{c}") for c in df.columns if c != "_slice"), (F.col("_before") + F.col("_place")).alias(name))


def interleaved_shards(docs: DataFrame, *, shards: int = 8, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the source of every row."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = materialize(rows.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")), "shard-rows")
    total = rows.count()
    slices = max(1, -(-total // SLICE_ROWS))
    high = F.shiftrightunsigned("_key", 33)  # the key's upper 31 bits
    own = rows.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    ranked = _numbered(rows, ["source"], F.floor(high * slices / F.lit(_STEPS)).cast("int"), ["_key", "doc_id", "text_crc32", "size"], "_rank")
    ranked = ranked.alias("l").join(own.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select("l.*", ((2 * F.col("_rank") - 1) / (2 * F.col("_n"))).alias("_share"))
    placed = _numbered(ranked, [], F.floor(F.col("_share") * slices).cast("int"), ["_share", "source", "_key", "doc_id", "text_crc32", "size"], "_pos")
    pos = F.col("_pos") - 1
    shard = F.expr(f"(_pos - 1) * {shards} div {max(1, total)}")
    first = F.expr(f"(_shard * {max(1, total)} + {shards - 1}) div {shards}")
    return placed.withColumn("_shard", shard).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"), (pos - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source")

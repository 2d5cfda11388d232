"""How two tables meet: without an equality by broadcast if one side is proven small, else in a grid of blocks; by keys with
the pairs of frequent keys cut into cells."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import written

#: Rows and text bytes up to which a side is broadcast; both are counted first.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 32 << 20
#: Rows of each side in a block of the grid.
BLOCK_ROWS = 20_000
#: Rows of each side in a cell of a frequent key; pairs from which a key is frequent; pairs and rows of a task.
CELL_ROWS, HOT_PAIRS, TASK_PAIRS, TASK_ROWS = 1_024, 1 << 18, 8 << 20, 1 << 20

#: Rows of a task that sorts whole groups.
SORT_ROWS = 1 << 19


def measured(df: DataFrame) -> tuple[int, int]:
    """A side's rows and bytes (as text)."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))), F.lit(0))
    n, total = df.agg(F.count(F.lit(1)), F.sum(width)).first()
    return n, total or 0


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a side's rows and bytes are within the bounds."""
    n, total = measured(df)
    return n <= rows and total <= size


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*(F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t))


def theta_join(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Inner join under any condition. A small side is broadcast; otherwise the sides meet in a grid: a left row is in one
    of its rows and visits each of its columns, a right row is in one column and visits each row, and each cell is an
    equi-join key. So a task holds BLOCK_ROWS rows or so of either side, whatever their sizes; equal rows share a cell."""
    n, n_bytes = measured(right)
    if n <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), condition)
    m, m_bytes = measured(left)
    if m <= BROADCAST_ROWS and m_bytes <= BROADCAST_BYTES:
        return F.broadcast(left).join(right, condition)
    rows, columns = (max(1, math.ceil(x / BLOCK_ROWS)) for x in (m, n))
    l = left.withColumns({"_row_l": F.pmod(row_hash(left), F.lit(rows)), "_column_l": F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))})
    r = right.withColumns({"_column_r": F.pmod(row_hash(right), F.lit(columns)), "_row_r": F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))})
    # few bytes, much work: the number of tasks is set, as small partitions would be joined into one
    tasks = min(rows * columns, 16 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    l, r = l.repartition(tasks, "_row_l", "_column_l"), r.repartition(tasks, "_row_r", "_column_r")
    return l.join(r, (F.col("_row_l") == F.col("_row_r")) & (F.col("_column_l") == F.col("_column_r")) & condition).drop("_row_l", "_column_l", "_row_r", "_column_r")


def _cells_fit(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> bool:
    """Whether equal keys have equal hashes: both sides' types are the same, and none has two forms of one value."""
    one, two = dict(left.dtypes), dict(right.dtypes)
    return all(one[a] == two[b] and (one[a] in ("string", "tinyint", "smallint", "int", "bigint", "boolean", "date", "timestamp") or one[a].startswith("decimal")) for a, b in keys)


def same_keys(keys: list[tuple[str, str]]) -> Column:
    """Equality of all keys, null with null, too."""
    return reduce(lambda x, y: x & y, (F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`")) for a, b in keys))


def celled(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_cell: str = "_cell_l", right_cell: str = "_cell_r") -> tuple[DataFrame, DataFrame] | None:
    """Both sides with the cells of a join by keys, partitioned by them; None if no key is frequent.

    A key with more than HOT_PAIRS pairs is cut into a grid of cells of CELL_ROWS rows or so of either side, and the number
    of tasks follows the pairs. A cell of 0 or more has one key; one below 0 has rare keys, which may be several.
    Frequent keys are at most one per 512 rows, so their list is broadcast."""
    if not _cells_fit(left, right, keys):
        return None
    names = [f"_k{n}" for n in range(len(keys))]
    counts = lambda df, side, n: df.groupBy(*(F.col(f"`{k[side]}`").alias(f"{n}{i}") for i, k in enumerate(keys))).agg(F.count(F.lit(1)).alias(f"{n}n"))
    both = counts(left, 0, "_k").join(counts(right, 1, "_j"), reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(names))))
    found = both.where(F.col("_kn") * F.col("_jn") > HOT_PAIRS).select(*names, "_kn", "_jn")
    hot = found.sort(*names).collect()
    if not hot:
        return None
    grid, first, pairs, copies = [], 0, 0, left.count() + right.count()
    for *k, m, n in hot:
        rows, columns = math.ceil(m / CELL_ROWS), math.ceil(n / CELL_ROWS)
        grid.append((*k, rows, columns, first))
        first, pairs, copies = first + rows * columns, pairs + m * n, copies + m * (columns - 1) + n * (rows - 1)
    spark = left.sparkSession
    types = T.StructType([*(T.StructField(f.name, f.dataType) for f in found.schema if f.name in names), *(T.StructField(c, T.LongType()) for c in ("_rows", "_columns", "_first"))])
    table = F.broadcast(spark.createDataFrame(grid, types))

    def placed(df: DataFrame, side: int, name: str) -> DataFrame:
        own = [F.col(f"`{k[side]}`") for k in keys]
        at = df.join(table, reduce(lambda x, y: x & y, (c.eqNullSafe(F.col(k)) for c, k in zip(own, names, strict=True))), "left")
        if side == 0:
            start = F.col("_first") + F.pmod(row_hash(df), F.col("_rows")) * F.col("_columns")
            cells = F.sequence(start, start + F.col("_columns") - 1)
        else:
            start = F.col("_first") + F.pmod(row_hash(df), F.col("_columns"))
            cells = F.sequence(start, start + (F.col("_rows") - 1) * F.col("_columns"), F.col("_columns"))
        rare = F.array(F.xxhash64(*own).bitwiseAND(F.lit((1 << 63) - 1)) - F.lit((1 << 63) - 1) - 1)  # below 0
        return at.withColumn(name, F.explode(F.when(F.col("_first").isNotNull(), cells).otherwise(rare))).drop(*names, "_rows", "_columns", "_first")

    # few bytes, much work: the number of tasks is set, as small partitions would be joined into one
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / TASK_PAIRS), math.ceil(copies / TASK_ROWS))
    return placed(left, 0, left_cell).repartition(tasks, left_cell), placed(right, 1, right_cell).repartition(tasks, right_cell)


def keyed_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], condition: Column | None = None, *, cell: str | None = None) -> DataFrame:
    """Inner equi-join on keys (null equals null), without columns of the same name on both sides, under a further condition.

    Few frequent keys make many pairs from few bytes, and a join by key gives all pairs of a key to one task. So frequent
    keys are cut into cells. `cell` names a column that keeps each pair's cell: pairs are partitioned by it, and equal calls
    give equal cells."""
    same, sides = same_keys(keys), celled(left, right, keys)
    if not sides:
        out = left.join(right, same if condition is None else same & condition)
        return out.withColumn(cell, F.lit(0).cast("long")) if cell else out
    l, r = sides
    # a cell of 0 or more has one key; in this form the cell is the only key of the hash join
    checked = (F.col("_cell_l") >= 0) | same
    out = l.join(r.hint("shuffle_hash"), (F.col("_cell_l") == F.col("_cell_r")) & (checked if condition is None else checked & condition)).drop("_cell_r")
    return out.withColumnRenamed("_cell_l", cell) if cell else out.drop("_cell_l")


def spread(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """df, of `rows` rows or so, partitioned by keys. The number of tasks follows the rows, as windows over groups sort all rows
    of a task together; windows by these keys and more need no other shuffle."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / SORT_ROWS))
    return df.repartition(tasks, *(F.col(f"`{k}`") for k in keys))


def with_index(df: DataFrame, name: str = "idx", order: list[str] | None = None) -> DataFrame:
    """Adds a row number from 0: by `order` (a range sort) if given, else by position.

    The rows are written once, so that the counts of its partitions and the numbers come from the same ones. A
    row's number is its place in its partition plus the rows before that; one small row per partition is
    broadcast, and no single task numbers all rows.
    """
    places = written((df.sort(*order) if order else df).select(F.struct("*").alias("_r"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    total, starts = 0, []
    for part, n in sorted(tuple(r) for r in places.groupBy("_part").agg(F.count(F.lit(1))).collect()):
        starts.append((part, total))
        total += n
    before = df.sparkSession.createDataFrame(starts, "_part int, _before long")
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    kept = [F.col(f"_r.`{c}`") for c in df.columns if c != name]
    return places.join(F.broadcast(before), "_part").select(*kept, number.cast("long").alias(name))

"""Sources and sinks: all-string CSV, optional workbooks, text lines, test cases, match results, reports."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..operators.assemble import normalize_headings
from ..plans.pairing import with_index

#: Rows up to which a frame is handed to a driver-side writer.
LOCAL_ROWS = 1_000_000
TRUE_WORDS = ("true", "1", "yes")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns are strings; empty fields are empty strings; NA and null stay text."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"').na.fill("")


def _workbooks() -> None:
    if importlib.util.find_spec("openpyxl") is None:
        raise RuntimeError("workbooks need the optional package openpyxl")


def sheet_names(path: str) -> list[str]:
    import pandas as pd

    _workbooks()
    return pd.ExcelFile(path).sheet_names


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet as strings; a single sheet needs no name."""
    import pandas as pd

    names = sheet_names(path)
    if sheet is None and len(names) > 1:
        raise ValueError(f"choose one of the sheets {names}")
    frame = pd.read_excel(path, sheet_name=sheet or names[0], dtype=str, keep_default_na=False)
    return spark.createDataFrame(frame, T.StructType([T.StructField(str(c), T.StringType()) for c in frame.columns]))


def column_values(df: DataFrame, column: str) -> DataFrame:
    """One column without nulls."""
    return df.select(column).where(F.col(column).isNotNull())


def text_lines(spark: SparkSession, source: str | Iterable[str], name: str = "value") -> DataFrame:
    """Stripped non-blank lines of a text file, or of lines given; any white space counts."""
    df = spark.read.text(source) if isinstance(source, str) else spark.createDataFrame([(x,) for x in source], "value string")
    return df.select(strip(F.col("value")).alias(name)).where(F.col(name) != "")


def test_cases(spark: SparkSession, path: str) -> DataFrame:
    """left, right, expected (boolean; true where it isn't given)."""
    df = read_csv(spark, path)
    given = F.lower(strip(F.coalesce(F.col("expected"), F.lit("true")))) if "expected" in df.columns else F.lit("true")
    return df.select("left", "right", given.isin(*TRUE_WORDS).alias("expected"))


def match_results(source: DataFrame | str, spark: SparkSession | None = None) -> DataFrame:
    """A match result from a frame or a CSV file, with normal headings."""
    return normalize_headings(read_csv(spark, source) if isinstance(source, str) else source)


def report_pairs(spark: SparkSession, path: str) -> DataFrame:
    """df1_idx, df2_idx (long) and final_result (boolean) of a pair report."""
    df = read_csv(spark, path)
    return df.select(F.col("df1_idx").cast("long"), F.col("df2_idx").cast("long"), (F.lower("final_result") == "true").alias("final_result"))


def write_csv(df: DataFrame, path: str, *, single_file: bool = False, bom: bool = False, compression: str = "none") -> None:
    """CSV with a heading; compressed files are read by their names' endings. A byte order mark needs one local file, and a result that the driver can hold."""
    if bom:
        rows = df.limit(LOCAL_ROWS + 1).toPandas()
        if len(rows) > LOCAL_ROWS:
            raise ValueError(f"more than {LOCAL_ROWS} rows; write without a byte order mark")
        rows.to_csv(path, index=False, encoding="utf-8-sig")
    else:
        (df.coalesce(1) if single_file else df).write.mode("overwrite").csv(path, header=True, escape='"', compression=compression)


def write_workbook(df: DataFrame, path: str, *, by: str | None = None) -> None:
    """One sheet, or one per value of `by` (names cut to 31 characters), of a result that the driver can hold."""
    import pandas as pd

    _workbooks()
    rows = df.limit(LOCAL_ROWS + 1).toPandas()
    if len(rows) > LOCAL_ROWS:
        raise ValueError(f"more than {LOCAL_ROWS} rows; write CSV")
    with pd.ExcelWriter(path) as book:
        for name, part in rows.groupby(by) if by else [("Sheet1", rows)]:
            part.to_excel(book, sheet_name=str(name)[:31], index=False)


def write_by_scenario(df: DataFrame, path: str) -> None:
    """One folder per scenario."""
    df.write.mode("overwrite").partitionBy("_scenario").csv(path, header=True)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)


def items(spark: SparkSession, source: Any) -> DataFrame:
    """index and data of a list, a dict (its keys) or a one-column frame."""
    if isinstance(source, DataFrame):
        return with_index(source.select(F.col(f"`{source.columns[0]}`").alias("data")), "index").select("index", "data")
    return spark.createDataFrame([(i, str(x)) for i, x in enumerate(source)], "index long, data string")


def nested_loop(*levels: DataFrame) -> DataFrame:
    """Every combination of the levels' rows, for small levels; a group-wise step after it is a groupBy."""
    from ..plans.pairing import theta_join

    out = levels[0]
    for level in levels[1:]:
        out = theta_join(out, level, F.lit(True))
    return out


def dataset(spark: SparkSession, path_1: str, path_2: str, rule: Any, required: tuple[Iterable[str], Iterable[str]] = ((), ())) -> tuple[DataFrame, DataFrame, Any]:
    """Two CSV tables and their rule, with the columns that the rule set needs checked."""
    frames = read_csv(spark, path_1), read_csv(spark, path_2)
    for df, names in zip(frames, required, strict=True):
        if missing := set(names) - set(df.columns):
            raise ValueError(f"missing columns: {sorted(missing)}")
    return *frames, rule

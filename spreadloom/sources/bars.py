"""Bar files: one Parquet file or folder per year; columns that only some years have are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampType

from ..functions.timecols import utc_clock

FILE_PATTERN = "bars_30m_{year}.parquet"


def load_bars(spark: SparkSession, base: str, years: int | list[int],
              regular_hours_only: bool = True, columns: list[str] | None = None,
              pattern: str = FILE_PATTERN) -> DataFrame:
    """Bars of the given years with the asked columns, in that order and once each.

    The regular-hours flag is filtered in the scans even when it is not asked for.
    """
    df = union_years([spark.read.parquet(p) for p in _paths(base, years, pattern)])
    if regular_hours_only:
        df = df.filter(F.col("is_regular_hours"))
    if columns is not None:
        df = df.select(*dict.fromkeys(columns))
    return df


def _paths(base: str, years: int | list[int], pattern: str) -> list[str]:
    years = [years] if isinstance(years, int) else years
    return [f"{base.rstrip('/')}/{pattern.format(year=y)}" for y in years]


def file_order(year: int) -> Column:
    """Where a row stands in the files: year, file path, place in the file.

    A struct of the three compares field by field, so ``max_by`` takes the last copy of a
    bar whatever the files are called, in a hash aggregate that combines before the shuffle.
    """
    return F.struct(F.lit(year).alias("year"), F.col("_metadata.file_path").alias("path"),
                    F.col("_metadata.row_index").alias("row"))


def load_panel_bars(spark: SparkSession, base: str, years: int | list[int],
                    price_col: str = "close", pattern: str = FILE_PATTERN) -> DataFrame:
    """(symbol, bar_ts, close, volume, file_order) of regular hours, for ``build_panel``.

    ``file_order`` tells which of two bars with one key comes last in the files.
    """
    years = [years] if isinstance(years, int) else years
    frames = []
    for year, path in zip(years, _paths(base, years, pattern)):
        bars = spark.read.parquet(path).filter(F.col("is_regular_hours"))
        ts = F.col("timestamp_utc")
        if isinstance(bars.schema["timestamp_utc"].dataType, TimestampType):
            ts = utc_clock(ts)
        frames.append(bars.select("symbol", ts.alias("bar_ts"), F.col(price_col).alias("close"), "volume",
                                  file_order(year).alias("file_order")))
    return union_years(frames)


def union_years(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; a column some year lacks is NULL there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out

"""From bar rows to the long panel: de-duplication, calendar, returns, fills.

The panel stays long, one row per (symbol, bar). ``bar_seq`` numbers the bars of
the union grid, so "previous grid row" is arithmetic on an integer and no dense
symbol-by-time matrix is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import MarketClock
from ..functions.numeric import finite
from ..functions.timecols import local_day, local_hhmm
from ..staging import stage

# Bars per window group. A window over a whole symbol would put a hot symbol in
# one task; a window over (symbol, chunk) holds at most this many rows.
CHUNK_BARS = 4096


def keep_last(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """One row per key, the one with the greatest ``order``.

    An aggregate rather than a ranking window: copies of a bar are combined
    before the shuffle, so a heavily duplicated key costs no more than others.
    """
    picks = [F.max_by(F.col(v), F.col(order)).alias(v) for v in values]
    return df.groupBy(*keys).agg(*picks)


def grid_calendar(bars: DataFrame, clock: MarketClock = MarketClock()) -> DataFrame:
    """(bar_ts, day, bar_seq, day_idx, is_open, n_bars, n_days) of the union grid.

    All time zone work happens here, once per distinct time rather than per bar.
    Ranks are taken within a month and shifted by the bars of earlier months, so
    the only unpartitioned window runs over one row per calendar month.
    """
    # Written, since a filter on what is made of a time would be pushed below ``distinct``, to every bar.
    times = stage(bars.select("bar_ts").filter(F.col("bar_ts").isNotNull()).distinct(), "bar-times")
    # The filter is spelled out so that both uses of the grid share one shuffle.
    grid = (
        times
        .withColumn("day", local_day(F.col("bar_ts"), clock.zone))
        .withColumn("month", F.trunc("day", "month")).filter(F.col("month").isNotNull())
    )
    months = grid.groupBy("month").agg(
        F.count(F.lit(1)).alias("bars"), F.count_distinct("day").alias("days")
    )
    earlier = W.orderBy("month").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("month").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = months.select(
        "month",
        F.coalesce(F.sum("bars").over(earlier), F.lit(0)).alias("bars_before"),
        F.coalesce(F.sum("days").over(earlier), F.lit(0)).alias("days_before"),
        F.sum("bars").over(whole).alias("n_bars"),
        F.sum("days").over(whole).alias("n_days"),
    )
    in_month = W.partitionBy("month")
    return grid.join(offsets, "month").select(
        "bar_ts",
        "day",
        (F.row_number().over(in_month.orderBy("bar_ts")) - 1 + F.col("bars_before"))
        .cast("bigint").alias("bar_seq"),
        (F.dense_rank().over(in_month.orderBy("day")) - 1 + F.col("days_before"))
        .cast("bigint").alias("day_idx"),
        (local_hhmm(F.col("bar_ts"), clock.zone) == F.lit(clock.open_time)).alias("is_open"),
        F.col("n_bars").cast("bigint").alias("n_bars"),
        F.col("n_days").cast("bigint").alias("n_days"),
    )


def on_grid(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    return bars.join(
        calendar.select("bar_ts", "day", "day_idx", "bar_seq", "is_open", "n_days"), "bar_ts")


def with_halo(
    df: DataFrame, seq: str, before: int = 0, after: int = 0, chunk: int = CHUNK_BARS
) -> DataFrame:
    """Split each series in chunks that also carry the rows just outside them.

    Adds ``chunk_id`` and ``is_halo``. A window partitioned by (key, chunk_id) sees
    ``before``/``after`` grid steps across the border; drop the halo rows after it.
    """
    s = F.col(seq)
    own = F.floor(s / F.lit(chunk)).cast("bigint")
    first = F.floor((s - after) / F.lit(chunk)).cast("bigint")
    last = F.floor((s + before) / F.lit(chunk)).cast("bigint")
    return (
        df.withColumn("chunk_id", F.explode(F.sequence(first, last)))
        .withColumn("is_halo", F.col("chunk_id") != own)
    )


def log_returns(panel: DataFrame, drop_overnight: bool = True, chunk: int = CHUNK_BARS) -> DataFrame:
    """Add ``logret``: log ratio to the previous grid row, NULL when it is missing.

    With ``drop_overnight`` a bar marked ``is_open`` keeps no return.
    """
    w = W.partitionBy("symbol", "chunk_id").orderBy("bar_seq")
    adjacent = F.lag("bar_seq").over(w) == F.col("bar_seq") - 1
    ratio = F.try_divide(F.col("close"), F.lag("close").over(w))
    ret = F.when(adjacent, F.ln(ratio))
    rows = with_halo(panel, "bar_seq", before=1, chunk=chunk).withColumn("logret", ret)
    rows = rows.filter(~F.col("is_halo")).drop("chunk_id", "is_halo")
    if drop_overnight:
        rows = rows.withColumn("logret", F.when(~F.col("is_open"), F.col("logret")))
    return rows


def build_panel(
    bars: DataFrame,
    clock: MarketClock = MarketClock(),
    order: str | None = "file_order",
    drop_overnight: bool = True,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Panel of (symbol, bar_ts, day, day_idx, bar_seq, n_days, close, dollar_vol, logret).

    ``bars`` needs symbol, bar_ts, close, volume and, unless ``order`` is None, a
    column that tells which of two bars with one key came last. A staged ``calendar``
    shows the optimizer its true size before the bars are joined to it.
    """
    rows = bars.select(
        "symbol", "bar_ts", *([order] if order else []),
        finite(F.col("close")).alias("close"),
        finite(F.col("close") * F.col("volume")).alias("dollar_vol"),
    )
    if order:
        rows = keep_last(rows, ["symbol", "bar_ts"], order, ["close", "dollar_vol"])
    if calendar is None:
        calendar = grid_calendar(bars, clock)
    priced = on_grid(rows, calendar).filter(F.col("close").isNotNull())
    return log_returns(priced, drop_overnight).select(
        "symbol", "bar_ts", "day", "day_idx", "bar_seq", "n_days", "close", "dollar_vol", "logret"
    )


def forward_fill(panel: DataFrame, value: str, last_seq: Column, limit: int = 3,
                 chunk: int = CHUNK_BARS) -> DataFrame:
    """(symbol, bar_seq, src_seq, value): each bar repeated over at most ``limit``
    empty grid rows after it, never beyond ``last_seq``.

    Rows are only ever added next to observed ones, so a sparse symbol is not
    blown up to the whole grid. ``src_seq`` tells where the value was observed.
    """
    rows = panel.filter(F.col(value).isNotNull()).select(
        "symbol", "bar_seq", F.col(value), last_seq.alias("last_seq")
    )
    w = W.partitionBy("symbol", "chunk_id").orderBy("bar_seq")
    stop = F.least(
        F.col("bar_seq") + limit,
        F.coalesce(F.lead("bar_seq").over(w) - 1, F.col("bar_seq") + limit),
        F.col("last_seq"),
    )
    return (
        with_halo(rows, "bar_seq", after=limit, chunk=chunk)
        .withColumn("stop", stop)
        .filter(~F.col("is_halo"))
        .select(
            "symbol",
            F.explode(F.sequence("bar_seq", "stop")).alias("filled_seq"),
            F.col("bar_seq").alias("src_seq"),
            F.col(value),
        )
        .withColumnRenamed("filled_seq", "bar_seq")
    )


def reindex_zero(df: DataFrame, grid: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of ``grid`` with the values of ``df``, zero where it has none."""
    joined = grid.join(df, keys, "left")
    kept = [c for c in joined.columns if c not in values]
    return joined.select(*kept, *[F.coalesce(F.col(v), F.lit(0.0)).alias(v) for v in values])


def wide_panel(panel: DataFrame, value: str, symbols: list[str]) -> DataFrame:
    """One column per symbol, for export of a named set of symbols."""
    return panel.filter(F.col("symbol").isin(symbols)).groupBy("bar_ts").pivot(
        "symbol", symbols).agg(F.first(value, ignorenulls=True))

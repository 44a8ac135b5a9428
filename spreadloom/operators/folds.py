"""Rolling train/test folds as a table, and bar-to-fold membership as arithmetic."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..config import FoldPlan
from ..staging import stage

ROLES = ("train_start", "train_end", "test_start", "test_end")


def last_fold(n_days: Column, plan: FoldPlan) -> Column:
    spare = n_days - (plan.train_days + plan.test_days)
    return F.floor(spare / F.lit(plan.roll_days)).cast("bigint")


def fold_table(calendar: DataFrame, plan: FoldPlan = FoldPlan()) -> DataFrame:
    """One row per fold: its four dates and the first/last ``bar_seq`` of each side.

    Every day names the folds it is a border of; collecting those roles by fold
    replaces four joins. A fold exists if its test window ends inside the data.
    """
    days = calendar.groupBy("day", "day_idx", "n_days").agg(
        F.min("bar_seq").alias("lo"), F.max("bar_seq").alias("hi")
    )
    shift = dict(zip(ROLES, (
        0, plan.train_days - 1, plan.train_days, plan.train_days + plan.test_days - 1)))
    roles = F.array(*[
        F.struct(F.lit(role).alias("role"), (F.col("day_idx") - shift[role]).alias("start"))
        for role in ROLES
    ])
    borders = (
        days.select("day", "lo", "hi", "n_days", F.inline(roles))
        .filter((F.col("start") >= 0) & (F.col("start") % plan.roll_days == 0))
        .withColumn("fold_id", (F.col("start") / plan.roll_days).cast("int"))
        .filter(F.col("fold_id") <= last_fold(F.col("n_days"), plan))
    )

    def pick(value: str, role: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(value)))

    return borders.groupBy("fold_id").agg(
        *[pick("day", role).alias(role) for role in ROLES],
        pick("lo", "train_start").alias("train_lo"),
        pick("hi", "train_end").alias("train_hi"),
        pick("lo", "test_start").alias("test_lo"),
        pick("hi", "test_end").alias("test_hi"),
    )


def check_no_lookahead(folds: DataFrame) -> DataFrame:
    """Fail the job if a fold tests on or before its last train day."""
    guard = F.assert_true(F.col("test_start") > F.col("train_end"), F.lit("fold looks ahead"))
    return folds.filter(guard.isNull())


class LookaheadError(ValueError):
    """A fold reads bars from the other side of its border."""


def stage_guarded(rows: DataFrame, label: str, folds: DataFrame, border: str, past: Column) -> DataFrame:
    """``stage``, and fail if a row reads past its fold's ``border``, a column of ``folds``.

    ``past`` says by how many bars, NULL or at most zero where a row keeps to its side. The
    greatest value is noted while the rows are written (``observe``), so the bars are not
    read again, and it stays the same if a lost executor's task runs twice, as a count
    would not. The check is of the bars themselves; ``check_no_lookahead`` looks at dates.
    """
    kept = rows.columns
    noted = Observation(f"{label}-{uuid.uuid4().hex}")
    table = stage(rows.join(folds.select("fold_id", border), "fold_id").observe(
        noted, F.max(past).alias("bars"), F.max_by("fold_id", past).alias("fold")).select(*kept), label)
    worst = noted.get
    if (worst.get("bars") or 0) > 0:
        raise LookaheadError(f"{label}: fold {worst['fold']} reads {worst['bars']} bars past {border}")
    return table


def last_bar(values: str) -> Column:
    """``bar_seq`` of the last value of a packed array, NULL without one."""
    return F.col("lo") + F.array_max(F.transform(values, lambda x, i: F.when(x.isNotNull(), i)))


def fold_evidence(series: DataFrame, pair_bars: DataFrame) -> DataFrame:
    """(fold_id, last_train_seq, first_test_seq): the last return that a fold trained on and the first bar on which
    it traded two prices; no test bar where it traded none."""
    read = series.groupBy("fold_id").agg(F.max(last_bar("ret")).alias("last_train_seq"))
    traded = pair_bars.filter("close_a IS NOT NULL AND close_b IS NOT NULL").groupBy("fold_id").agg(F.min("bar_seq").alias("first_test_seq"))
    return read.join(traded, "fold_id", "left")


def _fold_range(first_day: Column, last_day: Column, offset: int, length: int,
                n_days: Column, plan: FoldPlan) -> Column:
    """Ids of the folds whose window [start+offset, +length) holds both days."""
    roll = F.lit(plan.roll_days)
    lo = F.greatest(F.ceil((last_day - offset - length + 1) / roll), F.lit(0)).cast("int")
    hi = F.least(F.floor((first_day - offset) / roll), last_fold(n_days, plan)).cast("int")
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def train_folds(first_day: Column, last_day: Column, n_days: Column, plan: FoldPlan) -> Column:
    return _fold_range(first_day, last_day, 0, plan.train_days, n_days, plan)


def test_folds(first_day: Column, last_day: Column, n_days: Column, plan: FoldPlan) -> Column:
    return _fold_range(first_day, last_day, plan.train_days, plan.test_days, n_days, plan)


def window_folds(day: Column, n_days: Column, plan: FoldPlan) -> Column:
    """Ids of the folds that train or test on ``day``."""
    return _fold_range(day, day, 0, plan.train_days + plan.test_days, n_days, plan)


def assign_folds(panel: DataFrame, plan: FoldPlan, side: str) -> DataFrame:
    """Each bar once per fold whose ``side`` ('train' or 'test') window holds its day."""
    ids = train_folds if side == "train" else test_folds
    day = F.col("day_idx")
    return panel.withColumn("fold_id", F.explode(ids(day, day, F.col("n_days"), plan)))


def between_days(panel: DataFrame, start: str, end: str) -> DataFrame:
    """Bars whose local day lies in [start, end]."""
    return panel.filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def assign_members(panel: DataFrame, members: DataFrame, plan: FoldPlan, side: str) -> DataFrame:
    """As ``assign_folds``, for the (fold_id, symbol) rows of ``members`` only.

    A symbol's folds are gathered in one row first (there are no more than folds), so
    a single join on the symbol drops the bars of all other symbols before any bar is
    copied to its folds.
    """
    ids = train_folds if side == "train" else test_folds
    wanted = members.groupBy("symbol").agg(F.collect_set("fold_id").alias("wanted"))
    day = F.col("day_idx")
    held = F.array_intersect(ids(day, day, F.col("n_days"), plan), F.col("wanted"))
    return panel.join(wanted, "symbol").withColumn("fold_id", F.explode(held)).drop("wanted")

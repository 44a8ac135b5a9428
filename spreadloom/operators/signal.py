"""Trading rule of a pair as windows over (fold, pair): z-score, position, costs, trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from ..config import TradeRule
from ..functions.numeric import safe_div
from .pairstats import PAIR, residual

def leg_weights(beta: Column) -> tuple[Column, Column]:
    """Dollar-neutral weights of the two legs per unit of spread."""
    gross = 1 + F.abs(beta)
    return 1 / gross, -beta / gross


def window_width(half_life: Column, rule: TradeRule) -> Column:
    wide = F.rint(half_life * rule.window_per_half_life).cast("bigint")
    return F.greatest(wide, F.lit(rule.window_floor).cast("bigint"))


def _time_order(keys: tuple[str, ...]) -> WindowSpec:
    # Blocks follow each other in time, so this is the time order, and the sort that windows inside a block need.
    return W.partitionBy(*keys).orderBy("block", "bar_seq")


def with_blocks(grid: DataFrame, rule: TradeRule) -> DataFrame:
    """Add ``width``, the bars of the pair's own window, and ``block``: each pair's bars in runs of ``width``."""
    width = F.coalesce(window_width(F.col("half_life"), rule), F.lit(1).cast("bigint"))
    return grid.withColumn("width", F.greatest(width, F.lit(1))).withColumn(
        "block", F.expr("(bar_seq - first_seq) div width"))


def spread_zscores(grid: DataFrame, rule: TradeRule = TradeRule(),
                   keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Add ``spread`` and ``z`` to a pair grid that carries first_seq, alpha, beta, mu, sigma, half_life.

    z is taken against the trailing window of the pair's own width; a pair without
    a half-life is measured against its train mean and deviation.
    """
    spread = residual(F.ln("close_a"), F.ln("close_b"), F.col("alpha"), F.col("beta"))
    rows = with_blocks(grid, rule).withColumn("spread", spread)
    frozen = safe_div(F.col("spread") - F.col("mu"), F.col("sigma"))
    if not rule.rolling:
        return rows.withColumn("z", frozen)
    return rolling_zscores(rows, rule, keys).withColumn(
        "z", F.when(F.col("half_life").isNull(), frozen).otherwise(F.col("z")))


def _moments(value: str, frame: WindowSpec) -> Column:
    """(n, mean, m2, low, high) of a frame; m2 is the sum of squared deviations from the frame's own mean."""
    n = F.count(value).over(frame)
    return F.struct(
        n.alias("n"), F.avg(value).over(frame).alias("mean"), (F.var_pop(value).over(frame) * n).alias("m2"),
        F.min(value).over(frame).alias("low"), F.max(value).over(frame).alias("high"))


def merged_moments(a: Column, b: Column) -> Column:
    """The moments of two disjoint sets of values together; either may be empty or NULL."""
    n_a, n_b = F.coalesce(a["n"], F.lit(0)), F.coalesce(b["n"], F.lit(0))
    apart, share = b["mean"] - a["mean"], F.try_divide(n_b, n_a + n_b)
    low, high = F.least(a["low"], b["low"]), F.greatest(a["high"], b["high"])
    m2 = (F.coalesce(a["m2"], F.lit(0.0)) + F.coalesce(b["m2"], F.lit(0.0))
          + F.coalesce(apart * apart * share * n_a, F.lit(0.0)))
    return F.struct(
        (n_a + n_b).alias("n"), F.coalesce(a["mean"] + apart * share, a["mean"], b["mean"]).alias("mean"),
        # Means of equal values may differ in the last digit; low and high tell that nothing is spread.
        F.when(low == high, 0.0).otherwise(m2).alias("m2"), low.alias("low"), high.alias("high"))


def rolling_moments(rows: DataFrame, value: str, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Add ``seen``: (n, mean, m2, low, high) of ``value`` over the last ``width`` grid bars, at a cost that does not grow with the width.

    The last ``width`` bars are the end of one block and the beginning of the next. Running
    moments from both sides of every block give either part, and the two are merged, so
    nothing is ever subtracted and a large offset of the values costs no digits. The bar
    ``width - 1`` steps back is the previous one of those whose number leaves the same rest
    by ``width - 1``, which turns each pair's own distance into a plain lag. Rows need
    ``first_seq``, ``width``, ``block``, and one row for every bar from first_seq on.
    """
    step = F.greatest(F.col("width") - 1, F.lit(1))
    back = W.partitionBy(*keys, "block").orderBy(F.desc("bar_seq")).rowsBetween(W.unboundedPreceding, 0)
    forth = W.partitionBy(*keys, "block").orderBy("bar_seq").rowsBetween(W.unboundedPreceding, 0)
    stride = W.partitionBy(*keys, "stride").orderBy("bar_seq")
    to_end = F.struct("bar_seq", "block", _moments(value, back).alias("held"))
    rows = rows.withColumn("to_end", to_end).withColumn("stride", (F.col("bar_seq") - F.col("first_seq")) % step)
    rows = rows.withColumn("oldest", F.lag("to_end").over(stride))
    reaches_back = (F.col("oldest.bar_seq") == F.col("bar_seq") - F.col("width") + 1) & (F.col("oldest.block") < F.col("block"))
    rows = rows.withColumn("older", F.when(reaches_back, F.col("oldest.held"))).drop("to_end", "stride", "oldest")
    return rows.withColumn("newer", _moments(value, forth)).withColumn(
        "seen", merged_moments(F.col("older"), F.col("newer"))).drop("older", "newer")


def rolling_zscores(rows: DataFrame, rule: TradeRule, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """z of ``spread`` against its last ``width`` grid bars, NULL until enough are seen."""
    if rule.full_window:
        needed = F.col("width")
    else:
        needed = F.greatest(F.floor(F.col("width") / 2), F.lit(rule.window_floor))
    seen = F.col("seen")
    deviation = F.sqrt(safe_div(seen["m2"], seen["n"] - 1))
    z = safe_div(F.col("spread") - seen["mean"], deviation)
    return rolling_moments(rows, "spread", keys).withColumn("z", F.when(seen["n"] >= needed, z)).drop("seen")


def positions(rows: DataFrame, rule: TradeRule = TradeRule(),
              keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Add ``position`` in {-1, 0, 1} driven by ``z``; rows need ``block``.

    What a bar does to the state depends only on |z|: a missing or small or (when
    below entry) extreme z always ends flat; an entry-sized z always ends in a
    position; a z beyond both entry and stop swaps the two; anything else keeps
    the state. So the state is the last forcing bar plus the parity of the swaps
    since, and no loop is needed.
    """
    t = _time_order(keys)
    size = F.abs("z")
    opens = size >= rule.z_entry
    closes = (size <= rule.z_exit) | (size >= rule.z_stop)
    forced = (
        F.when(F.col("z").isNull(), 0)
        .when(opens & closes, F.lit(None).cast("int"))
        .when(opens, 1)
        .when(closes, 0)
    )
    swap = F.coalesce((opens & closes).cast("int"), F.lit(0))
    rows = rows.withColumn("forced", forced).withColumn("swaps", F.sum(swap).over(t))
    swaps_then = F.last(F.when(F.col("forced").isNotNull(), F.col("swaps")), True).over(t)
    state = F.coalesce(F.last("forced", True).over(t), F.lit(0))
    held = (state + F.col("swaps") - F.coalesce(swaps_then, F.lit(0))) % 2 == 1
    rows = rows.withColumn("held", held)
    enters = F.col("held") & ~F.coalesce(F.lag("held").over(t), F.lit(False))
    rows = rows.withColumn("entry_side", F.when(enters, -F.signum("z")))
    side = F.last("entry_side", True).over(t)
    return rows.withColumn(
        "position", F.when(F.col("held"), side).otherwise(F.lit(0.0)).cast("int")
    ).drop("forced", "swaps", "held", "entry_side")


def position_returns(rows: DataFrame, rule: TradeRule = TradeRule(),
                     keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Add gross_ret, turnover, cost and net_ret.

    A position earns from the bar after it was taken; a missing leg return is zero.
    """
    t = _time_order(keys)
    unit_a, unit_b = leg_weights(F.col("beta"))
    now = F.coalesce(F.lag("position", 1).over(t), F.lit(0))
    before = F.coalesce(F.lag("position", 2).over(t), F.lit(0))
    ret_a = F.coalesce("ret_a", F.lit(0.0))
    ret_b = F.coalesce("ret_b", F.lit(0.0))
    moved = F.abs(now - before)
    rows = rows.withColumns({
        "gross_ret": now * unit_a * ret_a + now * unit_b * ret_b,
        "turnover": moved * unit_a + moved * F.abs(unit_b),
    })
    rows = rows.withColumn("cost", F.col("turnover") * rule.cost_per_side)
    return rows.withColumn("net_ret", F.col("gross_ret") - F.col("cost"))


def evaluate_pairs(grid: DataFrame, rule: TradeRule = TradeRule(),
                   keys: tuple[str, ...] = PAIR) -> DataFrame:
    """The whole rule on a pair grid: spread, z, position, returns and costs."""
    return position_returns(
        positions(spread_zscores(grid, rule, keys), rule, keys), rule, keys)


def extract_trades(rows: DataFrame, keys: tuple[str, ...] = PAIR,
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per run of a constant non-zero position.

    A trade ends on the first bar that is flat or on the other side, or on the
    last bar. It earns the gross returns after its entry bar through its exit bar
    and pays the costs of the entry bar through the exit bar.
    """
    t = W.partitionBy(*keys).orderBy("bar_seq")
    marked = (
        rows.select(*keys, *carry, "bar_seq", "position",
                    F.col("cost").alias("cost_here"),
                    F.sum("gross_ret").over(t).alias("gross_sum"),
                    F.sum("cost").over(t).alias("cost_sum"),
                    (F.col("position") != F.coalesce(F.lag("position").over(t), F.lit(0)))
                    .alias("changes"),
                    F.lead("bar_seq").over(t).isNull().alias("is_end"))
        .filter(F.col("changes") | F.col("is_end"))
    )

    def at_exit(column: str) -> Column:
        return F.coalesce(F.lead(column).over(t), F.col(column))

    closed = marked.select(
        *keys, *carry, "position", "changes", "bar_seq",
        at_exit("bar_seq").alias("exit_seq"),
        (at_exit("gross_sum") - F.col("gross_sum")
         - (at_exit("cost_sum") - F.col("cost_sum") + F.col("cost_here"))).alias("pnl"),
    ).filter(F.col("changes") & (F.col("position") != 0))
    return closed.select(
        *keys, *carry, F.col("position").alias("side"),
        F.col("bar_seq").alias("entry_seq"), "exit_seq",
        (F.col("exit_seq") - F.col("bar_seq")).alias("holding_bars"), "pnl")

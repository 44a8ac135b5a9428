"""Reports over saved arms: load their tables, write every report table as text.

    spark-submit … with ``write_reports(spark, out, arms)``; the batch job ends with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import reports as rp
from ..operators.metrics import BARS_PER_YEAR
from ..sources.results import load_arms, write_tsv
from ..staging import stage

ORDERS = {
    "summary": ("arm",), "fold_metrics": ("arm", "fold_id"), "cost_sensitivity": ("arm", "cost_bps"),
    "pair_overlap": ("arm_1", "arm_2"), "unique_pairs": ("arm",), "most_traded": ("arm", "place"),
    "headline": ("line",), "fold_returns": ("test_start",), "equity": ("bar_ts",),
    "trades": ("arm", "fold_id", "entry_ts", "sym_a", "sym_b"),
}


def report_tables(tables: dict[str, DataFrame], arms: list[str], bars_per_year: int = BARS_PER_YEAR) -> dict[str, DataFrame]:
    """The report tables by name, from the saved tables of several arms."""
    summary = stage(rp.arm_summary(tables["aggregate"], tables["fold_metrics"]), "summary")
    return {
        "summary": summary,
        "fold_metrics": tables["fold_metrics"],
        "cost_sensitivity": rp.cost_sensitivity(tables["equity"], tables["aggregate"], bars_per_year=bars_per_year),
        "pair_overlap": rp.pair_overlap(tables["trades"], arms),
        "unique_pairs": rp.unique_pair_counts(tables["trades"]),
        "most_traded": rp.most_traded(tables["trades"]),
        "headline": rp.headline_table(summary, arms),
        "fold_returns": rp.fold_return_matrix(tables["fold_metrics"], arms),
        "equity": rp.equity_table(tables["equity"], arms),
        "trades": tables["trades"],
    }


def write_reports(spark: SparkSession, out: str, arms: list[str], bars_per_year: int = BARS_PER_YEAR) -> None:
    """Write ``<out>/reports/<table>`` for the arms saved in ``out``."""
    tables = {name: df.filter(df.arm.isin(list(arms))) for name, df in load_arms(spark, out).items()}
    for name, df in report_tables(tables, list(arms), bars_per_year).items():
        write_tsv(df, f"{out}/reports/{name}", ORDERS[name])

"""Result tables: committed bundles of arms, fold intermediates, JSON and TSV exports, and the weights cache.

A bundle is all result tables of one run of an arm. They are written to a folder of their
own first; then an empty marker file is created, which is one atomic step. Readers go by the
newest marker, so they see the bundle before or the new one whole, whenever a job stops.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructType
from pyspark.errors import AnalysisException

from ..staging import stage

ARM_TABLES = ("aggregate", "equity", "fold_metrics", "trades", "config")
FOLD_TABLES = ("embeddings", "lookbacks", "selection")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def six_decimals(df: DataFrame) -> DataFrame:
    return df.select(*[
        # format_string would write the word null for a missing number.
        F.when(F.col(f.name).isNotNull() & ~F.isnan(f.name), F.format_string("%.6f", F.col(f.name))).alias(f.name)
        if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema.fields])


def write_tsv(df: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """Tab-separated text with a header, sorted by ``order``; doubles carry six decimals."""
    rows = df.orderBy(*order) if order else df
    six_decimals(rows).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def config_frame(spark: SparkSession, arm: str, snapshot: dict) -> DataFrame:
    return spark.createDataFrame([(arm, json.dumps(snapshot, sort_keys=True))],
                                 "arm string, config string")


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what stands in a folder, in order; none where there is no folder."""
    fs, place = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(place)) if fs.exists(place) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, place = _file_system(spark, path)
    fs.delete(place, True)


def save_folds(tables: dict[str, DataFrame], out: str, arm: str) -> None:
    """Write intermediates of an arm's folds to ``<table>/arm=<arm>/fold_id=<n>``; other folds and arms stay."""
    for name, df in tables.items():
        (df.drop("arm").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("fold_id").parquet(f"{out}/{name}/arm={arm}"))


def _bundles(out: str, arm: str) -> str:
    return f"{out}/bundles/arm={arm}"


def committed_bundle(spark: SparkSession, out: str, arm: str) -> str | None:
    """The folder of the newest committed bundle of an arm."""
    done = names_in(spark, f"{_bundles(out, arm)}/_committed")
    return f"{_bundles(out, arm)}/{done[-1]}" if done else None


def commit_arm(tables: dict[str, DataFrame], out: str, arm: str) -> None:
    """Write the tables of an arm as a new bundle and make it the one that readers see.

    The bundle before it stays for readers that have it open; older ones go, and so does
    what earlier runs left without a commit. One job at a time may write an arm.
    """
    spark, base = next(iter(tables.values())).sparkSession, _bundles(out, arm)
    done = names_in(spark, f"{base}/_committed")
    for name in names_in(spark, base):
        if name != "_committed" and name not in done[-1:]:
            delete_folder(spark, f"{base}/_committed/{name}")
            delete_folder(spark, f"{base}/{name}")
    bundle = f"{int(done[-1].split('-')[0]) + 1 if done else 0:08d}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.drop("arm").write.parquet(f"{base}/{bundle}/{name}")
    fs, marker = _file_system(spark, f"{base}/_committed/{bundle}")
    fs.create(marker, False).close()


def read_bundle(spark: SparkSession, out: str, arm: str, table: str) -> DataFrame | None:
    """A table of an arm's newest committed bundle, or None."""
    bundle = committed_bundle(spark, out, arm)
    return spark.read.parquet(f"{bundle}/{table}") if bundle and table in names_in(spark, bundle) else None


def load_arms(spark: SparkSession, out: str, tables: tuple[str, ...] = ARM_TABLES) -> dict[str, DataFrame]:
    """Tables of all arms with their ``arm``: of committed bundles, or the intermediates of folds."""
    arms = [n.removeprefix("arm=") for n in names_in(spark, f"{out}/bundles")]

    def load(table: str) -> DataFrame:
        held = [(arm, read_bundle(spark, out, arm, table)) for arm in arms]
        parts = [df.withColumn("arm", F.lit(arm)) for arm, df in held if df is not None]
        if not parts:
            return spark.read.parquet(f"{out}/{table}")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    return {name: load(name) for name in tables}


def config_key(*parts) -> str:
    """Short hash of everything that decides what a fit would give."""
    text = json.dumps(parts, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def weights_folder(path: str, arm: str, key: str) -> str:
    """A folder of its own for each arm and key: arms that run side by side never write to one."""
    return f"{path}/arm={arm}/config_key={key}"


def cached_weights(spark: SparkSession, path: str, arm: str, key: str) -> DataFrame | None:
    try:
        return spark.read.parquet(weights_folder(path, arm, key))
    except AnalysisException:
        return None


def keyed_by_samples(samples: DataFrame) -> DataFrame:
    """(fold_id, sample_key): what a fold's samples are, whatever their order: their number and a sum of hashes."""
    return samples.groupBy("fold_id").agg(F.concat_ws(
        "-", F.count(F.lit(1)).cast("string"),
        F.sum(F.xxhash64("symbol", "sample_id", "x", "target").cast("decimal(38,0)")).cast("string")).alias("sample_key"))


def fit_with_cache(samples: DataFrame, fit, path: str, arm: str, key: str) -> DataFrame:
    """Weights of every fold in ``samples``; ``fit`` runs for the folds whose samples are not those of a fit in the cache."""
    spark = samples.sparkSession
    keys = stage(keyed_by_samples(samples), "sample-keys")
    known = cached_weights(spark, path, arm, key)
    todo = keys if known is None else keys.join(known.select("fold_id", "sample_key"), ["fold_id", "sample_key"], "left_anti")
    if known is None or not todo.isEmpty():
        todo = stage(todo, "folds-to-fit")
        fitted = fit(samples.join(todo.select("fold_id"), "fold_id", "left_semi"))
        fitted.join(todo, "fold_id").write.mode("append").parquet(weights_folder(path, arm, key))
    return cached_weights(spark, path, arm, key).join(keys, ["fold_id", "sample_key"], "left_semi").drop("sample_key")

"""Short sketches of return series that bound any two series' correlation from above.

1. ``PIVOTS`` series of a fold, of those that share the fold's most frequent pattern of
   missing returns, are turned into an orthonormal basis (one task per fold, which holds
   the pivots only).
2. A series with that same pattern, centred and of unit length, is its coordinates in the
   basis and a rest of known length. The correlation of two such series is at most the
   product of their coordinates plus the product of their rests (Cauchy-Schwarz).
3. Series nearest to one pivot are neighbours in the order that tiles are cut from.

A series with another pattern, or constant but for rounding, has no sketch (``regular`` is
false) and is in tiles of its own kind: its correlation is over other bars, so nothing
bounds it and it is always compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numeric import finite
from ..staging import stage

PIVOTS = 32
#: A pivot whose part outside the basis is shorter than this adds no direction.
NEW_DIRECTION = 0.05
#: A series is constant if its spread is below this share of its size.
CONSTANT = 1e-6
#: Room for rounding when a bound is compared with a correlation.
ROOM = 1e-9

BASIS = "fold_id int, place int, ret array<double>, spot array<double>"
SKETCH = "fold_id int, symbol string, regular boolean, cell int, own double, coords array<double>, rest double"


def unit_rows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows centred and of unit length, and which of them vary at all."""
    centred = m - m.mean(1, keepdims=True)
    size = np.linalg.norm(centred, axis=1)
    varies = size > CONSTANT * np.linalg.norm(m, axis=1)
    return centred / np.where(varies, size, 1.0)[:, None], varies


def _chained(spots: np.ndarray) -> list[int]:
    """The pivots in a row, each followed by the one of the rest that is most like it."""
    left, chain = list(range(len(spots))), []
    while left:
        chain.append(left[0] if not chain else max(left, key=lambda p: spots[p] @ spots[chain[-1]]))
        left.remove(chain[-1])
    return chain


def _basis(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    """Basis vectors, missing where the pivots are, and beside them the coordinates of the pivots, chained."""
    m = np.stack(block.sort_values("place")["ret"].to_list())
    seen = np.isfinite(m)
    unit, varies = unit_rows(m[(seen == seen[0]).all(1)][:, seen[0]])
    q, kept = np.zeros((0, unit.shape[1])), []
    for row in unit[varies]:
        rest = row - (q @ row) @ q
        rest = rest - (q @ rest) @ q
        if (size := np.linalg.norm(rest)) > NEW_DIRECTION:
            q = np.vstack([q, rest / size])
            kept.append(row)
    full = np.full((len(q), m.shape[1]), np.nan)
    full[:, seen[0]] = q
    spots = np.array(kept).reshape(q.shape) @ q.T
    spots = spots[_chained(spots)]
    return pd.DataFrame({"fold_id": key[0], "place": np.arange(len(q)), "ret": list(full), "spot": list(spots)})


def fold_bases(series: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """The orthonormal basis of each fold, at most ``pivots`` rows."""
    pattern = F.xxhash64(F.transform("ret", lambda x: finite(x).isNotNull()))
    known = stage(series.filter(F.exists("ret", lambda x: finite(x).isNotNull())).select("fold_id", "symbol", pattern.alias("pattern")), "patterns")
    usual = known.groupBy("fold_id", "pattern").count().groupBy("fold_id").agg(
        F.max_by("pattern", F.struct("count", "pattern")).alias("pattern"))
    by_hash = W.partitionBy("fold_id").orderBy(F.xxhash64("symbol"), "symbol")
    chosen = known.join(usual, ["fold_id", "pattern"]).withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= pivots)
    return (series.select("fold_id", "symbol", "ret").join(stage(chosen.select("fold_id", "symbol", "place"), "pivots"), ["fold_id", "symbol"])
            .groupBy("fold_id").applyInPandas(_basis, BASIS))


def _sketch(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    given, basis = block[block["place"].isna()], block[block["place"].notna()].sort_values("place")
    x = np.stack(given["ret"].to_list()) if len(given) else np.zeros((0, 0))
    regular = np.zeros(len(x), bool)
    coords, rest, cell, own = [[] for _ in x], np.zeros(len(x)), np.full(len(x), -1), np.zeros(len(x))
    if len(basis) and len(x):
        q, spots = np.stack(basis["ret"].to_list()), np.stack(basis["spot"].to_list())
        on = np.isfinite(q[0])
        q, alike = q[:, on], (np.isfinite(x) == on).all(1)
        unit, varies = unit_rows(x[alike][:, on])
        rows = np.flatnonzero(alike)[varies]
        unit = unit[varies]
        c = unit @ q.T
        near = c @ spots.T
        regular[rows], cell[rows], own[rows] = True, near.argmax(1), near.max(1)
        rest[rows] = np.linalg.norm(unit - c @ q, axis=1)
        for row, values in zip(rows, c):
            coords[row] = values
    return pd.DataFrame({"fold_id": key[0], "symbol": given["symbol"], "regular": regular, "cell": cell, "own": own,
                         "coords": coords, "rest": rest})


def sketched_tiles(series: DataFrame, tile: int, pivots: int = PIVOTS) -> DataFrame:
    """(fold_id, symbol, regular, coords, rest, tile, n_tiles); even tiles hold sketched series, odd ones the others.

    Every series travels once, and the basis once for each tile; what is written is a
    sketch per series.
    """
    n = F.ceil(F.col("n_universe") / tile).cast("int")
    bases = stage(fold_bases(series, pivots), "bases")
    given = series.select("fold_id", "symbol", "ret", F.floor((F.col("uni_rank") - 1) / tile).cast("int").alias("tile"),
                          F.lit(None).cast("int").alias("place"), F.lit(None).cast("array<double>").alias("spot"))
    spread = (series.select("fold_id", n.alias("n")).distinct().join(bases, "fold_id")
              .select("fold_id", F.lit(None).cast("string").alias("symbol"), "ret", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("tile"), "place", "spot"))
    sketches = stage(given.unionByName(spread).groupBy("fold_id", "tile").applyInPandas(_sketch, SKETCH), "sketches")
    order = W.partitionBy("fold_id", "regular").orderBy("cell", F.desc("own"), "symbol")
    place = F.floor((F.row_number().over(order) - 1) / tile).cast("int")
    sizes = series.select("fold_id", (n * 2).alias("n_tiles")).distinct()
    return stage(sketches.withColumn("tile", place * 2 + F.when(F.col("regular"), 0).otherwise(1)).drop("cell", "own")
                 .join(sizes, "fold_id"), "sketched-tiles")

"""Networks, their distributed fits, and the arms built on them."""

from dataclasses import replace
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import inputs as I, vector_queries as vq
from spreadloom.config import AutoencoderSpec, GruSpec, TrainerSpec
from spreadloom.functions import nets
from spreadloom.operators import autoregression as ar, training as tr, windows as wn
from spreadloom.plans import selection as sl
from spreadloom.sources import results as rs
from spreadloom.staging import side_by_side


@pytest.mark.parametrize("net", [
    nets.Autoencoder(AutoencoderSpec(seq_len=5, hidden=6, emb_dim=3)),
    nets.GruRegressor(GruSpec(max_lags=5, hidden=4, emb_dim=3))])
def test_gradients_equal_differences(net):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 5)), rng.normal(size=7)
    shapes = net.shapes()
    w = [rng.normal(size=s) * 0.5 for s, _ in shapes]
    grads = net.gradient(w, x, y)
    for k, g in enumerate(grads):
        for at in list(np.ndindex(*g.shape))[:6]:
            step = 1e-6
            up, down = [v.copy() for v in w], [v.copy() for v in w]
            up[k][at] += step
            down[k][at] -= step
            slope = (net.loss(up, x, y) - net.loss(down, x, y)) / (2 * step)
            assert abs(slope - g[at]) < 1e-6, (k, at)


def samples(spark, n=400, folds=2):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(2, 12))
    rows = []
    for f in range(folds):
        for i in range(n):
            x = rng.normal(size=2) @ base + 0.1 * rng.normal(size=12)
            rows.append((f, f"S{i % 20:02d}", i, [float(v) for v in x], float(x[0])))
    return spark.createDataFrame(rows, "fold_id int, symbol string, sample_id int, x array<double>, target double")


SPEC = AutoencoderSpec(hidden=16, emb_dim=4)


def test_gates_of_a_step_are_one_run_of_numbers():
    """Gates lay side by side in each sample's row, so that all arithmetic on them went row by row."""
    net = nets.GruRegressor(GruSpec(hidden=4, emb_dim=3))
    w = nets.unflatten(net, nets.initial_weights(net, 5), "float64")
    x = np.random.default_rng(6).normal(size=(7, 5))
    last, (seen, made, new) = net._recur(w, x, keep=True)
    assert made.shape == (5, 12, 7) and made[0, :8].flags.c_contiguous and new[0].flags.c_contiguous
    h = np.zeros((7, 4))
    for t in range(5):
        assert np.allclose(seen[t, :4], h.T) and np.allclose(seen[t, 4], x[:, t])
        a, b = x[:, t:t + 1] @ w[0] + w[2], h @ w[1] + w[3]
        r, z = (1 / (1 + np.exp(-(a[:, k:k + 4] + b[:, k:k + 4]))) for k in (0, 4))
        c = np.tanh(a[:, 8:] + r * b[:, 8:])
        assert np.allclose(made[t], np.hstack([r, z, b[:, 8:]]).T) and np.allclose(new[t], c.T)
        h = (1 - z) * c + z * h
    assert np.allclose(last, h)


@pytest.mark.parametrize("most", [4, 16])
def test_fit_lowers_loss(spark, most):
    trainer = TrainerSpec(epochs=12, batch_size=32, most_batches=most, lr=5e-3)
    fits = tr.fit_folds(samples(spark), nets.Autoencoder(SPEC), trainer).collect()
    assert sorted(r.fold_id for r in fits) == [0, 1]
    for r in fits:
        assert r.val_loss < 0.7 * r.first_loss and r.n_samples == 400 and 1 <= r.epochs_run <= 12
        assert np.isfinite(r.weights).all() and len(r.weights) == sum(int(np.prod(s)) for s, _ in nets.Autoencoder(SPEC).shapes())


def test_fit_does_not_depend_on_partitioning(spark):
    trainer = TrainerSpec(epochs=3, batch_size=32)
    rows = samples(spark, 120)
    def fit(df): return {r.fold_id: r.weights for r in tr.fit_folds(df, nets.Autoencoder(SPEC), trainer).collect()}
    assert fit(rows.repartition(1)) == fit(rows.repartition(7, "sample_id"))


def test_fit_does_not_depend_on_the_number_of_blocks(spark):
    rows = samples(spark, 200)
    trainer = TrainerSpec(epochs=3, batch_size=64)
    fits, blocks = [], []
    for size in (10_000, 20, 1):
        spec = replace(trainer, block_samples=size)
        blocks.append(tr.pack_blocks(rows, spec).count())
        fits.append({r.fold_id: np.array(r.weights) for r in tr.fit_folds(rows, nets.Autoencoder(SPEC), spec).collect()})
    assert blocks[0] == 2 * 4 and blocks[1] > 2 * 8 and blocks[2] > 200
    for other in fits[1:]:
        for fold, weights in fits[0].items():
            assert np.allclose(other[fold], weights, atol=1e-5)


@pytest.mark.parametrize("net", [nets.Autoencoder(AutoencoderSpec(hidden=6, emb_dim=3)), nets.GruRegressor(GruSpec(max_lags=12, hidden=4, emb_dim=3))])
def test_gradient_sums_equal_the_whole_gradient(spark, net):
    """Blocks add up to the gradient of all samples at once; those that judge add a loss only."""
    rows = samples(spark, 150)
    spec = TrainerSpec(batch_size=1000, block_samples=16)
    flat = {f: nets.initial_weights(net, f) for f in (0, 1)}
    got = tr.gradient_sums(tr.pack_blocks(rows, spec, "float64").rdd, net, flat, "float64")
    apart = tr.gradient_sums(tr.pack_blocks(rows, spec, "float64").rdd.repartition(70), net, flat, "float64")
    one = {(r.fold_id, r.part): r for r in tr.pack_blocks(rows, replace(spec, block_samples=10 ** 6), "float64").collect()}
    for f in (0, 1):
        w = nets.unflatten(net, flat[f], "float64")

        def block(part):
            r = one[f, part]
            return np.frombuffer(r.x).reshape(r.n, -1), np.frombuffer(r.y)

        want = np.concatenate([g.ravel() for g in net.gradient(w, *block(0))])
        for sums in (got, apart):
            assert np.allclose(sums[f].gradient / sums[f].n_fit, want, rtol=1e-9, atol=1e-12)
        n = one[f, tr.JUDGE].n
        assert got[f].n_judge == n and got[f].n_fit == 150 - n
        assert abs(got[f].error / n - net.loss(w, *block(tr.JUDGE))) < 1e-12


@pytest.mark.parametrize("net", [nets.Autoencoder(AutoencoderSpec(hidden=6, emb_dim=3)), nets.GruRegressor(GruSpec(max_lags=12, hidden=4, emb_dim=3))])
def test_equal_samples_are_multiplied_once(spark, net):
    """Copies of a sample were rows of their own in every step; now they are one row that counts as often."""
    rows = samples(spark, 60)
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("sample_id") < 20, 4).otherwise(1))).alias("copy")
    rows = rows.select("fold_id", "symbol", "sample_id", "x", "target", copies).withColumn(
        "sample_id", F.col("sample_id") + 1000 * F.col("copy")).drop("copy")
    spec = TrainerSpec(batch_size=1000, validation_share=0.0, block_samples=16)
    packed = tr.pack_blocks(rows, spec, "float64")
    assert [tuple(r) for r in packed.groupBy("fold_id").agg(F.sum("n"), F.sum("held")).orderBy("fold_id").collect()] == [(0, 60, 180), (1, 60, 180)]
    flat = {f: nets.initial_weights(net, f) for f in (0, 1)}
    got = tr.gradient_sums(packed.rdd, net, flat, "float64")
    for f in (0, 1):
        own = rows.filter(F.col("fold_id") == f).orderBy("symbol", "sample_id").collect()
        x, y, w = np.array([r.x for r in own]), np.array([r.target for r in own]), nets.unflatten(net, flat[f], "float64")
        want = np.concatenate([g.ravel() for g in net.gradient(w, x, y)])
        assert got[f].n_fit == 180 and np.allclose(got[f].gradient / 180, want, rtol=1e-9, atol=1e-12)
        times = np.random.default_rng(3).integers(1, 5, len(x))
        assert abs(net.loss(w, x, y, times) - net.loss(w, np.repeat(x, times, 0), np.repeat(y, times))) < 1e-12


@pytest.mark.parametrize("unit", [True, False])
def test_codes_are_pooled_where_they_are_made(spark, unit):
    """Only a mean for each symbol of a batch leaves it; codes left one by one."""
    net = nets.GruRegressor(GruSpec(max_lags=12, hidden=4, emb_dim=3))
    rows = samples(spark, 400).repartition(3)
    held = spark.createDataFrame([(f, nets.initial_weights(net, f).tolist()) for f in (0, 1)], "fold_id int, weights array<float>")
    want = wn.pool_codes(tr.encode_windows(rows, held, net), 5, unit)
    got = tr.encode_and_pool(rows.sortWithinPartitions("symbol"), held, net, 5, unit)
    found, told = ({(r.fold_id, r.symbol): r.embedding for r in df.collect()} for df in (got, want))
    assert found.keys() == told.keys() and len(told) == 40
    assert all(np.allclose(found[k], told[k], rtol=0, atol=1e-12) for k in told)
    assert tr.encode_and_pool(rows, held, net, 21, unit).count() == 0


def test_one_more_row_changes_little(spark):
    """No number of rows is a border at which training takes another way."""
    trainer = TrainerSpec(epochs=3, batch_size=32)
    def fit(n):
        rows = samples(spark, 241, 1).filter(F.col("sample_id") < n)
        return np.array(tr.fit_folds(rows, nets.Autoencoder(SPEC), trainer).first().weights)
    start = nets.initial_weights(nets.Autoencoder(SPEC), 0)
    fits = {n: fit(n) for n in (199, 200, 201, 239, 240, 241)}
    moved = np.linalg.norm(fits[200] - start)
    for n in (200, 201, 240, 241):
        assert np.linalg.norm(fits[n] - fits[n - 1]) < 0.35 * moved


def test_a_step_has_a_task_for_each_core(spark):
    """Small batches were cut in as many tasks as a shuffle, hundreds of times; large ones stay bounded by bytes."""
    cores = spark.sparkContext.defaultParallelism
    assert tr.step_partitions(spark, 1000) == cores
    assert tr.step_partitions(spark, 2 ** 40) >= 2 ** 15


def test_training_stops_and_returns_the_best(spark):
    run = tr.FoldRun(nets.TrainState(np.zeros(1, "float32")))
    spec = TrainerSpec(epochs=40, patience=2)
    for epoch, loss in enumerate([1.0, 0.5, 0.7, 0.6]):
        assert not run.over(spec) or epoch == 0
        run.state = nets.TrainState(np.full(1, epoch, "float32"))
        run.note(loss, spec)
    assert run.over(spec) and run.best[0] == 1 and run.best_epoch == 1


def test_codes_equal_direct_encoding(spark):
    rows = samples(spark, 60, 1)
    net = nets.Autoencoder(SPEC)
    weights = tr.fit_folds(rows, net, TrainerSpec(epochs=1))
    w = nets.unflatten(net, weights.first().weights)
    got = np.array(sorted(r.code for r in tr.encode_windows(rows, weights, net).collect()))
    want = net.codes(w, np.array([r.x for r in rows.collect()], dtype="float32"))
    assert np.allclose(got, np.array(sorted(want.tolist())), atol=1e-5)


def test_windows_are_encoded_where_they_are(spark):
    """Every symbol met its fold's weights in a row of its own, after a shuffle of all windows."""
    rows = samples(spark, 60)
    net = nets.Autoencoder(SPEC)
    size = sum(int(np.prod(s)) for s, _ in net.shapes())
    weights = spark.createDataFrame([(0, [0.01] * size)], "fold_id int, weights array<float>")
    codes = tr.encode_windows(rows, weights, net)
    assert "Exchange" not in codes._jdf.queryExecution().executedPlan().toString()
    assert codes.count() == 60 and codes.select("fold_id").distinct().count() == 1


def test_weights_cache_fits_only_missing_folds(spark, tmp_path):
    path, seen = str(tmp_path / "weights"), []

    def fit(df):
        seen.append(sorted(r.fold_id for r in df.select("fold_id").distinct().collect()))
        return tr.fit_folds(df, nets.Autoencoder(SPEC), TrainerSpec(epochs=1))

    rows = samples(spark, 40, 3)
    rs.fit_with_cache(rows.filter("fold_id < 2"), fit, path, "autoencoder", "k1")
    got = rs.fit_with_cache(rows, fit, path, "autoencoder", "k1")
    rs.fit_with_cache(rows, fit, path, "autoencoder", "k1")
    assert sorted(r.fold_id for r in got.collect()) == [0, 1, 2]
    rs.fit_with_cache(rows.filter("fold_id = 0"), fit, path, "autoencoder", "k2")
    assert seen == [[0, 1], [2], [0]]


def test_arms_write_their_weights_side_by_side(spark, tmp_path):
    rows, path = samples(spark, 40, 1), str(tmp_path / "weights")

    def one(arm, key):
        def fit(df): return tr.fit_folds(df, nets.Autoencoder(SPEC), TrainerSpec(epochs=0))
        return rs.fit_with_cache(rows, fit, path, arm, key).count()

    for key in range(10):
        assert side_by_side([partial(one, arm, str(key)) for arm in ("autoencoder", "gru")]) == [1, 1]
    assert spark.read.parquet(path).groupBy("arm").count().filter("count = 10").count() == 2


def test_sample_keys_follow_the_data_not_its_order(spark):
    rows = samples(spark, 30, 2)
    def keys(df): return {r.fold_id: r.sample_key for r in rs.keyed_by_samples(df).collect()}
    base = keys(rows)
    assert base == keys(rows.orderBy(F.rand(1)))
    moved = keys(rows.withColumn("target", F.when(F.col("fold_id") == 1, F.col("target") + 1e-9).otherwise(F.col("target"))))
    assert moved[0] == base[0] and moved[1] != base[1]


def test_one_changed_fold_refits_one_fold(spark, tmp_path):
    path, seen = str(tmp_path / "weights"), []

    def fit(df):
        seen.append(sorted(r.fold_id for r in df.select("fold_id").distinct().collect()))
        return df.groupBy("fold_id").agg(F.sum("target").alias("weight"))

    rows = samples(spark, 20, 3)
    changed = rows.withColumn("target", F.when(F.col("fold_id") == 2, F.lit(1.0)).otherwise(F.col("target")))
    first = {r.fold_id: r.weight for r in rs.fit_with_cache(rows, fit, path, "autoencoder", "k").collect()}
    second = {r.fold_id: r.weight for r in rs.fit_with_cache(changed, fit, path, "autoencoder", "k").collect()}
    third = {r.fold_id: r.weight for r in rs.fit_with_cache(rows, fit, path, "autoencoder", "k").collect()}
    assert seen == [[0, 1, 2], [2]]
    assert first == third and second == {**first, 2: 20.0}


def test_ar_fit_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    r = np.zeros(300)
    for i in range(2, 300):
        r[i] = 0.5 * r[i - 1] - 0.3 * r[i - 2] + rng.normal()
    gaps = r.copy()
    gaps[::17] = np.nan
    rows = [(0, "full", [float(v) for v in r]), (0, "gaps", [float(v) if v == v else None for v in gaps]),
            (0, "short", [float(v) for v in r[:44]]), (0, "just", [float(v) for v in r[:45]])]
    df = spark.createDataFrame(rows, "fold_id int, symbol string, ret array<double>")
    fits = {x.symbol: x for x in ar.ar_fits(df).collect()}
    assert fits["short"].coefs is None and len(fits["just"].coefs) == 15
    for name, series in (("full", r), ("gaps", gaps[np.isfinite(gaps)])):
        x = np.column_stack([series[15 - k:len(series) - k] for k in range(1, 16)])
        assert np.allclose(fits[name].coefs, np.linalg.lstsq(x, series[15:], rcond=None)[0])
        big = [k + 1 for k, c in enumerate(fits[name].coefs) if abs(c) >= 0.01]
        assert fits[name].lookback == max(big + [1])
    backs = {x.symbol: x.lookback for x in ar.lookbacks(ar.ar_fits(df)).collect()}
    assert backs["short"] == 5


def test_dependent_lags_have_no_coefficient(spark):
    """Where lags determine each other the fit is as close as any, and the later lag gets zero."""
    series = {"zero": [0.0] * 80, "flat": [0.25] * 80, "swing": [1.0, -1.0] * 40, "three": [1.0, 2.0, -3.0] * 30, "trend": [float(i) for i in range(70)]}
    rows = [(0, name, r) for name, r in series.items()]
    fits = {x.symbol: x for x in ar.ar_fits(spark.createDataFrame(rows, "fold_id int, symbol string, ret array<double>")).collect()}
    for name, r in series.items():
        x = np.column_stack([r[15 - k:len(r) - k] for k in range(1, 16)])
        coefs, best = np.array(fits[name].coefs), np.linalg.lstsq(x, r[15:], rcond=None)[0]
        assert np.allclose(x @ coefs, x @ best, atol=1e-6)
        assert np.all(coefs[np.linalg.matrix_rank(x):] == 0)
    assert fits["zero"].coefs == [0.0] * 15 and fits["zero"].lookback == 1
    assert np.allclose(fits["flat"].coefs, [1.0] + [0.0] * 14)


def test_lag_rows_are_sliced_without_a_shuffle(spark):
    rows = [(0, "gaps", 100, [None, 1.0, 2.0, None, 3.0, 4.0]), (0, "short", 100, [1.0, None, 2.0, None, None, None])]
    found = ar.lag_matrix(spark.createDataFrame(rows, "fold_id int, symbol string, lo bigint, ret array<double>"), 2)
    assert sorted(map(tuple, found.collect())) == [(0, "gaps", 104, 3.0, 2.0, 1.0), (0, "gaps", 105, 4.0, 3.0, 2.0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_sums_of_lags_are_computed_once(spark, sf_dir):
    """An inner explode of the sums was planned with a filter on their number, which computed them all again."""
    plan = vq.lag_products(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "size(aggregate(" not in plan and "isnotnull(aggregate(" not in plan


def test_fits_of_two_lags_are_computed_once(spark, sf_dir):
    """The filter on the fits was planned with the whole elimination, and again below it."""
    plan = vq.ar_fits_of_two_lags(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan


def test_a_row_that_another_determines_is_passed_over_by_the_elimination(spark):
    """Coefficients from given sums: a plain system, and one whose second lag is twice the first."""
    plain = [[9.0, 5.0, 4.0], [5.0, 4.0, 1.0], [4.0, 1.0, 3.0]]
    bound = [[9.0, 8.0, 16.0], [8.0, 4.0, 8.0], [16.0, 8.0, 16.0]]
    df = spark.createDataFrame([(0, plain), (1, bound)], "id int, products array<array<double>>")
    got = {r.id: r.c for r in df.select("id", ar.solved(F.col("products"), 2).alias("c")).collect()}
    assert np.allclose(got[0], [1.0, 1.0]) and got[1] == [2.0, 0.0]


def test_plan_of_fits_has_no_python(spark):
    df = spark.createDataFrame([(0, "a", [0.1] * 60)], "fold_id int, symbol string, ret array<double>")
    plan = ar.ar_fits(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lookback_strips_small_lags_from_the_end(spark):
    rows = [([0.5, 0.0, 0.2, 0.005, -0.009],), ([0.001, 0.002, 0.0],), ([0.0, -0.01, 0.0],)]
    df = spark.createDataFrame(rows, "coefs array<double>")
    got = [r[0] for r in df.select(ar.effective_lookback(F.col("coefs"), 0.01)).collect()]
    assert got == [3, 1, 2]


def test_embeddings_are_unit_vectors_and_gates_hold(spark, sf_dir):
    series = I.weekly_market(spark, sf_dir).train.series
    for vectors in (sl.autoencoder_embeddings(series, I.WEEKLY), sl.gru_embeddings(series, I.WEEKLY)):
        rows = vectors.collect()
        assert rows
        for r in rows:
            assert abs(np.linalg.norm(r.embedding) - 1) < 1e-6 or np.allclose(r.embedding, 0)
    few = wn.enough(wn.tumbling_windows(series, I.WEEKLY.autoencoder), 10 ** 6)
    assert few.count() == 0
    shut = replace(I.WEEKLY, autoencoder=replace(I.WEEKLY.autoencoder, min_samples=10 ** 6))
    market = I.weekly_market(spark, sf_dir)
    assert sl.autoencoder_selector(shut)(market.train).count() == 0

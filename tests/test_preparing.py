"""Imputers, scalers, encoders, splits, neighbours: properties and brute force."""

import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabsmith.operators import encode, features, impute, isolation, knn, roles, scale, split


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def test_split_sizes_are_exact_and_disjoint(spark):
    df = frame(spark, k=range(1000), y=["a"] * 700 + ["b"] * 299 + ["c"])
    train, val = split.train_val_split(df, ["k"], "y")
    sizes = {r["y"]: r["count"] for r in val.groupBy("y").count().collect()}
    assert sizes == {"a": 140, "b": 60, "c": 1}
    assert train.count() + val.count() == 1000 and train.join(val, "k").count() == 0


def test_folds_cover_each_row_once(spark):
    df = frame(spark, k=range(103), y=["a"] * 90 + ["b"] * 13)
    got = split.assign_folds(df, split.hash_order(["k"]), 5, "y").groupBy("y", "fold").count().collect()
    assert sorted(r["count"] for r in got if r["y"] == "b") == [2, 2, 3, 3, 3]
    assert {r["count"] for r in got if r["y"] == "a"} == {18}


@pytest.mark.parametrize("gaps", [False, True])
def test_knn_equals_brute_force(spark, gaps):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    x[:130] = x[0]  # one vector holds a third of the rows
    if gaps:
        x[rng.random(x.shape) < 0.15] = np.nan
        x[np.isnan(x).all(axis=1)] = 0.0
    rows = [(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {}
    for r in knn.knn_join(df, df, 4, exclude_self=True, cell_rows=32, query_rows=50).collect():
        got.setdefault(r["q_id"], {})[r["rank"]] = (r["d_id"], r["distance"])
    dist = knn.block_distances(x, x)
    np.fill_diagonal(dist, np.nan)
    for q in range(len(x)):
        ok = np.flatnonzero(~np.isnan(dist[q]))
        best = ok[np.lexsort((ok, dist[q][ok]))][:4]
        assert [got[q][i + 1][1] for i in range(len(best))] == pytest.approx(dist[q][best].tolist(), abs=1e-12)


def test_knn_fill_uses_the_nearest(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.1, 3.0), (9.0, 50.0), (0.05, None)], "a double, b double")
    got = impute.KnnFill.of(["a", "b"], k=2).fit(df).transform(df).where("a = 0.05").first()
    assert got["b"] == pytest.approx(2.0)


def test_chained_fill_recovers_a_linear_column(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=300)
    b = 2 * a + 1
    b[::5] = np.nan
    df = frame(spark, a=a, b=b)
    out = impute.ChainedFill.of(["a", "b"], rounds=3).fit(df).transform(df).toPandas()
    assert np.allclose(out["b"], 2 * out["a"] + 1, atol=1e-3)


def test_constant_columns_scale_to_zero(spark):
    df = frame(spark, c=[5.0, 5.0, 5.0])
    for kind in ("standard", "minmax", "robust"):
        assert scale.scaler(kind, ["c"]).fit(df).transform(df).first()["c"] == 0.0


def test_normal_quantile(spark):
    p = [1e-6, 0.001, 0.02, 0.3, 0.5, 0.8, 0.99, 0.999999]
    got = frame(spark, p=p).select(scale.normal_quantile(F.col("p"))).collect()
    assert [r[0] for r in got] == pytest.approx([statistics.NormalDist().inv_cdf(v) for v in p], abs=1e-7)


def test_quantile_scale_is_monotone_and_normal(spark):
    x = np.random.default_rng(1).exponential(size=2000)
    df = frame(spark, x=x, raw=x)
    out = scale.QuantileScale.of(["x"], levels=100).fit(df).transform(df).toPandas().sort_values("raw")
    assert (np.diff(out["x"]) >= -1e-9).all() and abs(out["x"].median()) < 0.05 and abs(out["x"].std() - 1) < 0.1


def test_yeo_johnson_finds_the_log(spark):
    x = np.expm1(np.random.default_rng(3).normal(2.0, 0.4, 3000))
    assert scale.fit_yeo_johnson(frame(spark, x=x), ["x"])["x"] == pytest.approx(0.0, abs=0.15)


def test_unseen_categories(spark):
    df, new = frame(spark, c=["a", "b", "b"], y=[1.0, 0.0, 1.0]), frame(spark, c=["zzz"])
    assert encode.OrdinalEncode.of(["c"]).fit(df).transform(new).first()["c"] == -1.0
    assert encode.FrequencyEncode.of(["c"]).fit(df).transform(new).first()["c"] == 0.0
    assert list(encode.OneHotEncode.of(["c"]).fit(df).transform(new).first()) == [0.0, 0.0]
    assert encode.TargetEncode.of(["c"], target="y").fit(df).transform(new).first()["c"] == pytest.approx(2 / 3)


def test_table_encoder_equals_inline(spark, monkeypatch, tmp_path):
    df = frame(spark, k=range(50), c=[f"v{i % 13}" for i in range(50)])
    want = encode.FrequencyEncode.of(["c"]).fit(df).transform(df).toPandas().sort_values("k")["c"].tolist()
    monkeypatch.setattr(encode, "INLINE_CATEGORIES", 3)
    model = encode.FrequencyEncode.of(["c"]).fit(df)
    assert isinstance(model, encode.CodeTableModel)
    assert model.transform(df).toPandas().sort_values("k")["c"].tolist() == want
    PipelineModel([model]).save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    assert back.transform(df).toPandas().sort_values("k")["c"].tolist() == want


def test_label_round_trip(spark):
    df = frame(spark, y=["cat", "dog", "cat", "bird"])
    m = encode.LabelEncode.of(["y"]).fit(df)
    assert m.classes == ["bird", "cat", "dog"]
    assert m.transform(df).where(m.decode(F.col("label")) != F.col("y")).count() == 0


def test_many_rare_categories_share_a_column(spark):
    df = frame(spark, c=[f"v{i:02d}" for i in range(60)] + ["v00"] * 5)
    out = encode.OneHotEncode.of(["c"], limit=10).fit(df).transform(df)
    assert len(out.columns) == 10 and out.agg(F.sum("c=(rare)")).first()[0] == 51.0


def test_isolation_forest_finds_the_outliers(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(size=(190, 2)), rng.normal(20, 5, size=(10, 2))]
    df = frame(spark, i=range(200), a=x[:, 0], b=x[:, 1])
    out = isolation.mark_outliers(df, ["a", "b"], 0.05, trees=30).toPandas()
    assert out["is_outlier"].sum() == 10 and out[out["is_outlier"]]["i"].min() >= 190


def test_roles(spark):
    n = 120
    df = frame(spark, uid=np.random.default_rng(0).permutation(n), name=["x"] * n, txt=[f"t{i}" for i in range(n)],
               cat=["a", "b"] * 60, many=[f"m{i % 60}" for i in range(n)], day=["2024-01-05"] * n, num=np.arange(n) / 7.0, y=[0, 1] * 60)
    assert dict(roles.detect_id_columns(df, "y")) == {"uid": "dense_key", "name": "name", "txt": "near_unique"}
    r = roles.split_columns(df, "y", ["uid", "name", "txt"])
    assert (r.numeric, r.low_card, r.high_card, r.date) == (["num"], ["cat"], ["many"], ["day"])
    assert roles.detect_problem_type(df, "y") == "classification" and roles.detect_problem_type(df, "num") == "regression"


def test_engineered_names_are_not_repeated(spark):
    df = frame(spark, a=[1.0, 2.0], b=[0.0, 4.0])
    once, names = features.engineer_features(df, None, "ratios")
    assert names == ["a_div_b"] and once.collect()[0]["a_div_b"] is None
    assert features.engineer_features(once, None, "ratios", ["a", "b"])[1] == []
    with pytest.raises(ValueError):
        features.engineer_features(df, None, "magic")

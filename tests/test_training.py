"""The model's gradient, its training and its scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.plans import training

KEY = ["year", "round"]


def race_rows(spark, n_races=8, n=10):
    rng = np.random.default_rng(0)
    rows = []
    for r in range(n_races):
        pace, junk = rng.normal(size=n), rng.normal(size=n)
        order = np.argsort(-(pace + 0.1 * rng.normal(size=n)))
        for place, i in enumerate(order):
            out = bool(pace[i] < -1.2)
            rows.append((2025, r, f"D{i}", float(pace[i]), float(junk[i]), None if out else float(place + 1), int(out)))
    return spark.createDataFrame(rows, "year int, round int, driver string, pace double, junk double, finish_position double, outcome_id int")


@pytest.mark.parametrize("kind", [training.RankModel, training.GatedModel])
def test_gradient_equals_differences(kind):
    rng = np.random.default_rng(1)
    model = kind(["a", "b", "c"], hidden=4)
    x, pos, out = rng.normal(size=(6, 3)), np.array([3, 1, np.nan, 2, 4, np.nan]), np.array([0, 0, 1, 0, 0, 2])
    loss, grads = training.race_gradient(model, x, pos, out, 1.5, np.array([1.0, 2.0, 3.0]))
    for name, w in model.weights.items():
        flat = w.reshape(-1)
        for i in range(flat.size):
            kept, e = flat[i], 1e-6
            flat[i] = kept + e
            up = training.race_gradient(model, x, pos, out, 1.5, np.array([1.0, 2.0, 3.0]))[0]
            flat[i] = kept
            assert (up - loss) / e == pytest.approx(grads[name].reshape(-1)[i], abs=1e-4)


def test_training_ranks_by_pace(spark):
    rows = race_rows(spark)
    model, losses = training.train(rows, ["pace", "junk"], KEY, epochs=12, step=0.08, hidden=6)
    assert losses[-1] < 0.8 * losses[0]
    scored = training.score(rows, model, KEY)
    one = scored.groupBy(*KEY).agg(F.sum("p_win").alias("p"), F.corr("rank_score", "pace").alias("c")).collect()
    assert all(r.p == pytest.approx(1.0) and r.c > 0.8 for r in one)
    drops = {r.feature: r.d for r in training.importance(rows, model, KEY, "driver").groupBy("feature").agg(F.avg(F.abs("drop")).alias("d")).collect()}
    assert drops["pace"] > 2 * drops["junk"]
    table = training.simulate(scored, KEY, "driver").collect()
    assert len(table) == 10 and sum(r.points for r in table) <= 8 * 101 and sorted(r.rank for r in table) == list(range(1, 11))


def test_a_gated_model_trains_and_scores_as_numpy_does(spark, tmp_path):
    from paddock.plans import artifacts

    rows = race_rows(spark)
    model, losses = training.train(rows, ["pace", "junk"], KEY, epochs=10, step=0.08, hidden=4, kind=training.GatedModel)
    assert losses[-1] < 0.85 * losses[0]
    artifacts.save(spark, model, str(tmp_path / "g"))
    model = artifacts.load(spark, str(tmp_path / "g"))
    scored = training.score(rows, model, KEY).toPandas()
    assert np.allclose(scored.rank_score, model.forward(scored[["pace", "junk"]].to_numpy(float))[1])


def test_models_are_stored_with_their_features(spark, tmp_path):
    from paddock.plans import artifacts

    model = training.RankModel(["a", "b"], hidden=3)
    artifacts.save(spark, model, str(tmp_path / "m"), {"spearman": 0.5})
    artifacts.save(spark, training.RankModel(["a", "z"], hidden=3), str(tmp_path / "n"))
    back = artifacts.first_usable(spark, [str(tmp_path / "n"), str(tmp_path / "m")], ["a", "b", "c"])
    assert back.features == ["a", "b"] and all((back.weights[k] == v).all() for k, v in model.weights.items())
    with pytest.raises(ValueError):
        artifacts.load(spark, str(tmp_path / "n"), ["a"])


def test_parameters():
    from paddock.functions import params

    assert params.number_list("1, 2,5-8,2") == [1, 2, 5, 6, 7, 8] and params.pairs("VER=1,NOR=2.5") == {"VER": 1.0, "NOR": 2.5} and params.name_list(" a,,b ") == ["a", "b"]


def test_gradient_of_layers_with_dropout_equals_differences():
    rng = np.random.default_rng(1)
    model = training.DeepModel(["a", "b", "c"], layers=(5, 4), dropout=0.3, epoch=3)
    x, pos, out = rng.normal(size=(6, 3)), np.array([3, 1, np.nan, 2, 4, np.nan]), np.array([0, 0, 1, 0, 0, 2])
    one = np.array([1.0, 2.0, 3.0])
    loss, grads = training.race_gradient(model, x, pos, out, 1.5, one)
    for name, w in model.weights.items():
        flat = w.reshape(-1)
        for i in range(flat.size):
            kept, e = flat[i], 1e-6
            flat[i] = kept + e
            up = training.race_gradient(model, x, pos, out, 1.5, one)[0]
            flat[i] = kept
            assert (up - loss) / e == pytest.approx(grads[name].reshape(-1)[i], abs=1e-4)
    masks = model._masks(x)
    assert all(set(np.unique(m)) == {0.0, 1 / 0.7} for m in masks) and training.DeepModel(["a"], layers=(3,))._masks(x[:, :1]) == [1.0]


def test_the_best_epoch_of_the_validation_is_kept(spark, tmp_path):
    from paddock.plans import artifacts

    rows = race_rows(spark, 9)
    train, held = rows.filter("round < 6"), rows.filter("round >= 6")
    fitted = training.fit(train, ["pace", "junk"], KEY, held, "driver", epochs=8, step=0.05, kind=training.DeepModel, layers=(8, 6), dropout=0.1)
    totals = [m["spearman"] + m["macro_f1"] for m in fitted.metrics]
    assert fitted.best == 1 + int(np.argmax(totals)) and len(fitted.losses) == 8 and fitted.metrics[fitted.best - 1]["spearman"] > fitted.metrics[0]["spearman"]
    again = training.evaluate(held, fitted.model, KEY, "driver")
    assert again["spearman"] == pytest.approx(fitted.metrics[fitted.best - 1]["spearman"])
    scored = training.score(held, fitted.model, KEY).toPandas()
    assert np.allclose(scored.rank_score, fitted.model.forward(scored[["pace", "junk"]].to_numpy(float))[1])
    artifacts.save(spark, fitted.model, str(tmp_path / "deep"), again, [{"feature": "pace", "mean": 0.0, "std": 1.0}])
    back = artifacts.load(spark, str(tmp_path / "deep"))
    assert isinstance(back, training.DeepModel) and back.layers == (8, 6) and all((back.weights[k] == v).all() for k, v in fitted.model.weights.items())
    assert artifacts.told(spark, str(tmp_path / "deep"))["scaler"][0]["feature"] == "pace"
    stopped = training.fit(train, ["junk"], KEY, held, "driver", patience=1, epochs=8, step=0.0, hidden=2)
    assert len(stopped.losses) == 2 and stopped.best == 1

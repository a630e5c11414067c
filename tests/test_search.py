"""Model-based search: seeded, resumable, halving, better than random draws."""

import json
import warnings

import numpy as np
import pytest

from tabsmith.functions.space import Choice, Real, Whole, draw
from tabsmith.plans import parzen

SPACE = {"rate": Real(1e-4, 1.0, log=True), "depth": Whole(2, 30), "leaves": Whole(8, 512, log=True), "kind": Choice(("a", "b", ("c", 1)))}
PLANE = {"x": Real(-5.0, 10.0), "y": Real(0.0, 15.0)}


def mixed(p):
    return -((np.log10(p["rate"]) + 2.5) ** 2 + ((p["depth"] - 17) / 7) ** 2 + np.log(p["leaves"] / 60) ** 2 + {"a": 1.0, "b": 0.5}.get(p["kind"], 0.0))


def branin(p):
    x, y = p["x"], p["y"]
    return -((y - 5.1 / (4 * np.pi**2) * x * x + 5 / np.pi * x - 6) ** 2 + 10 * (1 - 1 / (8 * np.pi)) * np.cos(x) + 10)


def best_of(objective, space, trials, seed):
    table = parzen.search(lambda p, folds: [objective(p) for _ in folds], space, trials, seed=seed)
    return parzen.best(table).value


@pytest.mark.parametrize("objective, space", [(mixed, SPACE), (branin, PLANE)])
def test_better_than_random_draws(objective, space):
    ours, theirs = [], []
    for seed in range(12):
        ours.append(best_of(objective, space, 60, seed))
        rng = np.random.default_rng(1000 + seed)
        theirs.append(max(objective(draw(space, rng)) for _ in range(60)))
    assert np.mean(ours) > np.mean(theirs) and sum(a > b for a, b in zip(ours, theirs)) >= 8


def test_values_stay_in_their_ranges():
    rng = np.random.default_rng(3)
    tried = [(draw(SPACE, rng), float(i % 7)) for i in range(40)]
    for i in range(60):
        p = parzen.suggest(SPACE, tried, np.random.default_rng(i))
        assert 1e-4 <= p["rate"] <= 1.0 and isinstance(p["depth"], int) and 2 <= p["depth"] <= 30
        assert isinstance(p["leaves"], int) and 8 <= p["leaves"] <= 512 and p["kind"] in SPACE["kind"].options
    assert {Whole(50, 220, step=50).value(x) for x in np.linspace(0, 400, 200)} == {50, 100, 150, 200}


def test_densities_sum_to_one():
    at, wide = np.array([0.3, 2.0]), np.array([0.5, 4.0])
    d = Whole(0, 9)
    assert abs(np.exp(d.log_density(np.arange(10.0), at, wide)).sum() - 1) < 1e-9
    r, x = Real(0.0, 3.0), np.linspace(0, 3, 20001)
    assert abs(np.exp(r.log_density(x, at, wide)).mean() * 3 - 1) < 1e-3
    w = Whole(1, 64, log=True)
    assert abs(np.exp(w.log_density(np.log(np.arange(1.0, 65.0)), np.array([1.0, 3.0]), np.array([0.7, 5.0]))).sum() - 1) < 1e-9


def test_same_seed_same_trials_and_taken_up_again(spark, tmp_path):
    def run(path, trials):
        return parzen.search(lambda p, folds: [mixed(p) + 0.01 * f for f in folds], SPACE, trials, 4, parzen.TrialTable(spark, path), seed=9)
    path = str(tmp_path / "trials")
    run(path, 6)
    run(path, 14)
    again = run(path, 20)
    whole = run(None, 20)
    assert len(again.trials) == 20
    for a, b in zip(again.trials, whole.trials):
        assert json.loads(json.dumps(a.params)) == json.loads(json.dumps(b.params)) and np.allclose(a.folds, b.folds) and a.state == b.state
    rows = spark.read.parquet(path).orderBy("trial").collect()
    assert [r["trial"] for r in rows] == list(range(20)) and {r["state"] for r in rows} == {"complete", "stopped"}
    assert all(len(r["folds"]) == 4 for r in rows if r["state"] == "complete") and any(len(r["folds"]) == 1 for r in rows)


def test_halving_keeps_the_best_third():
    asked = []
    table = parzen.search(lambda p, folds: asked.extend(folds) or [p["x"]] * len(folds), {"x": Real(0.0, 1.0)}, 40, 8, seed=2)
    assert parzen.rungs(8) == [1, 4, 8] and parzen.rungs(1) == [1] and parzen.rungs(3) == [1, 2, 3]
    assert len(asked) < 40 * 8 * 0.6
    top = max(t.params["x"] for t in table.trials)
    assert parzen.best(table).params["x"] == top


def test_a_failing_trial_does_not_end_the_search():
    def objective(p, folds):
        if p["x"] > 0.5:
            raise RuntimeError("no memory")
        return [p["x"]] * len(folds)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        table = parzen.search(objective, {"x": Real(0.0, 1.0)}, 25, seed=1)
    states = [t.state for t in table.trials]
    assert len(states) == 25 and states.count("failed") == len(said) > 0 and parzen.best(table).value <= 0.5
    assert parzen.best(parzen.search(lambda p, f: 1 / 0, {"x": Real(0.0, 1.0)}, 0)) is None

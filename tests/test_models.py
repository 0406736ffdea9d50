"""Models and samples on small panels whose answer is known."""

import datetime as dt

import numpy as np
import pytest

from tesserae.operators import evaluate, models

D0 = dt.date(2025, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """A feature that tells the label, one that tells the era, and one that tells nothing."""
    rng = np.random.default_rng(0)
    out = []
    for d in range(120):
        for t in range(20):
            x, noise = rng.normal(), rng.normal()
            up = int(x + 0.3 * rng.normal() > 0)
            out.append((f"T{t}", D0 + dt.timedelta(days=d), float(x), float(noise), float(d >= 60) + 0.1 * float(rng.normal()), up, 0.01 if up else -0.01, int(d >= 60)))
    return spark.createDataFrame(out, "ticker string, date date, x double, noise double, shift double, up int, ret double, era int")


def test_adversarial_validation_names_what_tells_eras_apart(rows):
    out = {r.feature: r for r in models.adversarial(rows, "era", ["x", "noise", "shift"], ["ticker", "date"]).collect()}
    assert out["shift"].importance > 0.9 and out["x"].auc > 0.95


def test_walk_forward_and_decay(rows):
    steps = [(r.anchor, r.next_month) for r in evaluate.anchors(rows, "date", "2025-02").orderBy("month").collect()]
    assert [m for _, m in steps] == ["2025-03", "2025-04"]
    out = models.decay(models.walk_forward(rows, ["x", "noise"], "up", "ret", "date", steps, lambda df, a: evaluate.training_rows(df, "date", a, "recent_30")), 0.02).collect()
    assert len(out) == 2 and all(r.auc > 0.9 and r.top_ret > r.base_ret and abs(r.decay_pct) < 40 for r in out)
    with pytest.raises(ValueError):
        evaluate.training_rows(rows, "date", D0, "weekly")


def test_search_and_early_stop(rows):
    found = models.search(rows, ["x", "noise"], "up", "date", [{"trees": 1, "depth": 1}, {"trees": 4, "depth": 3}])
    assert found[0][0] >= found[1][0] > 0.5
    out = models.boosted_scores(rows, rows, ["x", "noise"], "up", trees=5, time="date")
    assert out.count() == rows.count() and "_late" not in out.columns


def test_hash_split_and_draws(spark, rows):
    a = models.split_by_hash(rows, ["ticker", "date"], 3)
    b = models.split_by_hash(rows.repartition(7), ["ticker", "date"], 3)
    assert a.exceptAll(b).count() == 0 and 0.65 < a.where("part = 'train'").count() / rows.count() < 0.75
    groups = spark.createDataFrame([(f"T{t}", f"G{t % 4}") for t in range(20)], "ticker string, g string")
    out = {r.kind: r for r in models.portfolio_draws(rows, "ticker", "date", "ret", groups, "g", sims=20, picks=4).collect()}
    assert set(out) == {"random", "one group", "diversified"} and all(r.sims == 20 and r.p05 <= r.mean_vol <= r.p95 for r in out.values())
    again = {r.kind: r for r in models.portfolio_draws(rows.repartition(5), "ticker", "date", "ret", groups, "g", sims=20, picks=4).collect()}
    assert all(abs(out[k].mean_vol - again[k].mean_vol) < 1e-12 for k in out)


def test_balanced_sample_is_that_of_the_whole_order(spark):
    rows = [(i, [None, "a", "a", "a", "b"][i % 5]) for i in range(3000)] + [(9000 + i, "few") for i in range(5)]
    df = spark.createDataFrame(rows, "id bigint, g string")
    got = models.balanced_sample(df, "g", 40, 3, ["id"]).toPandas()
    order = df.selectExpr("id", "g", "xxhash64(3, id) AS h").toPandas().sort_values(["h", "id"])
    want = order.groupby(order.g.fillna("?")).head(40)
    assert set(got.id) == set(want.id) and len(got) == 40 * 3 + 5

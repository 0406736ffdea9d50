"""Queries that must take every row of their tables, not a part of them."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E


@pytest.fixture(scope="module")
def stored(small):
    return lambda name: pd.read_parquet(f"{small}/{name}.parquet")


def test_bars_get_the_index_of_their_own_day(spark, small, stored):
    r = stored("rfpredictions")
    own = r[r.vix_close > 0].groupby(r.date.astype(str)).vix_close.max()
    out = E.queries()["join_asof_index"](spark, small).toPandas()
    out = out[out.day.isin(own.index)]
    assert out.day.nunique() > 40 and (out.vix.to_numpy() == own[out.day].to_numpy()).all()


def test_every_model_is_joined(spark, small, stored):
    r = stored("rfpredictions").dropna(subset=["date", "raw_score"])
    out = E.queries()["join_asof_by_ticker"](spark, small)
    got = {tuple(x) for x in out.select("ticker", "model_tag").distinct().collect()}
    barred = {x[0] for x in out.select("ticker").distinct().collect()}
    assert got == {(t, m) for t, m in zip(r.ticker, r.model_tag) if t in barred} and len({m for _, m in got}) > 1


def test_no_known_close_is_taken_out(spark, small, stored):
    p = stored("pricedata").dropna(subset=["date"])
    good = p[(p.close > 0) & (p.close < 500000)].sort_values("bar_id").groupby(["ticker", "date"]).close.last()
    out = E.queries()["hygiene_interpolate"](spark, small).toPandas()
    got = out.set_index(["ticker", "day"])
    assert len(out) == len(p[["ticker", "date"]].drop_duplicates())
    known = got.loc[[(t, str(day)[:10]) for t, day in good.index]]
    assert not known.filled.any() and (abs(known.x.to_numpy() - good.to_numpy()) < 1e-3).all()


def test_calibration_is_fitted_on_all_rows(spark, tmp_path):
    rows = [(2 * i + 1, (i % 10 + 0.5) / 10, 1 if (i * 7) % 10 <= i % 10 else 0) for i in range(200)]
    spark.createDataFrame(rows, "pred_id bigint, upprobability double, upprediction int").write.parquet(f"{tmp_path}/rfpredictions.parquet")
    out = E.queries()["model_calibrated"](spark, str(tmp_path))
    assert out.count() == 200 and out.where(F.col("calibrated").isNull()).count() == 0
    assert abs(out.agg(F.avg("calibrated")).first()[0] - sum(r[2] for r in rows) / 200) < 1e-3

"""Problems 1, 3, 4 and 5 on small tables, with awkward input."""

import datetime as dt
import math
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserae.operators import fill, rolling, spikes
from tesserae.streaming.compact import Compactor, compact

BAR = "bar_id bigint, date date, ticker string, open double, high double, low double, close double, volume double, extra string"
D0 = dt.date(2025, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, BAR)


def series(ticker, n, start, level, seed, vol=0.01):
    rng = np.random.default_rng(seed)
    x = level * np.exp(np.cumsum(rng.normal(0, vol, n)))
    v = np.round(1e5 * np.exp(rng.normal(0, 0.3, n)))
    return [(start + i, D0 + dt.timedelta(days=i), ticker, float(round(c, 4)), float(round(c * 1.01, 4)), float(round(c * 0.99, 4)), float(round(c, 4)), float(w), "x") for i, (c, w) in enumerate(zip(x, v))]


def put(rows, i, **new):
    names = [c.split()[0] for c in BAR.split(", ")]
    r = list(rows[i])
    for k, v in new.items():
        r[names.index(k)] = v
    rows[i] = tuple(r)


def test_fill_marks_and_fills(spark):
    rows = series("A", 60, 0, 10, 1) + series("B", 60, 100, 200, 2) + series("C", 60, 200, 3, 3)
    truth = {i: rows[i][6] for i in (5, 70, 130)}
    put(rows, 5, close=None)
    put(rows, 70, close=float("nan"))
    put(rows, 130, close=-999.0)
    put(rows, 20, volume=float("inf"), close=999999.0)
    put(rows, 30, volume=0.0)
    rows += [(900, None, "A", 1.0, 1.0, 1.0, None, None, None), (901, D0, None, 1.0, 1.0, 1.0, None, 5.0, None), rows[5]]
    df = frame(spark, rows).withColumn("close_filled", F.lit("clash"))
    out = fill.fill_numeric(df).toPandas()
    assert len(out) == len(rows) and out["close"].notna().all() and np.isfinite(out["close"]).all()
    got = out.drop_duplicates("bar_id").set_index("bar_id")
    for i, want in truth.items():
        key = rows[i][0]
        assert got.close_filled[key] and abs(math.log(got.close[key] / want)) < 0.15
    assert not got.volume_filled[rows[30][0]] and got.volume_filled[rows[20][0]]
    cells = {tuple(r) for r in fill.missing_cells(frame(spark, rows)).collect()}
    assert {(5, "close"), (110, "close"), (210, "close"), (20, "close"), (20, "volume"), (900, "volume"), (901, "close")} == cells - {(900, "close")}


def test_fill_beats_the_group_mean(spark):
    rows = [r for k, t in enumerate("ABCDEFGH") for r in series(t, 120, 1000 * k, 5 * (k + 1), k, 0.03)]
    df = frame(spark, rows)
    hidden = df.withColumns({"truth": F.col("close"), "close": F.when(F.col("bar_id") % 9 == 4, None).otherwise(F.col("close"))})
    out = fill.fill_numeric(hidden).where("close_filled").toPandas()
    mean = {t: np.mean([math.log(r[6]) for r in rows if r[2] == t]) for t in "ABCDEFGH"}
    err = np.abs(np.log(out.close / out.truth)).mean()
    naive = np.mean([abs(mean[t] - math.log(x)) for t, x in zip(out.ticker, out.truth)])
    assert err < 0.5 * naive


def test_variance_components_are_those_of_the_model(spark):
    """Simulated groups of very different sizes: the moments find the spreads that made them, sampling error aside."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(400):
        level = rng.normal(0, 1.0)
        for b in range(int(rng.integers(1, 9))):
            local = rng.normal(0, 0.4)
            rows += [(f"g{g}", b, float(5 + level + local + e)) for e in rng.normal(0, 0.8, int(rng.integers(1, 6)))]
    df = spark.createDataFrame(rows, "g string, _block int, y double")
    cells = df.groupBy("g", "_block").agg(F.count("y").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") ** 2).alias("q"))
    square = F.col("s") ** 2 / F.col("n")
    groups = cells.groupBy("g").agg(F.sum("n").alias("_N_x"), F.sum("s").alias("_S_x"), F.count(F.lit(1)).alias("_B_x"), F.sum(F.col("n") ** 2).alias("_Q_x"), F.sum(F.col("q") - square).alias("_W_x"), (F.sum(square) - F.sum("s") ** 2 / F.sum("n")).alias("_C_x"))
    mu, ve, vl, vg = fill.solved(groups.agg(*fill.components(groups, "x")).first().asDict(), "x")
    assert abs(mu - 5) < 0.2 and abs(ve - 0.64) < 0.06 and abs(vl - 0.16) < 0.07 and abs(vg - 1.0) < 0.25


def test_small_groups_are_shrunk(spark):
    """Groups of one level and much noise: a group of one reading far off is filled near the level, a group of many near
    its own mean."""
    rng = np.random.default_rng(6)
    rows = []
    for k, t in enumerate("ABCDEFGH"):
        rows += [(1000 * k + i, D0 + dt.timedelta(days=i), t, 1.0, 1.0, 1.0, float(10 * np.exp(rng.normal(0, 0.4))), 5.0, "x") for i in range(80)]
    rows += [(9000, D0, "Z", 1.0, 1.0, 1.0, 40.0, 5.0, "x"), (9001, D0 + dt.timedelta(days=1), "Z", 1.0, 1.0, 1.0, None, 5.0, "x")]
    out = fill.fill_numeric(frame(spark, rows)).where("bar_id = 9001").collect()[0]
    assert out.close_filled and 8 < out.close < 18


def test_fill_of_nothing(spark):
    assert fill.fill_numeric(frame(spark, [])).count() == 0
    allnull = frame(spark, [(1, D0, "A", None, None, None, None, None, None)])
    assert fill.fill_numeric(allnull).select("close", "close_filled").collect()[0] == (None, True)


def test_fill_categorical(spark):
    rows = [("A", 1, "x"), ("A", 2, "x"), ("A", 3, None), ("B", 1, "y"), ("B", 2, "-"), ("C", 2, ""), ("D", 1, "x"), (None, 1, None)]
    out = fill.fill_categorical(spark.createDataFrame(rows, "g string, t int, c string"), "c", "g", "t").collect()
    got = {(r.g, r.t): (r.c, r.c_filled) for r in out}
    assert got["A", 3] == ("x", True) and got["B", 2] == ("y", True) and got["C", 2][1] and got["C", 2][0] in "xy" and got["A", 1] == ("x", False)
    assert got[None, 1][1]


PRED = "pred_id bigint, date date, upprobability double, ticker string, file_id bigint"


def preds(spark, rows):
    return spark.createDataFrame(rows, PRED)


def test_compaction_is_exact_and_restarts(spark, tmp_path):
    nan = float("nan")
    rows = [(i, D0, [0.1, 0.2, nan, None][i % 4], f"T{i % 3}", i // 5) for i in range(60)]
    rows += [(None, D0, 0.9, "Z", 1), (100, None, None, None, 2)]
    src = tmp_path / "in"
    for k in range(0, 40, 5):
        preds(spark, rows[k : k + 5]).coalesce(1).write.mode("append").parquet(str(src))
    preds(spark, []).coalesce(1).write.mode("append").parquet(str(src))
    work = f"file://{tmp_path}/work"
    c = Compactor(spark, str(src), work, files_per_batch=3).ingest()
    c.merge()
    first = c.staged.count()
    for k in range(40, len(rows), 5):
        preds(spark, rows[k : k + 5]).coalesce(1).write.mode("append").parquet(str(src))
    c = Compactor(spark, str(src), work, files_per_batch=3).ingest()  # a new process goes on
    merged = c.merge()
    assert first == 40 and c.staged.count() == len(rows)

    def code(r):
        return (r[1], "nan" if isinstance(r[2], float) and math.isnan(r[2]) else r[2], r[3])

    least = {}
    for r in rows:
        if code(r) not in least or (r[0] is not None and (least[code(r)] is None or r[0] < least[code(r)])):
            least[code(r)] = r[0]
    out = merged.collect()
    assert sorted(map(str, (code((r.pred_id, r.date, r.upprobability, r.ticker)) for r in out))) == sorted(map(str, least))
    assert {r.pred_id for r in c.surplus().collect()} == {r[0] for r in rows if r[0] is not None} - set(least.values())
    assert len(list((tmp_path / "work/merged").glob("*/part-*"))) == 2  # a file a generation, the last and the one before
    assert c.merge().count() == merged.count() and len(list((tmp_path / "work/merged").glob("*"))) == 2  # nothing new


def test_compaction_of_thousands_of_files(spark, tmp_path):
    """Two thousand files, a batch lost half-way, a merge that fails: readers see the last whole set throughout."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "in").mkdir()
    rows = [(i, (i * 7) % 900, f"T{(i * 7) % 11}", i // 3) for i in range(6000)]
    for k in range(2000):
        part = rows[3 * k : 3 * k + 3]
        pq.write_table(pa.table({"pred_id": [r[0] for r in part], "upprobability": [r[1] / 900 for r in part], "ticker": [r[2] for r in part], "file_id": [r[3] for r in part]}), tmp_path / "in" / f"{k:05d}.parquet")
    lost = []

    class Losing(Compactor):
        def _write(self, batch, batch_id):
            if batch_id == 2 and not lost:
                lost.append(batch_id)
                batch.limit(5).write.mode("overwrite").parquet(f"{self.work}/stage/batch={batch_id:09d}")
                raise RuntimeError("executor lost")
            super()._write(batch, batch_id)

    make = lambda: Losing(spark, str(tmp_path / "in"), f"file://{tmp_path}/w", sort=("upprobability",), files_per_batch=500, least_bytes=20_000)
    with pytest.raises(Exception):
        make().ingest()
    assert lost
    c = make().ingest()
    want = len({r[1:3] for r in rows})
    assert c.staged.count() == 6000 and c.merge().count() == want
    files = list((tmp_path / "w/merged").glob("*/part-*"))
    assert 2 <= len(files) <= 8
    pq.write_table(pa.table({"pred_id": [9000, 9001], "upprobability": [5.0, 0.0], "ticker": ["new", "T0"], "file_id": [1, 1]}), tmp_path / "in" / "late.parquet")
    c = make().ingest()
    whole = c.distinct
    c.distinct = lambda: whole().withColumn("upprobability", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception):
        c.merge()
    assert make().merged.count() == want
    assert make().merge().count() == want + 1
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_compaction_retry_replaces(spark, tmp_path):
    preds(spark, [(1, D0, 0.5, "A", 1), (2, D0, 0.5, "A", 2)]).write.parquet(str(tmp_path / "in"))

    class Failing(Compactor):
        def _write(self, batch, batch_id):
            super()._write(batch, batch_id)
            raise RuntimeError("lost after the write")

    with pytest.raises(Exception):
        Failing(spark, str(tmp_path / "in"), f"file://{tmp_path}/w").ingest()
    c = Compactor(spark, str(tmp_path / "in"), f"file://{tmp_path}/w").ingest()
    assert c.staged.count() == 2 and c.merge().count() == 1 and [r.pred_id for r in c.surplus().collect()] == [2]


def test_compaction_matches_sql(spark, small):
    c = compact(spark, f"{small}/rfpredictions.parquet")
    rows = pd.read_parquet(f"{small}/rfpredictions.parquet")
    assert c.merge().count() == len(rows.drop(columns=["pred_id", "file_id"]).drop_duplicates())
    shutil.rmtree(c.work.removeprefix("file:"), ignore_errors=True)


def test_implausible_cases(spark):
    rows = series("A", 100, 0, 50, 5) + series("B", 100, 200, 8, 6)
    put(rows, 30, close=rows[30][6] * 10)
    put(rows, 60, high=rows[60][4] * 1.6)
    put(rows, 61, high=rows[61][4] * 1.6)
    put(rows, 40, volume=rows[40][7] * 500)
    put(rows, 45, close=-rows[45][6])
    put(rows, 50, high=rows[50][5] * 0.9)
    for i in range(71, 80):
        put(rows, i, close=rows[70][6])
    for i in range(150, 200):  # a split is a lasting move
        put(rows, i, **{k: rows[i][j] / 4 for k, j in (("open", 3), ("high", 4), ("low", 5), ("close", 6))})
    put(rows, 120, close=-999.0)
    for i in range(130, 134):  # a halt: flat days without volume
        put(rows, i, close=rows[129][6], high=rows[129][6], low=rows[129][6], volume=0.0)
    again = (500, *rows[30][1:])
    fixed = list(rows[30])
    fixed[0], fixed[6] = 501, rows[30][6] / 10
    rows += [again, tuple(fixed), (600, None, "A", 1.0, 1.0, 1.0, 5.0, 1.0, "x"), (601, D0, None, 1.0, 1.0, 1.0, -5.0, 1.0, "x"), (602, D0, "tiny", 1.0, 1.0, 1.0, 1.0, 1.0, "x")]
    got = {r.bar_id for r in spikes.implausible(frame(spark, rows).withColumn("close_spike", F.lit(1))).collect()}
    assert got == {30, 500, 60, 61, 40, 45, 50, 601} | set(range(71, 80))


def test_stuck_sees_every_reading_of_a_day(spark):
    rows = series("A", 100, 0, 50, 5)
    frozen = rows[70][6]
    for i in range(71, 80):  # the frozen reading lands between two others, which differ every day
        rows += [(1000 + i, *rows[i][1:6], frozen, *rows[i][7:]), (2000 + i, *rows[i][1:6], round(rows[i][6] * 1.0001, 4), *rows[i][7:])]
    got = {r.bar_id for r in spikes.implausible(frame(spark, rows)).collect()}
    assert got == {1000 + i for i in range(71, 80)}


def test_stuck_runs_may_overlap():
    days = [{float(i)} for i in range(100)]
    for i in range(20, 30):
        days[i] = {-1.0}
    for i in range(29, 40):
        days[i] = days[i] | {-2.0} if i == 29 else {-2.0}
    got = spikes.stuck(days)
    assert [i for i in range(100) if got[i]] == list(range(21, 40)) and got[29] == [-1.0] and got[30] == [-2.0]


def test_the_check_before_stuck_runs_drops_none():
    rng = np.random.default_rng(12)
    for _ in range(400):
        n = int(rng.integers(1, 30))
        first, last = rng.integers(0, 4 if rng.random() < 0.5 else 40, (2, n)).astype(float)
        held = [x for x in spikes.stuck([{a, b} for a, b in zip(first, last)]) if x]
        assert not held or spikes._may_be_stuck(first, last, [None] * n)
    assert spikes._may_be_stuck(np.array([1.0]), np.array([1.0]), [[1.0, 2.0, 3.0]])


def test_implausible_of_nothing(spark):
    assert spikes.implausible(frame(spark, [])).count() == 0


def test_spike_interval_matches_brute_force():
    rng = np.random.default_rng(0)
    x = np.cumsum(rng.normal(0, 0.01, 80))
    lo, hi = spikes.accepted(x, 1e-4)
    assert ((x >= lo) & (x <= hi)).all()
    for at in (10, 40, 70):
        y = x.copy()
        y[at] += 0.5
        lo, hi = spikes.accepted(y, 1e-4)
        assert [i for i in range(80) if not lo[i] <= y[i] <= hi[i]] == [at]


def heavy(seed, n=400):
    """A walk whose moves have heavy tails, with three planted spikes."""
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.standard_t(3, n) * 0.01)
    x[[50, 200, 333]] += [0.9, -0.8, 1.0]
    return x


def flags(x):
    lo, hi = spikes.accepted(x, 1e-4)
    return set(np.flatnonzero((x < lo) | (x > hi)).tolist())


def test_ellipsoids_and_levels_both_decide(monkeypatch):
    planted = {50, 200, 333}
    both = [flags(heavy(k)) for k in range(20)]
    assert all(planted <= f for f in both) and sum(len(f - planted) for f in both) <= 2
    with monkeypatch.context() as m:
        m.setattr(spikes, "HEAVY", 1e-9)  # ellipsoids that nominate everything
        without = [flags(heavy(k)) for k in range(20)]
    assert all(planted <= f for f in without) and sum(len(f - planted) for f in without) >= 8
    lasting = np.concatenate([np.zeros(100), np.full(100, 2.0)]) + np.random.default_rng(1).normal(0, 0.01, 200)
    assert flags(lasting) == set()
    with monkeypatch.context() as m:
        m.setattr(spikes, "OFF", -1e9)  # levels that confirm everything
        m.setattr(spikes, "OFF_AT_END", -1e9)
        assert flags(lasting)


def test_trailing_matches_brute_force(spark):
    rows = [(1, D0, "A", 1.0, 1.0, 1.0, 10.0, 5.0, "x"), (2, D0 + dt.timedelta(days=3), "A", 1.0, 1.0, 1.0, 20.0, None, "x"), (3, D0 + dt.timedelta(days=3), "A", 1.0, 1.0, 1.0, float("nan"), 7.0, "x"),
            (4, D0 + dt.timedelta(days=15), "A", 1.0, 1.0, 1.0, 30.0, 1.0, "x"), (5, None, "A", 1.0, 1.0, 1.0, 1.0, 1.0, "x"), (6, D0, None, 1.0, 1.0, 1.0, 4.0, 2.0, "x")]
    out = rolling.trailing(frame(spark, rows + rows[:1])).toPandas()
    a = out[out.ticker == "A"].sort_values("day").reset_index(drop=True)
    assert len(a) == 16 and len(out) == 17
    close = {0: 10.0, 3: 20.0, 15: 30.0}
    volume = {0: 5.0, 3: 7.0, 15: 1.0}
    bars = {0: 2, 3: 2, 15: 1}
    for i in range(16):
        for n in (7, 30):
            days = range(max(0, i - n + 1), i + 1)
            assert a[f"bars_{n}"][i] == sum(bars.get(k, 0) for k in days)
            assert a[f"close_sum_{n}"][i] == sum(close.get(k, 0) for k in days)
            seen = [volume[k] for k in days if k in volume]
            assert a[f"volume_avg_{n}"][i] == sum(seen) / len(seen) if seen else pd.isna(a[f"volume_avg_{n}"][i])
    assert rolling.trailing(frame(spark, [])).count() == 0

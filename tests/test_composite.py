"""The composite of the cross-section formulas against NumPy."""

import numpy as np

import __spark_entry__ as E
from tesserae.functions import features  # noqa: F401  (fills the registry)
from tesserae.operators import kernels
from tesserae.plans import blocks
from tesserae.queries.panel import bars


def test_composite_matches_numpy(spark, small):
    out = E.queries()["panel_composite"](spark, small).toPandas().set_index(["ticker", "day"]).sort_index()
    b = bars(spark, small)
    keyed = lambda df: df.withColumn("day", df.date.cast("string")).drop("date").toPandas().set_index(["ticker", "day"]).sort_index().fillna(0)
    a, k = keyed(blocks.apply(b, blocks.REGISTRY["panel_inputs"])), keyed(kernels.run(b, ["complexity"]))
    day = a.index.get_level_values("day")

    def rank(x):
        g = x.groupby(day)
        n = g.transform("size")
        return (g.rank() / (n + 1) * 2 - 1).where(n >= 2, 0.0)

    x = {n: rank(c) for n, c in {0: a.in_return, 2: a.in_high_close, 3: a.in_low_close, 7: a.in_rate_of_change, 8: a.in_imf1_energy, 13: k.noise_white_60, 14: k.noise_pink_60, 18: k.spectral_entropy_60, 19: a.in_autocorr}.items()}
    y = -0.9931974192883872 * x[3]
    f1, n1 = rank((x[14] - np.where(1.77026646253569 + x[19] > 0, y, -y)).round(9)), rank((x[13] + x[3]).round(9))
    f3 = rank((-0.07320318705361156 * x[0]).round(9))
    raw = (0.17726009244632013 + x[2]) / (x[3] + x[7] + 2.6940490745579684**2 + x[8])
    f4 = (raw - raw.groupby(day).transform("mean")) / (raw.groupby(day).transform("std", ddof=0) + 1e-10)
    n4 = rank(np.sqrt(np.abs(np.abs(x[3]) * (-1.7102360477772514 + x[18] + x[0]) / abs(-1.2577672553937247 * 3.959124395312415))).round(9))
    composite = (-0.034224 * f1 + 1.296387 * f3 + 0.004473 * f4 + 0.012287 * n1 + 0.009157 * n4 - 0.274113 * f1 * f3 + 0.085361 * f1 * f4 + 0.021151 * f1 * n1 - 0.181167 * f1 * n4
                 - 1.295755 * f3 * f4 + 0.355264 * f3 * n1 + 2.387638 * f3 * n4 - 0.044057 * f4 * n1 - 0.000961 * f4 * n4 + 0.048930 * n1 * n4 + 0.002355)
    assert len(out) == len(a) and (k.noise_pink_60 != 0).any()
    for name, want in {"f1": f1, "f3": f3, "f4": f4, "n1": n1, "n4": n4, "composite": composite}.items():
        assert np.allclose(out[f"gp_{name}"], want, atol=1e-6), name

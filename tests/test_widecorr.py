"""Wide correlation against a plain computation, with missing values and constant columns."""

import numpy as np

from strata.operators import eda, widecorr


def test_wide_matrix(spark):
    rnd = np.random.default_rng(1)
    n, p = 150, 60
    x = rnd.normal(size=(n, p)) * 10.0 ** rnd.integers(-3, 6, p) + 10.0 ** rnd.integers(0, 7, p)
    x[rnd.random((n, p)) < 0.2] = np.nan
    x[:, 5] = 0.1                                   # constant
    x[:, 6] = np.where(np.arange(n) < 75, 3.3, np.nan)
    x[:, 7] = np.where(np.arange(n) < 75, x[:, 7], 1.5)   # varies only where 6 is present
    x[:, 8] = np.nan
    x[:, 9] = np.where(np.arange(n) < 75, 2.5, x[:, 9])   # constant in the pair with 6
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"c{i} double" for i in range(p))).repartition(3)
    for block in (16, 256):
        got = {(r.col_a, r.col_b): r.r for r in widecorr.wide_correlation(df, df.columns, block).collect()}
        assert len(got) == p * p
        for i in range(p):
            for j in range(p):
                both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
                a, b = x[both, i], x[both, j]
                r = got[f"c{i}", f"c{j}"]
                if both.sum() < 2 or len(set(a)) < 2 or len(set(b)) < 2:
                    assert r is None
                else:
                    assert abs(r - np.corrcoef(a, b)[0, 1]) < 1e-7
    assert eda.correlation_matrix(df).count() == p * p

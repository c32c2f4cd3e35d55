"""Lag-1 OLS forecast against the published fitted series (values re-typed as test data)."""

from pyspark.sql import functions as F

from ledgergraph.operators import series as S

# Fixed test data: quarterly revenue 2016-1Q … 2021-3Q and the published in-sample predictions.
ACTUAL = [49782252000000, 50937120000000, 47815633000000, 53331740000000, 50547526000000, 61000537000000,
          62048901000000, 65978412000000, 60563714000000, 58482658000000, 65459993000000, 59265050000000,
          52385546000000, 56127104000000, 62003471000000, 59884760000000, 55325178000000, 52966142000000,
          66964160000000, 61551508000000, 65388503000000, 63671585000000, 73979187000000]
PREDICTED = [54400260114703, 55075260318991, 53250805608423, 56474873945132, 54847549420785, 60957152042412,
             61569902516206, 63866633162267, 60701836617413, 59485495680495, 63563626298359, 59942790159027,
             55921840054422, 58108715450016, 61543349473537, 60304999845849, 57640003689170, 56261188290419,
             64442785676127, 61279184982590, 63521841640195, 62518333013454]


def _facts(spark):
    rows = []
    y, q = 2016, 1
    for v in ACTUAL:
        rows.append(("X", "Revenue", y, f"{q}Q", v))
        q += 1
        if q == 5:
            y, q = y + 1, 1
    return spark.createDataFrame(rows, "code string, account string, bsns_year int, quarter string, value long")


def test_ols_matches_published_fit(spark):
    p = S.pairs(_facts(spark))
    assert p.count() == 22
    c = S.fit(p).first()
    assert abs(c["intercept"] - 2.530340205823539) < 1e-9
    assert abs(c["slope"] - 0.5844825592957839) < 1e-9
    assert abs(c["r2"] - 0.28280) < 1e-5
    fitted = (p.join(S.fit(p), ["code", "account"])
              .select("bsns_year", "quarter", S.predict(F.col("x"), F.col("intercept"), F.col("slope")).alias("pred"))
              .orderBy("bsns_year", "quarter").collect())
    got = [r["pred"] for r in fitted]
    assert max(abs(a - b) for a, b in zip(got, PREDICTED)) <= 1
    nxt = _facts(spark).agg(F.max_by("value", F.col("bsns_year") * 10 + F.substring("quarter", 1, 1).cast("int"))).first()[0]
    c2 = S.fit(p).first()
    pred = spark.range(1).select(S.predict(S.scale(F.lit(nxt)), F.lit(c2["intercept"]), F.lit(c2["slope"]))).first()[0]
    assert abs(pred - 68542946610616) <= 1


def test_summary_closed_form(spark):
    p = S.pairs(_facts(spark))
    s = S.summary(S.fit(p).filter(F.col("n") > 2)).first()
    assert s["n"] == 22 and abs(s["r2"] - 0.2828) < 1e-4
    assert s["se_slope"] > 0 and s["t_slope"] > 0


def test_several_regressors_against_least_squares(spark):
    import numpy as np
    rnd = np.random.default_rng(3)
    rows, want = [], {}
    for g in range(30):
        n = int(rnd.integers(3, 40))
        x = rnd.normal(size=(n, 3)) * [1, 1e-6, 1e5] + [5, 1, -1e5]
        y = x @ [2.0, 3e5, -1e-5] + 7 + rnd.normal(size=n)
        if g == 7:
            x[:, 2] = x[:, 0] * 4  # no unique solution
        if g == 8:
            x[:, 1] = 1.0  # a constant
        rows += [(str(g), "a", float(b), *map(float, a)) for a, b in zip(x, y)]
        if n > 4 and g not in (7, 8):
            full = np.column_stack([np.ones(n), x])
            want[str(g)] = np.linalg.lstsq(full, y, rcond=None)[0]
    df = spark.createDataFrame(rows, "code string, account string, y double, x1 double, x2 double, x3 double").repartition(5)
    got = {r["code"]: r for r in S.fit_many(df, ["x1", "x2", "x3"]).collect()}
    assert len(got) == 30 and {k for k, r in got.items() if r["coef"] is not None} == set(want)
    for k, b in want.items():
        assert np.allclose([got[k]["intercept"], *got[k]["coef"]], b, rtol=1e-4)
        assert 0 <= got[k]["r2"] <= 1
    assert got["7"]["intercept"] is None and got["8"]["r2"] is None


def test_lagged_rows_need_every_quarter(spark):
    f = spark.createDataFrame([("c", "a", 2020, f"{q}Q", q * 100) for q in (1, 2, 3, 4)] + [("c", "a", 2021, "2Q", 600), ("c", "a", 2021, "3Q", 700)],
                              "code string, account string, bsns_year int, quarter string, value long")
    got = sorted((r["bsns_year"], r["quarter"], r["x1"] * 1e13, r["x2"] * 1e13) for r in S.lagged(f, 2).collect())
    assert got == [(2020, "3Q", 200.0, 100.0), (2020, "4Q", 300.0, 200.0)]
    after = sorted((r["bsns_year"], r["quarter"], r["x1"] * 1e13, r["x2"] * 1e13) for r in S.lagged(f, 2, current=False).collect())
    assert after == [(2020, "2Q", 200.0, 100.0), (2020, "3Q", 300.0, 200.0), (2020, "4Q", 400.0, 300.0), (2021, "3Q", 700.0, 600.0)]

"""The nearest vertex of another way where vertices are dense."""

import math

from waymeter.operators import payloads


def test_dense_vertices_meet_few_others(spark, monkeypatch):
    n, met, plain = 900, [], payloads.within

    def counted(*args, **how):
        out = plain(*args, **how)
        met.append(out.count())
        return out

    monkeypatch.setattr(payloads, "within", counted)
    spots = [(k, 39 + (k % 30) * 0.00005, -84 + (k // 30) * 0.00005) for k in range(n)] + [(n, 39.004, -84.0)]
    df = spark.createDataFrame(spots, "id long, lat double, lon double")
    got = {r.id: (r.other, r.distance) for r in payloads.nearest_other(df, df).collect()}
    assert len(got) == n + 1 and sum(met) < 20 * n  # a ring of 240 m holds nearly all of 900
    assert got[n][0] == 29 and math.isclose(got[n][1], (0.004 - 29 * 0.00005) * math.pi / 180 * 6_371_000, rel_tol=1e-6)
    assert all(d < 5 for k, (_, d) in got.items() if k < n)

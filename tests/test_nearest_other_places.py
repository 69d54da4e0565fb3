"""Vertices of many ways at few places."""

import math
import random

from waymeter.operators import payloads


def hav(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(h)))


def test_places_meet_each_once(spark, monkeypatch):
    """As by brute force; vertices at one place make no pairs, however many they are."""
    draw, met, plain = random.Random(3), [], payloads.within

    def counted(left, right, *args, **how):
        out = plain(left, right, *args, **how)
        met.append((right.count(), out.count()))
        return out

    monkeypatch.setattr(payloads, "within", counted)
    places = [(39 + k * 0.0001, -84 + (k * k % 7) * 0.0001) for k in range(12)] + [(39.5, -84.0)]
    spots = [(draw.randrange(60), *draw.choice(places[:9])) for _ in range(1500)] + [(100 + k, *places[9 + k]) for k in range(4)] + [(100, *places[9])] * 20
    df = spark.createDataFrame(spots, "id long, lat double, lon double")
    asked = spark.createDataFrame([(i, lat, lon, k) for k, (i, lat, lon) in enumerate(spots)], "id long, lat double, lon double, k long")
    got = {r.k: (round(r.distance, 6), r.other, (r.at.lat, r.at.lon)) for r in payloads.nearest_other(asked, df, keys=("k",)).collect()}
    for k, (i, *p) in enumerate(spots):
        d, other, at = min((round(hav(p, q), 6), j, tuple(q)) for j, *q in spots if j != i)
        assert got.get(k) == ((d, other, at) if d <= 800 else None)
    assert all(n <= len(places) for n, _ in met) and sum(n for _, n in met) < 500

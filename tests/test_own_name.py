"""What is measured, and how often names are read, where only a way's own name counts."""

import pytest

from waymeter.operators import matching
from waymeter.plans import more, registry  # noqa: F401

LINE = "array<struct<lat:double,lon:double>>"


def test_symmetric_match_measures_no_other_name(spark, sf, monkeypatch):
    """A quarter of the ways have no line of their own name that passes; they meet no others, which could not be theirs."""
    met, near = [], matching._near

    def counted(own, *a, **k):
        out = near(own, *a, **k)
        met.append((own.count(), out.count()))
        return out

    monkeypatch.setattr(matching, "_near", counted)
    assert registry.QUERIES["jn_11_symmetric_match"](spark, sf).count() > 0
    assert sum(n for _, n in met) <= met[0][0]


def test_own_name_is_of_plain_names(spark):
    with pytest.raises(ValueError):
        matching.match(None, None, fallback=False, own_name=True)


def test_keys_of_names_are_made_before_pairs(spark, monkeypatch):
    """The last join of scored pairs compares keys that are there; no name is spelt out in a pair."""
    on = [(39.0, -84.0), (39.0, -83.998)]
    ways = spark.createDataFrame([(i, n, on) for i, n in enumerate(["Elm St", "elm street ", None, " ", "Oak"])], f"id long, name string, geometry {LINE}")
    c = [(k, n, "no", "local", 25, on) for k, n in enumerate(["ELM STREET", "Elm  St", None, "", "oak"])]
    c = spark.createDataFrame(c, f"source_id long, source_name string, source_oneway string, functional_class string, speed_limit int, geometry {LINE}")
    got = matching.scored_pairs(ways, c, fuzzy=False)
    rated = {(r.id, r.source_id): r.name_similarity for r in got.collect()}
    assert len(rated) == 25 and {k for k, v in rated.items() if v} == {(0, 0), (1, 0), (4, 4)}
    assert set(got.columns) == set(matching.scored_pairs(ways, c).columns)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan.split("Join")[0]

"""Large realtime messages, and bundles that stay small."""

import time

from waymeter.plans import files
from waymeter.sources import realtime
from waymeter.sources.fixtures import Roads


def test_large_messages_take_linear_time(spark, tmp_path):
    """200,000 positions, 10 MB: bytes grown by appending were copied some 200,000 times."""
    start = time.process_time()
    data = realtime.vehicles_message([{"vehicle_id": str(k), "timestamp": 5, "speed": 1.5} for k in range(200_000)])
    assert time.process_time() - start < 25
    (tmp_path / "v.pb").write_bytes(data)
    got = realtime.vehicle_positions(spark, str(tmp_path / "v.pb"))
    assert (got.count(), got.select("vehicle_id").distinct().count()) == (200_000, 200_000)


class Events(Roads):
    """Relations alone, of many ids."""

    def __init__(self, spark, sf, n):
        super().__init__(spark, sf)
        self._made["restrictions"] = spark.range(n).toDF("id")


def test_bundles_are_more_not_larger(spark, sf):
    e = files._elements(Events(spark, sf, 100_000))
    assert e.where("type = 'relation'").count() == 100_000
    assert len(e.inputFiles()) == 100_000 // files.BUNDLE

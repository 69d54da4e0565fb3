"""Which calls a limited service takes: so many in a trailing window, so many in a month; a call that is refused counts for neither."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import discard, written

PER_WINDOW, WINDOW_S, QUOTA, SHARE = 5, 60, 5000, 0.8


def _deciding(given: dict[int, tuple[float, ...]], most: int, seconds: float):
    """Goes through a range (its number is the key) in the order of time, from the times that were taken last before it: what it takes, and with ``last`` what it hands on."""

    def decide(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        recent, taken = list(given[int(key[0])]), []
        for i, t in rows.sort_values(["t", "id"])[["id", "t"]].itertuples(index=False):
            while recent and recent[0] <= t - seconds:
                recent.pop(0)
            if len(recent) < most:
                recent.append(t)
                taken.append((i, t))
        out = pd.DataFrame({"id": [i for i, _ in taken], "t": [t for _, t in taken], "part": int(key[0]), "last": False})
        tail = pd.DataFrame({"id": -1, "t": recent, "part": int(key[0]), "last": True})
        return pd.concat([x for x in (out, tail) if len(x)] or [out.astype({"id": "int64", "t": "float64"})])

    return decide


def _taken(calls: DataFrame, most: int, seconds: float) -> DataFrame:
    """Of calls (id, t, part), ranges of time by ``part``, those that the trailing window takes.

    Each range is decided from the times that the range before has taken last. All ranges run at once from the state that is known of
    the one before; those whose state proves to be another run again. A pause of a window's length settles what comes after it, so
    that few rounds are needed unless calls come without a pause; then a round settles one range more, or more. A task holds one range.
    """
    state: dict[int, tuple[float, ...]] = {}
    ends: dict[int, tuple[float, ...]] = {}
    parts = sorted(r[0] for r in calls.select("part").distinct().collect())
    tables: dict[int, DataFrame] = {}
    due = parts
    while due:
        given = {p: state.get(p, ()) for p in due}
        done = written(calls.where(F.col("part").isin(due)).groupBy("part").applyInPandas(_deciding(given, most, seconds), "id long, t double, part int, last boolean"), "taken")
        for p in due:
            tables[p] = done
            ends[p] = ()
        for r in done.where("last").groupBy("part").agg(F.array_sort(F.collect_list("t")).alias("t")).collect():
            ends[r["part"]] = tuple(r["t"])
        due = []
        for before, p in zip(parts, parts[1:], strict=False):
            now = ends[before]
            if now != state.get(p, ()):
                state[p] = now
                due.append(p)
    out = None
    for table in {id(t): t for t in tables.values()}.values():
        own = [p for p, t in tables.items() if t is table]
        rows = table.where(F.col("part").isin(own) & ~F.col("last")).select("id", "t")
        out = rows if out is None else out.unionByName(rows)
    return calls.select("id", "t").limit(0) if out is None else out


def admitted(calls: DataFrame, most: int = PER_WINDOW, seconds: float = WINDOW_S, quota: int = QUOTA, share: float = SHARE, id_col: str = "event_id", ts: str = "ts") -> DataFrame:
    """(id, t): the calls that are taken, in the order of time, then id, over all callers.

    A month takes ``share`` of its quota and refuses the rest. What it refuses doesn't fill the window, which matters to the first
    calls of the next month: so the refused ones are taken out and the window is asked again, until nothing changes. Calls without a
    time are not taken.
    """
    cap = int(quota * share)
    moment = F.col(ts).cast("timestamp")
    own = calls.where(F.col(ts).isNotNull()).select(F.col(id_col).alias("id"), (F.unix_micros(moment) / 1_000_000).alias("t"), F.date_format(moment, "yyyy-MM").alias("month"))
    left = written(own.repartitionByRange("t", "id").withColumn("part", F.spark_partition_id()), "calls")
    while True:
        taken = written(_taken(left, most, seconds), "window")
        months = taken.join(left.select("id", "month"), "id")
        # of each month the call that fills it: ranked in days first, so that no month is gathered
        day = F.floor(F.col("t") / 86_400)
        days = months.groupBy("month", day.alias("day")).agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("month").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranks = months.withColumn("day", day).withColumn("k", F.row_number().over(Window.partitionBy("month", "day").orderBy("t", "id"))).join(days.select("month", "day", before.alias("base")), ["month", "day"])
        full = {r["month"]: (r["t"], r["id"]) for r in ranks.where(F.col("k") + F.col("base") == cap).select("month", "t", "id").collect()}  # a row a month
        over = F.lit(False)
        for month, (t, i) in full.items():
            over = over | ((F.col("month") == month) & ((F.col("t") > t) | (F.col("t") == t) & (F.col("id") > i)))
        rest = written(left.where(~over), "calls")
        if rest.count() == left.count():
            discard(rest)
            return taken
        left = rest

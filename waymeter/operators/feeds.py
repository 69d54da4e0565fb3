"""Call quotas, feed errors and readiness checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def over_rate(calls: DataFrame, key: str = "user_id", ts: str = "ts", seconds: int = 60, most: int = 5) -> DataFrame:
    """(key, ts, calls): calls of a key that come as more than ``most`` in the trailing ``seconds``."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_t").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return calls.withColumn("_t", at).withColumn("calls", F.count("*").over(w)).where(F.col("calls") > most).drop("_t")


def monthly_quota(calls: DataFrame, ts: str = "ts", quota: int = 5000, share: float = 0.8) -> DataFrame:
    """(month, used, remaining, refused): a month refuses calls beyond ``share`` of its quota."""
    g = calls.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.count("*").alias("used"))
    return g.select("month", "used", F.greatest(F.lit(quota) - F.col("used"), F.lit(0)).cast("long").alias("remaining"), (F.col("used") >= F.lit(int(quota * share))).alias("refused"))


def error_summary(errors: DataFrame, samples: int = 3) -> DataFrame:
    """(feed, reason, n, samples): the first details, cut to 200 characters, in the order of ``seq``."""
    first = F.row_number().over(Window.partitionBy("feed", "reason").orderBy("seq"))
    few = errors.withColumn("_r", first).where(F.col("_r") <= samples).groupBy("feed", "reason").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.left("detail", F.lit(200)).alias("d")))), lambda s: s["d"]), "|").alias("samples"))
    return errors.groupBy("feed", "reason").agg(F.count("*").alias("n")).join(few, ["feed", "reason"])


def readiness(checks: DataFrame) -> DataFrame:
    """One row of a check table (status): counts and the exit code."""
    n = lambda s: F.count_if(F.col("status") == s)
    return checks.agg(n("PASS").alias("n_pass"), n("FAIL").alias("n_fail"), n("WARN").alias("n_warn"), n("MANUAL").alias("n_manual"), F.when(n("FAIL") > 0, 1).otherwise(0).alias("exit_code"))


def newest(files: DataFrame, group: str, keep: int = 3) -> DataFrame:
    """The ``keep`` newest rows (mtime, then path) of each group."""
    return files.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("mtime"), "path"))).where(F.col("_r") <= keep).drop("_r")


def budget(usage: DataFrame, today: str, calls: int | None = None, quota: int = 5000, share: float = 0.8) -> DataFrame:
    """For the month of ``today`` (yyyy-MM-dd) in ``usage`` (month, used): what remains of ``share`` of the quota, days_left, today among them, per_day and, for a run of ``calls``, fits and its share of what remains in per cent (infinite of nothing)."""
    day = F.lit(today).cast("date")
    left = F.datediff(F.last_day(day), day) + 1
    month = usage.where(F.col("month") == F.date_format(day, "yyyy-MM"))
    out = month.select("month", F.greatest(F.lit(int(quota * share)) - F.col("used"), F.lit(0)).cast("long").alias("remaining"))
    out = out.select("month", "remaining", left.alias("days_left"), F.floor(F.col("remaining") / left).alias("per_day"))
    if calls is None:
        return out
    part = F.when(F.col("remaining") == 0, float("inf")).otherwise(F.try_divide(F.lit(100.0 * calls), F.col("remaining")))
    return out.withColumns({"fits": F.col("remaining") >= calls, "share_pct": part})


def once(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows that share ``key`` the first in the order of ``order``; rows without a key are one."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("r")).select(key, "r.*").select(*rows.columns)


def cache_key(payload: Column, digits: int = 16) -> Column:
    """A request's place in a cache: the first hexadecimal digits of the SHA-256 of its JSON."""
    return F.left(F.sha2(F.to_json(payload), 256), F.lit(digits))


def positive_int(said: Column) -> Column:
    """A whole number above 0, or null."""
    n = F.trim(said).try_cast("int")
    return F.when(n > 0, n)


def number(said: Column) -> Column:
    """A number, or null."""
    return F.trim(said).try_cast("double")


def moment(said: Column) -> Column:
    """An ISO time, or null."""
    return F.try_to_timestamp(F.trim(said))

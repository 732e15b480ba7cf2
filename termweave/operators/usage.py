"""Usage statistics over the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The event that each metric counts.
METRICS = {"jobs": "job_start", "minutes": "job_end", "logins": "login_ok", "downloads": "download"}


def since(events: DataFrame, now: str, days: int | None) -> DataFrame:
    """Events of the last ``days`` days before ``now`` (ISO with offset), or all."""
    if days is None:
        return events
    return events.where(F.to_timestamp("ts") >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days)))


def totals(events: DataFrame) -> DataFrame:
    """Per user: logins, jobs, minutes, downloads, errors, last_seen; names that only failed to sign in are left out."""
    is_ = lambda e: F.col("event") == e
    return events.where(~is_("login_failed")).groupBy("user").agg(
        F.count_if(is_("login_ok")).alias("logins"),
        F.count_if(is_("job_start")).alias("jobs"),
        F.round(F.coalesce(F.sum(F.when(is_("job_end"), F.col("duration_s"))), F.lit(0.0)) / 60, 6).alias("minutes"),
        F.count_if(is_("download")).alias("downloads"),
        F.count_if(is_("job_end") & (F.col("status") == "error")).alias("errors"),
        F.max("ts").alias("last_seen"),
    )


def metric_value(metric: str) -> Column:
    return F.coalesce(F.col("duration_s"), F.lit(0.0)) / 60 if metric == "minutes" else F.lit(1.0)


def daily(events: DataFrame, metric: str) -> DataFrame:
    """day (in the event's own offset), user, value; days without value are left out."""
    value = F.round(F.sum(metric_value(metric)), 6)
    return events.where(F.col("event") == METRICS[metric]).groupBy(F.substring("ts", 1, 10).alias("day"), "user").agg(value.alias("value")).where("value <> 0")


def _first_seen(events: DataFrame) -> DataFrame:
    return events.where("event <> 'login_failed'").groupBy("user").agg(F.min("pos").alias("pos"))


def users_in_order(events: DataFrame, bucket: int = 65_536) -> DataFrame:
    """user and place, by first appearance in the log.

    Users are numbered inside buckets of ``bucket`` positions; only the buckets' counts are summed in one task.
    """
    first = _first_seen(events).withColumn("bucket", F.floor(F.col("pos") / bucket))
    counts = first.groupBy("bucket").agg(F.count("*").alias("n"))
    before = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("pos"))
    return first.withColumn("inside", inside).join(before, "bucket").select("user", (F.col("before") + F.col("inside")).cast("int").alias("place"))


def series_names(events: DataFrame, slots: int = 8, rest: str = "Andere") -> DataFrame:
    """user, series, slot (from 1): up to ``slots`` users are series of their own; of more, all but the first
    ``slots`` - 1 share the last one."""
    first = _first_seen(events)
    few = first.orderBy("pos").limit(slots + 1).agg(F.sort_array(F.collect_list(F.struct("pos", "user"))).alias("few"))
    place = F.array_position(F.transform("few", lambda x: x["user"]), F.col("user")).cast("int")
    own = F.when((F.size("few") <= slots) | place.between(1, slots - 1), place)
    named = first.crossJoin(F.broadcast(few)).withColumn("own", own)  # one row, of slots + 1 users at most
    return named.select("user", F.when(F.col("own").isNotNull(), F.col("user")).otherwise(F.lit(rest)).alias("series"), F.coalesce("own", F.lit(slots)).alias("slot"))


def series(events: DataFrame, metric: str, slots: int = 8, rest: str = "Andere") -> DataFrame:
    """day, series, value: users by name, those beyond the slots folded into one series."""
    names = series_names(events, slots, rest).select("user", "series")
    return daily(events, metric).join(names, "user").groupBy("day", "series").agg(F.round(F.sum("value"), 6).alias("value"))


def colors(events: DataFrame, palette: tuple[str, ...]) -> DataFrame:
    """user, color: the palette's in order of first appearance, folded users share the folded series' one."""
    return series_names(events, len(palette)).select("user", F.element_at(F.array(*[F.lit(p) for p in palette]), F.col("slot")).alias("color"))


def kpis(events: DataFrame) -> DataFrame:
    """One row: users, logins, jobs, minutes, downloads, failed_sign_ins."""
    is_ = lambda e: F.col("event") == e
    return events.agg(
        F.count_distinct(F.when(~is_("login_failed"), F.col("user"))).alias("users"),
        F.count_if(is_("login_ok")).alias("logins"),
        F.count_if(is_("job_start")).alias("jobs"),
        F.round(F.coalesce(F.sum(F.when(is_("job_end"), F.col("duration_s"))), F.lit(0.0)) / 60, 1).alias("minutes"),
        F.count_if(is_("download")).alias("downloads"),
        F.count_if(is_("login_failed")).alias("failed_sign_ins"),
    )

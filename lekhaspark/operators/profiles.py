"""Profiles of accounts under a log of requests: deleted ones stay restorable for some days, the last one stays, and five at most are active."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

MOST_PROFILES = 5
RESTORE_DAYS = 7


def after_requests(profiles: DataFrame, requests: DataFrame, days: int = RESTORE_DAYS, most: int = MOST_PROFILES) -> DataFrame:
    """profiles (account, user_id, deleted_at), requests (account, number, at, user_id, action: delete or restore) -> (account, profiles, outcomes) of every account
    of either table: profiles is array<struct<user_id, deleted_at, purge_after>> after all requests in the order of at and number, outcomes array<struct<number, outcome>>.

    Outcomes: done; again (a profile deleted or active already: nothing changes); last (the only active profile stays); full (`most` are active, none can come
    back); unknown (no such profile, or its days are over). Requests of one account are folded inside its row."""
    kept = F.expr(f"interval {int(days)} days")
    own = profiles.groupBy("account").agg(F.array_sort(F.collect_list(F.struct("user_id", "deleted_at"))).alias("p"))
    asked = requests.groupBy("account").agg(F.array_sort(F.collect_list(F.struct("at", "number", "user_id", "action"))).alias("r"))
    met = own.join(asked, "account", "full")
    none = lambda of: F.slice(of, 1, 0)
    held = F.coalesce("p", none(F.array(F.struct(F.lit(None).cast(profiles.schema["user_id"].dataType).alias("user_id"), F.lit(None).cast("timestamp").alias("deleted_at")))))
    log = F.struct(F.lit(0).cast("long").alias("number"), F.lit("").alias("outcome"))
    start = F.struct(held.alias("p"), none(F.array(log)).alias("log"))

    def step(s: Column, r: Column) -> Column:
        mine = F.get(F.filter(s["p"], lambda p: p["user_id"] == r["user_id"]), F.lit(0))
        active = F.size(F.filter(s["p"], lambda p: p["deleted_at"].isNull()))
        gone = mine["deleted_at"].isNotNull() & (mine["deleted_at"] + kept <= r["at"])
        restore = r["action"] == "restore"
        outcome = F.when(mine.isNull() | gone, "unknown").when(restore & mine["deleted_at"].isNull() | ~restore & mine["deleted_at"].isNotNull(), "again")
        outcome = outcome.when(restore & (active >= most), "full").when(~restore & (active <= 1), "last").otherwise("done")

        def put(o: Column) -> Column:
            changed = lambda p: F.when((o == "done") & (p["user_id"] == r["user_id"]), F.struct(p["user_id"].alias("user_id"), F.when(restore, None).otherwise(r["at"]).cast("timestamp").alias("deleted_at"))).otherwise(p)
            return F.struct(F.transform(s["p"], changed).alias("p"), F.concat(s["log"], F.array(F.struct(r["number"].cast("long").alias("number"), o.alias("outcome")))).alias("log"))

        return let(outcome, put)

    folded = met.select("account", F.when(F.col("r").isNull(), start).otherwise(F.aggregate("r", start, step)).alias("s"))
    with_end = F.transform("s.p", lambda p: F.struct(p["user_id"].alias("user_id"), p["deleted_at"].alias("deleted_at"), (p["deleted_at"] + kept).alias("purge_after")))
    return folded.select("account", with_end.alias("profiles"), F.col("s.log").alias("outcomes"))


def purged(accounts: DataFrame, now: Column) -> DataFrame:
    """`after_requests` without the profiles whose days are over at `now`."""
    return accounts.withColumn("profiles", F.filter("profiles", lambda p: F.coalesce(p["purge_after"] > now, F.lit(True))))

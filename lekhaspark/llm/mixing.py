"""Operator 8 [native]: mixing sources to target weights by weighted fair queueing.

Every source shuffles its documents by a seeded hash. The virtual finish time of
a document is the running sum of its source's words up to and including it,
divided by the source's target; a source whose target exceeds its size goes
round its documents again, up to three times. All entries are ordered by finish time
over the whole corpus, and the mix takes them while their running sum of words
stays within the total budget.

No running sum is taken over a whole source or the whole corpus in one task:
both orders are cut into ranges of the sort key, sums of ranges are added up
first, and a window then runs inside one range only. The ranges follow the
number of rows, so a hot source is spread like the others, and the results do not
depend on how many there are.

Targets: sources in code-point order, null last, weigh 5, 2, 1, 5, 2, 1, ...
and share the budget; none gets more than three times its size, and the excess
is shared again by weight. Sorted by size / weight, the sources that stop at
their limit are a prefix, which one pass over the sums of the sorted sources finds.

Defined cases: a null or empty text has size 0 and is never taken; documents
without any word have target 0; equal doc_ids of one source are
separate rows in the order of their size; a null doc_id sorts first; an empty
table gives an empty result; a very long text is one entry of its size; only doc_id, source and text are
read, so further columns may bear any name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
SEED = 20240
_HASHES = 1 << 31


def _key(i: str = "doc_id"):
    """A shuffled place in 0 .. 2**31 - 1 that DuckDB can compute as well."""
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(i).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(_HASHES)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, size) -> source, source_size, target: one row for each source."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    totals = totals.withColumn("weight", pick)
    cap = MOST_TIMES * F.col("source_size").cast("decimal(38,0)")
    by_ratio = Window.orderBy(F.expr("source_size / weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole).cast("decimal(38,0)") - F.coalesce(F.sum(cap).over(before), F.lit(0))
    heavy = F.sum("weight").over(whole).cast("decimal(38,0)") - F.coalesce(F.sum(F.col("weight").cast("decimal(38,0)")).over(before), F.lit(0))
    ranked = totals.select("source", "source_size", "weight", left.cast("decimal(38,0)").alias("left"), heavy.cast("decimal(38,0)").alias("heavy"))
    full = F.expr(f"{MOST_TIMES} * cast(source_size as double) * cast(heavy as double) <= cast(weight as double) * cast(left as double)")
    ranked = ranked.withColumn("full", full)
    rest = ranked.select(
        "source", "source_size", "weight", "full",
        F.max(F.when(~F.col("full"), F.col("left"))).over(whole).alias("pool"), F.max(F.when(~F.col("full"), F.col("heavy"))).over(whole).alias("over"),
    )
    share = F.col("weight").cast("double") * F.col("pool").cast("double") / F.col("over").cast("double")
    return rest.select("source", "source_size", F.when(F.col("full"), (MOST_TIMES * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def _sizes(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), size.alias("size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, times (0 to 3), taken."""
    rows = written(_sizes(docs).withColumn("key", _key()), "sizes")
    n, budget = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(1, math.isqrt(n))
    rows = rows.withColumn("range", F.expr(f"key div {max(1, _HASHES // ranges)}"))
    # one row for each source and range, of about the square root of n rows: their running sums are small windows
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("s"))
    before = F.sum("s").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(F.col("source").alias("source2"), F.col("range").alias("range2"), F.coalesce(before, F.lit(0)).alias("start"))
    goal = targets(rows, weights).select(F.col("source").alias("source3"), "source_size", "target")
    starts = starts.join(goal, F.col("source2").eqNullSafe(F.col("source3")))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumn("part", F.sum("size").over(inside))
    upto = inner.join(starts, F.col("source").eqNullSafe(F.col("source2")) & (F.col("range") == F.col("range2")))
    upto = written(upto.select("doc_id", "source", "size", "key", "source_size", "target", (F.col("start") + F.col("part")).alias("upto")), "upto")
    place = f"struct({{e}} as finish, key, coalesce(doc_id, {-(1 << 63)}) as id, source is null as none, coalesce(source, '') as name, size, {{i}} as epoch)"
    finish = "(cast(upto + {e} * source_size as double) / nullif(target, 0D))"
    all_places = "array(" + ", ".join(place.format(e=finish.format(e=e), i=e) for e in range(MOST_TIMES)) + ")"
    entries = upto.where("size > 0 and target > 0").select(F.explode(F.expr(all_places)).alias("p")).withColumn("slot", F.expr(f"cast(floor(p.finish * {ranges}) as long)"))
    slots = entries.groupBy("slot").agg(F.sum("p.size").alias("s"))
    ends = slots.select("slot", "s", F.sum("s").over(Window.orderBy("slot")).alias("run")).where(F.col("run") > budget).orderBy("slot").first()
    if ends is None:
        times = F.expr("if(size > 0 and target > 0, %d, 0)" % MOST_TIMES)
    else:
        # the first entry that the budget has no room for; what stands before it is taken
        line = F.sum("p.size").over(Window.partitionBy("slot").orderBy("p")) + F.lit(ends["run"] - ends["s"])
        cut = entries.where(F.col("slot") == ends["slot"]).select("p", line.alias("line")).where(F.col("line") > budget).agg(F.min("p").alias("cut")).first()["cut"]
        kinds = entries.schema["p"].dataType
        cut = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cut, kinds)])
        times = F.when((F.col("size") > 0) & (F.col("target") > 0), F.size(F.filter(F.expr(all_places), lambda p: p < cut))).otherwise(0)
    return upto.select("doc_id", "source", "size", "source_size", "target", times.cast("int").alias("times")).withColumn("taken", F.col("size") * F.col("times"))


def take_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs."""
    keys = ["_mix_id", "_mix_source", "_mix_size"]
    named = docs.select("*", docs["doc_id"].cast("long").alias(keys[0]), docs["source"].cast("string").alias(keys[1]), F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias(keys[2]))
    # rows alike in id, source and size share a list of times and take from it in turn
    shares = mix(docs, weights).where("times > 0").groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list("times"), asc=False).alias("_mix_times"))
    shares = shares.select(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_z"), "_mix_times")
    met = named.join(shares, named[keys[0]].eqNullSafe(F.col("_i")) & named[keys[1]].eqNullSafe(F.col("_s")) & (named[keys[2]] == F.col("_z")))
    turn = F.row_number().over(Window.partitionBy("_i", "_s", "_z").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    met = met.withColumn("_turn", turn).where("_turn <= size(_mix_times)")
    return met.withColumn("_n", F.explode(F.expr("sequence(1, element_at(_mix_times, _turn))"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def sql() -> str:
    """The same in DuckDB SQL."""
    return f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {_HASHES} AS key FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([{", ".join(map(str, WEIGHTS))}], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT) AS weight FROM t),
r AS (SELECT *, sum(source_size) OVER () - coalesce({MOST_TIMES} * sum(source_size) OVER b, 0) AS lft, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS heavy FROM w
  WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, {MOST_TIMES} * source_size::DOUBLE * heavy::DOUBLE <= weight::DOUBLE * lft::DOUBLE AS is_full FROM r),
g AS (SELECT source, source_size, CASE WHEN is_full THEN ({MOST_TIMES} * source_size)::DOUBLE ELSE weight::DOUBLE * (max(lft) FILTER (NOT is_full) OVER ())::DOUBLE / (max(heavy) FILTER (NOT is_full) OVER ())::DOUBLE END AS target FROM f),
u AS (SELECT d.*, g.source_size, g.target, (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT u.*, x.e, (upto + x.e * source_size)::DOUBLE / target AS finish FROM u, range({MOST_TIMES}) AS x(e) WHERE size > 0 AND target > 0),
l AS (SELECT *, sum(size) OVER (ORDER BY finish, key, doc_id NULLS FIRST, source NULLS LAST, size, e ROWS UNBOUNDED PRECEDING) AS line FROM e),
k AS (SELECT doc_id, source, size, key, count(*) AS times FROM l WHERE line <= (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT u.doc_id, u.size, u.source_size, u.target, (u.size * coalesce(k.times, 0))::BIGINT AS taken FROM u LEFT JOIN k ON u.doc_id = k.doc_id AND u.source IS NOT DISTINCT FROM k.source AND u.size = k.size"""

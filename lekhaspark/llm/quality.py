"""Operator 2 [native]: quality verdicts by weak supervision.

Rules look at one document and vote bad (0), abstain (1) or vote good (2). A bad
vote is a hint and no verdict: most short documents are good, say. A
two-class model gives each rule a probability of each vote for good and for
bad documents; expectation-maximisation estimates these and the share of good
documents from the votes of the whole corpus, without labels. A document is
kept when its posterior probability of being good is at least one half and the
base rules did not fail it.

The corpus enters the estimation only as counts of vote patterns: one grouped
count, written as a table. Each round of EM is one aggregation over that table to a row for
each rule and vote, 3 * rules rows; only these sums reach the driver, which puts them into
the next round's expressions. Everything is DataFrame expressions; documents are never
shuffled, and nothing is broadcast.

Defined cases: a null or empty text has no words, fails the base and is not
kept; an empty table gives an empty result; repeated rows and equal vote patterns are judged alike;
a very long text is counted whole; only doc_id and text are read, so other columns may bear any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import documents, forget, written

SPACE = r"[\x20\x09-\x0D]+"
ROUNDS = 12
LEAST_WORDS = 50
GOOD_PRIOR = 0.9
#: (name, condition of a bad vote, condition of a good vote) over the features below.
RULES = [
    ("length", "n_words < 100", "n_words >= 200"),
    ("word_length", "word_chars > 8 * n_words or word_chars < 3 * n_words", "word_chars >= 4 * n_words and word_chars <= 7 * n_words"),
    ("symbols", "5 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    ("digits", "5 * n_digits > n_letters", "20 * n_digits <= n_letters"),
    ("repeats", "20 * n_repeat_words > n_words", "n_repeat_words = 0"),
    ("lines", "n_dup_lines > 0", "n_dup_lines = 0"),
    ("prose", "n_words >= 50 and 50 * n_stops < n_words", "30 * n_stops >= n_words and 4 * n_stops <= n_words"),
    ("function_words", "n_words >= 50 and 50 * n_function < n_words", "10 * n_function >= n_words"),
    ("letters", "10 * n_letters < 6 * word_chars", "10 * n_letters >= 8 * word_chars"),
    ("line_ends", "n_lines >= 3 and 5 * n_ended < n_lines", "10 * n_ended >= 7 * n_lines"),
    ("long_words", "20 * n_long > n_words", "50 * n_long <= n_words"),
]
#: Pseudo-votes (bad, abstain, good) of each rule for good and for bad documents, out of 1.
PRIOR = {"good": (0.05, 0.15, 0.80), "bad": (0.30, 0.10, 0.60)}
#: Weight of the pseudo-votes, as a share of all documents.
PRIOR_WEIGHT = 0.05
# Common function words of the languages that a corpus is mostly in; texts in others only lose the good vote's help.
FUNCTION_WORDS = (
    "the of and to in is that it for on with as was are be this by or from "
    "der die das und ist nicht ein eine mit auf zu den von sich "
    "le la les de des et est une un en que pour dans el los las y es por con para una del no se"
).split()
_N = 3 * len(RULES)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules read."""
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = documents(docs).select(
        "doc_id",
        words.alias("words"),
        lines.alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"[.!?]")).cast("long").alias("n_stops"),
        F.regexp_count("text", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.regexp_count("text", F.lit(r"[0-9]")).cast("long").alias("n_digits"),
    )
    grams = F.expr(
        "if(size(words) < 3, array(), zip_with(slice(words, 1, size(words) - 2), zip_with(slice(words, 2, size(words) - 2), "
        "slice(words, 3, size(words) - 2), (b, c) -> struct(b as b, c as c)), (a, x) -> xxhash64(a, x.b, x.c)))"
    )
    counted = counted.withColumn("grams", grams)
    return counted.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("grams")) == F.size("grams"), F.lit(0)).otherwise(_covered()).cast("long").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(FUNCTION_WORDS))).cast("long").alias("n_function"),
        F.size(F.filter("words", lambda w: F.length(w) > 14)).cast("long").alias("n_long"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?:;][\"')\]]?[\x20\x09-\x0D]*$"))).cast("long").alias("n_ended"),
        "n_stops", "n_letters", "n_digits",
    )


def _covered() -> Column:
    """Words in three-word windows that stand twice or more: equal windows are neighbours once sorted."""
    return F.expr(
        "aggregate(array(sort_array(transform(grams, (h, i) -> struct(h as h, i as i)))), 0, (z, s) -> "
        "size(array_distinct(flatten(transform(flatten(zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), "
        "(a, b) -> if(a.h = b.h, array(a.i, b.i), cast(array() as array<int>)))), i -> array(i, i + 1, i + 2))))))"
    )


def votes() -> list[Column]:
    return [F.when(F.expr(bad), 0).when(F.expr(good), 2).otherwise(1).alias(f"v_{name}") for name, bad, good in RULES]


def _log_odds(p: float, good: list[float], bad: list[float]) -> Column:
    """Of a row of votes, under a model: the share of good documents and each rule's vote probabilities for either kind."""
    out = F.lit(math.log(p) - math.log(1 - p))
    for i, (name, _, _) in enumerate(RULES):
        weights = [F.lit(math.log(good[3 * i + v]) - math.log(bad[3 * i + v])) for v in range(3)]
        out = out + F.when(F.col(f"v_{name}") == 0, weights[0]).when(F.col(f"v_{name}") == 2, weights[2]).otherwise(weights[1])
    return out


def fit(patterns: DataFrame) -> tuple[float, list[float], list[float]]:
    """(share of good documents, P(vote | good), P(vote | bad)) of vote patterns (v_..., n); votes of rule i are at 3 * i + vote."""
    good, bad = ([*PRIOR[k]] * len(RULES) for k in ("good", "bad"))
    p, prior_good, prior_bad = GOOD_PRIOR, good, bad
    keys = F.array(*[F.col(f"v_{name}") + 3 * i for i, (name, _, _) in enumerate(RULES)])
    for _ in range(ROUNDS):
        r = 1 / (1 + F.exp(-_log_odds(p, good, bad)))
        each = patterns.select(F.explode(F.concat(keys, F.array(F.lit(_N)))).alias("k"), (F.col("n") * r).alias("g"), (F.col("n") * (1 - r)).alias("b"))
        sums = {row["k"]: (row["g"], row["b"]) for row in each.groupBy("k").agg(F.sum("g").alias("g"), F.sum("b").alias("b")).collect()}
        if not sums:
            break
        all_good, all_bad = sums[_N]
        w = PRIOR_WEIGHT * (all_good + all_bad)
        p = (all_good + w * GOOD_PRIOR) / (all_good + all_bad + w)
        good = [(sums.get(k, (0.0, 0.0))[0] + w * prior_good[k]) / (all_good + w) for k in range(_N)]
        bad = [(sums.get(k, (0.0, 0.0))[1] + w * prior_bad[k]) / (all_bad + w) for k in range(_N)]
    return p, good, bad


def accuracies(p: float, good: list[float], bad: list[float]) -> dict[str, tuple[float, float]]:
    """For each rule: how likely a document with its bad vote is bad, and one with its good vote good, by the fitted model."""
    return {
        name: ((1 - p) * bad[3 * i] / ((1 - p) * bad[3 * i] + p * good[3 * i]), p * good[3 * i + 2] / (p * good[3 * i + 2] + (1 - p) * bad[3 * i + 2]))
        for i, (name, _, _) in enumerate(RULES)
    }


def quality(docs: DataFrame, least_words: int = LEAST_WORDS, report: Callable[[dict], None] | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, one vote column for each rule, p_good and kept. The base fails texts of under
    `least_words` words and those that repeat themselves in more than half of their words. `report` gets the accuracies."""
    failed = F.expr(f"n_words < {int(least_words)} or 100 * n_repeat_words > 50 * n_words")
    seen = written(features(docs).select("*", *votes()), "votes")
    patterns = written(seen.groupBy([f"v_{name}" for name, _, _ in RULES]).agg(F.count("*").cast("double").alias("n")), "patterns")
    model = fit(patterns)
    forget(patterns)
    if report:
        report(accuracies(*model))
    p_good = 1 / (1 + F.exp(-_log_odds(*model)))
    return seen.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (p_good >= 0.5)).alias("kept"), p_good.alias("p_good"), *[f"v_{name}" for name, _, _ in RULES],
    )


def keep_good(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs without rejected rows. A row is known by a hash of its doc_id and text, so that rows without a doc_id,
    and rows of different text that share one, are judged each for itself."""
    key = F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")))
    judged = quality(docs.select(key.alias("doc_id"), docs["text"].alias("text")), least_words)
    gone = judged.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, key == gone["_gone"], "left_anti").select(docs.columns)


def sql(least_words: int = LEAST_WORDS) -> str:
    """The same in DuckDB SQL."""
    vote = ", ".join(f"CASE WHEN {bad} THEN {3 * i} WHEN {good} THEN {3 * i + 2} ELSE {3 * i + 1} END AS k{i}" for i, (_, bad, good) in enumerate(RULES))
    ks = ", ".join(f"k{i}" for i in range(len(RULES)))
    prior = ", ".join(f"({k}, {PRIOR['good'][k % 3]!r}::DOUBLE, {PRIOR['bad'][k % 3]!r}::DOUBLE)" for k in range(_N))
    ctes = f"""w0 AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
u AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM w0),
g AS (SELECT doc_id, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g WHERE c IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM t, (VALUES (0), (1), (2)) AS s(d) WHERE k > 1 GROUP BY doc_id),
f AS (SELECT w0.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '[.!?]'))::BIGINT AS n_stops,
  len(regexp_extract_all(text, '\\p{{L}}'))::BIGINT AS n_letters,
  len(regexp_extract_all(text, '[0-9]'))::BIGINT AS n_digits,
  len(list_filter(words, lambda w: lower(w) IN ({', '.join(f"'{w}'" for w in FUNCTION_WORDS)})))::BIGINT AS n_function,
  len(list_filter(words, lambda w: length(w) > 14))::BIGINT AS n_long, len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;]["'')\\]]?[\\x20\\x09-\\x0D]*$')))::BIGINT AS n_ended FROM w0 LEFT JOIN r USING (doc_id)),
v AS (SELECT *, {vote} FROM f),
pat AS (SELECT {ks}, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
tot AS (SELECT sum(n) AS n FROM pat),
lon AS (SELECT {ks}, n, unnest([{ks}]) AS k FROM pat),
m0 AS (SELECT {GOOD_PRIOR}::DOUBLE AS p, k, g, b FROM (VALUES {prior}) AS x(k, g, b))"""
    for i in range(1, ROUNDS + 1):
        ctes += f""",
e{i} AS (SELECT {ks}, n, 1 / (1 + exp(-(ln(max(p)) - ln(1 - max(p)) + sum(ln(g) - ln(b))))) AS r FROM lon JOIN m{i - 1} USING (k) GROUP BY {ks}, n),
s{i} AS (SELECT sum(n * r) AS g, sum(n * (1 - r)) AS b FROM e{i}),
c{i} AS (SELECT k, sum(e{i}.n * r) AS g, sum(e{i}.n * (1 - r)) AS b FROM (SELECT *, unnest([{ks}]) AS k FROM e{i}) e{i} GROUP BY k),
m{i} AS (SELECT (s{i}.g + {PRIOR_WEIGHT} * tot.n * {GOOD_PRIOR}) / (tot.n + {PRIOR_WEIGHT} * tot.n) AS p, k,
  (coalesce(c{i}.g, 0) + {PRIOR_WEIGHT} * tot.n * m0.g) / (s{i}.g + {PRIOR_WEIGHT} * tot.n) AS g, (coalesce(c{i}.b, 0) + {PRIOR_WEIGHT} * tot.n * m0.b) / (s{i}.b + {PRIOR_WEIGHT} * tot.n) AS b
  FROM m0 LEFT JOIN c{i} USING (k), s{i}, tot)"""
    ctes += f""",
z AS (SELECT {ks}, 1 / (1 + exp(-(ln(max(p)) - ln(1 - max(p)) + sum(ln(g) - ln(b))))) AS p_good FROM lon JOIN m{ROUNDS} USING (k) GROUP BY {ks}),
q AS (SELECT *, n_words < {int(least_words)} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM v JOIN z USING ({ks}))"""
    return f"WITH {ctes} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND p_good >= 0.5) AS kept FROM q"

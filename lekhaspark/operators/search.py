"""Keyword search of a table of questions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.questions import search_terms
from ..functions.text import let, tokens


#: Terms that are tested inside the rows of texts; with more, all words are exploded and joined.
MOST_TERMS = 5000


def keyword_hits(docs: DataFrame, key: str, text: str, questions: DataFrame, question: str, asked: str, stop: list[str], top: int = 10) -> DataFrame:
    """(question, key, score, rank): the `top` texts of each question with any of its terms; score is the sum of
    ln(1 + occurrences) over 1 + ln(words of the text). Words that no question has leave before the shuffle, each text is
    counted once for all questions, and the rank limit is applied before rows of a question meet."""
    terms = questions.select(F.col(question), F.explode(search_terms(F.col(asked), stop)).alias("term"))
    words = tokens(F.lower(F.translate(F.col(text), "‌‍़", "")))
    held = docs.select(F.col(key), words.alias("words")).select(key, F.size("words").alias("n"), "words")
    asked_for = terms.select("term").distinct()
    few = [r["term"] for r in asked_for.limit(MOST_TERMS + 1).collect()]
    if len(few) <= MOST_TERMS:
        # terms of a bounded number leave each text's own array, before rows are made of words
        held = held.withColumn("words", F.filter("words", lambda w: w.isin(few)))
    # a stated number of tasks, which Spark does not merge: a text's words, counts and scores stay in one task and are more than the bytes tell
    held = held.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    # the outer form, since Spark would else infer a filter that makes the words a second time
    rows = held.select(key, "n", F.explode_outer("words").alias("term")).where("term is not null")
    if len(few) > MOST_TERMS:
        rows = rows.join(asked_for, "term", "left_semi")
    counts = rows.groupBy(key, "n", "term").agg(F.count("*").alias("tf"))
    score = F.round(F.sum(F.log1p("tf")) / (1 + F.log(F.col("n"))), 6)
    hits = counts.join(terms, "term").groupBy(question, key, "n").agg(score.alias("score"))
    order = Window.partitionBy(question).orderBy(F.desc("score"), key)
    return hits.select(question, key, "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)


def positions(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, n, term, at): the places of each of the terms (a column term) in every text of n words, one row for a text and term."""
    words = tokens(F.lower(F.translate(F.col(text), "‌‍़", "")))
    placed = docs.select(F.col(key), words.alias("words")).select(key, F.size("words").alias("n"), F.transform("words", lambda w, i: F.struct(w.alias("term"), (i + 1).alias("at"))).alias("words"))
    few = [r["term"] for r in terms.limit(MOST_TERMS + 1).collect()]
    if len(few) <= MOST_TERMS:
        placed = placed.withColumn("words", F.filter("words", lambda w: w["term"].isin(few)))
    rows = placed.select(key, "n", F.explode("words").alias("w")).select(key, "n", "w.term", "w.at")
    if len(few) > MOST_TERMS:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy(key, "n", "term").agg(F.array_sort(F.collect_list("at")).alias("at"))


def cover_density(places: Column, least: Column) -> Column:
    """places: array of struct(at, term) in order -> the sum of the weights of all covers. A cover is a stretch with at least `least`
    different terms that holds no shorter one; it weighs a tenth, divided by one more than the other words in it.

    The stretch that ends at a place begins where the `least`-th of the terms seen so far was seen last, latest first; it is a cover
    if the stretch that ends at the place before begins earlier."""
    numbered = F.transform(places, lambda p, k: F.struct(p["at"].alias("at"), k.alias("k"), p["term"].alias("term")))
    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"))

    def covers(x: Column) -> Column:
        start = F.struct(F.transform(x["kinds"], lambda t: none).alias("last"), none.alias("begin"), F.lit(0.0).alias("sum"))

        def step(state: Column, p: Column) -> Column:
            last = F.zip_with(state["last"], x["kinds"], lambda at, t: F.when(t == p["term"], F.struct(p["at"].alias("at"), p["k"].alias("k"))).otherwise(at))
            return let(F.struct(last.alias("last"), F.coalesce(F.get(F.sort_array(last, asc=False), least - 1), none).alias("begin")), lambda n: F.struct(
                n["last"].alias("last"), n["begin"].alias("begin"),
                (state["sum"] + F.when(n["begin"]["at"] > state["begin"]["at"], F.lit(0.1) / (1 + (p["at"] - n["begin"]["at"]) - (p["k"] - n["begin"]["k"]))).otherwise(0.0)).alias("sum"),
            ))

        return F.aggregate(x["places"], start, step, lambda s: s["sum"])

    return let(F.struct(numbered.alias("places"), F.array_distinct(F.transform(places, lambda p: p["term"])).alias("kinds")), covers)


def cover_ranks(docs: DataFrame, key: str, text: str, questions: DataFrame, question: str, asked: str, stop: list[str], least: int | None = 1, top: int = 10) -> DataFrame:
    """(question, key, score, rank): the `top` texts of each question by cover density over 1 + ln(words of the text). Covers hold `least` different
    terms of the question: 1 is a search for any term, None for all of them. Texts without a cover are no hits; of equal scores the least key."""
    terms = questions.select(F.col(question), F.explode(search_terms(F.col(asked), stop)).alias("term"))
    sizes = terms.groupBy(question).agg(F.count("*").cast("int").alias("least")) if least is None else terms.select(question).distinct().withColumn("least", F.lit(least))
    held = positions(docs, key, text, terms.select("term").distinct())
    each = held.join(terms, "term").groupBy(question, key, "n").agg(F.flatten(F.collect_list(F.transform("at", lambda a: F.struct(a.alias("at"), F.col("term").alias("term"))))).alias("places"))
    met = each.join(sizes, question).where(F.size(F.array_distinct(F.transform("places", lambda p: p["term"]))) >= F.col("least"))
    score = F.round(cover_density(F.array_sort("places"), F.col("least")) / (1 + F.log(F.col("n"))), 6)
    order = Window.partitionBy(question).orderBy(F.desc("score"), key)
    ranked = met.select(question, key, score.alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top)

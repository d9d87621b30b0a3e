"""What a question names: phrases of registries, playbooks, official terms, topics; as joins on words, so that questions and
registries may both be tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.unicode import nfc

# Topics of questions, each with the words that name it, in the order of the topic list.
QUERY_TOPICS = [
    ("gem", r"\bgem\b|जेम"),
    ("procurement", r"\bprocurement\b|\bpurchase rules\b|क्रय|अधिप्राप्ति|खरीद"),
    ("financial-rules", r"\bfinancial (?:rules|powers|guidelines)\b|\bgfr\b|\bdfpr\b|वित्तीय नियम|वित्तीय अधिकार"),
    ("pension", r"\bpension\b|पेंशन"),
    ("conduct-discipline", r"\bconduct rules\b|\bdisciplinary\b|आचरण|अनुशासन"),
    ("vigilance", r"\bvigilance\b|सतर्कता"),
    ("rti", r"\brti\b|right to information|सूचना का अधिकार"),
    ("cybersecurity", r"\bcyber ?security\b|\bcert-in\b|साइबर"),
    ("data-protection", r"\bdata protection\b|\bdpdp\b|डेटा संरक्षण"),
    ("digital-it", r"\bgigw\b|\be-?office\b|\bit policy\b|ई-?ऑफिस"),
    ("grievances", r"\bgrievances?\b|जन शिकायत"),
    ("accessibility", r"\baccessibility\b|दिव्यांग"),
    ("audit", r"\baudit\b|लेखा परीक्षा|ऑडिट"),
    ("pay-allowances", r"\bdearness allowance\b|महंगाई भत्ता|महँगाई भत्ता"),
]
MOST_TERMS = 4


def padded(c: Column) -> Column:
    """Words in lower case with one space before, between and after them; joiners, nukta and apostrophes dropped."""
    c = F.regexp_replace(F.lower(nfc(c)), "[\\u200c\\u200d\\u093c’'`]", "")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}]+", " ")), F.lit(" "))


def phrase_hits(questions: DataFrame, phrases: DataFrame) -> DataFrame:
    """questions (query, question), phrases (entry, phrase) -> (query, entry, phrase, n_words, n_chars, rest, before): phrases that stand in a
    question as whole words. Both sides meet on the first word, not in a cross join; rest is what follows the phrase, before what precedes it."""
    # texts leave their row inside the exploded values, in the outer form: a filter on a column would be moved before it and start Python a second time for it
    q = questions.select("query", padded(F.col("question")).alias("_q"))
    each = F.transform(F.array_distinct(F.split(F.trim("_q"), " ")), lambda w: F.struct(w.alias("_w"), F.col("_q").alias("_q")))
    q = q.select("query", F.explode_outer(each).alias("h")).select("query", "h._q", "h._w").where("_w <> ''")
    p = phrases.select("entry", "phrase", F.explode_outer(F.filter(F.array(padded(F.col("phrase"))), lambda x: F.length(x) > 2)).alias("_p")).where("_p is not null")
    p = p.withColumn("_w", F.split(F.trim("_p"), " ")[0])
    met = q.join(p, "_w").where(F.contains("_q", "_p"))
    return met.select("query", "entry", "phrase", F.size(F.split(F.trim("_p"), " ")).alias("n_words"), F.length(F.trim("_p")).alias("n_chars"), F.expr("substring(_q, instr(_q, _p) + length(_p), 40)").alias("rest"), F.expr("right(substring(_q, 1, instr(_q, _p)), 20)").alias("before"))


def department_mentions(questions: DataFrame, registry: DataFrame) -> DataFrame:
    """registry (entry, phrase): of each question the longest department phrase it names, and whether the mention is strong (two
    words, or the word department beside it); of equal lengths the strong one, then the least entry."""
    hits = phrase_hits(questions, registry)
    strong = (F.col("n_words") >= 2) | F.col("phrase").rlike("(?i)(विभाग|department)$") | F.col("rest").rlike("(?i)^(विभाग|विभागों|departments?|dept)( |$)") | F.col("before").rlike("(department|dept) of $")
    best = Window.partitionBy("query").orderBy(F.desc("n_chars"), F.desc("strong"), "entry", "phrase")
    return hits.withColumn("strong", strong).withColumn("_n", F.row_number().over(best)).where("_n = 1").select("query", "entry", "phrase", "strong")


def spellings(names: DataFrame, registry: DataFrame) -> DataFrame:
    """names (name) -> (name, spelling): every phrase of the entry whose name or alias it is, and the name itself."""
    key = lambda c: F.trim(F.regexp_replace(F.trim(padded(c)), "(?i) ?(विभाग|department)$", ""))
    named = registry.select("entry", key(F.col("phrase")).alias("_k")).groupBy("_k").agg(F.min("entry").alias("entry"))
    met = names.select("name", key(F.col("name")).alias("_k")).join(named, "_k").join(registry, "entry").select("name", F.col("phrase").alias("spelling"))
    return met.union(names.select("name", F.col("name").alias("spelling"))).distinct()


def playbooks(questions: DataFrame, triggers: DataFrame, contexts: DataFrame, boosts: DataFrame) -> DataFrame:
    """triggers and contexts (entry, phrase), boosts (entry, boost, place) -> (query, entry, score): the playbook with the most
    words of matched triggers and its boost; one that lists context words needs one of them; of equals the first."""
    score = phrase_hits(questions, triggers).groupBy("query", "entry").agg(F.sum("n_words").alias("words"))
    around = phrase_hits(questions, contexts).select("query", "entry").distinct().withColumn("_in", F.lit(True))
    gated = contexts.select("entry").distinct().withColumn("_gate", F.lit(True))
    met = score.join(gated, "entry", "left").join(around, ["query", "entry"], "left").where("_gate is null or _in").join(boosts, "entry")
    met = met.withColumn("score", F.col("words") + F.col("boost"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "place")
    return met.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("query", "entry", "score")


def official_terms(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """terms (place, english, official, everyday: arrays) -> (query, terms): official words in the other language, and the official
    Hindi for everyday Hindi, that the question lacks; four at most. Terms meet questions on the words they share."""
    named = terms.select("place", F.explode(F.concat("english", "official", "everyday")).alias("phrase")).select(F.col("place").alias("entry"), "phrase")
    likely = phrase_hits(questions, named).select("query", F.col("entry").alias("place")).distinct()
    met = questions.select("query", padded(F.col("question")).alias("_q")).join(likely, "query").join(terms, "place")
    has = lambda c: F.exists(c, lambda t: F.contains(F.col("_q"), F.concat(F.lit(" "), F.lower(t), F.lit(" "))))
    en, hi, also = has("english"), has("official"), has("everyday")
    add = F.concat(
        F.when(en & ~hi, F.slice("official", 1, 1)).otherwise(F.array().cast("array<string>")),
        F.when((hi | also) & ~en, F.slice("english", 1, 1)).otherwise(F.array().cast("array<string>")),
        F.when(also & ~hi, F.slice("official", 1, 1)).otherwise(F.array().cast("array<string>")),
    )
    each = met.select("query", "place", F.posexplode(add).alias("at", "term"))
    first = each.groupBy("query", "term").agg(F.min(F.struct("place", "at")).alias("o"))
    return first.groupBy("query").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("o", "term"))), lambda x: x["term"]), 1, MOST_TERMS).alias("terms"))


def query_topics(question: Column) -> Column:
    """struct(topics, matched): topics that a question names, in order, and the words that name them."""
    found = [F.regexp_extract_all(question, F.lit(f"(?iu){p}"), F.lit(0)) for _, p in QUERY_TOPICS]
    topics = F.filter(F.array(*[F.when(F.size(f) > 0, name) for (name, _), f in zip(QUERY_TOPICS, found)]), lambda x: x.isNotNull())
    return F.struct(topics.alias("topics"), F.flatten(F.array(*found)).alias("matched"))


def trigrams(c: Column) -> Column:
    """Distinct three-letter pieces of the words, each word with two spaces before it and one after."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pieces = F.transform(F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" "))), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two texts."""
    return F.coalesce(F.size(F.array_intersect(trigrams(a), trigrams(b))) / F.nullif(F.size(F.array_union(trigrams(a), trigrams(b))), F.lit(0)), F.lit(0.0))


def similar_names(rows: DataFrame, queries: DataFrame, key: str, name: str, top: int = 10) -> DataFrame:
    """(query, key, similarity, rank): the `top` rows of each query (tables with the same key and name columns) by shared trigrams, then by key; rows that share none
    are no hits. Names are compared once however often they occur: distinct names meet on their trigrams, and each stands for its first `top` keys."""
    def pieces(d: DataFrame, n: str, size: str, t: str) -> DataFrame:
        each = d.where(F.col(name).isNotNull()).select(F.col(name).alias(n)).distinct().withColumn("_g", trigrams(F.col(n)))
        return each.select(n, F.size("_g").alias(size), F.explode("_g").alias(t))

    shared = pieces(queries, "_q", "_qn", "_t").join(pieces(rows, "_r", "_rn", "_t"), "_t").groupBy("_q", "_r", "_qn", "_rn").agg(F.count("*").alias("_s"))
    pairs = shared.select("_q", "_r", F.round(F.col("_s") / (F.col("_qn") + F.col("_rn") - F.col("_s")), 6).alias("similarity"))
    first = Window.partitionBy(name).orderBy(key)
    held = rows.where(F.col(name).isNotNull()).select(key, name).withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= top)
    best = Window.partitionBy("_q").orderBy(F.desc("similarity"), key)
    ranked = pairs.join(held, F.col("_r") == F.col(name)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("_q", key, "similarity", "rank")
    asked = queries.select(F.col(key).alias("query"), F.col(name).alias("_name"))
    return asked.join(ranked, F.col("_name") == F.col("_q")).select("query", key, "similarity", "rank")

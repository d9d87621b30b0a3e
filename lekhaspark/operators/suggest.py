"""Hindi words for what was typed in Latin letters, over a table of typed words and a table of known words.

Both sides get keys on four levels, from exact spelling to bare consonants, and meet in one join on level and key. A key
keeps only the words that can still be among the suggestions, so a key that many words share stays small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import transliteration as T
from ..functions.unicode import nfc

LIMIT = 5
MOST_BY_CONSONANTS = 3
LEAST_PREFIX = 3
#: Levels in the order of their priority.
ALIAS, SPELT, SCHWA, CONSONANTS, RULE = range(5)


def _settled(rows: DataFrame, column: str) -> DataFrame:
    """rows as they are: an unpivot of one column, beyond which Spark's planner moves neither this column's rules nor filters on it. A chain of rules is
    worked off once for a word, not once for each key that is made of it."""
    return rows.unpivot([c for c in rows.columns if c != column], [column], "_of", column).drop("_of")


def lexicon(words: DataFrame) -> DataFrame:
    """words (word, weight) -> (word, weight, latin, loose, loose_bare): weights of equal words added up; words that have no Latin form leave."""
    known = words.select(nfc(F.col("word")).alias("word"), "weight").groupBy("word").agg(F.sum("weight").alias("weight"))
    spelt = _settled(known.withColumn("latin", T.romanize(F.col("word"))), "latin").where("latin <> ''")
    spelt = _settled(spelt.withColumn("loose", T.loose_key(F.col("latin"))), "loose")
    bare = F.when(F.col("word").rlike(f"[{T.NASALS}]"), T.loose_key(T.romanize(T.rewrite(F.col("word"), T.WITHOUT_NASALS)))).otherwise(F.col("loose"))
    return _settled(spelt.withColumn("loose_bare", bare), "loose_bare").select("word", "weight", "latin", "loose", "loose_bare")


def _best(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("weight"), "word")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def _key(level: int, *parts) -> Column:
    return F.struct(F.lit(level).alias("level"), F.concat_ws("|", *parts).alias("key"))


def suggest(typed: DataFrame, known: DataFrame, aliases: DataFrame, limit: int = LIMIT) -> DataFrame:
    """typed (latin), known as `lexicon` gives it, aliases (latin, word) -> (latin, place, word): at most `limit` words, an alias first, then words
    that are spelt so (with or without their nasals), words alike without any a, words with the same consonants, first letter and about the same
    length where the others do not fill the list, and last the word by rule. Within a level by weight, then by letters."""
    keys = F.array(
        _key(SPELT, "loose"), F.when(F.col("loose_bare") != F.col("loose"), _key(SPELT, "loose_bare")),
        _key(SCHWA, T.rewrite(F.col("loose"), T.SCHWA)),
        F.when(F.length("_bare") >= 3, _key(CONSONANTS, "_bare", F.substring("loose", 1, 1), F.length("loose").cast("string"))),
    )
    # the consonants of the loose key, which a word has already
    known = _settled(known.withColumn("_bare", T.rewrite(F.col("loose"), T.BARE)), "_bare")
    each = known.select("word", "weight", F.explode_outer(keys).alias("k")).where("k is not null").select("word", "weight", "k.level", "k.key").where(~F.col("key").isin("", "|"))
    # more than this of one key cannot be seen: `limit` words, and as many that stand before them already
    index = _best(each, ["level", "key"], 2 * limit + 1)
    asked = typed.select("latin").distinct().withColumn("loose", T.loose_key(F.col("latin"))).where("loose <> ''")
    bare = T.consonant_key(F.col("latin"))
    near = F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: _key(CONSONANTS, bare, F.substring("loose", 1, 1), (F.length("loose") + d).cast("string")))
    wanted = F.concat(F.array(_key(SPELT, "loose"), _key(SCHWA, T.schwa_key(F.col("latin")))), F.when(F.length(bare) >= 3, near).otherwise(F.slice(near, 1, 0)))
    hits = asked.select("latin", F.explode(wanted).alias("k")).select("latin", "k.*").join(index, ["level", "key"]).select("latin", "level", "word", "weight").distinct()
    hits = hits.where(F.col("level") < CONSONANTS).union(_best(hits.where(F.col("level") == CONSONANTS), ["latin"], MOST_BY_CONSONANTS))
    named = aliases.select(F.lower("latin").alias("_a"), "word").groupBy("_a").agg(F.min("word").alias("word"))
    fixed = asked.join(named, F.lower(asked["latin"]) == named["_a"]).select("latin", F.lit(ALIAS).alias("level"), "word", F.lit(0).cast("long").alias("weight"))
    by_rule = asked.select("latin", F.lit(RULE).alias("level"), T.phonetic(F.col("latin")).alias("word"), F.lit(0).cast("long").alias("weight")).where("word <> ''")
    all_hits = fixed.union(hits.select("latin", "level", "word", F.col("weight").cast("long"))).union(by_rule)
    once = all_hits.groupBy("latin", "word").agg(F.min(F.struct("level", (-F.col("weight")).alias("w"))).alias("o"))
    close = F.count_if(F.col("o.level") < CONSONANTS).over(Window.partitionBy("latin"))
    once = once.withColumn("_close", close).where((F.col("o.level") != CONSONANTS) | (F.col("_close") < limit))
    order = Window.partitionBy("latin").orderBy("o.level", "o.w", "word")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("latin", "place", "word")


def complete(typed: DataFrame, known: DataFrame, limit: int = 3) -> DataFrame:
    """typed (latin) -> (latin, place, word): known words that go on from what was typed, three letters at least, by weight. Each prefix of the known
    words keeps its best ones, so the two sides meet in an equi-join."""
    prefixes = F.when(F.length("loose") > LEAST_PREFIX, F.transform(F.sequence(F.lit(LEAST_PREFIX), F.length("loose") - 1), lambda n: F.substr("loose", F.lit(1), n)))
    index = _best(known.select("word", "weight", F.explode(prefixes).alias("prefix")), ["prefix"], limit)
    asked = typed.select("latin").distinct().withColumn("prefix", T.loose_key(F.col("latin")))
    order = Window.partitionBy("latin").orderBy(F.desc("weight"), "word")
    return asked.join(index, "prefix").select("latin", F.row_number().over(order).alias("place"), "word")

"""References from one order to another: number, date and kind, as column expressions.

A text is cut at every reference once; matches and the gaps between them are arrays of one row, so
the words after a reference end where the next one starts, and no row meets another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import first_per
from .text import ascii_digits, go_key, let, plain_go_key, strip_joiners

# Words for number and date, dates, months and relation words in clean and broken spellings.
NUMBER_WORD = r"(?:सं\s?ख्?\s?या|सं\s?या|संख्या|सं0|सं\.|No\.?)"
DATE_WORD = r"(?:दिनांक|िदनांक|दनांक|िदनाक|दि0|dated|dt\.?)"
DATE = r"(\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{1,2}\s+[ऀ-ॿA-Za-z ]{2,12}?,?\s+\d{4})"
NUMBER = r"(\d[0-9A-Za-zऀ-ॿ()/\-.\s]{0,70}?)"
MONTHS = ["जन|jan", "फर|feb", "मार्च|माच|mar", "अप्र|अ ैल|apr", "मई|may", "जून|jun", "जुला|jul", "अग|aug", "सित|िसत|sep", "अक्टू|अ टू|अक्तू|oct", "नव|nov", "दिस|िदस|dec"]
KINDS = {
    "corrects": (r"शुद्धि\s*-?\s*पत्र|शु\s*ि?\s*-?\s*प\s*त?्?र", ["corrigendum"]),
    "cancels": (r"निरस्त|िनर\s?स?्?त", ["rescind", "cancel", "withdrawn"]),
    "supersedes": (r"अतिक्रम|अधिक्रम|अ\s?ि?[तध]\s?ि?\s?(?:क्?र)?\s?म[णि]", ["supersession", "supersed"]),
    "amends": (r"संशोधन|संशोधित|संशो\s?ि?\s?ध", ["modif", "amend"]),
}
STRENGTH = {"supersedes": 4, "cancels": 3, "amends": 2, "corrects": 2, "refers": 0}
# Characters of evidence before and after a reference, and those after it in which its kind stands.
BEFORE, AFTER, KIND_AFTER = 40, 80, 120
# the first letters are looked at before the words that begin with them: most places of a text have neither
REFERENCE = rf"(?=[सN]){NUMBER_WORD}\s*[:\-–]?\s*{NUMBER}\s*[,।]?\s*(?=[दिd]){DATE_WORD}\s*[:\-–]?\s*{DATE}"
# What a text has that is to be changed before it is searched: joiners, digits of another script, blanks and the marks of its pieces.
FOREIGN, UNEVEN = "[\u200c\u200d०-९]", ["\t", "  ", "\1", "\2", "\3", "\4"]


def reference_date(c: Column) -> Column:
    """Day-first numbers (two-digit years from 2000) or day, month word and year; null when impossible or before 1950."""
    return let(F.trim(ascii_digits(c)), _reference_date)


def _reference_date(c: Column) -> Column:
    numeric, worded = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})$", r"^(\d{1,2})\s+([ऀ-ॿA-Za-z ]{2,12}?),?\s+(\d{4})$"
    # day, month and year with one blank between; a two-digit year gets its century
    parts = F.when(c.rlike(numeric), F.regexp_replace(F.regexp_replace(c, numeric, "$1 $2 $3"), r" (\d{2})$", " 20$1"))
    parts = parts.when(c.rlike(worded), F.concat_ws(" ", F.regexp_extract(c, worded, 1), _month(F.regexp_extract(c, worded, 2)), F.regexp_extract(c, worded, 3)))
    return _day(parts)


def _day(parts: Column) -> Column:
    day = let(parts, lambda p: F.try_to_date(F.when(p.rlike(r" \d{4}$"), p), "d M yyyy"))
    return let(day, lambda d: F.when(F.year(d) >= 1950, d))


def _found_date(c: Column) -> Column:
    """`reference_date` of what matched DATE: the parts need not be told from anything else."""
    def parts(p: Column) -> Column:
        word = lambda w: F.concat_ws(" ", F.substring_index(p, " ", 1), _month(w), F.substring_index(p, " ", -1))
        worded = let(F.regexp_replace(p, r"[\d ]+", ""), lambda w: F.when(w != "", word(w)).otherwise(F.regexp_replace(p, r" (\d{2})$", " 20$1")))
        return worded

    return _day(let(F.regexp_replace(c, r"[./,\s-]+", " "), parts))


def _month(word: Column) -> Column:
    """Number of a month word, null for another word."""
    plain = F.regexp_replace(word, r"\s+", "")
    return let(plain, lambda w: F.coalesce(*[F.when(w.rlike(rf"(?i)^(?:{m})"), F.lit(str(i))) for i, m in enumerate(MONTHS, 1)]))


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def _kind(c: Column, low: Column, hindi: Column) -> Column:
    """The first kind whose words stand in c; low is c in lower case, and Hindi patterns are tried only where `hindi` holds."""
    named = lambda pattern, words: reduce(lambda a, w: a | F.contains(low, F.lit(w)), words, hindi & c.rlike(pattern))
    return F.coalesce(*[F.when(named(*words), F.lit(k)) for k, words in KINDS.items()])


def order_references(docs: DataFrame, key: str, text: str, own_number: str | None = None, own_date: str | None = None, evidence: bool = True) -> DataFrame:
    """(key, kind, go_number, go_key, go_date, evidence): the strongest relation, the first of equals, for each order
    that a text refers to; its own header is no reference. `own_date` is a date column. Null texts refer to nothing.
    Without `evidence` there is no such column, and it costs nothing."""
    # most texts need no change, and searches for single words cost a small part of a pattern's
    uneven = lambda c: reduce(lambda a, w: a | F.contains(c, F.lit(w)), UNEVEN, ~_ascii(c) & c.rlike(FOREIGN))
    cleaned = lambda c: F.translate(F.regexp_replace(ascii_digits(strip_joiners(c)), r"[ \t]+", " "), "\1\2\3\4", "    ")
    dated = lambda x: F.contains(x, F.lit("dated")) | F.contains(x, F.lit("dt")) | (~_ascii(x) & x.rlike(DATE_WORD))
    own = [F.col(own_number).alias("own_number"), F.col(own_date).alias("own_date")] if own_number and own_date else [F.lit(None).cast("string").alias("own_number"), F.lit(None).cast("date").alias("own_date")]
    # a text is made and looked at once: a filter on the column would be moved before it and make it once more for each name in it
    x = let(F.col(text), lambda c: F.when(uneven(c), cleaned(c)).otherwise(c))
    held = docs.select(F.col(key), F.explode_outer(F.filter(F.array(x), dated)).alias("x"), *own).where("x is not null")
    # the patterns cost more than the bytes tell: a stated number of tasks, which Spark does not merge; the best of each order needs this order anyway
    held = held.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    pieces = F.split(F.regexp_replace("x", REFERENCE, "\1$0\2$1\2$2\2"), "\1")
    parts = F.transform(F.slice("pieces", F.lit(2), F.size("pieces")), lambda p: F.split(p, "\2"))
    cut = held.select("*", pieces.alias("pieces")).select(key, "x", "own_number", "own_date", F.get("pieces", F.lit(0)).alias("lead"), parts.alias("parts"))
    gaps = F.concat(F.array("lead"), F.transform("parts", lambda p: p[3]))
    # numbers, keys and dates are elements of the array: what filters the exploded rows reads them and computes nothing again; the text's digits are ASCII by now
    found = F.transform("parts", lambda p: let(F.regexp_replace(p[1], r"[,.।\-\s]+$|\s+", ""), lambda n: F.struct(F.length(p[0]).alias("size"), n.alias("number"), plain_go_key(n).alias("go_key"), _found_date(p[2]).alias("go_date"))))
    cut = cut.select(key, "x", "own_number", "own_date", gaps.alias("gaps"), found.alias("found"))
    # where each reference begins: the lengths of all that stands before it
    places = F.aggregate(
        F.arrays_zip(F.slice("gaps", F.lit(1), F.size("found")).alias("g"), F.transform("found", lambda m: m["size"]).alias("n")), F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts")),
        lambda s, p: F.struct((s["end"] + F.length(p["g"]) + p["n"]).alias("end"), F.concat(s["starts"], F.array(s["end"] + F.length(p["g"]))).alias("starts")), lambda s: s["starts"],
    )
    low = lambda start: F.greatest(start - BEFORE, F.lit(0))
    own_key = go_key(F.col("own_number"))
    cut = cut.select(key, "x", "own_date", own_key.alias("own_key"), "gaps", "found", *[places.alias("places")] * evidence)
    # only short pieces leave the row of a text: what stands beside a reference, and its evidence
    shown = lambda m, k: let(F.get("places", k), lambda s: F.trim(F.substr("x", low(s) + 1, s - low(s) + m["size"] + AFTER)))
    each = F.transform("found", lambda m, k: F.struct(
        k.alias("at"), m["number"].alias("go_number"), m["go_key"].alias("go_key"), m["go_date"].alias("go_date"), F.right(F.get("gaps", k), F.lit(BEFORE)).alias("before"), F.substring(F.get("gaps", k + 1), 1, KIND_AFTER).alias("after"),
        *[shown(m, k).alias("evidence")] * evidence,
    ))
    good = lambda m: m["go_key"].isNotNull() & m["go_date"].isNotNull() & ~F.coalesce((m["go_key"] == F.col("own_key")) & (m["go_date"] == F.col("own_date")), F.lit(False))
    # the outer form, since Spark would else infer a filter that finds all references a second time
    rows = cut.select(key, F.explode_outer(F.filter(each, good)).alias("m")).select(key, "m.*").where("go_key is not null")
    for side in ("after", "before"):
        rows = rows.withColumns({f"{side}_low": F.lower(side), f"{side}_hindi": ~_ascii(F.col(side))})
    kinds = [_kind(F.col(side), F.col(f"{side}_low"), F.col(f"{side}_hindi")) for side in ("after", "before")]
    rows = rows.withColumn("kind", F.coalesce(*kinds, F.lit("refers")))
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in STRENGTH.items()])
    best = first_per(rows, [key, "go_key", "go_date"], [rank.desc(), "at"])
    return best.select(key, "kind", "go_number", "go_key", "go_date", *["evidence"] * evidence)


def resolved(references: DataFrame, key: str, orders: DataFrame, order: str) -> DataFrame:
    """References with `target`: the one other order of their go_key and go_date, null where there is none or several."""
    named = orders.select(F.col(order).alias("target"), "go_key", "go_date").where("go_key is not null and go_date is not null")
    # the two smallest orders of a key tell whether exactly one differs from the source; a key stays one row
    ends = named.groupBy("go_key", "go_date").agg(F.min("target").alias("lo"), F.max("target").alias("hi"), F.count_distinct("target").alias("n"))
    met = references.join(ends, ["go_key", "go_date"], "left")
    one = F.when((F.col("n") == 1) & (F.col("lo") != F.col(key)), F.col("lo"))
    one = one.when((F.col("n") == 2) & (F.col("lo") == F.col(key)), F.col("hi")).when((F.col("n") == 2) & (F.col("hi") == F.col(key)), F.col("lo"))
    return met.select(references["*"], one.alias("target"))

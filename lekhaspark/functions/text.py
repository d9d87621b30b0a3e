"""Column builders for text: normalisation, tokens, scripts, quality, dates and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits and scripts.
NATIVE_DIGITS = "०१२३४५६७८९"
DEVANAGARI = r"[ऀ-ॿ]"
LATIN = r"[A-Za-z]"


def let(c: Column, f) -> Column:
    """f(c) with c computed once, however often f names it. A fold, since an element of a transformed array finds out its type anew for each row."""
    return F.aggregate(F.array(F.lit(0)), c, lambda x, _: x, f)


def ascii_digits(c: Column) -> Column:
    return F.translate(c, NATIVE_DIGITS, "0123456789")


def strip_joiners(c: Column) -> Column:
    """Without zero-width joiners and non-joiners."""
    return F.translate(c, "‌‍", "")


def normalize_space(c: Column) -> Column:
    """Line ends unified, runs of blanks one space, three or more line ends two, ends trimmed."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def numeric_tokens(c: Column) -> Column:
    """Numbers with their inner signs, in ASCII digits, distinct in order; signs at the end do not belong to them."""
    found = F.regexp_extract_all(ascii_digits(c), F.lit(r"[0-9][0-9.,:/()\-]*"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.regexp_replace(t, r"[.,;:]+$", "")))


def digit_groups(c: Column) -> Column:
    """Runs of digits without thousands commas and leading zeros."""
    flat = F.regexp_replace(ascii_digits(c), r"([0-9]),(?=[0-9])", "$1")
    return F.transform(F.regexp_extract_all(flat, F.lit(r"[0-9]+"), F.lit(0)), lambda t: F.regexp_replace(t, r"^0+(?=[0-9])", ""))


def script_counts(c: Column) -> tuple[Column, Column]:
    return F.regexp_count(c, F.lit(DEVANAGARI)), F.regexp_count(c, F.lit(LATIN))


def language(c: Column) -> Column:
    """hi, en, mixed or unknown, by script; Latin counts from three letters in a row."""
    hindi, latin = c.rlike(DEVANAGARI), c.rlike(r"[A-Za-z]{3,}")
    return F.when(hindi & latin, "mixed").when(hindi, "hi").when(latin, "en").otherwise("unknown")


def hash_bucket(c: Column, buckets: int) -> Column:
    """The first 32 bits of the SHA-256 of a text, modulo buckets."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long") % F.lit(buckets)


def word_overlap(a: Column, b: Column, least: int = 15) -> Column:
    """Shared words over the smaller word set; 0 when either has fewer than `least`."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller < least, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / smaller)


def word_set(c: Column, chars: int = 4000) -> Column:
    """Distinct lower-case words of three letters or more of the first `chars` characters (the overlap test reads no more)."""
    return F.array_distinct(F.filter(tokens(F.lower(F.substring(c, 1, chars))), lambda t: F.length(t) >= 3))


def iso_date(c: Column) -> Column:
    """ISO or day-first dates with / . - as ISO; impossible ones and years before 1900 are null."""
    c = F.trim(ascii_digits(c))
    day_first = F.regexp_replace(c, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", "$3-$2-$1")
    whole = F.when(day_first.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(day_first, "yyyy-M-d"))
    return F.when(F.year(whole) >= 1900, whole)


def order_key(number: Column, date: Column) -> Column:
    """Leading number and ISO day, null without digits or a date."""
    lead = F.regexp_extract(ascii_digits(number), r"^\D*(\d+)", 1)
    return F.when((lead != "") & iso_date(date).isNotNull(), F.concat_ws("|", F.regexp_replace(lead, r"^0+(?=\d)", ""), iso_date(date).cast("string")))


def go_key(number: Column) -> Column:
    """serial/year: a leading serial before a slash and the first year of 1900-2099 after it."""
    return let(F.regexp_replace(ascii_digits(number), r"\s+", ""), plain_go_key)


def plain_go_key(c: Column) -> Column:
    """The same of a number in ASCII digits without blanks, by one pattern."""
    serial_year = r"^0*(\d+)/.*?((?:19|20)\d{2})[\s\S]*$"
    return F.when(c.rlike(serial_year), F.regexp_replace(c, serial_year, "$1/$2"))


def source_id_parts(encoded: Column) -> Column:
    """The four parts of an encoded source id: number, department, section, year."""
    return F.split(F.decode(F.try_to_binary(F.url_decode(encoded), F.lit("base64")), "UTF-8"), "#")


def text_quality(c: Column) -> Column:
    """0 to 100 for Devanagari text: penalties for few vowel signs, short and single-letter tokens, broken conjuncts and joiners."""
    letters, marks = F.regexp_count(c, F.lit(r"[ऄ-हक़-ॡ]")), F.regexp_count(c, F.lit(r"[ऀ-ःऺ-ॏॢॣ]"))
    words = F.regexp_extract_all(c, F.lit(r"[ऀ-ॿ]+"), F.lit(0))
    n = F.size(words)
    deva = F.regexp_count(c, F.lit(DEVANAGARI))
    mark_ratio = marks / F.greatest(deva, F.lit(1))
    mean = F.aggregate(words, F.lit(0.0), lambda s, w: s + F.length(w)) / F.greatest(n, F.lit(1))
    single = F.size(F.filter(words, lambda w: F.length(w) == 1)) / F.greatest(n, F.lit(1))
    leading = F.size(F.filter(words, lambda w: w.rlike(r"^[ऀ-ःऺ-ॏॢॣ]")))
    lead_ratio = leading / F.greatest(n, F.lit(1))
    joiners = F.regexp_count(c, F.lit(r"[‌‍]"))
    join_ratio = joiners / F.greatest(deva, F.lit(1))
    # The penalties and their limits.
    score = (
        F.lit(100.0)
        - F.when(mark_ratio < 0.07, 25).when(mark_ratio < 0.10, 12).otherwise(0)
        - F.when(mean < 2.6, 20).when(mean < 3.0, 10).otherwise(0)
        - F.least(F.lit(30.0), single * 100)
        - F.least(F.lit(35), 7 * F.regexp_count(c, F.lit(r"्[ा-ौ]")))
        - F.least(F.lit(30), 5 * F.regexp_count(c, F.lit(r"�")))
        - F.when((joiners >= 20) & (join_ratio > 0.02), F.least(F.lit(50), 20 + F.round(join_ratio * 150))).otherwise(0)
        - F.least(F.lit(30), 3 * F.regexp_count(c, F.lit(r"ऄ")))
        - F.when((leading >= 3) & (lead_ratio >= 0.01), F.least(F.lit(45), 15 + F.round(lead_ratio * 300))).otherwise(0)
    )
    return F.when(deva < 100, F.lit(100)).otherwise(F.round(F.greatest(F.lit(0.0), score))).cast("int")


def quality_class(score: Column) -> Column:
    return F.when(score >= 78, "ok").when(score >= 60, "review").otherwise("suspicious")

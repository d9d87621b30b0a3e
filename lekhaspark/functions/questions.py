"""What a question asks for: its search terms and its date range, as column expressions over a table of questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .references import reference_date
from .text import ascii_digits, let

# Month names of dates and months on their own; each may be cut after three letters.
ENGLISH_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
HINDI_MONTHS = ["जनवरी", "फरवरी", "मार्च", "अप्रैल", "मई", "जून", "जुलाई", "अगस्त", "सितम्बर|सितंबर", "अक्टूबर|अक्तूबर", "नवम्बर|नवंबर", "दिसम्बर|दिसंबर"]
_MONTH = [rf"{e[:3]}(?:t|{e[3:]})?|{h}" if len(e) > 3 else rf"{e}|{h}" for e, h in zip(ENGLISH_MONTHS, HINDI_MONTHS)]
MONTH = "|".join(_MONTH)
DATE_TEXT = rf"(?:\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTH})\.?,?\s+\d{{4}})"


#: One day or a list of days, as questions write them.
_ORDINAL = r"\d{1,2}(?:st|nd|rd|th)?"
_DAYS = rf"{_ORDINAL}(?:\s*(?:,|or|and|&|और|या|व|तथा)\s*{_ORDINAL})*"


def search_terms(c: Column, stop: list[str], most: int = 12) -> Column:
    """The first `most` distinct words in order: no stop words, no single letters or digits outside Devanagari."""
    words = F.regexp_extract_all(F.lower(F.translate(c, "‌‍़", "")), F.lit(r"[0-9a-zऀ-ॣ०-ॿ]+"), F.lit(0))
    good = F.filter(words, lambda w: ((F.length(w) >= 2) | w.rlike(r"^[ऀ-ॿ]")) & ~w.isin(stop or [""]))
    return F.slice(F.array_distinct(good), 1, most)


def _day(c: Column) -> Column:
    iso = F.when(c.rlike(r"^\d{4}-"), F.try_to_date(c, "yyyy-M-d"))
    return F.coalesce(iso, reference_date(F.regexp_replace(F.regexp_replace(c, r"(\d)(?:st|nd|rd|th)\b", "$1"), r"[.,]\s", " ")))


def date_range(question: Column, today: Column) -> Column:
    """struct<from: date, to: date, dates: array<date>, said: string> of the first kind of range that a question names, null when it
    names none: dates are the days where several are named, said the words that name it, in lower case.

    In this order: between two dates, since a date, several dates, a day or a list of days with a month before or after it, the
    month also misspelt (without a year the latest past one), one date, today, yesterday, the last N days (366 at most), this or last week (from Monday), this or last month,
    this year, a month, a year. A range without a year never starts in the future. `today` is a date."""
    d = DATE_TEXT
    # The words that make a range, in English and Hindi; those of weeks, months and years stand in `chosen`.
    pairs = [(rf"(?:between|from)\s+({d})\s+(?:and|to|till|until)\s+({d})", 2), (rf"({d})\s+से\s+({d})\s+तक", 2), (rf"(?:since|after|from)\s+({d})", 1), (rf"({d})\s+(?:के\s+बाद|से)", 1)]
    days_month = rf"(?:^|\s)({_DAYS})\s+(?:of\s+)?((?:{MONTH}|[a-z]{{3,12}}))\.?(?:,?\s+(\d{{4}}))?(?=[\s,.?!]|$)"
    month_days = rf"(?:^|\s)((?:{MONTH}|[a-z]{{3,12}}))\.?\s+({_DAYS})(?:,?\s+(\d{{4}}))?(?=[\s,.?!]|$)"
    month_alone = rf"(?:^|\s)({MONTH})\.?(?:,?\s+(\d{{4}}))?(?=\s|$)"
    one_year = r"(?:^|\s)(?:in\s+)?((?:19|20)\d{2})(?:\s+(?:के|में))?(?=\s|$)"
    monday, month, year = F.date_trunc("week", today).cast("date"), F.trunc(today, "month"), F.trunc(today, "year")
    part = F.regexp_extract
    none = F.array().cast("array<date>")
    span = lambda a, b, text, days=none: F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a, b).alias("from"), F.greatest(a, b).alias("to"), F.when(F.size(days) > 1, days).otherwise(none).alias("dates"), F.trim(text).alias("said")))
    number = lambda text: F.coalesce(*[F.when(text.rlike(rf"^(?:{m})$"), F.lit(i)) for i, m in enumerate(_MONTH, 1)])
    made = lambda y, m, day: F.try_to_date(F.concat_ws("-", y.cast("string"), m.cast("string"), day), "yyyy-M-d")

    def loose(text: Column) -> Column:
        """Number of a month, also of an English name in which up to two letters are wrong."""
        near = F.array_sort(F.array(*[F.struct(F.levenshtein(text, F.lit(e)).alias("d"), F.lit(i).alias("m")) for i, e in enumerate(ENGLISH_MONTHS, 1)]))
        return F.coalesce(number(text), F.when(text.rlike("^[a-z]{5,12}$") & (near[0]["d"] <= 2), near[0]["m"]))

    def listed(q: Column, pattern: str, days: int, name: int) -> Column:
        """Days of a list that exist in the month, each the latest past one where no year is named."""
        m, y = loose(part(q, pattern, name)), part(q, pattern, 3).try_cast("int")
        at = lambda x: F.when(y.isNotNull(), made(y, x["m"], x["d"])).when(made(F.year(today), x["m"], x["d"]) > today, made(F.year(today) - 1, x["m"], x["d"])).otherwise(made(F.year(today), x["m"], x["d"]))
        each = F.transform(F.regexp_extract_all(part(q, pattern, days), F.lit(r"\d{1,2}"), F.lit(0)), lambda d: F.struct(m.alias("m"), d.alias("d")))
        return F.when(m.isNotNull(), F.array_sort(F.filter(F.transform(each, at), lambda x: x.isNotNull())))

    def named_days(q: Column) -> Column:
        made_of = lambda days, pattern: F.struct(F.array_distinct(days).alias("days"), part(q, pattern, 0).alias("said"))
        first, second = listed(q, days_month, 1, 2), listed(q, month_days, 2, 1)
        return F.when(F.size(first) > 0, made_of(first, days_month)).when(F.size(second) > 0, made_of(second, month_days))

    def month_start(q: Column) -> Column:
        y = part(q, month_alone, 2).try_cast("int")
        most_recent = lambda m: made(F.coalesce(y, F.year(today) - F.when(m > F.month(today), 1).otherwise(0)), m, F.lit("1"))
        return F.when(~((part(q, month_alone, 1) == "may") & y.isNull()), let(number(part(q, month_alone, 1)), lambda m: F.when(m.isNotNull(), most_recent(m))))

    def chosen(q: Column, ends: Column, found: Column, near: Column, first: Column) -> Column:
        said = lambda p, a, b: F.when(q.rlike(p), span(a, b, part(q, p, 0)))
        last_days = r"\b(?:last|past)\s+(\d{1,3})\s+days?\b|पिछले\s+(\d{1,3})\s+दिन"
        days = F.concat(part(q, last_days, 1), part(q, last_days, 2)).try_cast("int")
        named = part(q, one_year, 1).try_cast("int")
        at = lambda dates, k: F.get(dates, F.lit(k) if k >= 0 else F.size(dates) - 1)
        return F.coalesce(
            *[span(ends[2 * k], ends[2 * k + 1], part(q, pairs[k][0], 0)) for k in (0, 1)], *[span(ends[k + 2], today, part(q, pairs[k][0], 0)) for k in (2, 3)],
            F.when(F.size(found) >= 2, span(at(found, 0), at(found, -1), part(q, f"(?s){d}.*{d}", 0), found)),
            F.when(near.isNotNull(), span(at(near["days"], 0), at(near["days"], -1), near["said"], near["days"])),
            F.when(F.size(found) == 1, span(at(found, 0), at(found, 0), part(q, d, 0))),
            said(r"\btoday\b|आज", today, today),
            said(r"\byesterday\b|(?:^|\s)कल(?:\s|$)", F.date_sub(today, 1), F.date_sub(today, 1)),
            F.when(days >= 1, span(F.date_sub(today, F.least(days, F.lit(366)) - 1), today, part(q, last_days, 0))),
            said(r"\bthis\s+week\b|इस\s+(?:सप्ताह|हफ्ते|हफ़्ते)", monday, today),
            said(r"\blast\s+week\b|पिछले\s+(?:सप्ताह|हफ्ते|हफ़्ते)", F.date_sub(monday, 7), F.date_sub(monday, 1)),
            said(r"\bthis\s+month\b|इस\s+(?:माह|महीने)", month, today),
            said(r"\blast\s+month\b|पिछले\s+(?:माह|महीने)", F.add_months(month, -1), F.date_sub(month, 1)),
            said(r"\bthis\s+year\b|इस\s+(?:वर्ष|साल)", year, today),
            F.when(first <= today, span(first, F.least(F.last_day(first), today), part(q, month_alone, 0))),
            F.when(named <= F.year(today), span(F.make_date(named, F.lit(1), F.lit(1)), F.least(F.make_date(named, F.lit(12), F.lit(31)), today), part(q, one_year, 0))),
        )

    def read(q: Column) -> Column:
        # each kind is looked for only where a cheap sign of it stands
        dated = q.rlike(r"\d{4}")
        ends = F.when(dated, F.transform(F.array(*[part(q, p, i) for p, n in pairs for i in range(1, n + 1)]), _day)).otherwise(F.array(*[F.lit(None).cast("date")] * 6))
        found = F.when(dated, F.array_distinct(F.array_sort(F.filter(F.transform(F.regexp_extract_all(q, F.lit(rf"({d})"), F.lit(1)), _day), lambda x: x.isNotNull())))).otherwise(none)
        near = F.when(q.rlike(rf"(?:^|\s){_ORDINAL}(?:[\s,.?!]|$)"), named_days(q))
        first = F.when(q.rlike(rf"(?:^|\s)(?:{MONTH})"), month_start(q))
        return let(F.struct(ends.alias("ends"), found.alias("found"), near.alias("near"), first.alias("first")), lambda x: chosen(q, x["ends"], x["found"], x["near"], x["first"]))

    return let(F.lower(ascii_digits(question)), read)

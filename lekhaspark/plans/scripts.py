"""Legacy fonts and transliteration as queries. No table has Hindi, so texts and words of the tables are respelt in Devanagari by rules
that both engines follow: each letter of a text decides a letter, with joined letters, short i and leading r in between."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layout, legacy_font
from ..functions import transliteration as T
from ..operators import suggest
from .registry import query

_C = "बचदभगहजकलमनपखरसतवशषयझ"
#: Latin text in Devanagari: consonants, joined r, vowel signs after consonants, vowels elsewhere.
RESPELL: T.Rules = [
    ("[^a-z .\n]+", " "), ("[.]", "।"), *zip("bcdfghjklmnpqrstvwxyz", _C), (f"र([{_C}])", "र्\\1"),
    *[(f"([{_C}]){v}", rf"\1{T.SIGNS_OF[s]}") for v, s in (("a", "aa"), ("i", "i"), ("u", "u"), ("e", "e"), ("o", "o"))],
    *[(v, T.TYPED_VOWELS[v][0]) for v in "aiueo"],
]
_TEXT = T.rewrite_sql("lower(coalesce(text, ''))", RESPELL)
_OPEN, _CLOSE = '<td>Rule 5 of the Act</td><td><FONT size=2 FACE="Kruti Dev 020"><b>', "</b></FONT> <font color=red>dk</font></td>"
# Typed words that always mean one word.
ALIASES = [("mein", "में"), ("nahi", "नहीं"), ("hai", "है"), ("the", "थे")]


def _hindi():
    return T.rewrite(F.lower(F.coalesce("text", F.lit(""))), RESPELL)


@query(f"SELECT doc_id, {_TEXT} AS text FROM documents")
def legacy_font_text(t):
    """Texts typed in the legacy font, read back."""
    typed = t("documents").select("doc_id", legacy_font.unicode_to_legacy(_hindi()).alias("typed"))
    return typed.select("doc_id", legacy_font.legacy_to_unicode("typed").alias("text"))


@query(f"SELECT doc_id, concat('{_OPEN}', {_TEXT}, '{_CLOSE}') AS page FROM documents")
def legacy_font_tags(t):
    """The same inside font tags of pages; what other fonts hold stays."""
    typed = legacy_font.unicode_to_legacy(_hindi())
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        typed = F.replace(typed, F.lit(char), F.lit(entity))
    pages = t("documents").select("doc_id", F.concat(F.lit(_OPEN), typed, F.lit(_CLOSE)).alias("page"))
    return pages.select("doc_id", legacy_font.legacy_tags_to_unicode("page").alias("page"))


def _known(t):
    words = lambda name, weight: t(name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("w"), F.lit(weight).alias("weight"))
    latin = words("benchmark", 3).union(words("documents", 1)).groupBy("w").agg(F.sum("weight").alias("weight")).where("weight >= 2")
    return suggest.lexicon(latin.select(T.rewrite(F.col("w"), RESPELL).alias("word"), "weight"))


def _typed(t):
    """Words of the items as they stand, and the beginnings of them."""
    words = t("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("w")).distinct()
    return words.select(F.explode(F.array("w", F.replace("w", F.lit("c"), F.lit("ch")), F.substring("w", 1, 4))).alias("latin")).distinct()


_LEXICON = f"""a0 AS (SELECT w, sum(p) AS weight FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS w, 3 AS p FROM benchmark UNION ALL SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')), 1 FROM documents) x GROUP BY w HAVING sum(p) >= 2),
a1 AS (SELECT {T.rewrite_sql('w', RESPELL)} AS word, sum(weight) AS weight FROM a0 GROUP BY 1),
a2 AS (SELECT word, CAST(weight AS BIGINT) AS weight, {T.rewrite_sql('word', T.ROMANIZE)} AS latin, {T.rewrite_sql(T.rewrite_sql('word', T.WITHOUT_NASALS), T.ROMANIZE)} AS plain FROM a1),
k AS (SELECT word, weight, {T.rewrite_sql('latin', T.LOOSE)} AS loose, {T.rewrite_sql('plain', T.LOOSE)} AS bare_loose FROM a2 WHERE latin <> ''),
k2 AS (SELECT *, {T.rewrite_sql('loose', T.SCHWA)} AS schwa, {T.rewrite_sql('loose', T.BARE)} AS bare FROM k),
b0 AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{{2,}}')) AS w FROM benchmark), b1 AS (SELECT w AS latin FROM b0 UNION SELECT replace(w, 'c', 'ch') FROM b0 UNION SELECT substring(w, 1, 4) FROM b0),
b2 AS (SELECT latin, {T.rewrite_sql('lower(latin)', T.LOOSE)} AS loose, {T.rewrite_sql('lower(latin)', T.PHONETIC)} AS rule FROM b1),
q AS (SELECT *, {T.rewrite_sql('loose', T.SCHWA)} AS schwa, {T.rewrite_sql('loose', T.BARE)} AS bare FROM b2 WHERE loose <> '')"""


@query(f"""WITH {_LEXICON}, al AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in ALIASES)}) AS v(a, word)),
c AS (SELECT q.latin, k2.word, weight FROM q JOIN k2 ON length(q.bare) >= 3 AND q.bare = k2.bare AND substring(q.loose, 1, 1) = substring(k2.loose, 1, 1) AND abs(length(q.loose) - length(k2.loose)) <= 2 QUALIFY row_number() OVER (PARTITION BY q.latin ORDER BY weight DESC, k2.word) <= 3),
h AS (SELECT latin, 0 AS level, al.word, 0 AS weight FROM q JOIN al ON lower(latin) = a UNION ALL SELECT latin, 1, word, weight FROM q JOIN k2 ON q.loose = k2.loose UNION ALL SELECT latin, 1, word, weight FROM q JOIN k2 ON q.loose = bare_loose
  UNION ALL SELECT latin, 2, word, weight FROM q JOIN k2 ON q.schwa = k2.schwa AND q.schwa <> '' UNION ALL SELECT latin, 3, word, weight FROM c UNION ALL SELECT latin, 4, rule, 0 FROM q WHERE rule <> ''),
o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY latin, word ORDER BY level, weight DESC) = 1),
n AS (SELECT *, count(CASE WHEN level < 3 THEN 1 END) OVER (PARTITION BY latin) AS near FROM o),
r AS (SELECT latin, word, row_number() OVER (PARTITION BY latin ORDER BY level, weight DESC, word) AS place FROM n WHERE level <> 3 OR near < 5)
SELECT latin, CAST(place AS INTEGER) AS place, word FROM r WHERE place <= 5""")
def typed_suggestions(t):
    known = _known(t)
    return suggest.suggest(_typed(t), known, known.sparkSession.createDataFrame(ALIASES, "latin string, word string"))


@query(f"""WITH {_LEXICON}, h AS (SELECT q.latin, k2.word, weight FROM q JOIN k2 ON length(q.loose) >= 3 AND starts_with(k2.loose, q.loose) AND k2.loose <> q.loose)
SELECT latin, CAST(place AS INTEGER) AS place, word FROM (SELECT *, row_number() OVER (PARTITION BY latin ORDER BY weight DESC, word) AS place FROM h) x WHERE place <= 3""")
def typed_completions(t):
    return suggest.complete(_typed(t), _known(t))


_LINES = 12
_CUT = "(SELECT doc_id, lang, x, [{at}] AS l, [{after}] AS r FROM (SELECT doc_id, lang, regexp_replace(coalesce(text, ''), '\\s+', '_', 'g') AS x FROM documents) d) c"
_SQL_CUT = _CUT.format(**{n: ", ".join(f"substring(x, {1 + 30 * (k + first)}, 30)" for k in range(_LINES)) for n, first in (("at", 0), ("after", _LINES))})


@query(f"""SELECT doc_id, CASE WHEN length(x) < {60 * _LINES} THEN x WHEN lang = 'en' THEN concat(array_to_string(l, chr(10)), chr(10), chr(10), array_to_string(r, chr(10)))
ELSE array_to_string(list_transform(range(1, {_LINES + 1}), lambda i: concat(l[i], r[i])), chr(10)) END AS text FROM {_SQL_CUT}""")
def two_columns(t):
    """Texts printed in two columns (English ones with a gutter, the others without), read in one."""
    d = t("documents").select("doc_id", "lang", F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "_").alias("x"))
    gap = F.when(F.col("lang") == "en", "    ").otherwise("")
    lines = [F.concat(F.substring("x", 1 + 30 * k, 30), gap, F.substring("x", 1 + 30 * (k + _LINES), 30)) for k in range(_LINES)]
    page = F.when(F.length("x") < 60 * _LINES, F.col("x")).otherwise(F.concat_ws("\n", *lines))
    return d.select("doc_id", layout.one_column(page).alias("text"))

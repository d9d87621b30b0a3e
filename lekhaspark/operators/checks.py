"""Checks of drafts, suggestions, corrections and evaluation cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DEVANAGARI, ascii_digits
from ..functions.unicode import JOINERS, nfc, strip_joiners_and_space

# The token of a draft without an answer, sentences that say "not found", words of titles that say nothing,
# cues of questions about later changes and about an earlier document.
NO_ANSWER = "NO_ANSWER_IN_EVIDENCE"
NOT_FOUND = [
    r"\b(?:provided|given|retrieved|available|cited)\s+(?:evidence|documents?|pages?|orders?|excerpts?)\b[^.]*\b(?:do(?:es)?\s+not|doesn't|don't)\b",
    r"\b(?:evidence|documents?|pages?|orders?|excerpts?)\s+(?:do(?:es)?\s+not|doesn't|don't)\s+(?:contain|address|cover|mention|provide|include|specify|discuss)",
    r"\bnot\s+(?:established|specified|mentioned|covered|addressed|available)\s+(?:by|in)\s+the\s+(?:provided\s+|given\s+|retrieved\s+)?(?:evidence|documents?|pages?|orders?)",
    r"\bno\s+(?:specific\s+|relevant\s+)?information\s+(?:about|on|regarding|is\s+available)",
    r"\bthere\s+is\s+no\s+(?:specific\s+)?information\b",
    r"कोई\s+(?:विशिष्ट\s+|स्पष्ट\s+|संबंधित\s+)?जानकारी\s+(?:नहीं|उपलब्ध\s+नहीं)",
    r"जानकारी\s+(?:नहीं\s+(?:दी|मिली|है)|उपलब्ध\s+नहीं)",
    r"(?:साक्ष्य|साक्ष्यों|प्रमाण|दस्तावेज़ों|दस्तावेजों|पृष्ठों|आदेशों)\s+में\s+[^।]*?(?:उल्लेख|जानकारी|प्रावधान)\s+नहीं",
    r"\bthe\s+(?:retrieved|provided|given|supplied|cited)\s+(?:page|pages|documents?|evidence|excerpts?|orders?|sources?)\b",
    r"\bthe\s+available\s+(?:evidence|orders?|documents?|pages?)\s+(?:only|mainly|mostly)\b",
    r"\bnone\s+of\s+the\s+(?:retrieved\s+|provided\s+|available\s+|given\s+|cited\s+)?(?:pages?|documents?|evidence|orders?|sources?)\b",
    r"\bno\s+(?:document|page|order|source|evidence)s?\s+(?:here\s+)?(?:provides?|contains?|mentions?|covers?|addresses?|specifies|gives?)\b",
    r"^(?:it|this|they|these)\s+(?:does|do)\s+not\s+(?:address|cover|contain|mention|provide|specify|deal\s+with|relate\s+to)\b",
    r"\b(?:do(?:es)?\s+not|doesn't|don't)\s+answer\s+(?:your|the|this)\s+question",
]
TITLE_STOPWORDS = "उत्तर प्रदेश सम्बन्ध संबंध शासनादेश आदेश order orders government pradesh uttar what does about under with".split()
LATER_CHANGE = (
    r"\b(?:amend(?:ed|ment|ments)?|changed?|changes|supersed(?:ed|es)?|replaced|cancel(?:led|ed)?|withdrawn|rescinded|revised|modified|"
    r"still (?:valid|in force|applicable)|current(?:ly)? (?:valid|applicable))\b|"
    r"संशोधन|संशोधित|बदलाव|परिवर्तन|अतिक्रमित|अधिक्रमित|निरस्त|रद्द|वापस\s+लिया|अब\s+भी\s+(?:लागू|प्रभावी)|लागू\s+है|प्रभावी\s+है|शुद्धि"
)
EARLIER_HINDI = r"(?:^|\s)(?:इस|उस|इसी|उसी|यह|वह|उक्त|उपरोक्त|उपर्युक्त|संदर्भित)\s+(?:आदेश|शासनादेश|परिपत्र|अधिसूचना|नियमावली|नियम|अध्याय|दस्तावेज़?|पत्र|कार्यालय\s+ज्ञाप)"
EARLIER_ENGLISH = (
    r"\b(?:this|that|the same|the above|above|said|aforesaid|cited)\s+(?:order|go|g\.o\.|circular|notification|rules?|chapter|document|office memorandum|om)\b|"
    r"\b(?:it|its)\b.*\b(?:amend|change|supersed|cancel|revis|modif)"
)
NOTE_START = r"^[\s*_>]*(?:\(|\[)?\s*[*_]*\s*(?:note|nb|caution|disclaimer|नोट|टिप्पणी|ध्यान दें|सावधानी)\s*[:：-]"
NOTE_TOPIC = r"mask|ocr|verif|extraction|original (?:source|page)|सत्याप|संघर्ष|मूल (?:स्रोत|पृष्ठ)|ओसीआर|छिपा"
_NOT_FOUND = "(?iu)" + "|".join(NOT_FOUND)
#: A draft longer than this is no mere "not found"; so many signs beside the token are no answer.
LONGEST_NON_ANSWER, SHORTEST_ANSWER = 1500, 160


def sentences(text: Column) -> Column:
    """Sentences and lines without source marks and bullets; fragments of up to three signs do not count."""
    parts = F.split(F.regexp_replace(text, r"\[S\d+[^\]]*\]", " "), r"(?<=[.!?।])\s+|\n+")
    parts = F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"^[-*•\d.)\s]+", "")))
    return F.filter(parts, lambda x: F.length(F.regexp_replace(x, r"[\s.।]", "")) > 3)


def prose_non_answer(draft: Column) -> Column:
    """Two sentences or more, and the first two or most of them only say that the pages do not answer."""
    marks = F.transform(sentences(draft), lambda x: x.rlike(_NOT_FOUND))
    n, missing = F.size(marks), F.size(F.filter(marks, lambda m: m))
    two = F.coalesce(F.get(marks, F.lit(0)) & F.get(marks, F.lit(1)), F.lit(False))
    return (F.length(draft) <= LONGEST_NON_ANSWER) & (n >= 2) & (two | (2 * missing > n))


def no_answer(draft: Column) -> Column:
    """Whether a draft carries the token and next to nothing besides, or prose that says the same."""
    rest = F.trim(F.replace(draft, F.lit(NO_ANSWER), F.lit(" ")))
    first = F.coalesce(F.get(sentences(rest), F.lit(0)).rlike(_NOT_FOUND), F.lit(False))
    return draft.contains(NO_ANSWER) & ((F.length(rest) < SHORTEST_ANSWER) | first | prose_non_answer(rest))


def without_token(answer: Column) -> Column:
    return F.when(answer.contains(NO_ANSWER), F.trim(F.regexp_replace(F.replace(answer, F.lit(NO_ANSWER), F.lit("")), r"\n{3,}", "\n\n"))).otherwise(answer)


def without_notes(answer: Column) -> Column:
    """The answer without paragraphs at its end that only speak of masking, OCR or verification; as it is when no citation
    would be left."""
    parts = F.split(F.regexp_replace(answer, r"\s+$", ""), r"\n\s*\n")
    note = lambda x: x.rlike("(?iu)" + NOTE_START) & x.rlike("(?iu)" + NOTE_TOPIC)
    # the first paragraph stays whatever it is; of the others all up to the last that is no note
    kept = F.greatest(F.lit(1), F.array_max(F.transform(parts, lambda x, i: F.when(~note(x), i + 1).otherwise(0))))
    stripped = F.array_join(F.slice(parts, 1, kept), "\n\n")
    return F.when(stripped.rlike(r"\[S\d+\s+p\.\d+\]"), stripped).otherwise(answer)


def asks_about_changes(question: Column) -> Column:
    return F.translate(question, JOINERS, "").rlike("(?i)" + LATER_CHANGE)


def refers_to_earlier_document(question: Column) -> Column:
    bare = F.translate(question, JOINERS, "")
    return bare.rlike(EARLIER_HINDI) | bare.rlike("(?i)" + EARLIER_ENGLISH)


def _numbers(c: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(ascii_digits(c), F.lit(r"\d+"), F.lit(0)))


def accepted_correction(question: Column, corrected: Column) -> Column:
    """The corrected question if it differs, keeps the numbers and the script, and is neither much longer nor half as long; else null."""
    new, old = (F.trim(F.regexp_replace(c, r"\s+", " ")) for c in (corrected, question))
    same_length = (F.length(new) <= F.length(old) * 1.8 + 20) & (F.length(new) >= F.length(old) * 0.5)
    ok = (new != "") & (F.lower(new) != F.lower(old)) & same_length & (_numbers(new) == _numbers(old)) & (new.rlike(DEVANAGARI) == old.rlike(DEVANAGARI))
    return F.when(ok, new)


def clean_suggestions(rows: DataFrame, most: int = 3) -> DataFrame:
    """rows (query, question, language, at, item) -> (query, place, item): trimmed items of 8 to 140 characters without
    links, in the language asked for, with a question mark, each once and not the question itself; the first `most`."""
    item = F.trim(F.regexp_replace(F.regexp_replace("item", r"^[\s\[\"'“”,]+|[\s\]\"'“”,]+$", ""), r"\s+", " "))
    rows = rows.withColumn("item", item).where(F.length("item").between(8, 140) & ~F.col("item").rlike(r"(?i)https?:|www\."))
    hindi = F.col("item").rlike(DEVANAGARI)
    rows = rows.where(~((F.col("language") == "hi") & ~hindi) & ~((F.col("language") == "en") & hindi & ~F.col("item").rlike("[A-Za-z]{3}")))
    rows = rows.withColumn("item", F.when(F.col("item").rlike(r"[?？]$"), F.col("item")).otherwise(F.concat("item", F.lit("?"))))
    key = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", "")
    rows = rows.withColumn("_k", key(F.col("item"))).where(F.col("_k") != key(F.col("question")))
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query", "_k").orderBy("at"))).where("_n = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("at"))).where(F.col("place") <= most).select("query", "place", "item")


def from_departments(evidence: DataFrame, departments: DataFrame) -> DataFrame:
    """Queries with evidence of one of their officer's departments (query, department), by name without joiners and case."""
    key = lambda c: F.lower(strip_joiners_and_space(F.col(c)))
    names = departments.select("query", key("department").alias("_k")).distinct()
    return evidence.withColumn("_k", key("department")).join(names, ["query", "_k"], "left_semi").select("query").distinct()


def names_the_question(question: Column, title: Column, least: int = 2) -> Column:
    """Whether a title shares two words of four letters or more with the question, common title words aside."""
    words = lambda c: F.array_except(F.regexp_extract_all(F.lower(nfc(c)), F.lit(r"[\p{L}\p{M}]{4,}"), F.lit(0)), F.array(*map(F.lit, TITLE_STOPWORDS)))
    return F.coalesce(F.size(F.array_intersect(words(question), words(title))) >= least, F.lit(False))


def case_checks(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """cases (case_id, expected_sources, expected_pages, not_found, required, forbidden_prefixes; arrays) with answers (case_id,
    answer, validated, sources, pages) -> (case_id, failed: names of the checks that fail, passed).

    An expected source or page must be among those of the answer, an answer must be validated, have five words and end as a
    sentence, hold every required word and begin with no forbidden prefix; where nothing is to be found it must say so."""
    met = cases.join(answers, "case_id", "left")
    text = F.coalesce("answer", F.lit(""))
    none = F.array().cast("array<string>")
    have = lambda c: F.size(F.coalesce(c, none)) > 0
    says_no = no_answer(text) | prose_non_answer(text)
    found = ~F.coalesce("not_found", F.lit(False))
    checks = {
        "answered": text != "",
        "expected source": ~(found & have("expected_sources")) | F.arrays_overlap(F.coalesce("expected_sources", none), F.coalesce("sources", none)),
        "expected page": ~(found & have("expected_pages")) | F.arrays_overlap(F.coalesce("expected_pages", none), F.coalesce("pages", none)),
        "validated": ~found | F.coalesce("validated", F.lit(False)),
        "not found": found | says_no,
        "found": ~found | ~says_no,
        "five words": F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))) >= 5,
        "final punctuation": F.rtrim(text).rlike(r"[.!?।\])]$"),
        "required words": F.forall(F.coalesce("required", none), lambda w: F.contains(F.lower(text), F.lower(w))),
        "forbidden prefix": ~F.exists(F.coalesce("forbidden_prefixes", none), lambda w: F.startswith(F.lower(text), F.lower(w))),
    }
    failed = F.filter(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None).cast("string")).otherwise(name) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return met.select("case_id", failed.alias("failed")).withColumn("passed", F.size("failed") == 0)

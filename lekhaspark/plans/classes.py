"""Classes of orders, topics, admission of listed pages and shortened answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classification as C
from ..operators.answers import whole_sentences
from .registry import query

# Subjects as offices write them, each with its category, class, tier and confidence; every order takes one in turn.
SUBJECTS = [
    ("उत्तर प्रदेश सेवा नियमावली, 2025 का प्रख्यापन", "", "rules", "A", "high"),
    ("सेवा शर्तों के स्पष्टीकरण", "", "clarification", "A", "high"),
    ("Guidelines on records", "", "guideline", "A", "high"),
    ("आवास योजना के दिशा-निर्देश", "", "scheme-guideline", "B", "high"),
    ("शुद्धि-पत्र", "", "corrigendum", "B", "high"),
    ("सूचना भेजे जाने हेतु अनुस्मारक", "", "reminder", "C", "high"),
    ("मेसर्स अबस को भूमि", "", "case-specific", "C", "high"),
    ("जनपद लखनऊ में सड़क", "", "case-specific", "C", "high"),
    ("उद्योग नीति-2022 हेतु धनराशि", "", "sanction", "C", "low"),
    ("वित्तीय वर्ष 2026-27 में धनराशि", "", "sanction", "C", "high"),
    ("समस्त विभागों को पत्र", "", "general-instruction", "A", "low"),
    ("सेवा पुस्तिका का रखरखाव", "", "general-instruction", "A", "low"),
    ("पोषण मिशन", "", "other", "B", "low"),
    ("विविध", "वित्तीय स्वीकृति", "sanction", "C", "low"),
    ("विविध", "अधिसूचना", "notification", "B", "low"),
    ("", "", "other", "B", "low"),
]


def _literal(k: int) -> str:
    return "[" + ", ".join(f"'{s[k]}'" for s in SUBJECTS) + "]"


_PICK = f"[1 + o_orderkey % {len(SUBJECTS)}]"


@query(f"SELECT o_orderkey, {_literal(2)}{_PICK} AS doc_type, {_literal(3)}{_PICK} AS tier, {_literal(4)}{_PICK} AS confidence FROM orders")
def classified_orders(t):
    at = (F.col("o_orderkey") % len(SUBJECTS)).cast("int")
    subject, category = (F.get(F.array(*[F.lit(s[k]) for s in SUBJECTS]), at) for k in (0, 1))
    orders = t("orders").select("o_orderkey", subject.alias("subject"), category.alias("category"))
    return C.classified(orders, "subject", "category").select("o_orderkey", "c.doc_type", "c.tier", "c.confidence")


def _re2(pattern: str) -> str:
    return "regexp_matches(x, '(?i)" + pattern.replace("'", "''") + "')"


def _topic_sql(code: str) -> str:
    found = _re2(C.TOPICS[code])
    return f"CASE WHEN {found} OR {_re2(C.TOPICS['gem'])} THEN '{code}' END" if code == "procurement" else f"CASE WHEN {found} THEN '{code}' END"


@query("SELECT conv_id, turn, topics FROM (SELECT conv_id, turn, concat_ws(',', " + ", ".join(map(_topic_sql, C.TOPICS)) + ") AS topics FROM (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations))")
def turn_topics(t):
    """Topics of every turn of a conversation, in a fixed order."""
    return t("conversations").select("conv_id", "turn", F.array_join(C.topics(F.col("text")), ",").alias("topics"))


_KIND = "CASE " + " ".join(f"WHEN {_re2(p)} THEN '{k}'" for k, p in C.DOCUMENT_KINDS.items()) + " ELSE 'other' END"
_REASON = "CASE " + " ".join(f"WHEN {_re2(p)}" + (f" AND NOT {_re2(C.RULE_WORDS)}" if r in C.RULE_SAFE else "") + f" THEN '{r}'" for r, p in C.DROPPED) + " END"


@query(f"SELECT page_id, {_KIND} AS kind, {_REASON} AS reason FROM (SELECT page_id, regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1) || ' ' || regexp_extract(coalesce(html, ''), '<h1[^>]*>([^<]*)</h1>', 1) AS x FROM pages)")
def page_admission(t):
    """Kind of every page and why it would be left out, by its title and heading."""
    html = F.coalesce("html", F.lit(""))
    title = F.concat(F.regexp_extract(html, "<title>([^<]*)</title>", 1), F.lit(" "), F.regexp_extract(html, "<h1[^>]*>([^<]*)</h1>", 1))
    return t("pages").select("page_id", C.admission(title).alias("a")).select("page_id", "a.kind", "a.reason")


@query()
def whole_answers(t):
    """Every turn cut back to its last whole sentence, as its length; a walk over lines, tested on fixtures."""
    return t("conversations").select("conv_id", "turn", F.length(whole_sentences(F.col("text"))).cast("long").alias("kept_chars"))

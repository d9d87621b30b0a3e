"""Questions about buying and about named rulebooks: which books they name, and evidence in the order of the books' authority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.unicode import nfc

OTHER_RANK = 9

# Books with the words that name them, and words with which another book is meant; words of questions about buying; what makes GeM's own books worth a search.
UP_GEM = "UP GeM orders"
BOOKS = [
    (UP_GEM, r"\b(up|u\.p\.|uttar pradesh)\s+gem\s+(go|gos|order|orders|shasanadesh)\b|\bgem\s+(go|gos|shasanadesh)\b|जेम.{0,25}शासनादेश", None),
    ("GeM GTC", r"\bgtc\b|general terms (and|&) conditions (on|of|for) gem|जी\.?\s?टी\.?\s?सी|जीटीसी", None),
    ("GFR 2017", r"\bgfrs?\b|\bgrf\b|general financial rules?|जी\.?\s?एफ\.?\s?आर|जीएफआर|सामान्य वित्तीय नियम", None),
    ("DFPR", r"\bdfpr\b|delegation of financial powers rules?", None),
    ("Manual for Procurement of Works", r"\bworks?\s+manual\b|\bmanual\s+(for|of)\s+(the\s+)?(procurement\s+of\s+)?works?\b|\bprocurement\s+of\s+works\b", None),
    ("Manual for Procurement of Non-Consultancy Services", r"non[\s-]?consultancy", None),
    ("Manual for Procurement of Consultancy Services", r"\bconsultancy\s+(services\s+)?manual\b|\bmanual\s+(for|of)\s+(procurement\s+of\s+)?consultancy\b", r"non[\s-]?consultancy"),
    ("UP Procurement Manual (Goods) 2016", r"\b(up|u\.p\.|uttar pradesh)\s+procurement\s+manual\b|procurement\s+manual.{0,30}\b2016\b|उत्तर प्रदेश प्रोक्योरमेंट मैनुअल|प्रोक्योरमेंट मैनुअल", None),
    ("Manual for Procurement of Goods", r"\bgoods\s+manual\b|\bmanual\s+(for|of)\s+(the\s+)?(procurement\s+of\s+)?goods\b", r"\b(up|u\.p\.|uttar pradesh)\s+procurement\s+manual\b|\b2016\b"),
]
BUYING = (
    r"\b(e[\s-]?)?tender(s|ing|er|ers)?\b|\bbid(s|der|ders|ding)?\b|\bprocur(e|ed|ing|ement)\b|\bpurchas(e|es|ed|ing)\b|\bgem\b|\be[\s-]?marketplace\b|\bemd\b|\bearnest money\b|\b(bid|performance) security\b|"
    r"\be?pbg\b|\bl[\s-]?1\b|\breverse auction\b|\bforward auction\b|\bquotation(s)?\b|\brate contract\b|\b(supplier|vendor|seller)s?\b|\bempanel(ment|led)?\b|\bproprietary\b|\bmobili[sz]ation advance\b|"
    r"\bpayment terms?\b|\bterms of payment\b|\bpayments?\s+to\s+(?:suppliers?|sellers?|vendors?|contractors?)\b|\b(?:advance|part|stage|milestone)\s+payments?\b|\bgtc\b|\boutsourc(e|ing)\b|"
    "निविदा|टेंडर|बिड|बोलीदाता|क्रय|खरीद|जेम|आपूर्ति|ठेकेदार|कोटेशन|ईएमडी|ई0एम0डी0|अर्नेस्ट मनी|परफॉ[रर्]मेंस सिक्योरिटी|आउटसोर्सिंग"
)
GEM = r"\bgem\b|जेम|e[\s-]?marketplace"


def named_books(question: Column) -> Column:
    """Names of the rulebooks that a question names, in the order of BOOKS."""
    hit = lambda p: question.rlike(f"(?iu){p}")
    return F.array_compact(F.array(*[F.when(hit(p) & ~hit(unless) if unless else hit(p), F.lit(name)) for name, p, unless in BOOKS]))


def is_buying(question: Column) -> Column:
    return nfc(question).rlike(f"(?iu){BUYING}")


def books_to_check(question: Column) -> Column:
    """Books that a question about buying is searched in besides: the state's orders always, GeM's terms where it names GeM."""
    return F.array_compact(F.array(F.lit(UP_GEM), F.when(question.rlike(f"(?iu){GEM}"), F.lit("GeM GTC"))))


def missing_books(named: DataFrame, books: DataFrame, evidence: DataFrame) -> DataFrame:
    """named (query, book), books (book, source_id) -> (query, book) of which no page is among the evidence (query, source_id)."""
    present = evidence.select("query", "source_id").distinct().join(books, "source_id").select("query", "book")
    return named.select("query", "book").distinct().join(present, ["query", "book"], "left_anti")


def by_authority(evidence: DataFrame, ranks: DataFrame) -> DataFrame:
    """evidence (query, place, source_id, page_number), ranks (source_id, rank) -> (query, label, source_id, page_number): documents by rank, those without one last, then by
    their first place; pages of a document together, in their order."""
    met = evidence.join(ranks.groupBy("source_id").agg(F.min("rank").alias("_rank")), "source_id", "left")
    first = F.min("place").over(Window.partitionBy("query", "source_id"))
    met = met.withColumn("_first", first)
    n = F.row_number().over(Window.partitionBy("query").orderBy(F.coalesce("_rank", F.lit(OTHER_RANK)), "_first", "place"))
    return met.select("query", F.concat(F.lit("S"), n.cast("string")).alias("label"), "source_id", "page_number")


def named_first(evidence: DataFrame, extra: DataFrame, most: int) -> DataFrame:
    """(query, label, source_id, page_number): pages of the named books (query, place, source_id, page_number), then the others of the evidence while the whole is not longer
    than `most`; the named ones are never cut."""
    rest = evidence.join(extra.select("query", "source_id", "page_number"), ["query", "source_id", "page_number"], "left_anti")
    columns = ["query", "place", "source_id", "page_number"]
    both = extra.select(*columns).withColumn("_o", F.lit(0)).union(rest.select(*columns).withColumn("_o", F.lit(1)))
    n = F.row_number().over(Window.partitionBy("query").orderBy("_o", "place", "source_id", "page_number"))
    kept = both.withColumn("_n", n).where((F.col("_n") <= most) | (F.col("_o") == 0))
    return kept.select("query", F.concat(F.lit("S"), F.col("_n").cast("string")).alias("label"), "source_id", "page_number")

"""What questions for orders ask, as a plan of filters: a table of questions in, one row of filters for each that asks for a list.

Every step takes its words out of what is left of the question, so later steps do not see them: phrases in quotes, the
number, wildcards, jurisdictions and topics, dates, the issuer, the section, the department; the rest are words of the subject. Departments come
from a registry table by joins on words; everything else is built-in expressions. Questions about what an order says have no row.

Jurisdictions and topics leave the question as whole words, so "UP" does not leave "support".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import glossary
from ..functions.questions import MONTH, date_range
from ..functions.text import ascii_digits, strip_joiners
from .matching import department_mentions, query_topics

MOST_WORDS = 8

# The words and patterns by which a question shows what it wants.
ORDER_WORD = r"\b(?:orders?|gos?|g\.o\.s?|government orders?|circulars?|notifications?|shasanadesh)\b|शासनादेश|आदेश|परिपत्र|अधिसूचना"
RECENT_WORD = r"\b(?:recent|recently|latest|newest|new|fresh|last\s+\d+|released|issued|published|came out|list|dated)\b|हाल|हालिया|नवीनतम|नए|नये|नवीन|ताज़ा|ताजा|जारी|निर्गत|सूची|दिनांकित"
CONTENT_QUESTION = (
    r"^(?:can|could|is|are|does|do|should|may|must|whether)\s+(?!there\s+(?:(?:any|a|an|some)\s+)?(?:new\s+|recent\s+|latest\s+)?(?:orders?|gos?|g\.o\.?|circulars?|notifications?|shasanadesh)\b)"
    r"|\bwhat\s+\w+\s+does\b|डिटेल|विवरण|बताने\s+का\s+कष्ट|क्या\s+(?!कोई\b|कोई\s|हाल|नय|नए|नवीन|ताज|नवीनतम|(?:है|हैं)\s*[?।]?\s*$)"
    r"|\bwhat\s+(?:incentives?|benefits?|support|assistance|facilit(?:y|ies)|concessions?|relaxations?|is\s+the\s+order|order\s+(?:is|was))\b"
    r"|\b(?:what does|what do|says?|provisions?|rules? for|eligibility|procedure|process|how to|how do|how much|how many|explain|summar(?:y|ise|ize)|conditions?|limit|entitle|amount of"
    r"|what (?:is|are) the (?!latest|recent|newest|new|last|orders?\b|gos?\b))\b|क्या\s+(?:प्रावधान|नियम|कहता|कहते|शर्त)|प्रावधान|प्रक्रिया|पात्रता|शर्तें|कैसे|कितना|कितनी|कितने|किस प्रकार"
)
FIND_VERB = r"^(?:please\s+|pls\s+|kindly\s+)?(?:find|search|look\s*up|lookup|locate|show|get|fetch|give)\b|\b(?:find|search\s+for|look\s+for|lookup|locate)\b|खोज|ढूंढ|ढूँढ|तलाश|दिखाइए|दिखाएं|दिखाओ"
ABOUT_CUE = r"\b(?:about|regarding|related\s+to|relating\s+to|concerning|pertaining\s+to|on\s+the\s+subject\s+of|with\s+subject|subject)\b|के\s+(?:संबंध|सम्बन्ध|बारे|विषय)\s+में|विषयक|संबंधी|सम्बन्धी|से\s+(?:संबंधित|सम्बन्धित)"
RELEASED_BY = r"\b(?:released?|issued?|signed|sent)\s+by\s+(?:the\s+)?(.+?)(?=\s+(?:on|in|dated|between|since|from|during|about|regarding|for|with)\b|[,.?!]|\s*$)"
RELEASED_BY_HINDI = r"(?:^|\s)((?:[\p{L}\p{M}0-9-]+\s+){1,5}?)द्वारा\s+(?:जारी|निर्गत)"
ISSUER_AFTER = r"\s(?:के\s+लिए|के\s+लिये|हेतु|के\s+(?:संबंध|सम्बन्ध|बारे)\s+में|विषयक|संबंधी|सम्बन्धी|पर)\s"
GOVERNMENT = r"^(?:(?:उ0\s*प्र0|उ\.\s*प्र\.|उत्तर\s+प्रदेश|प्रदेश|राज्य)\s+)?(?:शासन|सरकार)$|^(?:up|state|uttar pradesh)?\s*(?:government|govt)$"
SECTION = r"(?:^|\s)((?:[\p{L}\p{M}]+\s+){1,4}अनुभाग(?:\s*[-–]?\s*\d+)?)(?=\s|$)"
ENGLISH_SECTION = r"\bsection\s*[-–]?\s*(\d+)\b"
QUOTED = r"[\"“”«»]([^\"“”«»]{2,80})[\"“”«»]"
NUMBER = r"(?<![\d/])(\d{1,5}/[^\s,;]+)"
STARRED = r"\*[^*\n]{2,60}?\*"
WILDCARD = r"\S*\*\S*|\S*[\p{L}\p{M}]\?[\p{L}\p{M}]\S*"
CENTRAL = r"(?iu)\b(?:central government|union government|government of india|goi|central (?:rules|guidelines|orders|manuals?))\b|केंद्र सरकार|केन्द्र सरकार|केंद्रीय सरकार|केन्द्रीय सरकार|भारत सरकार"
STATE = r"\b(?:uttar pradesh|u\.p\.|up government|up govt|state government)\b|\bUP\b|उत्तर प्रदेश|उ0प्र0|उ\.प्र\.|प्रदेश सरकार|राज्य सरकार"
KINDS = r"(?iu)\b(?:guidelines?|rules|manuals?|policy|policies|circulars?|instructions)\b|दिशा-?निर्देश|नियमावली|नियम|नीति"
RULEBOOKS = r"(?iu)\bgtc\b|\bgfrs?\b|\bgrf\b|general financial rules?|\bdfpr\b|delegation of financial powers rules?|\bworks?\s+manual\b|\bprocurement\s+of\s+works\b|non[\s-]?consultancy|\bconsultancy\s+(?:services\s+)?manual\b|procurement\s+manual|\bgoods\s+manual\b|\bmanual\s+(?:for|of)\s+(?:the\s+)?(?:procurement\s+of\s+)?(?:goods|works?|consultancy)\b|जीएफआर|जीटीसी|सामान्य वित्तीय नियम|प्रोक्योरमेंट मैनुअल"
FILLER = (
    "recent recently latest newest new fresh released issued published came out list dated "
    "orders order gos go g o government govt circulars circular notifications notification shasanadesh "
    "department departments dept of in the by for from on and show me all any please give "
    "which what were was are is there have has been a an release to up uttar pradesh state "
    "or also our my tell about it its another other suggest kindly "
    "कृपया अथवा या तथा एवं और अन्य दूसरा "
    "शासनादेश शासनादेशों आदेश आदेशों परिपत्र अधिसूचना विभाग विभागों हाल हालिया में के की का से द्वारा हेतु "
    "नवीनतम नए नये नवीन ताज़ा ताजा जारी निर्गत सूची किए किये गए गये हुए हैं है कौन कौनसे क्या बताइए "
    "बताएं बताओ दिखाइए दिखाएं सभी कोई उत्तर प्रदेश शासन दिनांकित तक बाद ही दिनांक date dt "
    "find search look lookup locate get fetch want need i we you related regarding relating "
    "concerning pertaining subject with that this those these can could would should do does "
    "खोजें खोजिए खोजो ढूंढें ढूंढिए ढूँढें मुझे हमें चाहिए वाला वाले वाली संबंध सम्बन्ध बारे "
    "विषय विषयक संबंधी सम्बन्धी संबंधित सम्बन्धित लिए एक इस उस यह वह जो पर को ने संख्या सं0 number no यो ऑर्डर"
).split()
GENERIC_KINDS = "guidelines guideline rules rule manual manuals policy policies instructions circulars नियम नियमावली नियमों दिशा निर्देश दिशानिर्देश नीति निर्देशों".split()


def normal_name(c: Column) -> Column:
    """Lower case, without joiners, signs as spaces, single spaces."""
    c = F.replace(F.replace(strip_joiners(F.lower(c)), F.lit("एवम्"), F.lit("एवं")), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[(),.\-–/:;\"'!?।]", " "), r"\s+", " "))


def _within(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _without(c: Column, said: Column) -> Column:
    """c without these words, wherever they stand as whole words."""
    return F.aggregate(said, c, lambda text, p: F.replace(text, _within(p), F.lit(" ")))


def _step(q: DataFrame) -> DataFrame:
    """q as it is: an unpivot of one column, which is a projection that Spark's planner draws no conclusions from. Over a chain of steps
    that each rewrite `rest`, these take it several seconds and help nothing."""
    return q.unpivot([c for c in q.columns if c != "rest"], ["rest"], "_of", "rest").drop("_of")


def _subject_words(rest: Column) -> Column:
    words = F.split(F.regexp_replace(F.regexp_replace(rest, ABOUT_CUE, " "), r"[(),.?!।:;\"'/\-]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(FILLER) & ~w.rlike(r"^\d+(?:st|nd|rd|th)?$"))


def _asked(questions: DataFrame, today: Column) -> DataFrame:
    """The steps that need no registry: what each finds, and what it leaves as `rest`."""
    q = questions.select("query", strip_joiners(ascii_digits(F.coalesce("question", F.lit("")))).alias("text"), today.cast("date").alias("today"))
    q = q.withColumn("lower", F.lower("text"))
    q = q.withColumn("phrases", F.filter(F.transform(F.regexp_extract_all("lower", F.lit(QUOTED), F.lit(1)), F.trim), lambda p: F.length(p) >= 2))
    q = q.withColumn("rest", _within(F.regexp_replace(F.regexp_replace("lower", QUOTED, " "), r"\s*/\s*", "/")))
    # a serial, a slash, and a year somewhere after it
    numbers = F.transform(F.regexp_extract_all("rest", F.lit(NUMBER), F.lit(1)), lambda n: F.struct(n.alias("said"), F.regexp_replace(n, r"[.)\]:।]+$", "").alias("number")))
    good = F.filter(numbers, lambda n: ~n["number"].rlike(r"^\d{1,2}[./-]\d{1,2}[./-]\d{4}$") & n["number"].rlike(r"^\d+/.*(?:19|20)\d{2}"))
    q = q.withColumn("number", F.get(good, F.lit(0)))
    said = F.coalesce("number.said", F.lit("\0"))
    q = q.withColumn("dated", F.when(F.col("number").isNotNull(), F.replace("lower", F.col("number.number"), F.lit(" "))).otherwise(F.col("lower"))).withColumn("rest", F.replace("rest", said, F.lit(" ")))
    # a phrase between stars is one pattern, then single words with a star, or a question mark between letters
    starred = F.filter(F.regexp_extract_all("rest", F.lit(STARRED), F.lit(0)), lambda p: F.trim(F.translate(p, "*", "")).rlike(r"\s") & (F.length(F.regexp_replace(p, r"[*?\s]", "")) >= 3))
    q = q.withColumn("starred", starred)
    q = q.withColumn("rest", F.aggregate("starred", F.col("rest"), lambda text, p: F.replace(text, p, F.lit(" "))))
    single = F.transform(F.regexp_extract_all("rest", F.lit(WILDCARD), F.lit(0)), lambda p: F.regexp_replace(p, r"^[(\[\"']+|[)\]\"'.,;:!]+$", ""))
    patterns = F.concat(F.transform("starred", lambda p: F.concat(F.lit("*"), F.trim(F.translate(p, "*", "")), F.lit("*"))), F.filter(single, lambda p: F.length(F.translate(p, "*?", "")) >= 2))
    q = q.withColumn("patterns", patterns).withColumn("rest", F.regexp_replace("rest", WILDCARD, " "))
    q = _step(q).withColumn("topics", query_topics(F.col("text")))
    named = F.concat(F.regexp_extract_all("text", F.lit(CENTRAL), F.lit(0)), F.regexp_extract_all("text", F.lit(STATE), F.lit(0)), F.col("topics.matched"))
    codes = F.filter(F.array(F.when(F.col("text").rlike(CENTRAL), "IN"), F.when(F.col("text").rlike(STATE), "UP")), lambda c: c.isNotNull())
    q = q.withColumn("jurisdictions", codes).withColumn("rest", _without(F.regexp_replace("rest", r"\s+", " "), F.transform(named, F.lower)))
    q = q.withColumn("range", date_range(F.col("dated"), F.col("today")))
    said = normal_name(F.col("range.said"))
    q = q.withColumn("rest", F.when(F.col("range").isNotNull(), F.replace(F.replace(_within(normal_name(F.col("rest"))), _within(said), F.lit(" ")), said, F.lit(" "))).otherwise(F.col("rest")))
    # who issued it: in Hindi what stands before is the subject
    q = _step(q)
    q = q.withColumn("by", F.coalesce(_first(F.col("rest"), RELEASED_BY, 0), _first(F.col("rest"), RELEASED_BY_HINDI, 0)))
    q = q.withColumn("who", F.trim(F.coalesce(_first(F.col("rest"), RELEASED_BY), _first(F.col("rest"), RELEASED_BY_HINDI))))
    subject = _first(_within(F.col("who")), rf"^(.*{ISSUER_AFTER})")
    q = q.withColumn("kept", F.coalesce(subject, F.lit("")))
    q = q.withColumn("who", F.trim(F.substr(_within(F.col("who")), F.length("kept") + 1, F.length(_within(F.col("who"))))))
    q = q.withColumn("rest", F.when(F.col("by").isNotNull(), F.replace("rest", "by", _within(F.col("kept")))).otherwise(F.col("rest")))
    q = q.withColumn("section", _first(F.col("rest"), SECTION))
    q = q.withColumn("rest", F.when(F.col("section").isNotNull(), F.replace("rest", "section", F.lit(" "))).otherwise(F.col("rest")))
    by_number = F.regexp_extract("who", ENGLISH_SECTION, 1)
    government = F.col("who").rlike(GOVERNMENT) | (F.col("who") == "")
    issuing = F.when(government, None).when(by_number != "", F.concat(F.lit("अनुभाग-"), by_number)).when(F.col("who").contains("अनुभाग"), F.col("who"))
    q = q.withColumn("_government", F.coalesce(government, F.lit(True))).withColumn("issuing", issuing)
    english = _first(F.col("rest"), ENGLISH_SECTION, 0)
    free = F.col("section").isNull() & F.col("issuing").isNull() & english.isNotNull()
    q = q.withColumn("numbered", F.when(free, F.concat(F.lit("अनुभाग-"), F.regexp_extract("rest", ENGLISH_SECTION, 1))))
    return _step(q.withColumn("rest", F.when(F.col("numbered").isNotNull(), F.regexp_replace("rest", ENGLISH_SECTION, " ")).otherwise(F.col("rest"))))


def parse(questions: DataFrame, registry: DataFrame, today: Column | str) -> DataFrame:
    """questions (query, question), registry (entry, phrase: all names of a department) -> one row for each question that asks for
    orders: query, mode (recent or find), explicit, department, go_number, phrases, patterns, section, person, jurisdictions, topics,
    words, date_from, date_to, dates, similar (the words for search by meaning; null without any).

    Defined cases: null and empty questions ask for nothing; a one-word department beside other words is a subject word; registry entries
    named twice are one; without a registry no department is found."""
    q = _asked(questions, F.lit(today) if isinstance(today, str) else today)
    # departments named by the issuer, the section, the rest, and anywhere: one lookup for all
    parts = q.select("query", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.coalesce(c, F.lit("")).alias("words")) for k, c in enumerate((F.col("who"), F.coalesce("section", "issuing"), F.col("rest"), F.col("lower")))])).alias("p"))
    asked = parts.where("p.words <> ''").select(F.struct("query", "p.part").alias("query"), F.col("p.words").alias("question"))
    phrases = registry.select("entry", F.explode(F.array("phrase", F.regexp_replace("phrase", r"\s*विभाग$", ""))).alias("phrase")).where("length(phrase) >= 2").distinct()
    called = phrases.select("entry", normal_name(F.col("phrase")).alias("p")).distinct().groupBy("entry").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.length("p")).alias("n"), "p"))), lambda x: x["p"]).alias("called"))
    found = department_mentions(asked, phrases).join(called, "entry").select(F.col("query.query").alias("_query"), F.col("query.part").alias("part"), F.struct("entry", "strong", "phrase", "called").alias("m"))
    wide = found.groupBy("_query").agg(*[F.max(F.when(F.col("part") == k, F.col("m"))).alias(n) for k, n in enumerate(["_who", "_section", "_rest", "_any"])])
    q = q.join(wide, q["query"] == wide["_query"], "left")
    spaced = _within(normal_name(F.col("rest")))
    # a one-word name is a department only where nothing else is asked for
    others = F.filter(_subject_words(_without(spaced, F.coalesce("_rest.called", F.array()))), lambda w: ~w.rlike(f"^(?:{MONTH})$"))
    by_rest = F.when(F.col("_rest.strong") | (F.size(others) == 0), F.col("_rest"))
    of_issuer = F.when(F.col("_government"), None).otherwise(F.col("_who"))
    q = q.withColumn("department", F.coalesce(of_issuer["entry"], F.col("_section.entry"), by_rest["entry"]))
    named = F.when(of_issuer.isNotNull(), F.col("_who.called")).when(F.col("_section").isNotNull(), F.col("_section.called")).when(by_rest.isNotNull(), F.col("_rest.called"))
    q = q.withColumn("rest", F.when(F.col("department").isNotNull(), _without(spaced, F.coalesce(named, F.array()))).otherwise(F.col("rest")))
    # sections have Hindi names
    hindi = F.get(F.filter("_section.called", lambda p: p.rlike("[\\u0900-\\u097f]") & ~p.endswith("विभाग")), F.lit(0))
    in_hindi = F.trim(F.replace(_within(normal_name(F.col("section"))), _within(F.lower("_section.phrase")), _within(hindi)))
    section = F.when(F.col("_section.phrase").rlike("[A-Za-z]") & hindi.isNotNull() & F.col("section").isNotNull(), in_hindi).otherwise(F.col("section"))
    q = q.withColumn("section", F.coalesce(section, "issuing", "numbered"))
    person = ~F.col("_government") & F.col("issuing").isNull() & F.col("_who").isNull() & (F.length(F.regexp_replace("who", r"\s", "")) >= 3)
    q = q.withColumn("person", F.when(person, F.col("who")))
    narrowed = (F.size("jurisdictions") > 0) | (F.size("topics.topics") > 0)
    words = F.slice(F.filter(_subject_words(F.col("rest")), lambda w: ~(narrowed & w.isin(GENERIC_KINDS))), 1, MOST_WORDS)
    q = q.withColumn("words", words)
    order_word, verb = F.col("lower").rlike(ORDER_WORD), F.trim("lower").rlike(FIND_VERB)
    explicit = F.col("number").isNotNull() | (F.size("phrases") > 0) | (F.size("patterns") > 0) | verb
    left = F.replace(_within(normal_name(F.col("lower"))), normal_name(F.col("range.said")), F.lit(" "))
    bare = F.col("range").isNotNull() & F.col("_any").isNotNull() & (F.size(F.filter(_subject_words(_without(F.regexp_replace(left, r"\s+", " "), F.coalesce("_any.called", F.array()))), lambda w: ~w.rlike(f"^(?:{MONTH})$"))) == 0)
    listing = order_word | explicit | (narrowed & F.col("lower").rlike(KINDS)) | bare
    content = F.col("lower").rlike(CONTENT_QUESTION) & ~explicit
    about_rules = ~explicit & ~order_word & F.col("text").rlike(RULEBOOKS)
    found = (F.size("words") > 0) | F.col("number").isNotNull() | (F.size("phrases") > 0) | (F.size("patterns") > 0) | F.col("section").isNotNull() | narrowed | F.col("person").isNotNull()
    asks = found | F.col("range").isNotNull() | F.col("lower").rlike(RECENT_WORD) | F.col("department").isNotNull() | verb
    q = q.where(listing & ~content & ~about_rules & asks)
    stems = F.filter(F.transform("patterns", lambda p: F.trim(F.regexp_replace(p, r"[*?]+", " "))), lambda p: F.length(p) >= 3)
    hindi_words = F.flatten(F.transform("words", lambda w: F.slice(F.filter(glossary.known_spellings(w), lambda v: (v != w) & v.rlike("[\\u0900-\\u097f]")), 1, 2)))
    return q.select(
        "query", F.when(found, "find").otherwise("recent").alias("mode"), (explicit | F.col("by").isNotNull() | F.col("section").isNotNull()).alias("explicit"), "department",
        F.col("number.number").alias("go_number"), "phrases", "patterns", "section", "person", "jurisdictions", F.col("topics.topics").alias("topics"), "words",
        F.col("range.from").alias("date_from"), F.col("range.to").alias("date_to"), F.coalesce("range.dates", F.array().cast("array<date>")).alias("dates"),
        F.nullif(F.array_join(F.concat("phrases", stems, "words", hindi_words), " "), F.lit("")).alias("similar"),
    )


def request(row: Row, names: dict[int, list[str]] | None = None) -> dict:
    """The filters of one parsed question, for `filters.scope`; names: department entry -> its spellings."""
    known = glossary.spellings()
    other = {w: [v for v in known[w] if v != w] for w in {*row["words"], *(p for x in row["patterns"] for p in x.replace("*", " ").replace("?", " ").split())} if w in known}
    out = {
        "departments": (names or {}).get(row["department"], []), "number_prefix": row["go_number"] or "", "section": row["section"] or "", "words": " ".join(row["words"]), "phrases": row["phrases"],
        "patterns": row["patterns"], "jurisdictions": row["jurisdictions"], "topics": row["topics"], "spellings": other,
    }
    return {k: v for k, v in out.items() if v}

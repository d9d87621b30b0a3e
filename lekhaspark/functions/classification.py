"""What an order is, which topics it has and whether a listed document is worth keeping, as column expressions.

All patterns are tried on a line in which Devanagari letters have one spelling, without zero-width signs
and with single blanks. Nulls count as empty lines."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

# Letters with a nukta that the composed normal form writes as two signs, and those it writes as one.
DECOMPOSED = {c: unicodedata.normalize("NFC", c) for c in map(chr, range(0x958, 0x960))}
COMPOSED = {unicodedata.normalize("NFD", c): c for c in "\u0929\u0931\u0934"}

# Words of single cases that always win.
HARD_CASES = {
    "prison-release": r"(बन्दी|बंदी|सिद्धदोष|कारागार).*(रिहाई|दयायाचिका|दया याचिका|पैरोल)|समयपूर्व रिहाई",
    "named-person": r"(पुत्र|पुत्री|पत्नी)\s+(श्री|स्व0|स्व\.)|निवासी\s*[-–]?\s*(जनपद|ग्राम)|^(सेवानिवृत्त\s+)?(न्यायमूर्ति\s+)?(श्री|श्रीमती|सुश्री|डॉ0|डा0|डॉ\.)\s*[\p{L}\p{M}]+|(श्री|श्रीमती|सुश्री)\s+[\p{L}\p{M}]+(\s+[\p{L}\p{M}]+){0,3}\s*(\(|,)?\s*[^।]{0,60}\s(को|की)\s",
    "named-staff-group": r"\d+\s*(कार्मिकों|अधिकारियों|कर्मचारियों|शिक्षकों|प्रवक्ताओं)\s*(को|की)",
    "company": r"मेसर्स|मै0\s|प्रा\.?\s*लि|प्राइवेट\s*लिमिटेड|\bPvt\b|कम्पनी\s*लिमिटेड",
    "court-case": r"(वाद|याचिका|रिट|अवमानना)\s*(सं0|संख्या|सं\.)|मा0\s*(उच्च|सर्वोच्च)\s*न्यायालय|कामर्शियल कोर्ट|अधिकरण|ओ\s*ए\s*संख्या|O\.\s*A\.",
    "land-parcel": r"(खसरा|गाटा|मौजा|परगना|अराजी)\s*(संख्या|सं0|नं)?",
    "units-count": r"\d+\s*(औद्योगिक\s*)?(इकाइयों|इकाईयों|इकाइयाँ|फर्मों)",
    "nominate-members": r"(सदस्य|अधिकारी)\s*नामित|नामांकन|बैठक\s*(हेतु|के सम्बन्ध|के संबंध|की कार्यवृत्त)|कार्यवृत्त|पीठासीन\s*अधिकारी",
    "transfer-posting": r"स्थानान्तरण|स्थानांतरण|तैनाती|कार्यमुक्त|प्रतिनियुक्ति पर|पदोन्नति\s*दिनांक|ए0\s*सी0\s*पी0",
    "en-transfer-posting": r"(?i)\btransfer\s*(&|and)\s*posting|\bposting\s+orders?\b",
    "en-appointment": r"(?i)\b(nominat(ion|e|ed|ing)|appoint(ment|s|ed|ing)?|designating)\b[^.]{0,80}\b(as|of|to)\b|\blist\s+of\s+cpios?\b|\bconstitut(es|ion)\b[^.]{0,40}\b(board|committee|commission|council)\b|\b(minutes|meeting)\s+of\b",
}
# Words of single cases that give way when everyone is addressed.
SOFT_CASES = {
    "place": r"^(जनपद|जिला|कमिश्नरेट|पुलिस\s*कमिश्नरेट)\s*[-–]?\s*[\p{L}\p{M}]|(थाना|पुलिस\s*चौकी|चौकियां|वाहिनी)\s|केन्द्रीय\s*कारागार|जिला\s*कारागार",
    "district-project": r"जनपद\s*[-–]?\s*[\p{L}\p{M}]+.*(निर्माण|सुदृढ़ीकरण|सुदृढीकरण|चौड़ीकरण|चौडीकरण|विकास कार्य|मरम्मत|अनुरक्षण|स्थापना)",
    "construction": r"निर्माण(ाधीन)?\s*(कार्य|हेतु|के|की)|भवनों?\s*(के|का)\s*निर्माण|बाउण्ड्री\s*वाल|बाउण्ड्रीवाल|टेण्डर|टेंडर|प्राक्कलन",
    "procurement": r"\d+\s*अदद|क्रय\s*(किये|किए|हेतु|के)|प्रतिस्थापन|साज-?सज्जा|अस्त्र-?शस्त्र",
    "specific-institution-grant": r"(विश्वविद्यालय|संस्थान|अकादमी|महाविद्यालय|चिकित्सालय|कारागार)[,\s].*(को|हेतु|के लिए).*(धनराशि|अनुदान|किश्त|स्वीकृति)",
    "post-creation": r"(पद|पदों|कोर्ट|न्यायालयों)\s*(के\s*)?सृजन|कोड\s*आवंटन",
}
# Words of sanctions and releases of money.
MONEY = {
    "financial-year": r"^(विषय\s*[-:]?\s*)?(चालू\s*|वर्तमान\s*)?वित्ती\S*\s?\S?\s*वर्ष\s*\d{4}\s*-?\s*\d{0,4}\s*(में|मे|के|हेतु|की)\s",
    "financial-sanction": r"वित्तीय\s*स्वी[ाी]?कृति|प्रशासकीय\s*(एवं|व)\s*वित्तीय|वित्तीय\s*स्वीकृतियां",
    "fund-release": r"धनराशि|अवमुक्त|अवमुक्ति|किश्त|किस्त|आहरण|भुगतान\s*(हेतु|के सम्बन्ध)",
    "budget-head": r"अनुदान\s*(सं0|संख्या|सं\.)\s*-?\s*\d+|लेखाशीर्षक|आय-?व्ययक|पुनर्विनियोग|अनुपूरक\s*अनुदान|बजट\s*(आवंटन|प्राविधान)",
    "salary-grant-item": r"(गैर\s*)?वेतन\s*मद|एन0?पी0?एस0?\s*अंशदान",
}
# Words of documents that apply in general, the deciding one first.
GENERAL = {
    "rules": r"(?i)नियमावली|विनियमावली|विनियम,?\s*\d{4}|सेवा\s*नियम|नियम,?\s*\d{4}|अवकाश\s*नियम|नियमों|नियम\s*के\s|परन्तुक|रूल्स|\bRules\b|\bRegulations?\b|\bAct,?\s*\d{4}\b|\(Amendment\)\s*(Act|Rules|Order)",
    "clarification": r"(?i)स्पष्टीकरण|स्पष्ट\s*किए?\s*जाने|स्थिति\s*स्पष्ट|\bclarification\b",
    "guideline": r"(?i)दिशा-?\s*निर्देश|दिशानिर्देश|गाइड\s*लाइन|गाइडलाइन|मार्गदर्शिका|मार्गदर्शी|मानक\s*संचालन\s*प्रक्रिया|\bSOP\b|प्रक्रिया\s*(का\s*)?निर्धारण|प्रक्रिया\s*निर्धारित|नियमपुस्तिका|हस्तपुस्तिका|मैनुअल|Guidelines?|\bInstructions?\s+(for|on|regarding)\b|\bManual\b|\bProcedure\b",
    "policy": r"(?i)नीति\s*[-–,]?\s*\d{4}(?!\s*(के|की)?\s*(अन्त|अंत))|नीति\s*\(\s*(प्रथम|द्वितीय|तृतीय)?\s*संशोधन|Policy\s*,?\s*\d{4}",
}
# Single patterns of the decision list, and the types that a catalogue may state.
BROAD = r"^प्रदेश\s*(में|के)\s|प्रदेश\s*के\s*(समस्त|सभी|सेवारत|शासकीय|राजकीय)|सरकारी\s*कार्मिको|सरकारी\s*कार्मिकों|समस्त\s*(विभागों|विभागाध्यक्षों|जिलाधिकारियों|अधिकारियों|कार्यालयों)|सभी\s*(विभागों|अधिकारियों|कर्मचारियों)|राज्य\s*कर्मचारियों|शासकीय\s*(कर्मियों|सेवकों)|अधिकारियों\s*[/एवं]+\s*कर्मचारियों|सुनिश्चित\s*किये?\s*जाने|अनुपालन\s*सुनिश्चित|ऑनलाइन\s*प्रस्तुत|व्यवस्था\s*(के सम्बन्ध|लागू)"
PROCEDURE = r"उपयोगिता\s*प्रमाण-?\s*पत्र|सेवा\s*पुस्तिका|प्रारूप|समय-?\s*सीमा|सरलीकरण|शपथ\s*पत्र|मानक\s*मद|व्यवस्था\s*लागू"
SCHEME = r"(?<!परि)योजना|मिशन|कार्यक्रम|अभियान"
CORRIGENDUM = r"(?i)शुद्धि-?\s*पत्र|शुद्धिपत्र|Corrigendum"
REMINDER = r"अनुस्मारक"
PLAIN_GUIDELINE = r"दिशा-?\s*निर्देश|दिशानिर्देश|गाइडलाइन"
GUIDELINE_CATEGORY = r"दिशा-?\s*निर्देश|नीतिगत|नीतियों|नीतियोँ"
FINANCE_CATEGORY = r"वित्तीय\s*स्वीकृति|बजट|अनुदान|वित्तीय"
NOTIFICATION = r"अधिसूचना"
STATED_TYPES = ["rules", "policy", "guideline", "clarification", "general-instruction"]

# Topics in their order, each with its words.
TOPICS = {
    "procurement": r"procure|purchase|tender|\bbid|क्रय|खरीद|अधिप्राप्ति|निविदा|टेण्डर|टेंडर|ई-?प्रोक्योरमेंट|आपूर्ति आदेश|make in india|मेक इन इंडिया",
    "gem": r"\bgem\b|जेम|गवर्नमेंट ई-?मार्केट|government e-?marketplace",
    "financial-rules": r"financial (rules|powers|handbook)|delegation of financial|वित्तीय (नियम|हस्त ?पुस्तिका|अधिकार)|वित्तीय अधिकारों का प्रतिनिधायन|\bgfr\b|dfpr|बजट मैनुअल|budget manual",
    "budget-accounts": r"budget|sanction|allocation|grant no|accounts|बजट|वित्तीय स्वीकृति|प्रशासकीय (एवं|व) वित्तीय स्वीकृति|धनावंटन|धनराशि|अवमुक्त|अनुदान संख्या|लेखाशीर्षक|आहरण|कोषागार|treasury|pfms",
    "audit": r"\baudit|लेखा ?परीक्षा|ऑडिट|महालेखाकार|\bcag\b",
    "service": r"service rules|seniority|promotion|recruitment|transfer|posting|appointment|सेवा नियमावली|सेवा शर्त|वरिष्ठता|पदोन्नति|भर्ती|नियुक्ति|स्थानान्तरण|स्थानांतरण|तैनाती|संवर्ग|कार्मिक",
    "pay-allowances": r"\bpay\b|salary|allowance|dearness|\bda\b|वेतन|भत्ता|भत्ते|महंगाई|महँगाई|मानदेय|वेतनमान|एसीपी|acp",
    "pension": r"pension|gratuity|\bnps\b|\bgpf\b|retire|पेंशन|ग्रेच्युटी|सेवानिवृत्त|सामान्य भविष्य निधि|जीपीएफ|अंशदायी पेंशन",
    "conduct-discipline": r"conduct rules|discipline|disciplinary|suspension|आचरण|अनुशासन|निलम्बन|निलंबन|अनुशासनिक|दण्ड|दंड",
    "vigilance": r"vigilance|integrity pact|\bcvc\b|सतर्कता|भ्रष्टाचार",
    "digital-it": r"\bit\b policy|information technology|e-?office|website|software|digital|meity|gigw|cloud|आई\.?टी\.?|सूचना प्रौद्योगिकी|ई-?ऑफिस|डिजिटल|वेबसाइट|सॉफ्टवेयर",
    "data-protection": r"data protection|personal data|dpdp|open data|ndsap|डेटा संरक्षण|व्यक्तिगत डेटा",
    "cybersecurity": r"cyber|cert-in|information security|साइबर",
    "rti": r"right to information|\brti\b|सूचना का अधिकार|जन सूचना",
    "records-office": r"public records|record retention|office procedure|csmop|अभिलेख|कार्यालय पद्धति|पत्रावली",
    "grievances": r"grievance|cpgrams|शिकायत|जनसुनवाई|आईजीआरएस|igrs",
    "accessibility": r"disabilit|divyang|accessib|दिव्यांग|विकलांग",
    "schemes": r"scheme|yojana|योजना|मिशन|अभियान",
    "works": r"\bworks?\b|construction|road|bridge|building|निर्माण|मार्ग|सड़क|सेतु|भवन|मरम्मत|चौड़ीकरण|चौडीकरण|सुदृढ़ीकरण",
    "land-revenue": r"land|revenue|stamp|registration|भूमि|राजस्व|स्टाम्प|रजिस्ट्री|खतौनी|पट्टा",
    "education": r"education|school|college|university|teacher|शिक्षा|विद्यालय|महाविद्यालय|विश्वविद्यालय|शिक्षक|छात्र",
    "health": r"health|medical|hospital|ayush|चिकित्सा|स्वास्थ्य|अस्पताल|चिकित्सालय|आयुष",
    "agriculture": r"agricultur|farmer|crop|कृषि|किसान|फसल|उद्यान|पशु",
    "law-order": r"police|prison|jail|home guard|पुलिस|कारागार|बन्दी|बंदी|गृह विभाग|होमगार्ड",
}
TOPIC_ALIASES = {"financial": ["financial-rules"], "budget": ["budget-accounts", "financial-rules"], "consultancy": ["procurement"], "services": ["procurement"], "make-in-india": ["procurement"], "auction": ["gem"], "conduct": ["conduct-discipline"]}

# Reasons to leave a listed document out (the first one counts), kinds of documents, words of rules.
DROPPED = [
    ("tender", r"\b(e-?tender( notice)?s?|tender (notice|document|for|no\.?)|nit|rfp|rfq|eoi|expression of interest|bid document|corrigendum.{0,40}\b(tender|nit|bid|rfp)|quotations?|auction notice)\b|निविदा (सूचना|आमंत्रण|प्रपत्र)|ई-निविदा|अल्पकालीन निविदा|कोटेशन|नीलामी (सूचना|विज्ञप्ति)|ई-टेंडर"),
    ("recruitment/exam", r"\b(recruitment|vacanc(y|ies)|admit card|merit list|answer key|result|interview|walk-?in|shortlisted|selection list|exam(ination)? (schedule|date|centre))\b|भर्ती (विज्ञापन|सूचना)|विज्ञापन संख्या|रिक्तियों? (का|की|हेतु) विज्ञापन|प्रवेश पत्र|मेरिट (सूची|लिस्ट)|परीक्षा परिणाम|परिणाम घोषित|साक्षात्कार|चयन सूची|उत्तर कुंजी"),
    ("event/press", r"\b(press (release|note)|photo gallery|news ?letter|celebration|workshop on|webinar|invitation|programme schedule)\b|प्रेस विज्ञप्ति|समारोह|आमंत्रण|कार्यशाला का आयोजन|फोटो"),
    ("RTI list", r"\b(rti (reply|application|appeal)s?|right to information.*(list|reply))\b|जन सूचना अधिकारी की सूची"),
    ("individual personnel order", r"\b(transfer(red)?|posting|suspension|suspended|reinstatement|relieving|charge handed|attachment) (order )?(of|in respect of) (shri|smt|sri|mr|ms|dr)\b|(श्री|श्रीमती|सुश्री|डॉ0?)\s*\S+.*(का|के|की) (स्थानान्तरण|स्थानांतरण|तैनाती|निलम्बन|निलंबन|सम्बद्धीकरण|कार्यमुक्त)|(स्थानान्तरण|स्थानांतरण|तैनाती|निलम्बन|निलंबन) (आदेश )?(श्री|श्रीमती|सुश्री)"),
    ("individual personnel order", r"^(sh|shri|sri|smt|ms|mr|dr)\.?\s+[A-Z][a-z]+|(office order|कार्यालय आदेश).{0,80}(श्री|सुश्री|श्रीमती|shri|smt|ms\.|mr\.)|medical reimbursement (given|sanctioned|granted) to|चिकित्सा (प्रतिपूर्ति|व्यय).{0,40}(श्री|श्रीमती)"),
    ("seniority/gradation list", r"\b(seniority|gradation) list\b|ज्येष्ठता सूची|वरिष्ठता सूची|पदोन्नति सूची"),
    ("leave/court case of an individual", r"\b(writ petition|contempt|w\.?p\.? ?no)\b.*\b(shri|smt)\b|अवमानना याचिका"),
]
DOCUMENT_KINDS = {
    "budget-release": r"\b(release of (funds|amount|grant)|sanction(ed)? (of|for) (rs|amount|funds)|financial sanction|fund release|allocation of funds)\b|धनराशि.{0,40}(अवमुक्त|स्वीकृत|आवंटन|निर्गत)|(अवमुक्त|स्वीकृत).{0,20}धनराशि|वित्तीय स्वीकृति|बजट आवंटन|अनुदान.{0,20}(अवमुक्त|स्वीकृत)",
    "act-rules": r"\b(act|rules|regulations?|manual|handbook|code|niyamavali)\b,?\s*(\d{4}|$)|अधिनियम|नियमावली|नियमसंग्रह|विनियमावली|संहिता|हस्तपुस्तिका|मैनुअल",
    "gazette": r"\bgazette\b|गजट|गज़ट|असाधारण",
    "notification": r"\bnotification\b|अधिसूचना",
    "policy": r"\bpolicy\b|नीति[\s,-]*\d{4}|नीति$",
    "guideline": r"\b(guidelines?|sop|standard operating procedure|instructions?)\b|दिशा-?\s?निर्देश|मार्गदर्शिका|मार्गदर्शी सिद्धान्त",
    "circular": r"\b(circular|office memorandum|o\.?m\.?)\b|परिपत्र|कार्यालय ज्ञाप",
    "report": r"\b(annual report|report|statistics|data book|progress report)\b|प्रतिवेदन|वार्षिक रिपोर्ट|सांख्यिकी",
    "go": r"\b(g\.?o\.?|government order)\b|शासनादेश|शासनादेशों",
    "notice": r"\b(notice|public notice)\b|सूचना$|विज्ञप्ति",
}
LISTED_KINDS = ["go", "circular", "notification", "policy", "guideline", "budget-release", "notice"]
RULE_WORDS = r"शासनादेश|दिशा-?\s?निर्देश|नियमावली|नियम|नीति|प्रक्रिया|\b(guidelines?|policy|procedure|rules|manual|g\.?o\.?|government order|office memorandum|circular)\b"
RULE_SAFE = ["tender", "recruitment/exam"]

_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def one_spelling(c: Column) -> Column:
    """Letters with a nukta in one spelling, as in composed normal form of Unicode."""
    for x, y in (DECOMPOSED | COMPOSED).items():
        c = F.replace(c, F.lit(x), F.lit(y))
    return c


def line(c: Column) -> Column:
    """One spelling, no zero-width signs, single blanks."""
    c = F.translate(one_spelling(F.coalesce(c, F.lit(""))), "\u200b\u200c\u200d\ufeff", "")
    return F.trim(F.regexp_replace(c, r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))


def has(c: Column, pattern: str, fold: bool = False) -> Column:
    """A pattern is found; word edges are those of ASCII words in every Java version."""
    java = unicodedata.normalize("NFC", pattern).replace(r"\b", _EDGE)
    return c.rlike(("(?i)" if fold else "") + java)


def _names(c: Column, rules: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(has(c, p), F.lit(name)) for name, p in rules.items()]))


def classify_order(subject: Column, category: Column | None = None, provider: Column | None = None, rulebooks: tuple[str, ...] = (), portal: str = "") -> Column:
    """struct<doc_type, tier, confidence, reasons> of an order by its subject; the category is a weak hint.

    Documents of the `rulebooks` providers are of tier A with the type that their category states. Without a subject,
    those of other providers than the order `portal` count as guidelines."""
    category, provider = (F.lit("") if x is None else F.coalesce(x, F.lit("")) for x in (category, provider))
    facts = let(line(subject), lambda s: F.struct(s.alias("s"), _names(s, HARD_CASES).alias("hard"), _names(s, SOFT_CASES).alias("soft"), _names(s, MONEY).alias("money"), _names(s, GENERAL).alias("general"), has(s, BROAD).alias("broad"), has(s, SCHEME).alias("scheme")))
    return let(facts, lambda x: _decision(x, line(category), F.trim(category), provider.isin(*rulebooks) if rulebooks else F.lit(False), (provider != "") & (provider != portal), provider))


def classified(orders: DataFrame, subject: str, category: str) -> DataFrame:
    """orders with c, their class: each distinct subject and category is classified once and joined back, since orders
    repeat their subjects while the patterns cost more than the join."""
    keys = orders.select(subject, category).distinct()
    known = keys.select(F.col(subject).alias("_s"), F.col(category).alias("_c"), classify_order(F.col(subject), F.col(category)).alias("c"))
    met = orders.join(known, F.col(subject).eqNullSafe(F.col("_s")) & F.col(category).eqNullSafe(F.col("_c")))
    return met.select(*[orders[c] for c in orders.columns], "c")


def _decision(x: Column, category: Column, stated: Column, rulebook: Column, other: Column, provider: Column) -> Column:
    s, hard, soft, money, general, broad, scheme = (x[k] for k in ("s", "hard", "soft", "money", "general", "broad", "scheme"))
    any_of = lambda a: F.size(a) > 0
    top = F.get(general, F.lit(0))

    def of(kind, tier, confidence, *reasons):
        as_column = lambda v: F.lit(v) if isinstance(v, str) else v
        parts = [F.array(F.lit(r)) if isinstance(r, str) else r for r in reasons]
        return F.struct(as_column(kind).alias("doc_type"), F.lit(tier).alias("tier"), as_column(confidence).alias("confidence"), F.concat(*parts).alias("reasons"))

    # Types, tiers, confidences and reasons of the decisions, in their order.
    w = F.when(rulebook, of(F.when(stated.isin(STATED_TYPES), stated).otherwise("guideline"), "A", "high", "curated core rule"))
    w = w.when((s == "") & other, of("guideline", "A", "low", F.array(F.concat(F.lit("provider:"), provider))))
    w = w.when(s == "", of("other", "B", "low", "no-subject"))
    w = w.when(has(s, CORRIGENDUM), of("corrigendum", "B", "high", "corrigendum"))
    w = w.when(has(s, REMINDER) & ~any_of(general), of("reminder", "C", "high", "reminder"))
    w = w.when(any_of(hard), of("case-specific", "C", "high", hard, soft, money))
    w = w.when(any_of(soft) & ~broad, of("case-specific", "C", F.when(any_of(general), "low").otherwise("high"), soft, money))
    w = w.when(any_of(general) & any_of(money) & ~top.isin("rules", "clarification") & ~has(s, PLAIN_GUIDELINE), of("sanction", "C", "low", money, general))
    w = w.when((top == "guideline") & scheme & ~broad, of("scheme-guideline", "B", "high", general, "scheme"))
    w = w.when(any_of(general), of(top, "A", "high", general))
    w = w.when(any_of(money), of("sanction", "C", "high", money))
    w = w.when(broad, of("general-instruction", "A", "low", "broad-audience"))
    w = w.when(has(s, PROCEDURE) & ~scheme, of("general-instruction", "A", "low", "procedure-words"))
    w = w.when(scheme, of("other", "B", "low", "scheme-related"))
    w = w.when(has(category, GUIDELINE_CATEGORY), of("guideline", "A", "low", "category:guideline"))
    w = w.when(has(category, FINANCE_CATEGORY), of("sanction", "C", "low", "category:finance"))
    w = w.when(has(category, NOTIFICATION) | has(s, NOTIFICATION), of("notification", "B", "low", "notification"))
    return w.otherwise(of("other", "B", "low", "unmatched"))


def topics(*texts: Column, catalogue: Column | None = None) -> Column:
    """Topics of the texts and of the catalogue's own words (an array), in the order of TOPICS; gem is procurement too."""
    whole = F.translate(one_spelling(F.concat_ws(" ", *[F.when(t != "", t) for t in texts])), "\u200c\u200d", "")
    named = F.lit(None).cast("array<string>") if catalogue is None else catalogue

    def of(x):
        hit = {code: has(x, p, fold=True) for code, p in TOPICS.items()}
        for code in hit:
            words = [code] + [k for k, v in TOPIC_ALIASES.items() if code in v]
            hit[code] = hit[code] | F.coalesce(F.arrays_overlap(named, F.array(*map(F.lit, words))), F.lit(False))
        hit["procurement"] = hit["procurement"] | hit["gem"]
        return F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in hit.items()]))

    return let(whole, of)


def admission(title: Column, listed: Column | None = None, district: Column | None = None) -> Column:
    """struct<admitted, kind, reason> of a listed document by its title; `listed` is the kind that its list holds.

    A notice about tenders or recruitment is dropped, a rule about them is not; of a district's notices none is kept."""
    listed = F.lit("") if listed is None else F.coalesce(listed, F.lit(""))
    district = F.lit(False) if district is None else F.coalesce(district, F.lit(False))

    def of(x):
        kind = F.coalesce(*[F.when(has(x, p, fold=True), F.lit(k)) for k, p in DOCUMENT_KINDS.items()], F.when(listed == "rules", "act-rules"), F.when(listed.isin(LISTED_KINDS), listed), F.lit("other"))
        rule = has(x, RULE_WORDS, fold=True)
        reasons = [F.when(has(x, p, fold=True) & ~rule if r in RULE_SAFE else has(x, p, fold=True), F.lit(r)) for r, p in DROPPED]
        return F.struct(kind.alias("kind"), F.coalesce(*reasons).alias("reason"))

    found = let(one_spelling(F.coalesce(title, F.lit(""))), of)
    reason = lambda f: F.coalesce(f["reason"], F.when(district & (f["kind"] == "notice"), "district notice"))
    return let(found, lambda f: F.struct(reason(f).isNull().alias("admitted"), f["kind"].alias("kind"), reason(f).alias("reason")))

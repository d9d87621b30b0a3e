"""Spellings that order subjects use for the words people ask with."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of one group mean the same.
GROUPS = [
    "solar, सोलर, सौर",
    "pump, pumps, पम्प, पंप, पम्पों, पंपों",
    "subsidy, subsidies, अनुदान, सब्सिडी",
    "grant, grants, अनुदान",
    "pension, pensions, पेंशन, पेन्शन",
    "transfer, transfers, स्थानान्तरण, स्थानांतरण, तबादला",
    "promotion, promotions, पदोन्नति, प्रोन्नति",
    "recruitment, भर्ती",
    "appointment, appointments, नियुक्ति",
    "salary, pay, वेतन",
    "allowance, allowances, भत्ता, भत्ते",
    "leave, अवकाश",
    "seniority, ज्येष्ठता, वरिष्ठता",
    "suspension, निलम्बन, निलंबन",
    "teacher, teachers, शिक्षक, अध्यापक",
    "school, schools, विद्यालय, स्कूल",
    "hospital, hospitals, चिकित्सालय, अस्पताल",
    "doctor, doctors, चिकित्सक, चिकित्साधिकारी",
    "farmer, farmers, कृषक, किसान",
    "seed, seeds, बीज",
    "fertilizer, fertiliser, उर्वरक",
    "road, roads, मार्ग, सड़क, सडक",
    "bridge, bridges, सेतु, पुल",
    "building, buildings, भवन",
    "construction, निर्माण",
    "canal, canals, नहर",
    "irrigation, सिंचाई",
    "electricity, power, विद्युत, बिजली",
    "water, जल, पानी",
    "housing, आवास",
    "land, भूमि",
    "loan, loans, ऋण",
    "budget, बजट",
    "purchase, procurement, क्रय, खरीद",
    "tender, tenders, निविदा",
    "honorarium, मानदेय",
    "scholarship, scholarships, छात्रवृत्ति",
    "police, पुलिस",
    "prison, jail, कारागार, जेल",
    "election, elections, निर्वाचन, चुनाव",
    "retirement, सेवानिवृत्ति",
    "sanction, स्वीकृति",
    "scheme, योजना",
    "guidelines, guideline, दिशा-निर्देश, दिशानिर्देश, मार्गदर्शिका",
    "kusum, pm-kusum, कुसुम",
]


def spellings() -> dict[str, list[str]]:
    """Every word with all spellings of its groups, its own included."""
    out: dict[str, list[str]] = {}
    for group in GROUPS:
        words = group.split(", ")
        for w in words:
            out[w] = list(dict.fromkeys(out.get(w, []) + words))
    return out


def known_spellings(word: Column) -> Column:
    """The spellings of a word (lower case), the word alone where the glossary has none."""
    pairs = [x for w, other in spellings().items() for x in (F.lit(w), F.array(*map(F.lit, other)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), word), F.array(word))


def pattern_spellings(pattern: str, most: int = 6) -> list[str]:
    """A wildcard pattern with its Latin words in their other spellings, `most` patterns at the most."""
    known, out = spellings(), [pattern]
    for word in re.findall(r"(?<![^\s*?])[A-Za-z-]{3,}(?![^\s*?])", pattern):
        other = [w for w in known.get(word.lower(), []) if w != word.lower()]
        if other and len(out) < most:
            out = [made for base in out for made in (base, *(base.replace(word, w) for w in other))]
    return list(dict.fromkeys(out))[:most]

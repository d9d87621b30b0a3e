"""Hindi words and how they are typed in Latin letters, as lists of rewriting rules.

Every list is (pattern, replacement) pairs that Java's and RE2's patterns read alike, so the same list is a chain of Spark's
built-in regexp_replace or an expression of another SQL engine. A rule whose matches overlap stands twice.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, str]]

# Letters, signs and their casual spellings, in the order of the alphabet.
CONSONANTS = dict(zip("क ख ग घ ङ च छ ज झ ञ ट ठ ड ढ ण त थ द ध न प फ ब भ म य र ल ळ व श ष स ह".split(), "k kh g gh n ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l l v sh sh s h".split()))
DOTTED = dict(zip("कखगजडढफय", "q kh g z r rh f y".split()))
VOWELS = dict(zip("अ आ इ ई उ ऊ ऋ ए ऐ ओ औ ऑ ऍ".split(), "a aa i ee u oo ri e ai o au o e".split()))
SIGNS = dict(zip("\u093e \u093f \u0940 \u0941 \u0942 \u0943 \u0947 \u0948 \u094b \u094c \u0949 \u0945".split(), "aa i ee u oo ri e ai o au o e".split()))
NASALS, BREATH, HALANT, DOT, LIPS = "\u0902\u0901", "\u0903", "\u094d", "\u093c", "पफबभम"
TYPED_CONSONANTS = "chh छ ksh क्ष shh ष kh ख gh घ ch च jh झ th थ dh ध ph फ bh भ sh श k क g ग c क j ज t त d द n न p प b ब m म y य r र l ल v व w व s स h ह f फ\u093c z ज\u093c q क\u093c x क्स".split()
TYPED_VOWELS = {"aa": "आ\u093e", "ai": "ऐ\u0948", "au": "औ\u094c", "ee": "ई\u0940", "ii": "ई\u0940", "oo": "ऊ\u0942", "uu": "ऊ\u0942", "a": "अ", "i": "इ\u093f", "u": "उ\u0941", "e": "ए\u0947", "o": "ओ\u094b"}

_CON = "[" + "".join(CONSONANTS) + "]" + DOT + "?"
_SIGN = "".join(SIGNS)
#: A vowel is inherent inside a word, none stands at its end.
ROMANIZE: Rules = [
    ("[\u200c\u200d]", ""),
    *[(f"({_CON})([^{_SIGN}{HALANT}{DOT}a])", r"\1a\2")] * 2,
    (HALANT, ""),
    (f"[{NASALS}]([{LIPS}])", r"m\1"), (f"[{NASALS}]", "n"), (BREATH, "h"),
    *[(k + DOT, v) for k, v in DOTTED.items()],
    *[(k, v) for d in (CONSONANTS, VOWELS, SIGNS) for k, v in d.items()],
    ("[^a-z]", ""),
]
WITHOUT_NASALS: Rules = [(f"[{NASALS}]", "")]
#: Habits of spelling that do not change a word.
_HABITS: Rules = [("[^a-z]", ""), ("w", "v"), ("ph", "f"), ("q", "k"), ("z", "j"), ("x", "ks"), ("ei", "e"), ("ee|ii", "i"), ("oo|uu", "u")]
LOOSE: Rules = [*_HABITS, *[(c + c + "+", c) for c in "abcdefghijklmnopqrstuvwxyz"]]
SCHWA: Rules = [("a", "")]
BARE: Rules = [("([bcdgjkpst])h", r"\1"), ("[aeiou]", "")]


def _phonetic() -> Rules:
    # vowels of two letters become one capital first, from the left where they overlap
    pairs = [v for v in TYPED_VOWELS if len(v) == 2]
    mark = dict(zip(pairs, "ABDIIUU"))
    vowels = "".join(sorted({*"aiueo", *mark.values()}))
    alone = {**{v: TYPED_VOWELS[v][0] for v in "aiueo"}, **{m: TYPED_VOWELS[v][0] for v, m in mark.items()}}
    after = {**{v: TYPED_VOWELS[v][1:] for v in "iueo"}, **{m: TYPED_VOWELS[v][1:] for v, m in mark.items()}}
    out: Rules = [("[^a-z]", "")]
    # n and m after a vowel and before a consonant are a nasal
    out += [(f"([aeiou{NASALS[0]}])[nm]([b-df-hj-np-tv-z])", rf"\1{NASALS[0]}\2")] * 3
    out += [(v, m) for v, m in mark.items()]
    out += list(zip(TYPED_CONSONANTS[::2], TYPED_CONSONANTS[1::2]))
    out += [(f"({_CON})([{''.join(CONSONANTS)}])", rf"\1{HALANT}\2")] * 2
    # a vowel that no consonant stands before
    letters = "".join(alone.values())
    for _ in range(2):
        out += [(f"(^|[{vowels}{letters}{NASALS[0]}]){v}", rf"\1{x}") for v, x in alone.items()]
    out += [("a$", SIGNS_OF["aa"]), ("i$", SIGNS_OF["ee"])]
    out += [(v, x) for v, x in after.items()] + [("a", "")]
    return out


SIGNS_OF = {v: k for k, v in reversed(SIGNS.items())}
PHONETIC: Rules = _phonetic()


def _merged(rules: Rules) -> list[tuple[Rules, bool]]:
    """The rules in order; neighbours that put one character for one, of which none rewrites what another wrote, stand together (True)."""
    out: list[tuple[Rules, bool]] = []
    for pattern, by in rules:
        single = bool(re.fullmatch(r"[\w\u0900-\u097f]", pattern)) and len(by) == 1 and by != "\\"
        if single and out and out[-1][1] and not any(pattern in (p, b) for p, b in out[-1][0]):
            out[-1][0].append((pattern, by))
        else:
            out.append(([(pattern, by)], single))
    return out


def rewrite(c: Column, rules: Rules) -> Column:
    """c after all rules, one after another; runs of single characters in one pass."""
    for group, single in _merged(rules):
        if single and len(group) > 1:
            c = F.translate(c, "".join(p for p, _ in group), "".join(b for _, b in group))
            continue
        pattern, by = group[0]
        c = F.replace(c, F.lit(pattern), F.lit(by)) if re.fullmatch(r"[\w\u0900-\u097f]+", pattern) and "\\" not in by else F.regexp_replace(c, pattern, re.sub(r"\\(\d)", r"$\1", by))
    return c


def rewrite_sql(expression: str, rules: Rules) -> str:
    """The same as an SQL expression."""
    for pattern, by in rules:
        expression = f"regexp_replace({expression}, '{pattern}', '{by}', 'g')"
    return expression


def romanize(word: Column) -> Column:
    """A Hindi word (composed form) in casual Latin spelling."""
    return rewrite(word, ROMANIZE)


def loose_key(latin: Column) -> Column:
    return F.regexp_replace(rewrite(F.lower(latin), _HABITS), r"([a-z])\1+", "$1")


def schwa_key(latin: Column) -> Column:
    """The loose key without any a."""
    return rewrite(loose_key(latin), SCHWA)


def consonant_key(latin: Column) -> Column:
    """The consonants of the loose key, without breath."""
    return rewrite(loose_key(latin), BARE)


def phonetic(latin: Column) -> Column:
    """A typed word in Hindi by rule alone."""
    return rewrite(F.lower(latin), PHONETIC)


def is_typed_hindi(word: Column, before: Column) -> Column:
    """Whether a typed word may be Hindi: only letters, no acronym, and not the end of a number, pattern or handle."""
    return word.rlike("^[A-Za-z]+$") & ~((F.length(word) >= 2) & (word == F.upper(word))) & ~before.rlike(r"[\d/*?@#_\\-]$")

"""Hindi in a legacy font (its glyphs stand at Latin codes) as Unicode, and back.

A run of glyphs is read by a transducer that takes the longest known sequence at each place. The short i is typed before
its syllable and the sign of a leading r after it; one pattern of a whole syllable puts both where Unicode has them. English words
between the glyphs are found by a pattern over one letter for each word (what kind of English word it may be, and the brackets at its
ends), and stay.

Spark has no function that maps matches, so these run in Arrow batches. A word decides its own letters, so each task keeps
the words it has met, up to MOST_KNOWN of them.
"""

from __future__ import annotations

import html as _html
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MOST_KNOWN = 1 << 17

# The glyphs of the font. Half consonants: with a stroke ("k") after them they are whole ones.
STROKE = "k"
HALVES = (
    "D क् [ ख् X ग् ? घ् P च् T ज् ÷ झ् Ö झ् . ण् R त् F थ् / ध् è ध् Ë ध् U न् I प् ¶ फ् C ब् H भ् E म् ¸ य् Y ल् O व् ' श् Ü श् \" ष् L स् { क्ष् Ù त्त् Ÿ त्त्"
)
# Halves that are never completed by a stroke.
ONLY_HALVES = "º ह् ™ न्न् « त्र् [+ ख़् T+ ज़् ¶+ फ़्"
WHOLE = (
    "d क x ग ³ ङ p च N छ t ज > झ ¥ ञ V ट B ठ M ड < ढ r त n द u न i प Q फ c ब Ò भ e म ; य j र y ल G ळ o व l स g ह "
    "d+ क़ [+k ख़ x+ ग़ t+ ज़ M+ ड़ <+ ढ़ Q+ फ़ ;+ य़ j+ ऱ u+ ऩ "
    "Ä क्त – दृ — कृ Ñ कृ é न्न à ह्न á ह्य â हृ ã ह्म ºz ह्र í द्द = त्र Nî छ्य Vî ट्य Bî ठ्य Mî ड्य <î ढ्य | द्य K ज्ञ } द्व J श्र Vª ट्र Mª ड्र <ª ढ्र Nª छ्र Ø क्र Ý फ्र "
    "nzZ र्द्र æ द्र ç प्र Á प्र xz ग्र # रु : रू ô क्क ê ट्ट ë ट्ठ ì ड्ड ï ड्ढ ) द्ध )Z र्द्ध Ì द्द Í ट्ट Î ट्ठ Ï ड्ड Ô ड्ढ pkS चै"
)
VOWELS = "v‚ ऑ vks ओ v¨ ओ v® ओ vkS औ v© औ vk आ v अ b± ईं bZ ई Ã ई b इ m उ Å ऊ ,s ऐ , ए _ ऋ"
SIGNS = "k ा h ी q ु w ू ` ृ s े ¢ े S ै ks ो ¨ ो ® ो kS ौ © ौ ‚ ॉ W ॅ È ीं a ं ¡ ँ % ः z ्र ª ्र ~ ् + ़"
OTHERS = (
    "å ० Œ ० ƒ १ „ २ … ३ † ४ ‡ ५ ˆ ६ ‰ ७ Š ८ ‹ ९ ñ ॰ • ऽ · • A । & - @ / ¼ ( ½ ) ¿ { À } Þ “ ß ” ^ ‘ * ’ ] , \\ ?"
)
SHORT_I, SHORT_I_AND_R, LEADING_R = "f", "Æ", "Z"
FONTS = r"(?i)kruti|devlys|chanakya|walkman"
# Spellings that typists of these fonts used, and what they stand for.
TYPED = [("([\u093e-\u094c])\u094d\u0930", "\u094d\u0930\\1"), ("ाॅ", "ॉ"), ("दिनॉक", "दिनांक"), ("([\u0901-\u0903\u093e-\u094c])\\1+", "\\1")]
FUNCTION_WORDS = frozenset("of and the to in for on by with or at from an a".split())


def _pairs(text: str) -> dict[str, str]:
    parts = text.split(" ")
    return dict(zip(parts[::2], parts[1::2]))


_HALF = _pairs(HALVES)
GLYPHS = _pairs(WHOLE) | _HALF | {g + STROKE: u[:-1] for g, u in _HALF.items()} | _pairs(ONLY_HALVES) | _pairs(VOWELS) | _pairs(SIGNS) | _pairs(OTHERS)
# Marks for what stands elsewhere in Unicode; no text has these characters.
_I, _IR, _R = "\U000f0001", "\U000f0002", "\U000f0003"
GLYPHS |= {SHORT_I: _I, SHORT_I_AND_R: _IR, LEADING_R: _R}

# a comma between digits is no letter
_SEQUENCE = re.compile("(?<=[0-9])(,)(?=[0-9])|" + "|".join(map(re.escape, sorted(GLYPHS, key=len, reverse=True))))
_LETTER = "[\u0915-\u0939\u0958-\u095f]\u093c?"
_SYLLABLE = re.compile(f"([{_I}{_IR}]?)((?:{_LETTER}्)*{_LETTER})([\u093c\u093e-\u094c\u0901-\u0903]*)({_R}?)")
_TYPED = [(re.compile(a), b) for a, b in TYPED]
_SPACES = re.compile(r"(\s+)")
# what any kind but - needs: one of their spellings, between brackets and signs
_MAYBE_ENGLISH = re.compile(r"[¼(]*(?:[A-Z]{2,}|[A-Z]?[a-jl-z]+)[½)\].,;:]*A?")
_ENGLISH_RUN = re.compile(r"\(?[SWAF]+\)?")


def _in_order(m: re.Match) -> str:
    before, letters, signs, after = m.groups()
    return ("र्" if after or before == _IR else "") + letters + ("ि" if before else "") + signs


@lru_cache(MOST_KNOWN)
def _word(glyphs: str) -> str:
    glyphs = glyphs.translate({ord("’"): "'", ord("‘"): "'"}).replace(LEADING_R * 2, LEADING_R)
    out = _SEQUENCE.sub(lambda m: m[1] or GLYPHS[m[0]], glyphs)
    # without a mark every syllable stands in order
    if _I in out or _IR in out or _R in out:
        out = _SYLLABLE.sub(_in_order, out).replace(_I, "ि").replace(_IR, "ि").replace(_R, "र्")
    for pattern, by in _TYPED:
        out = pattern.sub(by, out)
    return out


@lru_cache(MOST_KNOWN)
def _kind(word: str) -> str:
    """One letter for a word - S surely English, W perhaps, A an abbreviation, F a function word, - none - between the brackets it has."""
    if not _MAYBE_ENGLISH.fullmatch(word):
        return "-"
    bare = re.sub(r"[½)\].,;:]+$", "", re.sub(r"[½)\].,;:]*A?$", "", re.sub(r"^[¼(]+", "", word)))
    share = sum(c in "aeiouAEIOU" for c in bare) / max(1, len(bare))
    if bare in FUNCTION_WORDS:
        kind = "F"
    elif re.fullmatch("[A-Z]{2,6}", bare):
        kind = "A"
    elif re.fullmatch("[A-Z][a-jl-z]{2,}", bare) and share >= 0.2:
        kind = "S"
    elif re.fullmatch("[a-jl-z]{3,}", bare) and share >= 0.3:
        kind = "W"
    else:
        return "-"
    return ("(" if word[0] in "¼(" else "") + kind + (")" if re.search("[½)]A?$", word) else "")


def _english(words: list[str]) -> list[tuple[int, int]]:
    """Ranges of words that stay: runs with a surely English word that has company or a bracket, and abbreviations in brackets."""
    kinds = list(map(_kind, words))
    line = "".join(kinds)
    if "S" not in line and "(A)" not in line:
        return []
    line, number = "".join(kinds), [k for k, x in enumerate(kinds) for _ in x]
    out = []
    for m in _ENGLISH_RUN.finditer(line):
        run = m[0]
        bracket = run[0] == "(" or run[-1] == ")"
        if "S" in run and (bracket or sum(c in "SWA" for c in run) >= 2) or run == "(A)":
            out.append((number[m.start()], number[m.end() - 1] + 1))
    return out


def convert(text: str) -> str:
    """Legacy glyphs as Unicode; English in between stays."""
    if "`" in text:
        text = re.sub(r"`(?=\s?\d)", "₹", text)
    parts = _SPACES.split(text)
    words = [k for k in range(0, len(parts), 2) if parts[k]]
    stays: set[int] = set()
    runs = _english([parts[k] for k in words])
    if not runs:
        parts[::2] = map(_word, parts[::2])
        return "".join(parts)
    for a, b in runs:
        own = words[a:b]
        stays.update(own)
        for k in own:
            parts[k] = parts[k].replace("¼", "(").replace("½", ")")
        if b == len(words) or words[b] not in stays:
            parts[own[-1]] = re.sub(r"\]$", ",", re.sub(r"\)A$", ")।", parts[own[-1]]))
    return "".join(p if k % 2 or k in stays else _word(p) for k, p in enumerate(parts))


# What each piece of Unicode is typed as: the longest piece first, of several glyphs for one the first in the tables above.
_TYPED_AS: dict[str, str] = {}
for _g, _u in GLYPHS.items():
    if _u not in (_I, _IR, _R):
        _TYPED_AS.setdefault(_u, _g)
_PIECE = re.compile("|".join(map(re.escape, sorted(_TYPED_AS, key=len, reverse=True))))
_UNICODE_SYLLABLE = re.compile(f"(र्(?={_LETTER}))?((?:{_LETTER}्)*{_LETTER})(\u093f?)([\u093e-\u094c\u0901-\u0903]*)")


def encode(text: str) -> str:
    """Unicode Hindi as the glyphs of the font: the inverse of `convert` for what the font can write. No piece and no syllable holds a blank."""
    return " ".join(map(_typed_word, text.split(" ")))


@lru_cache(MOST_KNOWN)
def _typed_word(text: str) -> str:

    def typed(m: re.Match) -> str:
        return (SHORT_I if m[3] else "") + _PIECE.sub(lambda p: _TYPED_AS[p[0]], m[2] + m[4]) + (LEADING_R if m[1] else "")

    out, last = [], 0
    for m in _UNICODE_SYLLABLE.finditer(text):
        out += [_PIECE.sub(lambda p: _TYPED_AS[p[0]], text[last : m.start()]), typed(m)]
        last = m.end()
    return "".join(out) + _PIECE.sub(lambda p: _TYPED_AS[p[0]], text[last:])


_TOKEN = re.compile(r"<[^>]*>|[^<]+")
_FACE = re.compile(r"""(?i)\bface\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")


def convert_tags(page: str) -> str:
    """HTML with the text inside any legacy <font> element converted; all other text, tags and blanks as they are."""
    if not re.search(FONTS, page):
        return page
    out, fonts = [], []
    for m in _TOKEN.finditer(page):
        token = m[0]
        if token[0] == "<":
            if re.match(r"(?i)<font\b", token):
                face = _FACE.search(token)
                fonts.append(bool(face and re.search(FONTS, next(filter(None, face.groups()), ""))))
            elif re.match(r"(?i)</font\b", token) and fonts:
                fonts.pop()
        elif any(fonts) and not token.isspace():
            token = _html.escape(convert(_html.unescape(token)), quote=False)
        out.append(token)
    return "".join(out)


@F.pandas_udf(StringType())
def legacy_to_unicode(s: pd.Series) -> pd.Series:
    """Text in the legacy font as Unicode; null stays null."""
    return s.map(convert, na_action="ignore")


@F.pandas_udf(StringType())
def unicode_to_legacy(s: pd.Series) -> pd.Series:
    """Unicode Hindi in the glyphs of the legacy font; null stays null."""
    return s.map(encode, na_action="ignore")


@F.pandas_udf(StringType())
def legacy_tags_to_unicode(s: pd.Series) -> pd.Series:
    """HTML whose <font> elements of a legacy face are read as Unicode; null stays null."""
    return s.map(convert_tags, na_action="ignore")

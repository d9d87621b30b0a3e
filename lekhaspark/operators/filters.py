"""Filters over a table of documents, as conditions that Catalyst can push down and combine.

A documents table has source_id, department, department_id, jurisdiction_code, topics (array), provenance_ok, provider,
go_number, go_date, tier, section, category, subject, and metadata (JSON text), as far as a filter reads them. Each function
returns a Column, or a DataFrame where a condition needs other rows of the table. Empty requests filter nothing unless stated.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.unicode import JOINERS, department_id, strip_joiners_and_space

#: Bounds of a request.
MOST_SOURCE_IDS, MOST_TERMS, MOST_WORDS = 200, 8, 8


def _everything() -> Column:
    return F.lit(True)


def _any(conditions: Iterable[Column]) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return _everything() if out is None else out


def _clean(name: str) -> str:
    return " ".join(name.translate({ord(c): None for c in JOINERS}).split())


def _bare(c: Column) -> Column:
    return F.translate(c, JOINERS, "")


def _is(c: Column) -> Column:
    """True or false, never null, so that conditions can be negated and joined by OR."""
    return F.coalesce(c, F.lit(False))


def subject(metadata: Column) -> Column:
    """The title, else the portal's subject; empty ones count as missing."""
    return F.coalesce(*(F.nullif(F.get_json_object(metadata, p), F.lit("")) for p in ("$.title", "$.portal.subject")))


def like_escape(text: str) -> str:
    """A literal text inside a LIKE pattern."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def wildcard_to_like(pattern: str) -> str:
    """* is any run, ? one character, everything else literal."""
    return re.sub(r"\*+", "%", like_escape(pattern)).replace("?", "_")


def section_pattern(section: str) -> str:
    """A section as typed, whatever its spaces and dashes, but with its whole number (1 is not 12)."""
    text = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", _clean(section))
    text = re.sub(r"\s*[-–]\s*", r"\\s*[-–]?\\s*", text)
    text = re.sub(r" (?=\d)", r"\\s*[-–]?\\s*", text).replace(" ", r"\s+")
    return f"(?iu){text}([^0-9]|$)" if text[-1:].isdigit() else f"(?iu){text}"


def by_jurisdiction(codes: Iterable[str], two_letters: bool = False) -> Column:
    """Upper-cased codes; two_letters drops malformed ones from the request."""
    wanted = [c.strip().upper() for c in codes]
    wanted = [c for c in wanted if re.fullmatch("[A-Z]{2}", c)] if two_letters else [c for c in wanted if c]
    return _is(F.col("jurisdiction_code").isin(wanted)) if wanted else _everything()


def by_topic(topics: Iterable[str]) -> Column:
    wanted = [t for t in topics if re.fullmatch("[a-z-]{2,40}", t)]
    return _is(F.arrays_overlap("topics", F.array(*map(F.lit, wanted)))) if wanted else _everything()


def official_only() -> Column:
    return _is(F.col("provenance_ok"))


def number_contains(number: str) -> Column:
    return _is(F.col("go_number").ilike(f"%{number.strip()}%")) if number.strip() else _everything()


def number_prefix(prefix: str) -> Column:
    """Spaces and joiners count neither in the number nor in the prefix."""
    wanted = re.sub(r"\s+", "", _clean(prefix)).lower()
    return _is(F.lower(_bare(F.regexp_replace("go_number", " ", ""))).startswith(wanted)) if wanted else _everything()


def by_source_ids(ids: Iterable[str] | None) -> Column:
    """None filters nothing, an empty list matches nothing."""
    return _everything() if ids is None else _is(F.col("source_id").isin([i.strip() for i in ids if i and i.strip()][:MOST_SOURCE_IDS]))


def section_like(section: str) -> Column:
    return _bare(F.coalesce("section", F.lit(""))).rlike(section_pattern(section)) if section.strip() else _everything()


def named(column: str, value: str) -> Column:
    """A section or category that is exactly this name, joiners aside."""
    return _is(_bare(F.col(column)) == _clean(value)) if value.strip() else _everything()


def searchable() -> Column:
    """What finder terms may match: subject, section, category and number."""
    return _bare(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("subject", "section", "category", "go_number"))))


def finder_terms(phrases: Iterable[str] = (), patterns: Iterable[str] = (), spellings: dict[str, list[str]] | None = None) -> Column:
    """Every phrase and every pattern must match; a pattern in any of its spellings (`spellings`: word -> other spellings)."""
    groups = [[f"%{like_escape(_clean(p))}%"] for p in phrases]
    groups += [[f"%{wildcard_to_like(v)}%" for v in variants(_clean(p), spellings or {})] for p in patterns]
    groups = [[t for t in g if t.replace("%", "")] for g in groups]
    out = _everything()
    for g in [g for g in groups if g][:MOST_TERMS]:
        out = out & _any(searchable().ilike(t) for t in g)
    return out


def variants(pattern: str, spellings: dict[str, list[str]], most: int = 6) -> list[str]:
    """The pattern, and the pattern with one known word after another in its other spellings."""
    out = [pattern]
    for word in re.findall(r"[A-Za-z]+", pattern):
        for other in spellings.get(word.lower(), []):
            for base in list(out):
                if word in base and base.replace(word, other) not in out:
                    out.append(base.replace(word, other))
    return out[:most]


def all_words(text: str, spellings: dict[str, list[str]] | None = None) -> Column:
    """Every word somewhere, in any of its spellings."""
    out = _everything()
    for w in _clean(text).split(" ")[:MOST_WORDS]:
        if w:
            out = out & _any(searchable().ilike(f"%{like_escape(v)}%") for v in [w, *(spellings or {}).get(w.lower(), [])])
    return out


def by_department_keys(keys: Iterable[str]) -> Column:
    """Keys id:N, name:X and none, any of them."""
    keys = list(keys)
    ids = [int(k[3:]) for k in keys if re.fullmatch(r"id:-?\d+", k)]
    names = [n for n in (_clean(k[5:]) for k in keys if k.startswith("name:")) if n]
    parts = []
    if ids:
        parts.append(_is(F.col("department_id").isin(ids)))
    if names:
        parts.append(_is(_bare(F.col("department")).isin(names)))
    if "none" in keys:
        parts.append(F.coalesce(F.trim("department"), F.lit("")) == "")
    return _any(parts)


def _widened(docs: DataFrame, match: Column, also: Column) -> DataFrame:
    """Documents that match by name, that share the department id of one that does, or for which `also` holds. The ids that
    match are a small distinct list; the join leaves it to Spark to broadcast them."""
    ids = docs.where(match & F.col("department_id").isNotNull()).select(F.col("department_id").alias("_id")).distinct().withColumn("_by_id", F.lit(True))
    met = docs.join(ids, docs["department_id"] == ids["_id"], "left").where(match | F.coalesce("_by_id", F.lit(False)) | also)
    return met.select([docs[c] for c in docs.columns])


def _rulebook(providers: Iterable[str]) -> Column:
    providers = list(providers)
    return _is(F.col("provider").isin(providers)) if providers else F.lit(False)


def _central() -> Column:
    return _is(F.get_json_object("metadata", "$.jurisdiction") == "central")


def department_contains(docs: DataFrame, name: str, rulebooks: Iterable[str] = ()) -> DataFrame:
    """Search by one name: contained in the department, widened by department id; rulebooks always stay."""
    return _widened(docs, _is(_bare(F.col("department")).ilike(f"%{_clean(name)}%")), _rulebook(rulebooks))


def department_any(docs: DataFrame, names: Iterable[str], rulebooks: Iterable[str] = ()) -> DataFrame:
    """Search by a list of names: equal, widened by department id; central documents and rulebooks always stay."""
    wanted = [n for n in map(_clean, names) if n]
    if not wanted:
        return docs
    return _widened(docs, _is(_bare(F.col("department")).isin(wanted)), _is(F.col("jurisdiction_code") == "IN") | _central() | _rulebook(rulebooks))


def department_scope(docs: DataFrame, names: Iterable[str], spellings: dict[str, list[str]] | None = None) -> DataFrame:
    """Browse by a profile's departments in all their spellings: only documents marked central stay besides."""
    wanted = {v for n in map(_clean, names) if n for v in [n, *(spellings or {}).get(n, [])]}
    return _widened(docs, _is(_bare(F.col("department")).isin(sorted(wanted))), _central()) if wanted else docs


def by_department_ids(ids: Iterable[int], rulebooks: Iterable[str] = ()) -> Column:
    wanted = [int(i) for i in ids]
    return (_is(F.col("department_id").isin(wanted)) | _rulebook(rulebooks)) if wanted else _everything()


STATUSES = ("conflict", "ocr_only_unverified", "variants_agree", "native_primary", "unverified")


def by_verification(pages: DataFrame, variants_of: DataFrame, status: str) -> DataFrame:
    """Pages (source_id, page_number, numeric_conflict) of one verification status. The kinds of a page's variants
    (source_id, page_number, variant_type) are reduced to two flags first, so one join answers all cases."""
    if status not in STATUSES:
        raise ValueError(f"unsupported verification status: {status}")
    kinds = variants_of.groupBy("source_id", "page_number").agg(F.bool_or(F.col("variant_type") == "native").alias("_native"), F.bool_or(F.col("variant_type") == "ocr").alias("_ocr"))
    met = pages.join(kinds, ["source_id", "page_number"], "left")
    native, ocr = _is(F.col("_native")), _is(F.col("_ocr"))
    calm = ~_is(F.col("numeric_conflict"))
    rule = {"conflict": ~calm, "ocr_only_unverified": calm & ~native & ocr, "variants_agree": calm & native & ocr, "native_primary": calm & native & ~ocr, "unverified": calm & ~native & ~ocr}[status]
    return met.where(rule).select([met[c] for c in pages.columns])


def department_facet(docs: DataFrame) -> DataFrame:
    """(key, names, documents): id:N for ids of the portal's form, none without a name, else name:X; most documents first, then key."""
    name = strip_joiners_and_space(F.coalesce("department", F.lit("")))
    known = department_id(F.col("source_id"))
    key = F.when(known.isNotNull(), F.concat(F.lit("id:"), known.cast("string"))).when(name == "", "none").otherwise(F.concat(F.lit("name:"), name))
    found = docs.select(key.alias("key"), F.when(name != "", name).alias("name")).groupBy("key").agg(F.array_sort(F.collect_set("name")).alias("names"), F.count("*").alias("documents"))
    return found.orderBy(F.desc("documents"), "key")


def not_duplicates() -> Column:
    """Documents that are not known as a copy of another."""
    return F.col("duplicate_of").isNull()


def usable_page(text: Column, least: int = 400, letters: float = 0.45) -> Column:
    """Mostly words, no table of figures and no signature block."""
    return (F.length(text) >= least) & (F.regexp_count(text, F.lit(r"[\p{L}\p{M}]")) >= F.lit(letters) * F.length(text))


def public_links(text: Column, hosts: str = r"(?:[a-z0-9-]+\.)*(?:gov|nic)\.in") -> Column:
    """Text without links to other hosts than those that the pattern matches."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, rf"(?i)https?://(?!{hosts}(?:[/:?#\s]|$))\S+", ""), r"[ \t]{2,}", " "))


def hide_providers(question: str, hidden: dict[str, str]) -> Column:
    """Providers of single districts (provider -> name) stay hidden unless the question names the district."""
    asked = question.casefold()
    gone = sorted(p for p, district in hidden.items() if district.casefold() not in asked)
    return ~_is(F.col("provider").isin(gone)) if gone else _everything()


def scope(docs: DataFrame, request: dict) -> DataFrame:
    """All filters of a search scope at once: keys departments, jurisdictions, topics, number, number_prefix, source_ids,
    section, words, phrases, patterns, spellings, rulebooks, official; unknown keys are an error."""
    known = {"departments", "jurisdictions", "topics", "number", "number_prefix", "source_ids", "section", "words", "phrases", "patterns", "spellings", "rulebooks", "official"}
    if set(request) - known:
        raise ValueError(f"unknown filters: {sorted(set(request) - known)}")
    spellings = request.get("spellings", {})
    conditions = [
        by_jurisdiction(request.get("jurisdictions", [])), by_topic(request.get("topics", [])), number_contains(request.get("number", "")), number_prefix(request.get("number_prefix", "")),
        by_source_ids(request.get("source_ids")), section_like(request.get("section", "")), all_words(request.get("words", ""), spellings),
        finder_terms(request.get("phrases", []), request.get("patterns", []), spellings), official_only() if request.get("official", True) else _everything(),
    ]
    for c in conditions:
        docs = docs.where(c)
    return department_any(docs, request.get("departments", []), request.get("rulebooks", ()))

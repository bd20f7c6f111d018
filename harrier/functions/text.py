"""Text, number and key expressions. Each function takes and returns columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}_]+"
#: Runs of word characters joined by - or '.
TOKEN = rf"{WORD}(?:[-']{WORD})*"

#: Runs without white space, of any script.
NON_SPACE = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]+"

#: Conversational openings and related terms of the query transformations.
POLITE = r"(?i)^(?:please\s+|could you\s+|can you\s+|would you\s+|i want to know\s+)+"
TELL_ME = r"(?i)^(?:tell me|explain)\s+(?:about\s+)?"
GLOSSARY: dict[str, tuple[str, ...]] = {
    "runway": ("airside", "surface inspection", "FOD", "ATC clearance"),
    "queue": ("passenger flow", "terminal operations", "holding area"),
    "electrical": ("energized panel", "PPE", "lockout-tagout", "LOTO"),
    "cyber": ("information security", "controls", "risk", "incident response"),
    "maintenance": ("inspection", "preventive maintenance", "SOP"),
    "safety": ("hazard", "control measure", "PPE", "emergency procedure"),
}

#: Markers of question categories, tried in this order.
CATEGORY_MARKERS: dict[str, tuple[str, ...]] = {
    "operational": ("procedure", "step", "responsib", "deadline", "must", "how"),
    "comparative": ("compare", "difference", "versus", " vs "),
    "temporal": ("when", "date", "frequency", "how often"),
    "definition": ("what is", "define", "meaning"),
}


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order, repeats kept; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def word_set(text: Column) -> Column:
    """Distinct lower-cased runs of word characters and hyphens."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}_-]+"), F.lit(0)), F.array().cast("array<string>")))


def ascii_words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def rewrite(query: Column) -> Column:
    """Without conversational openings and closing marks, first letter raised; the cleaned query if nothing is left."""
    body = F.regexp_replace(F.trim(F.regexp_replace(clean(query), POLITE, "")), TELL_ME, "")
    body = F.rtrim(F.regexp_replace(body, r"[ ?.!]+$", ""))
    return F.when(body == "", clean(query)).otherwise(F.concat(F.upper(F.substring(body, 1, 1)), F.substring(body, F.lit(2), F.length(body))))


def expand(query: Column, glossary: Mapping[str, tuple[str, ...]] = GLOSSARY, within: Column | None = None) -> Column:
    """The query with related terms that it does not hold yet; ``within`` is the part of it whose words tell them, if not all."""
    text, low = clean(query), F.lower(clean(query if within is None else within))
    parts = [F.when(low.contains(term.lower()), F.array(*[F.lit(r) for r in related])).otherwise(F.array().cast("array<string>")) for term, related in glossary.items()]
    found = F.filter(F.array_distinct(F.concat(*parts)), lambda r: ~F.contains(low, F.lower(r)))
    return F.when(F.size(found) == 0, text).otherwise(F.concat(text, F.lit(" | Related terms: "), F.array_join(found, ", ")))


def reframe(query: Column, domain: str) -> Column:
    return F.concat(F.lit(f"{domain} policy, SOP, manual, controls, responsibilities, and required actions: "), rewrite(query))


def category(question: Column) -> Column:
    low, out = F.lower(question), None
    for name, markers in CATEGORY_MARKERS.items():
        test = low.contains(markers[0])
        for m in markers[1:]:
            test = test | low.contains(m)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("general")


def search_form(text: Column) -> Column:
    """Lower case, punctuation but - to spaces, white space collapsed."""
    return clean(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}_\s-]", " "))


def initials(normal: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(normal, " "), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")


def match_score(title: Column, body: Column, query: Column) -> Column:
    """The ladder of title and body matches: 100, 94, 90, 87, 84, 74, 66 or 0. query is in search form.

    Title and body are brought to search form once: as the one value of a list they have a name within the ladder, where
    an expression that stands in many branches would be worked out in each.
    """
    terms = F.filter(F.split(query, " "), lambda w: w != "")
    has_terms = F.size(terms) > 0

    def ladder(x: Column) -> Column:
        t, b = x["t"], x["b"]
        return (
            F.when(t == query, 100)
            .when(F.contains(t, query) & F.startswith(t, query), 94)
            .when(F.contains(t, query), 90)
            .when((F.length(query) >= 2) & F.startswith(initials(t), F.replace(query, F.lit(" "), F.lit(""))), 87)
            .when(has_terms & F.forall(terms, lambda w: F.contains(t, w)), 84)
            .when(F.contains(b, query), 74)
            .when(has_terms & F.forall(terms, lambda w: F.contains(b, w)), 66)
            .otherwise(0)
        )

    both = F.array(F.struct(search_form(title).alias("t"), search_form(F.coalesce(body, F.lit(""))).alias("b")))
    return F.get(F.transform(both, ladder), F.lit(0))


def match_reason(score: Column) -> Column:
    return F.when(score == 100, "Exact title").when(score >= 90, "Title phrase").when(score == 87, "Acronym").when(score == 84, "Title terms").when(score == 74, "Exact phrase").when(score == 66, "Matching terms").otherwise("")


def band(score: Column) -> Column:
    return F.when(score >= 88, "Highly relevant").when(score >= 70, "Relevant").otherwise("Related")


def excerpt(text: Column, query: Column, limit: int = 320, lead: int = 80) -> Column:
    """Up to limit characters from lead before the first hit of query, with marks where text is cut."""
    flat = clean(F.regexp_replace(text, "<[^>]+>", " "))
    hit = F.position(query, F.lower(flat)) - 1
    start = F.when(hit >= 0, F.greatest(F.lit(0), hit - lead)).otherwise(0)
    out = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(flat, start + 1, F.lit(limit)), F.when(start + limit < F.length(flat), "…").otherwise(""))
    return F.when(F.coalesce(flat, F.lit("")) == "", None).otherwise(out)


def preview(text: Column, limit: int) -> Column:
    flat = clean(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("...")))


def plain_markdown(text: Column) -> Column:
    """Without fences, emphasis, heading marks, link targets and tags; white space collapsed."""
    out = F.regexp_replace(text, r"`+", "")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(?m)^#{1,6}\s*", "")
    out = F.regexp_replace(out, r"[*_~]+", "")
    return clean(F.regexp_replace(out, "<[^>]+>", " "))


def markers(text: Column) -> Column:
    """Numbers of citation marks [n], repeats kept."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def drop_reference_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"(?im)^\s*references?\s*:\s*(?:\[\d+\][,\s]*)+\s*$", "")


def keep_markers(text: Column, allowed: Column) -> Column:
    """The text without marks whose number is not allowed."""
    gone = F.array_except(F.array_distinct(markers(text)), allowed)
    return F.aggregate(gone, text, lambda acc, n: F.replace(acc, F.concat(F.lit("["), n.cast("string"), F.lit("]")), F.lit("")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigram_redundancy(words: Column) -> Column:
    """1 - distinct / all trigrams; 0 below four words."""
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))
    return F.when(n < 4, F.lit(0.0)).otherwise(F.round(1 - F.size(F.array_distinct(grams)) / (n - 2), 4))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4.0).cast("int"))


def run_estimate(text: Column) -> Column:
    """1.32 tokens for each run of other than white space, rounded up."""
    return F.ceil(F.round(F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))) * 1.32, 6)).cast("int")


def join_overlapping(left: Column, right: Column, limit: int = 250) -> Column:
    """right without the longest start (up to limit) that ends left; else both with a line break between."""
    n = F.least(F.length(left), F.length(right), F.lit(limit))
    sizes = F.when(n > 0, F.sequence(n, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    hit = F.filter(sizes, lambda k: F.right(left, k) == F.left(right, k))
    return F.when(F.size(hit) > 0, F.concat(left, F.substring(right, F.get(hit, F.lit(0)) + 1, F.length(right)))).otherwise(F.concat(left, F.lit("\n"), right))


def uuid5(name: Column, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """Name-based UUID by SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def normal_path(path: Column) -> Column:
    """Slashes forward, none at the ends."""
    return F.btrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))


def parent_path(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extension(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return F.when(F.regexp_extract(base, r"^.+\.([^.]+)$", 1) != "", F.lower(F.regexp_extract(base, r"^.+\.([^.]+)$", 1))).otherwise(F.lower(base))


def safe_number(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def clean_duration(value: Column, most: float) -> Column:
    """The value if finite, not negative and at most so much, else null."""
    return F.when(~F.isnan(value) & value.between(0.0, most), value)


def safe_cell(value: Column) -> Column:
    """Cells that a spreadsheet would run as a formula get a quote in front."""
    return F.when(F.substring(value, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), value)).otherwise(value)


def backoff(attempts: Column, base: float) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), attempts - 1)


def citation_link(url: Column, page: Column) -> Column:
    """PDF links only, with the page as fragment."""
    is_pdf = F.lower(F.regexp_replace(url, r"[?#].*$", "")).endswith(".pdf")
    return F.when(is_pdf, F.concat(F.regexp_replace(url, "#.*$", ""), F.when(page.isNotNull(), F.concat(F.lit("#page="), page.cast("string"))).otherwise("")))


def rounded(value: Column, places: int) -> Column:
    """To so many places, by a product: engines that share the rounding of whole numbers agree on it."""
    return F.round(value * 10.0**places) / 10.0**places


def matched_terms(terms: Column, text: Column) -> Column:
    """The terms (lower-cased) that are tokens of the text, sorted, each once."""
    return F.array_sort(F.array_intersect(tokens(text), terms))


def ordered_union(*lists: Column) -> Column:
    """Values of all lists, each once, in the order in which they are first met; null lists have none."""
    return F.array_distinct(F.flatten(F.array_compact(F.array(*lists))))


def markdown_blocks(text: Column, title: Column) -> Column:
    """Blocks between blank lines as (block, section, text): section is the first line without heading marks, cut to 160
    characters, or the title where that leaves nothing."""
    white = " \t\r\n\x0b\x0c"
    blocks = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda b: F.btrim(b, F.lit(white))), lambda b: b != "")
    section = lambda b: F.left(F.regexp_replace(F.btrim(F.get(F.split(b, r"\r?\n"), F.lit(0)), F.lit(white)), r"^#{1,6}\s+", ""), F.lit(160))
    return F.transform(blocks, lambda b, i: F.struct(i.alias("block"), F.coalesce(F.nullif(section(b), F.lit("")), title).alias("section"), b.alias("text")))


def json_scalar(text: Column, path: str, kind: str = "string") -> Column:
    """The value at a path of a JSON text, null if there is none, it is no value of this kind, or the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


#: What may stand before and after a JSON object in an answer.
JSON_BEFORE = ("", "json:", "here is the json:", "here is the object:", "here is the requested json:", "here is the requested object:")
JSON_AFTER = ("", "end of json.", "end of object.", "end of response.")


def embedded_json(answer: Column) -> Column:
    """The JSON object of an answer, as it stands there, or null: fences and known phrases may surround it, nothing else.

    The object runs from the first brace to the last one; a text that is no object is null.
    """
    value = F.regexp_replace(F.btrim(F.regexp_replace(answer, "^\\ufeff+", ""), F.lit(" \t\r\n")), r"(?i)^```[ \t]*(?:json)?[ \t]*\r?\n", "")
    found = F.regexp_extract(value, r"(?s)^([^{]*)(\{.*\})(.*)$", 2)
    before, after = (F.lower(F.btrim(F.regexp_replace(F.regexp_extract(value, r"(?s)^([^{]*)(\{.*\})(.*)$", g), "```", ""), F.lit(" \t\r\n"))) for g in (1, 3))
    fine = before.isin(*JSON_BEFORE) & after.isin(*JSON_AFTER) & (found != "") & F.try_parse_json(found).isNotNull()
    return F.when(fine, found)

"""Text functions as column expressions: token estimates, query planning, redaction, citations, normal forms.

White space and word characters are ASCII's, as in the regular expressions of the JVM without (?U).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the lexical scorers leave out.
STOPWORDS = (
    "a an and are as at be by for from how in is it of on or the to was what when where which who why with"
).split()

# Redaction rules in their order (type, pattern, replacement); the last one keeps the key's name.
REDACTIONS = (
    ("private_key", r"(?is)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    ("bearer_token", r"(?i)\bBearer\s+[A-Za-z0-9._~+/\-=]{12,}", "Bearer [REDACTED_SECRET]"),
    ("openai_api_key", r"\bsk-(?:proj-|svcacct-)?[A-Za-z0-9_-]{12,}\b", "[REDACTED_SECRET]"),
    ("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_AWS_KEY]"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    ("email", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[REDACTED_EMAIL]"),
    ("phone", r"(?<!\w)(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}(?!\w)", "[REDACTED_PHONE]"),
    ("secret_assignment", r"(?i)\b(api[_-]?key|secret|token|password|passwd|pwd)\s*[:=]\s*['\"]?[^'\"\s,;]{6,}['\"]?", "$1=[REDACTED_SECRET]"),
)

# Filler in front of a query, a citation's mark, levels of a log from the gravest down.
FILLER = r"(?i)^\s*(?:please\s+)?(?:can\s+you|could\s+you|would\s+you|tell\s+me|show\s+me|find|search\s+for|look\s+up)\b\s*"
CITATION = r"【\d+†source】"
SEVERITIES = ("FATAL", "ERROR", "WARN", "INFO", "DEBUG", "TRACE")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def estimate_tokens(text: Column) -> Column:
    """A third more than the words, one at least (F1)."""
    return F.greatest(F.lit(1), F.floor(F.regexp_count(text, F.lit(r"\S+")) * 4 / 3)).cast("int")


def estimate_embedding_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 2)).cast("int")


def estimate_response_tokens(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4).cast("int")


def normalize_query(q: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(q, r"\s+", " "), r"^[ \t\r\n?.!]+|[ \t\r\n?.!]+$", "")


def rewrite_query(q: Column) -> Column:
    """Without filler in front (up to four times) and "what is the"; the normal form where nothing is left."""
    base = normalize_query(q)
    short = reduce(lambda c, _: F.trim(F.regexp_replace(c, FILLER, "")), range(4), base)
    short = normalize_query(F.trim(F.regexp_replace(short, r"(?i)\bwhat\s+(?:was|were|is|are)\s+the\s+", "")))
    return F.when(short == "", base).otherwise(short)


def decompose_query(q: Column, most: int = 4) -> Column:
    """Parts between "and", "also", `;` and `?` of two words at least, each once whatever its case."""
    base = normalize_query(q)
    parts = F.transform(F.split(base, r"(?i)\s+(?:and|also)\s+|[;?]+"), normalize_query)
    long_ = F.filter(parts, lambda p: F.size(words(p)) >= 2)
    none = F.array().cast("array<string>")
    once = F.aggregate(
        long_, none, lambda got, p: F.when(F.exists(got, lambda x: F.lower(x) == F.lower(p)), got).otherwise(F.concat(got, F.array(p)))
    )
    return F.when(F.size(once) > 0, F.slice(once, 1, most)).otherwise(F.array(base))


# What the legal planner recognises in a query.
DOCKET_LABELLED = r"(?i)\b(?:docket(?:\s+(?:no\.?|number))?|no\.?)\s*(\d{4,6})\b"
DOCKET = r"(?i)\b(?:docket(?:\s+(?:no\.?|number))?\s*)?(?:no\.?\s*)?(\d{5,6})\b"
DECISION_DATE = r"\b((?:19[8-9]\d|20\d{2})-\d{2}-\d{2})\b"
DECISION_YEAR = r"\b(19[8-9]\d|20\d{2})\b"
APPEALS = r"(?i)\b(?:kansas\s+)?court\s+of\s+appeals\b|\bcourt\s+of\s+appeals\b"
SUPREME = r"(?i)\b(?:kansas\s+)?supreme\s+court\b"
UNPUBLISHED, PUBLISHED = r"(?i)\bunpublished\b", r"(?i)\bpublished\b"


def _found(q: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(q, pattern, group), F.lit(""))


def legal_attributes(q: Column) -> dict[str, Column]:
    """Attribute filters that a legal query names (F7): null where it doesn't."""
    q = normalize_query(q)
    date = _found(q, DECISION_DATE)
    return {
        "docket_number": F.coalesce(_found(q, DOCKET_LABELLED), _found(q, DOCKET)),
        "decision_date": date,
        "decision_year": F.coalesce(F.substring(date, 1, 4), _found(q, DECISION_YEAR)),
        "court": F.when(q.rlike(APPEALS), "Court of Appeals").when(q.rlike(SUPREME), "Supreme Court"),
        "status": F.when(q.rlike(UNPUBLISHED), "Unpublished").when(q.rlike(PUBLISHED), "Published"),
    }


def legal_effective_query(q: Column) -> Column:
    """The query without the spans that became filters (F8)."""
    base = normalize_query(q)
    gone = (DOCKET_LABELLED, DOCKET, DECISION_DATE, DECISION_YEAR, UNPUBLISHED, PUBLISHED, APPEALS, SUPREME, r"(?i)\b(?:from|in|on|decided)\s*$")
    left = reduce(lambda c, p: F.regexp_replace(c, p, " "), gone, base)
    short = rewrite_query(left)
    return F.when(short == "", base).otherwise(short)


#: A run of letters and digits that isn't a stopword, told by the expression itself rather than by a lambda over all tokens.
TOKEN = rf"(?<![a-z0-9])(?!(?:{'|'.join(STOPWORDS)})(?![a-z0-9]))[a-z0-9]+"


def rerank_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def exact_symbols(q: Column, most: int = 32) -> Column:
    """Tokens that name code, paths or numbers (F9), each once whatever its case, in order."""
    raw = F.transform(F.regexp_extract_all(q, F.lit(r"([A-Za-z0-9][A-Za-z0-9_./:-]{2,})")), lambda t: F.trim(t))
    has = lambda t, p: t.rlike(p)
    upper, lower = "[A-Z]", "[a-z]"
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    mixed = lambda t: has(t, upper) & has(t, lower) & ~has(t, r"^[A-Z][^A-Z]*$")
    keep = lambda t: ~F.array_contains(stop, F.lower(t)) & (has(t, r"[_./:\-0-9]") | ((F.upper(t) == t) & has(t, upper)) | mixed(t))
    none = F.array().cast("array<string>")
    once = F.aggregate(
        F.filter(raw, keep), none, lambda got, t: F.when(F.exists(got, lambda x: F.lower(x) == F.lower(t)), got).otherwise(F.concat(got, F.array(t)))
    )
    return F.slice(once, 1, most)


def symbol_matches(symbol: Column, haystack: Column) -> Column:
    """Paths anywhere, other symbols between characters that can't belong to one (F10); case doesn't matter."""
    hay, s = F.lower(haystack), F.lower(symbol)
    bounded = F.concat(F.lit(r"(?<![a-z0-9_./:-])\Q"), s, F.lit(r"\E(?![a-z0-9_./:-])"))
    return F.when(F.contains(symbol, F.lit("/")), F.contains(hay, s)).otherwise(F.regexp_like(hay, bounded))


def redact(text: Column, leave: tuple[str, ...] = ()) -> Column:
    """The text with each rule's finds replaced; rules named in leave are left out."""
    rules = [r for r in REDACTIONS if r[0] not in leave]
    return reduce(lambda c, rule: F.regexp_replace(c, rule[1], rule[2]), rules, F.coalesce(text, F.lit("")))


def redaction_counts(text: Column, leave: tuple[str, ...] = ()) -> Column:
    """array<struct<type, count>> of what `redact` takes out, rule by rule."""
    at, out = F.coalesce(text, F.lit("")), []
    for kind, pattern, put in (r for r in REDACTIONS if r[0] not in leave):
        out.append(F.struct(F.lit(kind).alias("type"), F.regexp_count(at, F.lit(pattern)).alias("count")))
        at = F.regexp_replace(at, pattern, put)
    return F.filter(F.array(*out), lambda x: x["count"] > 0)


SENSITIVE = r"(^|_)(password|passwd|pwd|secret|token|api_?key|authorization|credential|cookie|private_?key|session_?id)($|_)"


def sensitive_key(key: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(key, r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_")).rlike(SENSITIVE)


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, "")


def citation_marker(n: Column) -> Column:
    return F.concat(F.lit("【"), n.cast("string"), F.lit("†source】"))


# Private-use characters around and between the parts of a model's citation.
CITE_START, CITE_BETWEEN, CITE_STOP = "", "", ""


def model_citation_marker(ids: Column, locator: Column | None = None) -> Column:
    """Family, ids, and a line locator if there is one."""
    parts = F.concat(F.array(F.lit("cite")), ids)
    if locator is not None:
        parts = F.concat(parts, F.filter(F.array(locator), lambda x: x.isNotNull()))
    return F.concat(F.lit(CITE_START), F.array_join(parts, CITE_BETWEEN), F.lit(CITE_STOP))


def model_citation_ids(text: Column) -> Column:
    """The source ids that markers in the text name, in order."""
    inner = F.regexp_extract_all(text, F.lit(f"{CITE_START}cite{CITE_BETWEEN}([^{CITE_STOP}]*){CITE_STOP}"))
    parts = F.flatten(F.transform(inner, lambda m: F.split(m, CITE_BETWEEN)))
    return F.filter(parts, lambda p: p.rlike("^[A-Za-z0-9_-]+$") & ~p.rlike(r"^L\d+(-L\d+)?$"))


def line_locator(first: Column, last: Column) -> Column:
    one = F.concat(F.lit("L"), first.cast("string"))
    return F.when(first.isNull(), None).when(last.isNull() | (last == first), one).otherwise(F.concat(one, F.lit("-L"), last.cast("string")))


def snippet(text: Column, most: int = 700) -> Column:
    flat = F.trim(F.regexp_replace(strip_citations(text), r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("...")))


def fold_text(text: Column) -> Column:
    """Dashes and quotes folded, lower case, thousands and dollar signs dropped; NFKC is `functions.python.nfkc`."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, "‐‑‒–—−‘’“”,$", "------''\"\"")), r"\s+", " "))


def normalize_evidence(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whole tokens in a row."""
    return F.contains(F.concat(F.lit(" "), normalize_evidence(text), F.lit(" ")), F.concat(F.lit(" "), normalize_evidence(phrase), F.lit(" ")))


def compact_lines(text: Column) -> Column:
    """Line feeds alone, stripped lines, one blank line at most between others."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"(?m)^[ \t]+|[ \t]+$", ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def canonical_url(url: Column, root: str) -> Column:
    """Under root: scheme and host as given there, no query or fragment, a path without a slash at its end; else null."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), r"/+$", "")
    scheme, home, base = root.split("://")[0], root.split("://")[1].split("/")[0].lower(), "/" + "/".join(root.split("://")[1].split("/")[1:]).rstrip("/")
    base = base.rstrip("/")
    inside = (host == home) & ((path == base) | path.startswith(base + "/"))
    return F.when(inside, F.concat(F.lit(f"{scheme}://{home}"), path))


def slug(text: Column, most: int = 80) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when((s == "") | (F.length(s) > most), F.substring(F.sha2(text, 256), 1, 16)).otherwise(s)


def index_part(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def severity(text: Column) -> Column:
    """The gravest level that the text names."""
    return F.coalesce(*[F.when(text.rlike(rf"\b{s}\b"), F.lit(s)) for s in SEVERITIES])


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D+", "")


def section_number(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"\s*-\s*", "-")


def case_name(text: Column) -> Column:
    """A cited case's name without signals and clauses before it."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    t = F.regexp_replace(t, r"(?i)^.*(?:^|[.;:]\s+)(?:see also|see|but see|cf\.|compare)\s+", "")
    lead = r"(?i)^(?:in|and|also|under|the court in|as stated in|quoting|citing|following)\s+(?!re\b)"
    return reduce(lambda c, _: F.regexp_replace(c, lead, ""), range(3), t)


def case_parties(title: Column) -> Column:
    t = F.trim(F.regexp_replace(title, r"\s+", " "))
    at = F.instr(t, " v. ")
    both = F.array(F.trim(F.substring(t, F.lit(1), at - 1)), F.trim(F.substring(t, at + 4, F.length(t))))
    alone = F.array(F.trim(F.substring(t, F.lit(7), F.length(t))))
    return F.when(F.lower(t).startswith("in re "), alone).when(at > 0, F.filter(both, lambda p: p != "")).otherwise(F.array().cast("array<string>"))


def ordinance_identity(label: Column) -> dict[str, Column]:
    """Category, number and year that a label names."""
    kind = F.when(label.rlike(r"(?i)charter\s+ordinance"), "charter_ordinance").when(label.rlike(r"(?i)resolution"), "resolution").otherwise("ordinance")
    number = _found(label, r"(?i)(?:ordinance|ord|resolution|no)\.?\s*(?:no\.?\s*)?#?\s*(\d{2,6})")
    return {"category": kind, "number": number, "year": _found(label, DECISION_YEAR)}


def ordinance_relation(text: Column) -> Column:
    t = F.lower(text)
    return F.when(F.contains(t, F.lit("repeal")), "REPEALS").when(F.contains(t, F.lit("adopt")), "ADOPTS").otherwise("AMENDS")


# Words by which a query asks for the graph of courts or of a code.
COURT_INTENT = r"(?i)\b(cited by|citing|citations?|authorit(?:y|ies)|related (?:case|part)|same docket|overruled|precedent)\b"
CODE_INTENT = r"(?i)\b(ordinance|amend(?:s|ed|ment)?|repeal(?:s|ed)?|definition|defined|chapter|article|section|table of contents|history)\b"


def graph_intent(q: Column, pattern: str = COURT_INTENT) -> Column:
    return q.rlike(pattern)


def infer_lens(q: Column, phrases: dict[str, list[str]], allowed: list[str]) -> Column:
    """The first allowed lens one of whose phrases the query holds (F32)."""
    t, out = F.lower(q), F.lit(None).cast("string")
    for lens in reversed([x for x in phrases if x in allowed]):
        out = F.when(reduce(lambda a, b: a | b, (F.contains(t, F.lit(p)) for p in phrases[lens])), F.lit(lens)).otherwise(out)
    return out


def extend_query(q: Column, extra: list[Column]) -> Column:
    """The query with each input that it doesn't hold yet."""
    return reduce(lambda c, x: F.when(x.isNull() | F.contains(F.lower(c), F.lower(x)), c).otherwise(F.concat_ws(" ", c, x)), extra, q)


def last_chars(text: Column, most: int = 4000) -> Column:
    return F.ltrim(F.right(text, F.lit(most)))


def structured_code(code: Column) -> dict[str, Column]:
    """Parts of ddd-dd-dddd-dddd; null where the form is another."""
    ok, parts = code.rlike(r"^\d{3}-\d{2}-\d{4}-\d{4}$"), F.split(code, "-")
    name = ("agency", "fund", "account", "program")
    return {n: F.when(ok, F.regexp_replace(F.get(parts, i), "^0+(?=.)", "") if n == "fund" else F.get(parts, i)) for i, n in enumerate(name)}

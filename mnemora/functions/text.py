"""Text functions of retrieval and summaries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no keywords (fixed values).
STOP_WORDS = ("what", "when", "where", "which", "who", "tell", "about", "does", "did", "with", "from", "that", "this")
#: Substrings that tell a query's intent, tested in this order (fixed values).
INTENT_WORDS = (
    ("temporal", ("when", "date", "time", "before", "after", "昨天", "什么时候", "哪天")),
    ("relational", ("relationship", "friend", "partner", "family", "support", "married", "with", "between", "关系", "支持")),
    ("search", ("list", "find", "search", "show", "summarize", "activities", "hobbies", "hobby", "partake", "sports", "interests", "哪些", "列出", "查找")),
    ("entity_lookup", ("who is", "what is", "identity", "background", "profile", "是谁", "身份")),
)
#: Words that widen a query of each intent (fixed values).
INTENT_TERMS = {
    "entity_lookup": ("identity", "background", "profile", "personal info"),
    "factual": ("fact", "details", "context"),
    "temporal": ("timeline", "event", "date", "time"),
    "relational": ("relationship", "friend", "support", "connection"),
    "search": ("search", "relevant", "memory"),
}


def keywords(text: Column) -> Column:
    """Distinct lower-case words of more than two letters or digits (`+` and `#` count), sorted, without stop words."""
    words = F.transform(F.split(text, r"[^\p{L}\p{N}+#]+"), F.lower)
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.char_length(w) > 2) & ~w.isin(*STOP_WORDS))))


def entities(text: Column) -> Column:
    """Distinct capitalised tokens of at least two characters, stripped of outer punctuation but `-` and `_`, sorted."""
    bare = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda w: (F.char_length(w) >= 2) & w.rlike(r"^\p{Lu}"))))


def intent(text: Column) -> Column:
    """Heuristic intent by substrings of the lower-cased query; the first that matches, else factual."""
    low = F.lower(text)
    out = None
    for kind, words in INTENT_WORDS:
        test = low.rlike("|".join(words))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("factual")


def rewritten(text: Column) -> Column:
    """The query with its entities, first six keywords and the intent's terms: distinct, sorted, joined, 200 characters."""
    terms = F.concat(F.array(text), entities(text), F.slice(keywords(text), 1, 6))
    kind = intent(text)
    extra = F.array().cast("array<string>")
    for k, words in INTENT_TERMS.items():
        extra = F.when(kind == k, F.array(*[F.lit(w) for w in words])).otherwise(extra)
    return F.left(F.array_join(F.array_sort(F.array_distinct(F.concat(terms, extra))), " "), F.lit(200))


def snippet(text: Column, query: Column, around: int = 100, head: int = 200) -> Column:
    """The text around the first case-insensitive match of the whole query, else its beginning."""
    at = F.position(F.lower(query), F.lower(text))
    start = F.greatest(at - around, F.lit(1))
    found = F.concat(F.when(start > 1, F.lit("...")).otherwise(""), F.substr(text, start, (at - start) + F.char_length(query) + around))
    return F.when((at > 0) & (query != ""), found).when(F.char_length(text) > head, F.concat(F.left(text, F.lit(head)), F.lit("..."))).otherwise(text)


def token_count(text: Column) -> Column:
    """Number of tokens between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda t: t != "")).cast("long")


def token_estimate(text: Column) -> Column:
    """A third of the bytes."""
    return F.floor(F.octet_length(text) / 3)


def without_metadata_lines(text: Column) -> Column:
    """Without lines that carry a source hash or the time of addition."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~(x.startswith("<!-- source-hash:") | x.startswith("**Added**:")))
    return F.array_join(kept, "\n")


def without_added(text: Column) -> Column:
    """Cut at the first `**Added**:` (with the blank line before it) and trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)(\n\n)?\*\*Added\*\*:.*$", ""), r"^\s+|\s+$", "")


def content_summary(text: Column, most: int = 200) -> Column:
    """The lines but headings in bold and rules, joined by blanks, trimmed, cut to `most` characters."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~(x.startswith("**") | x.startswith("---")))
    joined = F.trim(F.array_join(kept, " "))
    return F.when(F.char_length(joined) > most, F.concat(F.left(joined, F.lit(most)), F.lit("..."))).otherwise(joined)


def limited_abstract(text: Column, most: int = 2000) -> Column:
    """Trimmed; above the limit cut after the last sentence end before it, else hard with an ellipsis."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    to_end = F.regexp_extract(F.left(t, F.lit(most)), r"(?s)^(.*[。.?!！？])", 1)
    return F.when(F.char_length(t) <= most, t).when(to_end != "", to_end).otherwise(F.concat(F.left(t, F.lit(most - 3)), F.lit("...")))


def limited_overview(text: Column, most: int = 6000, mark: str = "\n\n[...]") -> Column:
    """Trimmed; above the limit cut at the last paragraph before it, else hard, with a mark."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    to_end = F.regexp_extract(F.left(t, F.lit(most)), r"(?s)^(.*)\n\n", 1)
    return F.when(F.char_length(t) <= most, t).when(to_end != "", F.concat(to_end, F.lit(mark))).otherwise(F.concat(F.left(t, F.lit(most)), F.lit(mark)))


def word_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of lower-case words; 0 where both are empty."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")) for t in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))

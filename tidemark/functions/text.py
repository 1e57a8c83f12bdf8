"""Text expressions: tokenisers, matching, truncation, ids and classification, all in Catalyst."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that keyword extraction leaves out.
STOP_WORDS = tuple("a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in into is it its just like me more my no not of on or our out she so some than that the their them then there these they this to up us was we were what when which who will with would you your".split())

#: Ordered rules of the kind classifier: the first kind with a phrase in the text wins. Fixed values.
KIND_PHRASES = (
    ("definition", ("is defined as", "means that", "refers to", "definition of", "defined as")),
    ("constraint", ("must ", "should ", "need to", "require", "cannot ", "can't ", "must not", "should not")),
    ("preference", ("i prefer", "i like", "i avoid", "i hate", "i dislike", "prefer to", "rather than")),
    ("procedure", ("step ", "first,", "then,", "finally,", "next,", "step 1", "step 2", "to do this")),
)

#: Kinds that staleness does not touch.
EXEMPT_KINDS = ("constraint", "definition", "procedure", "preference")

#: What stands between words.
SEPARATORS = r"[^\p{L}\p{N}]+"


def contains_ci(text: Column, needle: str | Column) -> Column:
    """Case-insensitive substring test."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.lower(text), F.lower(needle))


def query_terms(query: str) -> list[str]:
    """Lower-case words of a query that have at least three bytes."""
    return [w.lower() for w in query.split() if len(w.encode()) >= 3]


def query_terms_column(query: Column) -> Column:
    words = F.split(F.lower(F.trim(query)), r"\s+")
    return F.filter(words, lambda w: F.octet_length(w) >= 3)


def term_overlap(text: Column, terms: Sequence[str]) -> Column:
    """Share of the terms that the text contains; null where it has none, or without terms."""
    if not terms:
        return F.lit(None).cast("double")
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
    return F.nullif(hits, F.lit(0)) / F.lit(float(len(terms)))


def split_words(text: Column) -> Column:
    """What stands between separators, in lower case; the first and the last part may be empty. Null for null."""
    return F.split(F.lower(text), SEPARATORS)


def between_ends(parts: Column) -> Column:
    """The words of :func:`split_words`: its parts without an empty first or last one, which needs no pass over them."""
    first, last = (F.element_at(parts, 1) == "").cast("int"), (F.element_at(parts, -1) == "").cast("int")
    return F.slice(parts, 1 + first, F.greatest(F.size(parts) - first - last, F.lit(0)))


def spaced_words(text: Column) -> Column:
    """The words of a text with a space between them, and perhaps one before and after all: one string to move instead of many. Null for null."""
    return F.regexp_replace(F.lower(text), SEPARATORS, " ")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def query_words(query: str) -> list[str]:
    """:func:`words` of a query: the same runs of letters and digits that texts are split into."""
    runs = groupby(query.lower(), lambda c: unicodedata.category(c)[0] in "LN")
    return ["".join(run) for good, run in runs if good]


def topic_words(text: Column) -> Column:
    """Words for TF-IDF: over one byte, no stop word, not all digits."""
    return F.filter(words(text), lambda w: (F.octet_length(w) > 1) & ~w.isin(*STOP_WORDS) & ~w.rlike("^[0-9]+$"))


def keyword_words(text: Column) -> Column:
    """White-space words over three bytes, in lower case, without stop words."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")
    return F.filter(parts, lambda w: (F.octet_length(w) > 3) & ~w.isin(*STOP_WORDS))


def cut_bytes(text: Column, size: int) -> Column:
    """The longest beginning of whole characters with at most ``size`` bytes."""
    head = F.substring(text, 1, size)
    # UTF-8 has up to four bytes a character: shorten the beginning to where it fits.
    sizes = F.transform(F.split(head, ""), lambda c: F.octet_length(c))
    fits = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("used"), F.lit(0).alias("chars")),
        lambda s, n: F.when(s["used"] + n <= size, F.struct((s["used"] + n).alias("used"), (s["chars"] + F.when(n > 0, 1).otherwise(0)).alias("chars"))).otherwise(F.struct(F.lit(size + 1).alias("used"), s["chars"].alias("chars"))),
        lambda s: s["chars"],
    )
    return F.when(F.octet_length(text) <= size, text).otherwise(F.substring(text, F.lit(1), fits))


def ellipsis(text: Column, size: int) -> Column:
    """A text of over ``size`` bytes cut to them, with dots."""
    return F.when(F.octet_length(text) > size, F.concat(cut_bytes(text, size), F.lit("..."))).otherwise(text)


def cut_at_word(text: Column, chars: int) -> Column:
    """A text of over ``chars`` characters cut to them, then back to its last space."""
    head = F.substring(text, 1, chars)
    back = F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)
    return F.when(F.char_length(text) <= chars, text).otherwise(F.when(back != "", back).otherwise(head))


def label_from_keywords(keywords: Column, count: int = 5, chars: int = 50) -> Column:
    joined = F.array_join(F.slice(keywords, 1, count), " ")
    return F.when(F.size(keywords) > 0, cut_at_word(joined, chars)).otherwise(F.lit("Unknown Topic"))


def label_confidence(scores: Column) -> Column:
    """0 without scores, the score (1 at most) if there is one, else 0.5 + 0.5 top / sum."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    many = F.when(total > 0, 0.5 + 0.5 * F.element_at(scores, 1) / total).otherwise(F.lit(0.5))
    return F.when(F.size(scores) == 0, F.lit(0.0)).when(F.size(scores) == 1, F.least(F.element_at(scores, 1), F.lit(1.0))).otherwise(many)


def memory_kind(text: Column) -> Column:
    """The first kind of :data:`KIND_PHRASES` with a phrase in the text, else observation."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("observation")
    for kind, phrases in reversed(KIND_PHRASES):
        found = F.lit(False)
        for phrase in phrases:
            found = found | F.contains(low, F.lit(phrase))
        out = F.when(found, F.lit(kind)).otherwise(out)
    return out


def expand_query(query: str) -> list[str]:
    """The query, its lower case, and that without leading question words, without neighbours that repeat."""
    low = query.lower()
    bare = low
    for prefix in ("what ", "how ", "why ", "when ", "where ", "did we ", "do we "):
        while bare.startswith(prefix):
            bare = bare.removeprefix(prefix)
    out: list[str] = []
    for variant in (query, low, bare.strip()):
        if variant and (not out or out[-1] != variant):
            out.append(variant)
    return out


def expanded(query: Column) -> Column:
    """The variants of :func:`expand_query` of a column, as an array."""
    low = F.lower(query)
    bare = F.trim(F.regexp_replace(low, "^(what )*(how )*(why )*(when )*(where )*(did we )*(do we )*", ""))
    kept = F.filter(F.array(query, low, bare), lambda v: v != "")
    return F.filter(kept, lambda v, k: (k == 0) | (F.try_element_at(kept, F.greatest(k, F.lit(1))) != v))


def extract_json(text: Column) -> Column:
    """The JSON in a model's answer: a fenced json block, a fenced block, what lies between braces, or the text."""
    fenced_json = F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1)
    fenced = F.regexp_extract(text, r"(?s)```\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(fenced_json != "", fenced_json).when(fenced != "", fenced).when(braces != "", braces).otherwise(F.trim(text))


def clean_label(text: Column, chars: int = 50) -> Column:
    """A model's label without quotes and white space around it, cut at a word."""
    return cut_at_word(F.regexp_replace(F.regexp_replace(text, r"^[\s\"']+", ""), r"[\s\"']+$", ""), chars)


def node_level(node_id: Column) -> Column:
    return F.element_at(F.split(node_id, ":"), 2)


def valid_grip_id(grip_id: Column) -> Column:
    return grip_id.rlike(r"^grip:[+-]?\d+:[0-9A-Za-z]{26}$")


def grip_ms(grip_id: Column) -> Column:
    return F.when(valid_grip_id(grip_id), F.element_at(F.split(grip_id, ":"), 2).cast("bigint"))


def event_key_parts(key: Column) -> Column:
    """ms and ulid of an event key, or null."""
    return F.when(key.rlike(r"^evt:\d+:[0-9A-Za-z]+$"), F.struct(F.element_at(F.split(key, ":"), 2).cast("bigint").alias("ms"), F.element_at(F.split(key, ":"), 3).alias("ulid")))


def normalise_agent(agent: Column) -> Column:
    """Lower case without white space around it; an empty agent is null."""
    return F.nullif(F.lower(F.trim(agent)), F.lit(""))


def any_expected(response: Column, expected: Column) -> Column:
    """Whether the response contains any expected string, in any case."""
    low = F.lower(response)
    return F.exists(expected, lambda e: F.contains(low, F.lower(e)))


def bm25_text(title: Column, bullets: Column) -> Column:
    """What word search indexes of a node."""
    return F.concat_ws(" ", title, F.array_join(bullets, " "))


def vector_text(title: Column, bullets: Column, keywords: Column) -> Column:
    """What is embedded of a node; null if it is blank."""
    whole = F.concat_ws(". ", title, F.array_join(bullets, ". "), F.array_join(keywords, ", "))
    return F.nullif(F.trim(whole), F.lit(""))


def searchable_text(title: Column, keywords: Column, bullets: Column) -> Column:
    """What a federated search looks at."""
    return F.concat_ws(" ", title, F.array_join(keywords, " "), F.array_join(bullets, " "))


def merged_keywords(lists: Column, count: int = 7) -> Column:
    """The first of the sorted different keywords of several lists."""
    return F.slice(F.array_sort(F.array_distinct(F.flatten(lists))), 1, count)


def sorted_agents(agents: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(agents, F.lower)))

"""Text expressions. Everything here is a built-in column expression."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The instruction put before a query, never before a passage.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "

# Words that are never highlighted.
HIGHLIGHT_STOP_WORDS = (
    "the and was are were for with that this from its his her did does "
    "who what when where why how not but has had have"
).split()

# Java's Unicode \s leaves out the four ASCII separators.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
TOKEN = r"[\p{L}\p{N}]+"


def clean_text(text: Column) -> Column:
    """Collapse every whitespace run to one space and strip the ends."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def trim_whitespace(text: Column) -> Column:
    """Strip whitespace of any kind from both ends only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def query_prefix(text: Column, prefix: str = QUERY_PREFIX) -> Column:
    return F.concat(F.lit(prefix), trim_whitespace(text))


def tokenize(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case letter and digit runs, in text order."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    if stop_words:
        tokens = F.filter(tokens, lambda t: ~t.isin(list(stop_words)))
    return tokens


def token_counts(tokens: Column) -> Column:
    """Each distinct token with its count, as ``array<struct<term, tf>>``.

    The tokens of a row are sorted and cut into runs inside the row, so
    counting them needs neither a shuffle nor a hash table.
    """

    def runs(ordered: Column) -> Column:
        def start(token: Column, i: Column) -> Column:
            return F.when((i == 0) | (F.get(ordered, i - 1) != token), i)

        return let(F.array_compact(F.transform(ordered, start)), lambda starts: cut(ordered, starts))

    def cut(ordered: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(ordered)))
        return F.zip_with(
            starts,
            ends,
            lambda low, high: F.struct(F.get(ordered, low).alias("term"), (high - low).cast("long").alias("tf")),
        )

    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), runs))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def client_key(forwarded: Column, peer: Column) -> Column:
    """First forwarded hop; else the host part of the peer; else the peer."""
    hop = trim_whitespace(F.substring_index(forwarded, ",", 1))
    bracketed = F.regexp_extract(peer, r"^\[([^\[\]]*)\]:[^:\[\]]*$", 1)
    plain = F.regexp_extract(peer, r"^([^:\[\]]*):[^:\[\]]*$", 1)
    host = (
        F.when(peer.rlike(r"^\[[^\[\]]*\]:[^:\[\]]*$"), bracketed)
        .when(peer.rlike(r"^[^:\[\]]*:[^:\[\]]*$"), plain)
        .otherwise(peer)
    )
    return F.when(F.coalesce(forwarded, F.lit("")) != "", hop).otherwise(host)


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), (" ", "&nbsp;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def highlight_terms(query: Column) -> Column:
    """Distinct query terms worth marking: three or more characters, no stop word."""
    terms = F.split(F.lower(query), r"[^\p{L}\p{N}]+")
    return F.array_distinct(
        F.filter(terms, lambda t: (F.length(t) >= 3) & ~t.isin(HIGHLIGHT_STOP_WORDS))
    )


def highlight(text: Column, query: Column) -> Column:
    """HTML-escaped text with each word that starts with a query term marked.

    Marks are set as control characters before escaping, so a term can never
    match inside an entity or inside another mark.
    """
    terms = highlight_terms(query)
    pattern = F.concat(
        F.lit(r"(?iu)(?<![\p{L}\p{N}])("), F.array_join(terms, "|"), F.lit(")")
    )
    marked = F.regexp_replace(text, pattern, F.lit("\u0002$1\u0003"))
    chosen = F.when(F.size(terms) > 0, marked).otherwise(text)
    return F.replace(
        F.replace(escape_html(chosen), F.lit("\u0002"), F.lit("<mark>")),
        F.lit("\u0003"),
        F.lit("</mark>"),
    )

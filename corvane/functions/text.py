"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no keywords.
KEYWORD_STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "were", "of", "to", "in", "on", "for", "and", "or", "what", "how", "why",
    "does", "do", "did", "with", "that", "this", "it", "as", "by", "be", "have", "has", "can", "which",
]
# Words that are no concepts.
CONCEPT_STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "that", "this", "is", "are", "was", "were",
    "be", "been", "by", "as", "at", "from", "it", "its", "we", "our", "us", "they", "their", "can", "may", "such",
    "these", "those", "than", "then", "but", "not", "have", "has", "had", "which", "when", "while", "also", "more",
    "most", "other", "using", "used", "use", "based", "show", "shows", "propose", "proposed", "paper", "method",
    "methods", "approach", "results", "however", "both", "each", "all", "new", "via",
]
#: All white space of Unicode; the engine's own class is smaller. Written so that a plain letter is told by a table and one comparison.
WHITE = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]+"


def words(c, limit: int = -1) -> Column:
    """Words; with a limit the text is cut into so many parts at most, the last of which is what is left of it."""
    return F.array_remove(F.split(c, WHITE, limit), "")


def keywords(c) -> Column:
    """Keyword tokens in order, with repeats."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9\-]+)"), 1)
    return F.filter(tokens, lambda x: (F.length(x) > 2) & ~x.isin(KEYWORD_STOPWORDS))


def concept_words(c) -> Column:
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z0-9\-]{2,})"), 1)
    return F.filter(tokens, lambda x: ~x.isin(CONCEPT_STOPWORDS))


def embed_words(c) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), 1)


def bucket(word) -> Column:
    """Bucket of 64 by the last two digits of the word's MD5."""
    return F.conv(F.substring(F.md5(word), 31, 2), 16, 10).cast("int") % 64


def normalise(c) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " ")


def cited_ids(c) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\[arxiv:([^\]]+)\]"), 1)))


def has_citations(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).rlike(r"\[arxiv:[^\]]+\]")


def clean_query(c) -> Column:
    """Without white space and then quotation marks at both ends."""
    return F.regexp_replace(F.regexp_replace(c, rf"^{WHITE}|{WHITE}$", ""), '^"+|"+$', "")


def published_year(c) -> Column:
    """The first four characters as a year, if they are digits."""
    y = F.regexp_extract(c, "^([0-9]{4})", 1)
    return F.when(y != "", y.cast("long"))


def writer_context(chunks) -> Column:
    """What a draft is written from: each retrieved chunk (source_id, source_title, chunk_index, text) under a heading, parted by rules."""
    head = lambda c: F.concat(F.lit("[arxiv:"), c["source_id"], F.lit('] "'), c["source_title"], F.lit('" (chunk '), c["chunk_index"].cast("string"), F.lit(")\n"), c["text"])
    return F.array_join(F.transform(chunks, head), "\n\n---\n\n")


def judge_context(chunks) -> Column:
    """What a draft is judged by: each retrieved chunk with its whole text."""
    return F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("[arxiv:"), c["source_id"], F.lit("] "), c["text"])), "\n\n")


def one_line(c) -> Column:
    return F.regexp_replace(F.trim(c), "\n", " ")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)

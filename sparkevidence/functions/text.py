"""Column functions on text, hashes and addresses. Each takes and returns columns; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
#: Shapes of code-like terms; repeated groups are possessive, as the JVM's matcher recurses on others.
EXACT = r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)++|[A-Za-z0-9]+(?:[./][A-Za-z0-9]+)++|v[0-9]+(?:\.[0-9]+)++"
#: Words that do not count as significant terms. Fixed values.
STOPWORDS = ("the", "of", "and", "to", "in", "is", "it", "on", "for", "that", "with", "as", "was", "are", "be", "this", "le", "la", "de", "des", "un", "une", "et", "der", "die", "das", "und", "el", "los", "las", "y")
#: Labels that are page furniture when they make up a whole line. Fixed values.
BOILERPLATE = ("home", "menu", "next", "previous", "back to top", "table of contents", "cookie settings", "skip to content", "privacy policy", "terms of use")
#: Shapes of secrets that are blanked out, with what replaces them. Fixed values.
SECRETS = (
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "[id]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"),
    (r"AKIA[0-9A-Z]{16}", "[key]"),
    (r"sk-[A-Za-z0-9_-]{16,}", "[key]"),
    (r"gh[pousr]_[A-Za-z0-9]{20,}", "[token]"),
    (r"(?i)bearer [a-z0-9._-]{12,}", "[token]"),
    (r"(?i)(password|secret|token|api_key)[ ]*[=:][ ]*[^ \t\n]+", "[secret]"),
)


def normalize_text(text: Column) -> Column:
    """One kind of line end and space; runs of spaces and of blank lines shortened, but not inside code fences."""

    def prose(part: Column) -> Column:
        out = F.regexp_replace(F.regexp_replace(F.regexp_replace(part, "\u00a0", " "), "[ \t]+", " "), " ?\n ?", "\n")
        return F.regexp_replace(out, "\n{3,}", "\n\n")

    parts = F.split(F.regexp_replace(text, "\r\n?", "\n"), "```")
    return F.btrim(F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, prose(x)).otherwise(x)), "```"), F.lit(" \n"))


def drop_boilerplate_lines(text: Column) -> Column:
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.lower(F.btrim(x)).isin(*BOILERPLATE))
    return F.array_join(kept, "\n")


def clean_heading(value: Column, most: int = 160) -> Column:
    """Without leading marks, single-spaced, cut at a length."""
    return F.rtrim(F.substring(F.btrim(F.regexp_replace(F.regexp_replace(value, "^[#*>\\- ]+", ""), "[ \t]+", " ")), 1, most))


def is_generic_heading(value: Column) -> Column:
    """A heading that names no subject: empty, a number, a part of a book, or a filler word."""
    h = F.lower(clean_heading(value))
    return h.rlike("^(page|section|chapter|part|lesson)? ?[0-9.]*$") | h.isin("introduction", "overview", "other", "unknown", "none", "untitled")


def title_of(text: Column, otherwise: Column) -> Column:
    """The first line that says anything."""
    first = F.filter(F.transform(F.split(text, "\n"), lambda x: clean_heading(x)), lambda x: F.length(x) >= 3)
    return F.coalesce(F.try_element_at(first, F.lit(1)), otherwise)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def root(token: Column) -> Column:
    """A token cut to a common stem: eight letters and more to seven, six and seven to five."""
    n = F.length(token)
    return F.when(n >= 8, F.substring(token, 1, 7)).when(n >= 6, F.substring(token, 1, 5)).otherwise(token)


def significant_terms(text: Column) -> Column:
    """Distinct tokens in order of first use, without stopwords, digits and single characters. Only tokens that begin below the letters
    are looked at for digits."""
    return F.filter(F.array_distinct(tokens(text)), lambda t: (F.length(t) > 1) & ((t > ":") | ~t.rlike("^[0-9]+$")) & ~t.isin(*STOPWORDS))


def exact_terms(text: Column, most: int = 12) -> Column:
    """Code-shaped terms: upper-case names, dotted or slashed paths, versions."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(EXACT), F.lit(0))), 1, most)


def guess_term_type(term: Column) -> Column:
    return (
        F.when(term.rlike(r"^https?://"), "url")
        .when(term.rlike(r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$"), "config")
        .when(term.rlike(r"^/[a-z0-9/_-]+$"), "path")
        .when(term.rlike(r"^[0-9]+([.][0-9]+)*$"), "number")
        .when(term.rlike(r"^[a-z0-9]+[.][a-z0-9.]+$"), "file")
        .when(term.rlike(r"^[A-Z]{2,6}$"), "acronym")
        .otherwise("term")
    )


def summarize(text: Column, most: int) -> Column:
    return F.rtrim(F.substring(F.btrim(F.regexp_replace(text, "[ \t\n]+", " ")), 1, most))


def content_hash(*fields: Column) -> Column:
    """SHA-256 over fields, each led by a NUL; null fields are empty."""
    return F.sha2(F.concat(*[F.concat(F.lit("\0"), F.coalesce(f, F.lit(""))) for f in fields]), 256)


def identifier_hash(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 16)


def redact(text: Column) -> Column:
    for shape, instead in SECRETS:
        text = F.regexp_replace(text, shape, instead)
    return text


def contains_secret(text: Column) -> Column:
    out = F.lit(False)
    for shape, _ in SECRETS:
        out = out | text.rlike(shape)
    return out


def normalize_url(url: Column) -> Column:
    """Without query, fragment and trailing slashes; scheme and host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", "")
    return F.concat(F.lower(F.regexp_extract(bare, "^([a-zA-Z]+://[^/]*)", 1)), F.regexp_replace(bare, "^[a-zA-Z]+://[^/]*", ""))


def url_filename(url: Column) -> Column:
    """The last part of an address's path."""
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", ""), "([^/]+)$", 1)


def title_from_url(url: Column) -> Column:
    """The same without its ending, words apart."""
    return F.regexp_replace(F.regexp_replace(url_filename(url), "[.][a-z]+$", ""), "[-_]+", " ")


def url_domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#:]+)", 1))


def normalize_service_id(value: Column) -> Column:
    bare = F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_")
    return F.regexp_replace(F.btrim(bare, F.lit("_")), "_(docs|documentation)$", "")


def split_sentences(text: Column) -> Column:
    """Pieces between sentence marks that white space follows."""
    return F.filter(F.split(text, r"(?<=[.!?])[ \n]+"), lambda s: F.length(s) > 0)


def trigrams(text: Column) -> Column:
    """Distinct character trigrams, with two spaces before and one after the lower-cased text. Three shifted arrays of characters are
    zipped, so the work is in proportion to the text."""
    c = F.split(F.concat(F.lit("  "), F.lower(text), F.lit(" ")), "")
    n = F.length(text) + 1
    join = lambda x, y: F.concat(x, y)
    return F.array_distinct(F.zip_with(F.zip_with(F.slice(c, 1, n), F.slice(c, 2, n), join), F.slice(c, 3, n), join))


def word_trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each with two spaces before and one after it."""
    padded = F.transform(F.array_distinct(tokens(text)), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))

"""Column expressions over text: terms, lines, slugs, addresses, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A term, words that no search uses, and limits.
TERM = "[A-Za-z_][A-Za-z0-9_]*"
STOPWORDS = (
    "a an and are as at be by can code does do for from how in is it its of on or that the this to what when where which who why with work works"
).split()
MOST_TERMS, SHORTEST_TERM = 16, 2


def tokens(text: Column) -> Column:
    """Lower-cased identifiers of a text, repeats included."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TERM})"), F.lit(1)), F.lower)


def search_terms(texts: Column, most: int = MOST_TERMS) -> Column:
    """Terms of an array of texts, in order of first appearance; the cap comes after all texts."""
    every = F.flatten(F.transform(texts, tokens))
    kept = F.filter(every, lambda t: (F.length(t) >= SHORTEST_TERM) & ~t.isin(STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, most)


def lines(text: Column) -> Column:
    """Lines of a text; a last line break ends a line and starts none."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\R\z", ""), r"\R"))


def truncated(code: Column, most: int) -> Column:
    """The first lines of a text, with a note on how many more there are."""
    every = lines(F.coalesce(code, F.lit("")))
    note = F.concat(F.lit("\n# ... "), (F.size(every) - most).cast("string"), F.lit(" more lines not shown"))
    return F.when(F.size(every) <= most, code).otherwise(F.concat(F.array_join(F.slice(every, 1, most), "\n"), note))


def repository_address(url: Column) -> Column:
    """The one form of a repository's address: no blanks around it, no trailing slash, no ``.git``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(url), "/+$", ""), r"\.git$", ""), "/+$", "")


def slug(name: Column) -> Column:
    """Lower case, runs of other characters as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def last_segment(name: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(name, ".", -1)


def owner_of(name: Column) -> Column:
    """What precedes the last dot; null if there is none."""
    return F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", ""))


def base_name(name: Column) -> Column:
    """A qualified name without the number that tells equal names apart."""
    return F.regexp_replace(name, r"#\d+$", "")


def blob_sha(content: Column) -> Column:
    """The hash that git gives a file of this content."""
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(content).cast("string").cast("binary"), F.lit(bytes(1)), content.cast("binary")))

"""What database descriptions say: names, uninformative phrases, short forms, species, GO ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What makes a description uninformative, anywhere in it, at its start, or as all of it.
UNINFORMATIVE = (
    "uncharacterized protein", "hypothetical protein", "unnamed protein product", "putative uncharacterized",
    "uncharacterized conserved", "predicted protein", "whole genome shotgun", "scaffold",
)
UNINFORMATIVE_START = ("cdna clone", "genome assembly")
UNINFORMATIVE_WHOLE = ("low quality protein", "expressed protein")
#: Words before a description that its short form drops, and those that its unique form drops.
PREFIXES = ("probable", "putative", "predicted:")
UNIQUE_PREFIXES = ("putative", "probable", "uncharacterized")
GO_FORMAT = "GO:%07d"


def is_name(word: Column) -> Column:
    """Whether a word is an identifier: over two characters, no slash, at least two digits, and five digits or a share
    of digits of one half."""
    digits = F.length(F.regexp_replace(word, r"\D", ""))
    return F.coalesce((F.length(word) > 2) & ~word.contains("/") & (digits > 1) & ((digits >= 5) | (digits / F.length(word) >= 0.5)), F.lit(False))


def is_good(desc: Column) -> Column:
    """Whether a description says something: up to its last ``{`` and with ``_`` as a space it has no uninformative phrase,
    and it is not just a name, a name beside the word protein, or a word that starts with orf. Null and empty ones don't."""
    low = F.trim(F.regexp_replace(F.lower(F.trim(desc)), r"\{[^{]*$", ""))
    plain = F.translate(low, "_", " ")
    words = F.split(low, " ")
    bad = (low == "") | plain.isin(*UNINFORMATIVE_WHOLE)
    for phrase in UNINFORMATIVE:
        bad = bad | plain.contains(phrase)
    for phrase in UNINFORMATIVE_START:
        bad = bad | plain.startswith(phrase)
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    one = (F.size(words) == 1) & (is_name(first) | low.startswith("orf"))
    two = (F.size(words) == 2) & ((is_name(first) & (second == "protein")) | (is_name(second) & (first == "protein")))
    return F.coalesce(~(bad | one | two), F.lit(False))


def brief(desc: Column) -> Column:
    """In lower case and up to a ``{``, without leading probable, putative or predicted, the first two words; a first word
    of over 20 characters stands alone."""
    text = F.trim(F.substring_index(F.lower(desc), "{", 1))
    for prefix in PREFIXES:
        text = F.regexp_replace(text, f"^{prefix}\\s+", "")
    words = F.split(text, r"\s+")
    return F.when(F.length(F.element_at(words, 1)) > 20, F.element_at(words, 1)).otherwise(F.array_join(F.slice(words, 1, 2), " "))


def without_evidence(desc: Column) -> Column:
    return F.trim(F.regexp_replace(desc, r"\s*\{[^}]*\}", ""))


def unique_form(desc: Column) -> Column:
    """A form that near-equal descriptions share: lower case, up to a ``{``, without ``-like`` if it ends so, without a name
    after two or more words, and without a leading putative, probable or uncharacterized. Of what is left, if it has four
    characters or more, a number of one or two digits after the last space, ``-`` or ``_`` (the first of these that has one)
    goes, or else the last character if it is a digit."""
    text = F.trim(F.substring_index(F.lower(F.trim(desc)), "{", 1))
    text = F.when(text.endswith("-like"), F.trim(F.replace(text, F.lit("-like")))).otherwise(text)
    words = F.split(text, " ")
    text = F.when((F.size(words) > 2) & is_name(F.element_at(words, -1)), F.regexp_replace(text, " [^ ]*$", "")).otherwise(text)
    shorter = F.when(F.lit(False), text)
    for prefix in UNIQUE_PREFIXES:
        shorter = shorter.when(text.startswith(prefix), F.trim(F.replace(text, F.lit(prefix))))
    text = shorter.otherwise(text)
    number = lambda mark: r"(?s)^(.*)" + mark + r"(?:\d{1,2}|[+-]\d)$"
    trimmed = F.when(F.length(text) < 4, text)
    for mark in (" ", "-", "_"):
        trimmed = trimmed.when(text.rlike(number(mark)), F.regexp_extract(text, number(mark), 1))
    return trimmed.otherwise(F.regexp_replace(text, r"\d$", ""))


def species(text: Column) -> Column:
    """The first two words."""
    return F.substring_index(F.regexp_replace(F.trim(text), r"\s+", " "), " ", 2)


def go_id(number: Column) -> Column:
    return F.format_string(GO_FORMAT, number.cast("int"))


def go_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^(?:GO:)?0*(\d+)$", 1), F.lit("")).cast("int")


def database_label(dbtype: Column, taxonomy: Column) -> Column:
    """Such as ``SPpla``: the type in capitals and the first three letters of the taxonomy."""
    return F.concat(F.upper(F.substring(dbtype, 1, 2)), F.lower(F.substring(taxonomy, 1, 3)))

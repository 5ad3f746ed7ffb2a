"""Column expressions on text.  All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions import fixed_values as fv

# Regex classes spelled out character by character, so that they do not depend
# on the regex engine's idea of white space or of a line end.
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
OTHER_BREAKS = "\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
OTHER_BREAK_CLASS = r"\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029"
LINE_BREAK_CLASS = r"\n" + OTHER_BREAK_CLASS
INLINE_SPACE_CLASS = r"\t\x1f \xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
SPACE_CLASS = LINE_BREAK_CLASS + INLINE_SPACE_CLASS

# A letter with case, as opposed to digits, marks and scripts without case.
CASED_CLASS = r"\p{IsUppercase}\p{IsLowercase}\p{Lt}"


def strip(col: Column) -> Column:
    """Remove white space at both ends.

    ``btrim`` with a character set only looks at the ends of the value; a
    regex would scan all of it.
    """
    return F.btrim(col, F.lit(fv.SPACE_CHARS))


def is_blank(col: Column) -> Column:
    # The start decides: a trim at the left ends at the first other character.
    return F.ltrim(col, F.lit(fv.SPACE_CHARS)) == ""


def or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def rewritten(col: Column, marks: Iterable[str], rewrite) -> Column:
    """``rewrite(text)`` for texts that hold one of the marks, others as they are.

    For a rewrite that changes nothing without a mark.  Looking for bytes costs a
    fraction of a regex, which decodes the text, tries every place and encodes it.
    """

    def one(text: Column) -> Column:
        found = reduce(Column.__or__, [F.contains(text, F.lit(mark)) for mark in marks])
        return F.when(found, rewrite(text)).otherwise(text)

    return let(col, one)


def newlines(col: Column) -> Column:
    """Every line break as ``\\n``."""
    return rewritten(
        col,
        OTHER_BREAKS,
        lambda text: F.regexp_replace(
            F.replace(text, F.lit("\r\n"), F.lit("\n")), f"[{OTHER_BREAK_CLASS}]", "\n"
        ),
    )


def collapse_space(col: Column) -> Column:
    return F.regexp_replace(col, f"[{SPACE_CLASS}]+", " ")


def title_case(col: Column) -> Column:
    """Upper-case every letter that follows a character without case."""
    runs = F.regexp_extract_all(col, F.lit(f"([{CASED_CLASS}]+|[^{CASED_CLASS}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def occurrences(text: Column, term: Column) -> Column:
    """Number of non-overlapping occurrences of a non-empty term.

    Counted in bytes: ``octet_length`` is a field read, ``length`` a scan.
    """
    removed = F.octet_length(text) - F.octet_length(F.replace(text, term, F.lit("")))
    return F.floor(removed / F.octet_length(term))


def plain_text(col: Column) -> Column:
    """Markdown to plain text: the nine rewrites in order, then strip."""
    space = f"[{SPACE_CLASS}]*"
    rewrites = [
        (["<", "&"], rf"(?i)<br{space}/?>|&lt;br{space}/?&gt;", " "),
        (["```"], r"(?s)```.*?```", " "),
        (["`"], r"`([^`]*)`", "$1"),
        (["]("], r"(?d)!\[.*?\]\(.*?\)", " "),
        (["]("], r"(?d)\[(.*?)\]\(.*?\)", "$1"),
        (["#"], rf"(?md)^#{{1,6}}{space}", ""),
        ("*_~>#-", "[*_~>#-]", " "),
        (["\n\n"], r"\n{2,}", "\n"),
        (["  ", "\t"], r"[ \t]+", " "),
    ]
    out = col
    for marks, pattern, replacement in rewrites:
        out = rewritten(out, marks, lambda text, p=pattern, r=replacement: F.regexp_replace(text, p, r))
    return strip(out)


def haystack(*cols: Column) -> Column:
    """The lower-cased text that search terms are looked up in."""
    return F.lower(F.concat_ws(" ", *[or_empty(c) for c in cols]))


def escape_html(col: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def snippet(col: Column) -> Column:
    """The start of a hit's text, always followed by dots."""
    return F.concat(F.left(or_empty(col), F.lit(fv.SNIPPET_CHARS)), F.lit("..."))


def preview(col: Column) -> Column:
    """The start of a fragment's text, with dots only where text was left out."""
    head = strip(F.left(or_empty(col), F.lit(fv.PREVIEW_CHARS)))
    return F.when(F.length(col) > fv.PREVIEW_CHARS, F.concat(head, F.lit("..."))).otherwise(head)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Inside a lambda there is no column to hold an intermediate value, and
    repeating the expression would repeat its work.
    """
    return F.element_at(F.transform(F.array(value), body), 1)

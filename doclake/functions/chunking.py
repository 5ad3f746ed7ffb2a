"""Markdown body to an array of pieces, inside one row.

A body is one input row, so cutting it needs no shuffle: the sections are one
regex split, and the packing of an oversize section is a fold over its units.
The array position is the piece number, which saves the window that numbering
rows of an exploded document would need.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions import fixed_values as fv
from doclake.functions.text import (
    INLINE_SPACE_CLASS,
    LINE_BREAK_CLASS,
    let,
    newlines,
    strip,
)

FOLD_BLOCK = 256

HEADER = rf"#{{1,6}}[{INLINE_SPACE_CLASS}]"
# Looking ahead for the header first is quicker: few characters pass that test.
SECTION_START = rf"(?={HEADER})(?<=[{LINE_BREAK_CLASS}])"


def sections(markdown: Column) -> Column:
    """``array<struct<section, content>>``: one entry per header, plus the text before the first."""

    def one(raw: Column) -> Column:
        rest_of_header = F.regexp_extract(raw, rf"^#{{1,6}}([^{LINE_BREAK_CLASS}]*)", 1)
        title = F.when(raw.rlike(f"^{HEADER}"), strip(rest_of_header)).otherwise(fv.DEFAULT_SECTION)
        return F.struct(
            title.alias("section"),
            strip(newlines(raw)).alias("content"),
        )

    raw_sections = F.filter(F.split(markdown, SECTION_START, -1), lambda raw: raw != "")
    return F.transform(raw_sections, one)


def _units(content: Column, max_chars: int) -> Column:
    """What is packed: paragraphs, or the lines of a paragraph that is too long itself.

    ``gap`` is the length of the joiner a unit asks for: 1 for a line, 2 for a
    paragraph.
    """

    def stripped(parts: Column) -> Column:
        return F.filter(F.transform(parts, strip), lambda part: part != "")

    def unit(text: Column, gap: int) -> Column:
        return F.struct(text.alias("text"), F.length(text).alias("size"), F.lit(gap).alias("gap"))

    return F.flatten(
        F.transform(
            stripped(F.split(content, "\n\n", -1)),
            lambda para: F.when(
                F.length(para) > max_chars,
                F.transform(stripped(F.split(para, "\n", -1)), lambda line: unit(line, 1)),
            ).otherwise(F.array(unit(para, 2))),
        )
    )


def _cuts(units: Column, max_chars: int) -> Column:
    """Positions of the units that open a new part.

    A fold copies its state at every step, so the list of cuts must not grow
    with the section: an inner fold over ``FOLD_BLOCK`` units starts with an
    empty list, and an outer fold over the blocks puts the lists together.
    """
    count = F.size(units)

    def state(used: Column, cuts: Column) -> Column:
        return F.struct(used.alias("used"), cuts.alias("cuts"))

    def nothing() -> Column:
        return F.array().cast("array<int>")

    def step(before: Column, at: Column) -> Column:
        unit = F.get(units, at)
        full = (before["used"] > 0) & (before["used"] + unit["size"] > max_chars)
        return state(
            F.when(full, 0).otherwise(before["used"]) + unit["size"] + unit["gap"],
            F.when(full, F.array_append(before["cuts"], at)).otherwise(before["cuts"]),
        )

    def block(before: Column, first: Column) -> Column:
        positions = F.sequence(first, F.least(first + FOLD_BLOCK, count) - 1)
        inner = F.aggregate(positions, state(before["used"], nothing()), step)
        return let(inner, lambda after: state(after["used"], F.concat(before["cuts"], after["cuts"])))

    blocks = F.sequence(F.lit(0), count - 1, F.lit(FOLD_BLOCK))
    return F.aggregate(blocks, state(F.lit(0), nothing()), block, lambda after: after["cuts"])


def _pack(section: Column, content: Column, max_chars: int) -> Column:
    def parts(units: Column, bounds: Column) -> Column:
        count = F.size(bounds) - 1

        def part(k: Column) -> Column:
            first, end = F.get(bounds, k - 1), F.get(bounds, k)
            # By position: a slice would copy the whole array once per part.
            texts = F.transform(F.sequence(first, end - 1), lambda at: F.get(units, at)["text"])
            # A full part is joined the way the unit that did not fit asks for.
            by_line = F.coalesce(F.get(units, end)["gap"] == 1, F.lit(False))
            label = F.when(
                count > 1, F.concat(section, F.lit(" (Parte "), k.cast("string"), F.lit(")"))
            ).otherwise(section)
            joined = F.when(by_line, F.array_join(texts, "\n")).otherwise(F.array_join(texts, "\n\n"))
            return F.struct(label.alias("section"), joined.alias("content"))

        return F.transform(F.sequence(F.lit(1), count), part)

    def bounded(units: Column) -> Column:
        bounds = F.concat(F.array(F.lit(0)), _cuts(units, max_chars), F.array(F.size(units)))
        return let(bounds, lambda b: parts(units, b))

    return let(_units(content, max_chars), bounded)


def pieces(sections_col: Column, max_chars: int = fv.MAX_FRAGMENT_CHARS) -> Column:
    """``array<struct<section, content>>`` where long sections are cut into parts."""

    def one(sec: Column) -> Column:
        return F.when(F.length(sec["content"]) <= max_chars, F.array(sec)).otherwise(
            _pack(sec["section"], sec["content"], max_chars)
        )

    return F.flatten(F.transform(sections_col, one))

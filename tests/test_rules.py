"""Rules on hand-written rows, with expected values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from doclake.functions import chunking, names, noise
from doclake.functions.terms import highlight_terms, query_terms
from doclake.functions.text import (
    is_blank,
    newlines,
    occurrences,
    plain_text,
    preview,
    rewritten,
    snippet,
    strip,
    title_case,
)
from doclake.operators.fragments import fragments_from_markdown, split_sections
from doclake.operators.present import highlight, mark_pattern


def test_strip_knows_all_white_space(values):
    assert values(strip, ["  a b  \x1c", "\t\n", "", "​a"]) == ["a b", "", "", "​a"]


def test_title_case_restarts_after_every_non_letter(values):
    given = ["res rc.001a o'neil", "ÁRBOL élan 2a", "n° 5ª x", "", "ABC-def_ghi"]
    assert values(title_case, given) == ["Res Rc.001A O'Neil", "Árbol Élan 2A", "N° 5ª X", "", "Abc-Def_Ghi"]


@pytest.mark.parametrize("text", ["ab1c d'e", "ñandú É", "a日本b", "xªy"])
def test_title_case_is_the_usual_one(values, text):
    assert values(title_case, [text]) == [text.title()]


PLAIN = {
    "a<br/>b<BR >c&lt;BR&gt;d": "a b c d",
    "x ```code\n# not``` y": "x y",
    "use `code` here": "use code here",
    "![alt](img.png)see [text](http://x)": "see text",
    "## Title\n\n\nbody": "Title\nbody",
    "## \n\n\nbody": "body",
    "ORD-001_2 ~x~ > # *b*": "ORD 001 2 x b",
    "a | b": "a | b",
    "a\n\n\n\nb": "a\nb",
    "a\t \tb": "a b",
    " a ": "a",
    "#######x": "x",
    "a # b": "a  b",
    "": "",
}


def test_plain_text(values):
    assert values(plain_text, list(PLAIN)) == list(PLAIN.values())


def test_texts_without_a_mark_are_not_rewritten(values):
    def rewrite(text):
        return F.when(F.contains(text, F.lit("#")), F.concat(text, F.lit("!"))).otherwise(F.raise_error(F.lit("rewritten")))

    texts = ["", "a b", "a # b", None, "é`"]
    assert values(lambda c: rewritten(c, ["#"], rewrite), texts) == ["", "a b", "a # b!", None, "é`"]


def test_every_line_break_and_blank_text_is_known(values):
    breaks = ["\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\n"]
    assert values(newlines, [f"a{one}b" for one in breaks] + ["a b", None]) == ["a\nb"] * len(breaks) + ["a b", None]
    assert values(is_blank, ["", " \u3000\r\n\x85", " x ", None]) == [True, True, False, None]


def test_the_title_is_made_per_document(spark):
    docs = spark.createDataFrame([("RES_1", "RES_1.md", "# a\nx\n# b\ny")], "document_id string, file_name string, markdown string")
    made = fragments_from_markdown(docs)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "initcap" not in plan[: plan.index("Generate")]
    assert [r["title"] for r in made.collect()] == ["Res 1", "Res 1"]


def test_occurrences_do_not_overlap(spark):
    rows = spark.createDataFrame([("aaaa", "aa"), ("ababab", "abab"), ("ñañ", "ñ"), ("x", "yy")], "t string, w string")
    assert [r[0] for r in rows.select(occurrences(F.col("t"), F.col("w"))).collect()] == [2, 1, 2, 0]


def sections_of(spark, markdown):
    docs = spark.createDataFrame([("d", "d.md", markdown)], "document_id string, file_name string, markdown string")
    return [(r["section"], r["content"]) for r in split_sections(docs).orderBy("sec_no").collect()]


SECTIONS = [
    ("", []),
    ("\n", [("Inicio", "")]),
    ("\n\n# A\nx", [("Inicio", ""), ("A", "# A\nx")]),
    ("# A\nx", [("A", "# A\nx")]),
    ("# A", [("A", "# A")]),
    ("# A\n## B", [("A", "# A"), ("B", "## B")]),
    ("####### A\nx", [("Inicio", "####### A\nx")]),
    ("#A\nx", [("Inicio", "#A\nx")]),
    ("x\n# \ny", [("Inicio", "x"), ("", "# \ny")]),
    ("x\n#\ny", [("Inicio", "x\n#\ny")]),
    ("```\n# in a fence\n```", [("Inicio", "```"), ("in a fence", "# in a fence\n```")]),
    ("a\r\n# B\r\nc\x0cd # E", [("Inicio", "a"), ("B", "# B\nc\nd"), ("E", "# E")]),
    ("a\x1fb\n# T \nc", [("Inicio", "a\x1fb"), ("T", "# T \nc")]),
    ("a\n # no header", [("Inicio", "a\n # no header")]),
    ("a\r\r\n\n# B", [("Inicio", "a"), ("B", "# B")]),
]


@pytest.mark.parametrize("markdown,expected", SECTIONS)
def test_sections(spark, markdown, expected):
    assert sections_of(spark, markdown) == expected


def pieces_of(spark, markdown, max_chars=2000):
    df = spark.createDataFrame([(markdown,)], "m string")
    pieces = chunking.pieces(chunking.sections(F.col("m")), max_chars)
    return [(p["section"], p["content"]) for p in df.select(pieces.alias("p")).first()["p"]]


@pytest.mark.parametrize("length,parts", [(1999, 1), (2000, 1), (2001, 1)])
def test_one_long_line_is_never_cut(spark, length, parts):
    assert [p[0] for p in pieces_of(spark, "x" * length)] == ["Inicio"] * parts


def test_a_line_of_its_own_beyond_the_limit(spark):
    assert pieces_of(spark, "x" * 2500) == [("Inicio", "x" * 2500)]


def test_paragraphs_are_packed_greedily(spark):
    a, b, c = "a" * 900, "b" * 900, "c" * 900
    assert pieces_of(spark, f"{a}\n\n{b}\n\n\n{c}") == [
        ("Inicio (Parte 1)", f"{a}\n\n{b}"),
        ("Inicio (Parte 2)", c),
    ]


def test_limit_counts_joiners_of_earlier_units_only(spark):
    # 996 + 2 + 1002 = 2000 fits, one more does not.
    assert len(pieces_of(spark, f"{'a' * 996}\n\n{'b' * 1002}\n\n{'c' * 10}")) == 2
    first, second = pieces_of(spark, f"{'a' * 996}\n\n{'b' * 1003}\n\n{'c' * 10}")
    assert first == ("Inicio (Parte 1)", "a" * 996)
    assert second == ("Inicio (Parte 2)", f"{'b' * 1003}\n\n{'c' * 10}")


def test_full_part_is_joined_as_the_next_unit_asks(spark):
    short, lines = "s" * 500, "\n".join(c * 700 for c in "abcd")
    got = pieces_of(spark, f"{short}\n\n{lines}\n\n{'z' * 800}")
    assert got == [
        # closed by a line: joined with one newline, also after the paragraph
        ("Inicio (Parte 1)", "\n".join([short, "a" * 700, "b" * 700])),
        # closed by a paragraph: joined with a blank line, also between lines
        ("Inicio (Parte 2)", "\n\n".join(["c" * 700, "d" * 700])),
        ("Inicio (Parte 3)", "z" * 800),
    ]


def test_lines_of_a_long_paragraph_are_stripped(spark):
    got = pieces_of(spark, f"  {'a' * 1500}  \n \n{'b' * 1500} ")
    assert got == [("Inicio (Parte 1)", "a" * 1500), ("Inicio (Parte 2)", "b" * 1500)]


def test_numbers_count_blank_pieces(spark):
    docs = spark.createDataFrame(
        [("ORD_1-x", "ORD_1-x.md", "\n\n## Página 1\n\ntext\n# \n")],
        "document_id string, file_name string, markdown string",
    )
    rows = fragments_from_markdown(docs).orderBy("chunk_number").collect()
    assert [(r["id"], r["title"], r["section"], r["chunk_number"], r["content_text"]) for r in rows] == [
        ("ORD_1-x-fragment-2", "Ord 1 X", "Página 1", 2, "Página 1\ntext"),
        ("ORD_1-x-fragment-3", "Ord 1 X", "", 3, ""),
    ]


NOISE = {
    "": True,
    " \n ": True,
    "x" * 49: True,
    "x" * 50: False,
    "word " * 16 + "-" * 20: False,  # 20 of 100 is not above the share
    "word " * 16 + "-" * 21: True,
    "word " * 16 + "--- " * 20: False,  # runs of three do not count
    "ab " * 14 + "1" * 39: True,  # 14 words, 81 characters
    "ab " * 14 + "1" * 38: False,  # 14 words, 80 characters
    "ab " * 15 + "1" * 36: False,
}


def test_noise_rule(values):
    assert values(noise.is_text_noisy, list(NOISE)) == list(NOISE.values())


def test_null_text_is_noise(values):
    assert values(noise.is_text_noisy, [None]) == [True]


def terms_of(values, build, text):
    return [(t["text"], t["is_phrase"], t["required"], t["weight"]) for t in values(build, [text])[0]]


def word(text):
    return (text, False, True, 10)


def phrase(text, required=True):
    return (text, True, required, 1000)


TERMS = [
    ("", []),
    ("   ", []),
    ("The", [word("the")]),
    ("de la", [word("de"), word("la"), phrase("de la", False)]),
    ("que  tion", [word("tion"), phrase("que tion", False)]),
    ('"de la" tion', [phrase("de la"), word("tion")]),
    ('"of the" "and the" x', [phrase("of the"), phrase("and the"), word("x")]),
    ("THE  the", [word("the"), word("the"), phrase("the the", False)]),
    ('"the', [word('"the')]),
    ('" " de la', []),
    ('"de" la', [phrase("de"), word("la")]),
    ('"a" b "a" c', [phrase("a"), phrase("a"), word("b"), word("c")]),
    ("más que nada", [word("nada"), phrase("más que nada", False)]),
    ("ord-001 x", [word("ord-001"), word("x"), phrase("ord-001 x", False)]),
]


@pytest.mark.parametrize("text,expected", TERMS)
def test_search_terms(values, text, expected):
    assert terms_of(values, query_terms, text) == expected


def test_highlight_terms_look_at_each_word_of_a_quoted_part(values):
    # As a whole the quoted part is no stop word; its words all are.
    assert terms_of(values, query_terms, '"de la" el') == [phrase("de la")]
    assert terms_of(values, highlight_terms, '"de la" el') == [phrase("de la"), word("el")]
    # A part with blanks inside its quotes is not found again once trimmed.
    assert terms_of(values, highlight_terms, '" x " z') == [
        phrase("x"), word('"'), word("x"), word('"'), word("z"),
    ]


def test_names(values):
    assert values(names.stem, ["a.pdf", "a.tar.gz", ".bashrc", "a.", "a", "a.pdf.pdf"]) == [
        "a", "a.tar", ".bashrc", "a.", "a", "a.pdf",
    ]
    assert values(names.suffix, ["a.PDF", "a", ".x", "a.b.Doc"]) == [".pdf", "", "", ".doc"]
    assert values(names.humanize_stem, ["a_b-c", " _- ", "", "x"]) == ["A B C", "Documento", "Documento", "X"]
    assert values(names.payload_title, ["_a-b_", ""]) == [" A B ", ""]
    hex32 = "0123456789abcdefABCDEF0123456789"
    assert values(names.original_filename, [f"{hex32}_a_b.pdf", f"{hex32[:31]}_a.pdf", f"{hex32}a.pdf"]) == [
        "a_b.pdf", f"{hex32[:31]}_a.pdf", f"{hex32}a.pdf",
    ]
    assert values(names.display_name, [f"{hex32}_mi_doc.pdf"]) == ["Mi Doc"]


def test_sanitizing(values):
    given = ["Acción N° 5ª  (1).pdf", "ﬁn a___b.PDF", "日本.pdf", "a-b.c_d"]
    assert values(names.sanitize_filename, given) == ["Accion_N_5a_1_.pdf", "fin_a_b.PDF", ".pdf", "a-b.c_d"]
    got = values(lambda c: names.sanitize_upload_name(c, F.lit("k")), ["Acción  1.pdf"])
    assert got == ["8ce4b16b22b58894aa86c421e8759df3_Acci_n__1.pdf"]


def test_category(values):
    given = ["ord_1", "RES_RC-2", "res_radmq", "RES_RAQ1", "MARCO", "ACTA_CONCEJO_3", "x"]
    assert values(names.category, given) == [
        "Ordenanzas", "Resoluciones de Concejo", "Resoluciones de Alcaldía", "Resoluciones de Alcaldía",
        "Resoluciones de Concejo", "Resoluciones de Concejo", "Resoluciones de Alcaldía",
    ]


def test_duplicate_key(values):
    given = ["A b.PDF", "a-b.pdf.pdf", "a_b.docx.md", "a - b.pdf", "a____b.pdf", "_x_.json", ".pdf", "a.txt"]
    assert values(names.duplicate_key, given) == ["a_b", "a_b", "a_b", "a__b", "a__b", "x", "", "a.txt"]


def test_name_penalty(values):
    given = ["a.pdf", "a.pdf.pdf", "a.PDF", "a.pdf.docx", "a.pdf.PDF", "x", ".pdf"]
    assert values(names.name_penalty, given) == [0, 30, 2, 10, 32, 0, 0]


def test_snippet_and_preview(values):
    assert values(snippet, ["a", "b" * 301, None]) == ["a...", "b" * 300 + "...", "..."]
    assert values(preview, [" a ", "b" * 140, "c" * 141, " " + "d" * 139 + " e"]) == [
        "a", "b" * 140, "c" * 140 + "...", "d" * 139 + "...",
    ]


def marked(spark, text, query):
    df = spark.createDataFrame([(text, query)], "t string, q string")
    return df.select(highlight(F.col("t"), mark_pattern(F.col("q")))).first()[0]


def test_highlight(spark):
    assert marked(spark, "The cat & THE <dog>", "the") == "<mark>The</mark> cat &amp; <mark>THE</mark> &lt;dog&gt;"
    assert marked(spark, "of  the\nof the", "of the") == "<mark>of  the</mark>\n<mark>of the</mark>"
    assert marked(spark, "of<br/>the", '"of the"') == "<mark>of&lt;br/&gt;the</mark>"
    assert marked(spark, "1+1 (x) [y]", '1+1 "(x) [y]"') == "<mark>1+1</mark> <mark>(x) [y]</mark>"
    assert marked(spark, "ÉTÉ", "été") == "<mark>ÉTÉ</mark>"
    assert marked(spark, "a < b", "") == "a &lt; b"

"""Benchmark questions in documents, also with other numbers, names and units.

Texts are brought to a template: numbers, names (capitalised words inside a
sentence) and units after a number become typed placeholders, the rest is lower
case.  Windows of template words are hashed and joined.  The words of the
benchmark give a window at every place, those of a document one after the other
without overlap: a shared run of ``2 * WINDOW - 1`` words holds a whole window of
the document wherever it starts.  Each meeting fixes how question and document
lie against each other; there the templates are compared word by word, and in
a common run every slot value of the question must stand for one value of the
document and the other way round.  A run whose words are the same on both sides,
slots included, needs no such check.

Everything is done with DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.session import broadcast_if, fits_broadcast, lookup_join, stored

WINDOW = 5
MIN_RUN = 13
MIN_PLAIN = 6

NUMBER, NAME, UNIT = "0", "\ue000", "\ue001"

# Abbreviations and names of units.
UNITS = (
    "mm cm dm m km in ft yd mi mg g kg t lb lbs oz ml cl dl l ms s sec min h hr hrs hz khz mhz ghz kb mb gb tb w kw mw kwh "
    "v kv a ma j kj cal kcal pa kpa bar n kn k c f usd eur gbp percent seconds minutes hours days weeks months years "
    "meters metres kilometers kilometres centimeters centimetres miles feet inches grams kilograms pounds ounces liters "
    "litres dollars cents euros degrees"
).split()

# Each pattern opens with the rarest class, so most places fail at one look.
_UNIT = r"([0-9]\x20?)(?i:" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + r")(?![\p{L}\p{N}])"
_NAME = r"\p{Lu}(?<=[\p{Ll}0-9][,;]?\x20\p{Lu})\p{Ll}+"
_WORD = f"[\\p{{L}}\\p{{N}}{NAME}{UNIT}]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def template(text: Column) -> Column:
    """The words of a text with typed placeholders; one for each word of the text."""
    marked = F.regexp_replace(F.regexp_replace(text, _UNIT, "$1" + UNIT), _NAME, NAME)
    return _words(F.lower(F.regexp_replace(marked, "[0-9]+", NUMBER)))


def _windows(words: Column, length: int, stride: int) -> Column:
    """Hashes of windows of ``length`` words, one every ``stride`` words."""
    count = F.floor((F.size(words) - length) / F.lit(stride)).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), count), lambda n: F.xxhash64(F.slice(words, n * stride + 1, length)))
    return F.when(F.size(words) >= length, hashes)


def _rows(df: DataFrame, id_col: str, text_col: str, prefix: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias(f"{prefix}_id"), F.xxhash64(text).alias(f"{prefix}_version"), text.alias(f"{prefix}_text"))


def _meetings(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, doc_version, item_id, item_version, shift)`` where a window meets."""
    item_words = stored(items.withColumn("words", template(F.col("item_text"))).drop("item_text"), "templates")
    doc_words = docs.select("doc_id", "doc_version", template(F.col("doc_text")).alias("words"))
    lengths = [r[0] for r in item_words.select(F.least(F.size("words"), F.lit(2 * WINDOW - 1))).distinct().collect()]
    found = None
    # Questions too short to hold a whole window wherever it starts are windows
    # of their own length, looked for at every place; at most 2 * WINDOW - 1 passes.
    for length in sorted(n for n in lengths if n > 0):
        whole = length == 2 * WINDOW - 1
        width, stride = (WINDOW, WINDOW) if whole else (length, 1)
        chosen = item_words.where(F.size("words") >= length if whole else F.size("words") == length)
        asked = chosen.select("item_id", "item_version", F.posexplode_outer(_windows(F.col("words"), width, 1)).alias("at", "hash"))
        asked = stored(asked, "windows")
        # The outer form, as the inner one adds a filter that works out all windows once more.
        hashes = _windows(F.col("words"), width, stride)
        tiles = doc_words.select("doc_id", "doc_version", F.posexplode_outer(hashes).alias("n", "hash"))
        met = tiles.join(broadcast_if(fits_broadcast(asked), asked), "hash")
        met = met.select("doc_id", "doc_version", "item_id", "item_version", (F.col("n") * stride - F.col("at")).alias("shift"))
        found = met if found is None else found.unionByName(met)
    if found is None:
        return docs.join(items.limit(0), F.lit(False)).select(
            "doc_id", "doc_version", "item_id", "item_version", F.lit(0).alias("shift")
        )
    return found.distinct()


def _runs(same: Column, least: Column, exact: bool) -> Column:
    """``(start, length, exact)`` of the runs of true of at least ``least`` words."""
    kind = "array<struct<start:int,length:int,exact:boolean>>"
    zero = F.struct(F.lit(0).alias("here"), F.lit(0).alias("n"), F.array().cast(kind).alias("runs"))

    def step(s: Column, equal: Column) -> Column:
        run = F.struct((s["n"] - s["here"]).alias("start"), s["here"].alias("length"), F.lit(exact).alias("exact"))
        ended = ~equal & (s["here"] > 0) & (s["here"] >= least)
        return F.struct(
            F.when(equal, s["here"] + 1).otherwise(0).alias("here"),
            (s["n"] + 1).alias("n"),
            F.when(ended, F.concat(s["runs"], F.array(run))).otherwise(s["runs"]).alias("runs"),
        )

    return F.aggregate(F.concat(same, F.array(F.lit(False))), zero, step, lambda s: s["runs"])


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_run: int = MIN_RUN,
    min_plain: int = MIN_PLAIN,
) -> DataFrame:
    """``(doc_id, doc_version, item_id, run_words, item_words, n_slots, verbatim)``: documents that hold a question.

    One row per document and question whose templates share a run of ``min_run``
    words, or of the whole question if it is shorter, with ``min_plain`` words
    (or all) that are more than placeholders, and with consistent slots, or whose
    words themselves do, apart from case; ``verbatim`` says that all slots have
    the values of the question.  The longest run of the pair is given.

    Whole texts on both sides, null texts are empty and hold nothing, questions
    without words match nothing.  Rows that repeat id and text give one row; null
    ids are kept.  Only questions and pairs that met are ever gathered; the
    windows of the benchmark are broadcast if they were measured to be small.
    """
    doc_rows, items = _rows(docs, id_col, text_col, "doc"), stored(_rows(benchmark, item_col, item_text_col, "item").distinct(), "items")
    met = stored(_meetings(doc_rows, items), "meetings")
    asked = met.select("doc_id", "doc_version").distinct()
    keyed = asked.select(
        "doc_version", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.col("doc_id").isNull().alias("no_id")
    )
    texts = lookup_join(
        doc_rows.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("no_id", F.col("doc_id").isNull()),
        keyed,
        ["doc_version", "key", "no_id"],
        "left_semi",
    )
    texts = texts.select("doc_id", "doc_version", template(F.col("doc_text")).alias("d"), _words(F.col("doc_text")).alias("d_raw"))
    texts = stored(texts.dropDuplicates(["doc_id", "doc_version"]), "suspects")
    asks = items.select(
        F.col("item_id").alias("i_id"),
        F.col("item_version").alias("i_version"),
        template(F.col("item_text")).alias("i"),
        _words(F.col("item_text")).alias("i_raw"),
    )
    asks = stored(asks, "asks")
    pairs = met.join(
        broadcast_if(fits_broadcast(asks), asks),
        F.col("item_id").eqNullSafe(F.col("i_id")) & (F.col("item_version") == F.col("i_version")),
    )
    t = texts.select(F.col("doc_id").alias("t_id"), F.col("doc_version").alias("t_version"), "d", "d_raw")
    pairs = pairs.join(t, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("doc_version") == F.col("t_version")))
    # Only the words that lie against the question go on.
    first = F.greatest(F.lit(0), -F.col("shift"))
    count = F.least(F.size("i"), F.size("d") - F.col("shift")) - first

    def part(words: str, start: Column) -> Column:
        return F.slice(F.col(words), start + 1, F.greatest(count, F.lit(0)))

    laid = pairs.select(
        "doc_id",
        "doc_version",
        "item_id",
        F.size("i").alias("item_words"),
        part("i", first).alias("i"),
        part("i_raw", first).alias("i_raw"),
        part("d", first + F.col("shift")).alias("d"),
        part("d_raw", first + F.col("shift")).alias("d_raw"),
    )
    least = F.least(F.lit(min_run), F.col("item_words"))
    alike = F.zip_with("i", "d", lambda a, b: a == b)
    equal = F.zip_with("i_raw", "d_raw", lambda a, b: F.lower(a) == F.lower(b))
    laid = laid.withColumn("runs", _runs(alike, least, False)).where(F.size("runs") > 0)
    exact = _runs(F.zip_with(alike, equal, lambda a, b: a & b), least, True)
    laid = laid.withColumn("run", F.explode_outer(F.concat("runs", exact)))

    def in_run(words: str) -> Column:
        return F.slice(F.col(words), F.col("run.start") + 1, F.col("run.length"))

    holes = F.filter(
        F.transform(in_run("i"), lambda word, n: F.struct(word.alias("word"), n.alias("n"))),
        lambda x: x["word"].rlike(f"[{NUMBER}{NAME}{UNIT}]"),
    )
    slots = F.transform(
        holes,
        lambda x: F.struct(
            x["word"].alias("kind"),
            F.lower(F.get(in_run("i_raw"), x["n"])).alias("asked"),
            F.lower(F.get(in_run("d_raw"), x["n"])).alias("found"),
        ),
    )
    judged = laid.withColumn("slots", slots)

    def kinds(field: str) -> Column:
        return F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s[field]))))

    meant = F.size(F.array_distinct("slots"))
    bare = F.filter(in_run("i"), lambda word: word.rlike(f"^[{NUMBER}{NAME}{UNIT}]+$"))
    plain = F.col("run.length") - F.size(bare)
    enough = plain >= F.least(F.lit(min_plain), F.col("item_words"))
    consistent = judged.where(F.col("run.exact") | ((kinds("asked") == meant) & (kinds("found") == meant) & enough))
    best = F.max(
        F.struct(
            F.col("run.length").alias("run_words"),
            (~F.exists("slots", lambda s: s["asked"] != s["found"])).alias("verbatim"),
            F.size("slots").alias("n_slots"),
        )
    )
    found = consistent.groupBy("doc_id", "doc_version", "item_id", "item_words").agg(best.alias("best"))
    return found.select(
        "doc_id", "doc_version", "item_id", "best.run_words", "item_words", "best.n_slots", "best.verbatim"
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a question of the benchmark, same columns."""
    found = matches(docs, benchmark, id_col, text_col).select(
        F.col("doc_id").alias("held_id"), F.col("doc_version").alias("held_version")
    )
    found = stored(found.distinct(), "held")
    version = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    same = F.col(id_col).eqNullSafe(F.col("held_id")) & (version == F.col("held_version"))
    return docs.join(broadcast_if(fits_broadcast(found), found), same, "left_anti")

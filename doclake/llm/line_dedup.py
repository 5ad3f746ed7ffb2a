"""Repeated runs of lines, found by prefix doubling over sequences of line ids.

A line is named by its content (128 bits).  Names of runs of ``2k`` lines are made
from the names of their two halves, so ``t`` rounds of doubling name every run of
``2**t`` lines that starts anywhere; a run of any length is named by the two
overlapping runs of a power of two that cover it.  Runs with one name are
neighbours in the suffix array of the sequences: they are its intervals with a
common prefix of at least that many lines.  Only equality matters for deleting
copies, so names take the place of ranks, each round is local to a document, and
one shuffle brings the members of the intervals together.

The first member of an interval in order of ``(doc_id, line)`` stays, the lines
of all others go.  The union of these windows is that of all maximal repeated
runs with at least the required number of lines: where a run of ``L`` lines
occurred before, each of its windows did.  A single line counts as a run if it has
``LONG_WORDS`` words or more: a passage, however its neighbours differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.session import lookup_join, stored

MIN_LINES = 2
LONG_WORDS = 50


def _line_names(text: Column, long_words: int) -> Column:
    """Per line two hashes with different seeds, whether it holds more than white space, and if it is long."""

    def is_long(line: Column) -> Column:
        # Words are counted only where there is room for so many.
        room = F.octet_length(line) >= max(1, 2 * long_words - 1)
        return room & (F.size(F.regexp_extract_all(line, F.lit(r"\S+"), F.lit(0))) >= long_words)

    return F.transform(
        F.split(text, "\n", -1),
        lambda line: F.struct(
            F.xxhash64(line).alias("a"),
            F.xxhash64(F.lit(1), line).alias("b"),
            line.rlike(r"\S").alias("full"),
            is_long(line).alias("long"),
        ),
    )


def _joined(names: Column, shift: int) -> Column:
    """Names of the runs made of one run and the one that starts ``shift`` lines on."""

    def join(x: Column, n: Column) -> Column:
        y = F.get(names, n + shift)
        return F.struct(
            F.xxhash64(x["a"], x["b"], y["a"], y["b"]).alias("a"),
            F.xxhash64(F.lit(1), x["b"], x["a"], y["b"], y["a"]).alias("b"),
            (x["full"] | y["full"]).alias("full"),
        )

    return F.transform(F.slice(names, 1, F.greatest(F.size(names) - shift, F.lit(0))), join)


def run_names(rows: DataFrame, min_lines: int, long_words: int = LONG_WORDS) -> DataFrame:
    """``(doc_id, version, line, size, a, b)``: names of the runs that count, from each line on.

    These are the runs of ``min_lines`` lines and the single lines of at least
    ``long_words`` words.
    """
    named = rows.select("doc_id", "version", _line_names(F.col("text"), long_words).alias("lines"))
    named = named.withColumn("names", F.transform("lines", lambda x: x.dropFields("long")))
    length = 1
    while 2 * length <= min_lines:
        named = named.withColumn("names", _joined(F.col("names"), length))
        length *= 2
    if length < min_lines:
        named = named.withColumn("names", _joined(F.col("names"), min_lines - length))

    def sized(size: int, counts: str):
        return lambda x, n: F.struct(n.alias("line"), F.lit(size).alias("size"), x["a"].alias("a"), x["b"].alias("b"), x[counts].alias("counts"))

    # A run of blank lines is spacing, not a copy.
    found = F.transform("names", sized(min_lines, "full"))
    if min_lines > 1:
        found = F.concat(found, F.filter(F.transform("lines", sized(1, "long")), lambda x: x["counts"]))
    # The outer form, as the inner one adds a filter that names all lines once more.
    runs = named.select("doc_id", "version", F.explode_outer(found).alias("run"))
    return runs.where("run.counts").select("doc_id", "version", "run.line", "run.size", "run.a", "run.b")


def _versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents of one id are told apart by their texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, version, starts)``: lines at which a run starts that also starts earlier, with its size.

    The groups are aggregated to their first member before they are joined back,
    so a line that a third of all documents share is one row per task in the
    first shuffle, and one key that Spark can split in the second.
    """
    runs = stored(run_names(_versions(docs, id_col, text_col), min_lines), "runs")
    # A null id sorts first, as in the order of a struct.
    firsts = runs.groupBy("a", "b").agg(F.min(F.struct("doc_id", "version", "line")).alias("first"), F.count("*").alias("n"))
    repeated = firsts.where("n > 1").drop("n")
    members = lookup_join(runs, repeated, ["a", "b"], "inner")
    later = members.where(F.struct("doc_id", "version", "line") > F.col("first"))
    # At most two rows per line of the document, which is one row of its table.
    starts = F.array_sort(F.collect_set(F.struct("line", "size"))).alias("starts")
    return later.groupBy("doc_id", "version").agg(starts)


def _with_starts(docs: DataFrame, starts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents with the starts of their later copies; a null id finds its own."""
    keyed = starts.withColumn("has_id", F.col("doc_id").isNotNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    rows = docs.select(
        F.struct("*").alias("document"),
        F.col(id_col).isNotNull().alias("has_id"),
        F.coalesce(F.col(id_col), F.lit(0)).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("version"),
    )
    return lookup_join(rows, keyed, ["doc_id", "version", "has_id"], "left").select("document", "starts")


def _covered(starts: list[dict] | None, n_lines: int) -> np.ndarray:
    steps = np.zeros(n_lines + 1, np.int64)
    if starts:
        at = np.array([s["line"] for s in starts])
        np.add.at(steps, at, 1)
        np.add.at(steps, at + np.array([s["size"] for s in starts]), -1)
    return np.cumsum(steps)[:-1] > 0


def line_report(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_lines, n_removed, n_runs, longest_run, kept_sha256)``, one row per row of ``docs``.

    Lines end at line feeds, so an empty or null text has one empty line.  A run
    is a maximal run of removed lines.  Runs of blank lines alone are no copies.
    Rows with one id count in order of a hash of their texts; rows with the same
    id and text are one document listed twice and keep the same lines.  Other
    columns are left out; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = _with_starts(rows, later_copies(rows, min_lines), "doc_id", "text")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
                lines = (text or "").split("\n")
                gone = _covered(starts, len(lines))
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                lengths = edges[1::2] - edges[::2]
                kept = "\n".join([line for line, drop in zip(lines, gone) if not drop])
                values = (len(lines), int(gone.sum()), len(lengths), int(lengths.max(initial=0)))
                for column, value in zip(out, (*values, hashlib.sha256(kept.encode()).hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string())],
                ["doc_id", "n_lines", "n_removed", "n_runs", "longest_run", "kept_sha256"],
            )

    return found.select("document.doc_id", "document.text", "starts").mapInArrow(
        report, "doc_id long, n_lines long, n_removed long, n_runs long, longest_run long, kept_sha256 string"
    )


def without_copies(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of repeated runs deleted from the texts, same columns.

    A document that loses all its lines is left out; one that had nothing to lose
    stays as it is, also if it is empty.  ``n_chars``, where there is such a
    column, is the length of the text that is left.
    """
    found = _with_starts(docs, later_copies(docs, min_lines, id_col, text_col), id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            document = batch.column("document")
            names = [document.type.field(n).name for n in range(document.type.num_fields)]
            columns = dict(zip(names, document.flatten()))
            texts, stays, changed = columns[text_col].to_pylist(), [], []
            for row, starts in enumerate(batch.column("starts").to_pylist()):
                changed.append(starts is not None)
                stays.append(True)
                if starts is not None:
                    lines = texts[row].split("\n")
                    gone = _covered(starts, len(lines))
                    stays[row] = not gone.all()
                    texts[row] = "\n".join([line for line, drop in zip(lines, gone) if not drop])
            columns[text_col] = pa.array(texts, columns[text_col].type)
            if "n_chars" in columns:
                lengths = pa.array([len(t) if c else n for t, c, n in zip(texts, changed, columns["n_chars"].to_pylist())])
                columns["n_chars"] = lengths.cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names).filter(pa.array(stays, pa.bool_()))

    return found.mapInArrow(cut, docs.schema)

"""Near copies among vectors by sorted projection passes.

Each pass hashes a vector to the signs of 63 random projections, written one after
the other, and sorts all vectors of a label by these bits.  Vectors at a small angle
share long prefixes and come to stand near each other, so a vector is compared with
the ``window`` ones that follow it.  Pairs whose cosine in double precision reaches
the threshold are verified on the spot; their union over all passes gives the
components, in which links are then counted exactly.

A pair at the threshold agrees on a bit with probability ``1 - angle / pi`` (0.936 at
0.98), and two of ``n`` vectors that agree on the first ``log2(n / window)`` bits are
in one window, so a pass finds it with ``p = 0.936 ** log2(n / window)`` or more.
``passes_for`` takes as many passes as leave ``(1 - p) ** passes`` below ``MISSED``,
for the largest label; the number grows with a small power of the table.

How it is laid out:

* Equal vectors of a label are one class with a weight, by partial aggregation, so
  a vector that a third of all rows hold costs one row.
* Every pass is a part of one range sort by (pass, label, width, bits); a window
  crosses into the next partition by the rows at the edges.  Of the pairs of a batch
  only a spanning forest leaves the task, never all pairs of a dense group.
* Links are counted inside components without emitting pairs.  In a component over
  ``CELL`` classes the ones within half the angle of a hub are all linked with each
  other (triangle inequality) and only counted; the others meet all in blocks.

Vectors that are null, empty, zero or hold a null or non-finite component, and those
without a label, link with nothing.  Vectors of unlike length are not compared.  A row
with a null id gets the smallest id it reaches, null if there is none.  Rows that
share an id stay rows of their own.  Classes are named by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.components import components, roots
from doclake.session import stored

THRESHOLD = 0.98
WINDOW = 32
BITS = 63
MISSED = 0.005
CELL = 256
# Room for rounding where the triangle inequality decides in place of a product.
SLACK = 1e-6


def passes_for(rows: int, threshold: float = THRESHOLD, window: int = WINDOW) -> int:
    """How many passes leave a pair at the threshold unfound with probability ``MISSED``."""
    agree = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    found = agree ** max(0.0, math.log2(max(1, rows) / window))
    return 1 if found > 1 - MISSED else math.ceil(math.log(MISSED) / math.log1p(-found))


def classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``(vec_id, h)``, with a null ``h`` for what links with nothing, and the classes of equal vectors."""
    doubles = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), doubles.alias("v"))

    def unfit(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    fit = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", unfit) & F.exists("v", lambda x: x != 0)
    named = rows.withColumn("h", F.when(fit, F.xxhash64("label", "v")))
    counted = named.where("h is not null").groupBy("h").agg(
        F.count("*").alias("w"), F.min("vec_id").alias("low"), F.min("v").alias("v"), F.min("label").alias("label")
    )
    return named.select("vec_id", "h"), counted.withColumn("width", F.size("v"))


def unit_rows(batch: pa.RecordBatch | pa.Table, column: str = "v") -> np.ndarray:
    """The vectors of a batch, all of one length, scaled to length one (a first scaling avoids overflow)."""
    values = batch.column(column)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    found = flat.reshape(batch.num_rows, -1)
    found = found / np.abs(found).max(1, keepdims=True)
    return found / np.sqrt((found * found).sum(1, keepdims=True))


def _bit_keys(passes: int, seed: int):
    """A function for ``mapInArrow``: each class once per pass with its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for whole in batches:
            widths = whole.column("width").to_numpy()
            for width in np.unique(widths):
                batch = whole.filter(pa.array(widths == width))
                if width not in planes:
                    planes[width] = np.random.default_rng((seed, int(width))).standard_normal((int(width), passes * BITS))
                for start in range(0, batch.num_rows, 1024):
                    part = batch.slice(start, 1024)
                    signs = (unit_rows(part) @ planes[width] > 0).reshape(part.num_rows, passes, BITS)
                    keys = (signs * weight).sum(2)
                    for n in range(passes):
                        columns = [pa.array(np.full(part.num_rows, n, np.int32)), pa.array(keys[:, n])]
                        names = ["pass", "bits", "label", "width", "h", "v"]
                        yield pa.RecordBatch.from_arrays(columns + [part.column(c) for c in names[2:]], names)

    return run


def _linked(unit: np.ndarray, h: np.ndarray, group: np.ndarray, window: int, threshold: float) -> pa.RecordBatch:
    """Edges of a spanning forest of the verified pairs at most ``window`` rows apart."""
    left, right = [], []
    for step in range(1, min(window, len(h) - 1) + 1):
        close = np.flatnonzero(group[:-step] == group[step:])
        for start in range(0, len(close), 8192):
            at = close[start : start + 8192]
            hit = at[np.einsum("ij,ij->i", unit[at], unit[at + step]) >= threshold]
            left.append(hit)
            right.append(hit + step)
    x, y = (np.concatenate(side) if side else np.zeros(0, np.int64) for side in (left, right))
    root = roots(len(h), x, y)
    child = np.flatnonzero(root != np.arange(len(h)))
    return pa.RecordBatch.from_arrays([pa.array(h[child]), pa.array(h[root[child]])], ["x", "y"])


_EDGE = "x long, y long, part int, side int, place long, pass int, label string, width int, v array<double>"


def _windows(window: int, threshold: float):
    """A function for ``mapInArrow`` over a sorted partition: verified edges, and the rows at both ends."""

    def edge_rows(rows: pa.Table, part: int, side: int, first: int) -> pa.RecordBatch:
        n = rows.num_rows
        none = pa.nulls(n, pa.int64())
        columns = [rows.column("h"), none, pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, side, np.int32)),
                   pa.array(np.arange(first, first + n)), *(rows.column(c) for c in ("pass", "label", "width", "v"))]
        return pa.table(columns, ["x", "y", "part", "side", "place", "pass", "label", "width", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, carried, opening = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                rows = pa.Table.from_batches([batch.slice(start, 4096)])
                seen += rows.num_rows
                if opening is None or opening.num_rows < window:
                    opening = rows if opening is None else pa.concat_tables([opening, rows])
                    opening = opening.slice(0, window).combine_chunks()
                rows = rows if carried is None else pa.concat_tables([carried, rows])
                pairs = pa.Table.from_batches([edges_of(rows, window, threshold)])
                empty = {f: pa.nulls(pairs.num_rows, rows.schema.field(f).type) for f in ("pass", "label", "width", "v")}
                number = {"part": pa.nulls(pairs.num_rows, pa.int32()), "side": pa.nulls(pairs.num_rows, pa.int32()),
                          "place": pa.nulls(pairs.num_rows, pa.int64())}
                yield from pa.table({"x": pairs["x"], "y": pairs["y"], **number, **empty}).to_batches()
                carried = rows.slice(max(0, rows.num_rows - window)).combine_chunks()
        if opening is not None:
            yield from edge_rows(opening, part, 0, 0).to_batches()
            yield from edge_rows(carried, part, 1, seen - carried.num_rows).to_batches()

    return run


def edges_of(rows: pa.Table, window: int, threshold: float) -> pa.RecordBatch:
    """The verified edges among sorted rows; runs of one (pass, label, width) are groups."""
    names = ("pass", "label", "width")
    same = np.ones(max(0, rows.num_rows - 1), bool)
    for name in names:
        column = rows.column(name)
        same &= pa.compute.equal(column.slice(0, max(0, rows.num_rows - 1)), column.slice(1)).to_numpy(zero_copy_only=False)
    group = np.concatenate((np.zeros(min(1, rows.num_rows), np.int64), np.cumsum(~same)))
    h = rows.column("h").to_numpy()
    left, right = [], []
    bounds = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
    for start, stop in zip(bounds[:-1], bounds[1:]):
        if stop - start > 1:
            part = rows.slice(start, stop - start)
            found = _linked(unit_rows(part), h[start:stop], group[start:stop], window, threshold)
            left.append(found.column("x"))
            right.append(found.column("y"))
    x, y = (pa.chunked_array(side, pa.int64()).combine_chunks() for side in (left, right))
    return pa.RecordBatch.from_arrays([x, y], ["x", "y"])


def _across(window: int, threshold: float):
    """The windows that cross from one partition into the next."""

    def run(rows: pa.Table) -> pa.Table:
        order = [("gap_side", "descending"), ("place", "ascending")]
        rows = rows.sort_by(order).rename_columns([{"x": "h"}.get(c, c) for c in rows.column_names])
        return pa.Table.from_batches([edges_of(rows, window, threshold)])

    return run


def verified_edges(sets: DataFrame, passes: int, threshold: float = THRESHOLD, window: int = WINDOW, seed: int = 7) -> DataFrame:
    """A forest of pairs ``(x, y)`` of classes that some pass brought together and a product confirmed."""
    keyed = sets.select("h", "v", F.col("label").cast("string").alias("label"), "width")
    keyed = keyed.mapInArrow(_bit_keys(passes, seed), "pass int, bits long, label string, width int, h long, v array<double>")
    order = ["pass", "label", "width", "bits", "h"]
    ranged = stored(keyed, "projections").repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(ranged.mapInArrow(_windows(window, threshold), _EDGE), "windows")
    # The last rows of a partition and the first of the next that has any.
    edge = found.where("part is not null")
    parts = [r["part"] for r in edge.select("part").distinct().orderBy("part").collect()]
    before = F.create_map(*[F.lit(v) for pair in zip(parts[1:], parts[:-1]) for v in pair]) if parts[1:] else None
    inside = found.where("y is not null").select("x", "y")
    if before is None:
        return inside
    gap = F.when(F.col("side") == 1, F.col("part")).otherwise(before[F.col("part")])
    edge = edge.withColumn("gap", gap).withColumn("gap_side", F.col("side")).where("gap is not null")
    return inside.unionByName(edge.groupBy("gap").applyInArrow(_across(window, threshold), "x long, y long"))


def _counts(rows: pa.Table, others: pa.Table, threshold: float) -> pa.Table:
    """How many vectors of ``others`` each class of ``rows`` is linked with, itself left out."""
    a, b = unit_rows(rows), unit_rows(others)
    ids, other_ids = rows.column("h").to_numpy(), others.column("h").to_numpy()
    weight = others.column("w").to_numpy()
    found = np.zeros(len(a), np.int64)
    for start in range(0, len(a), 512):
        near = (a[start : start + 512] @ b.T >= threshold) & (ids[start : start + 512, None] != other_ids[None, :])
        found[start : start + 512] = near @ weight
    return pa.table({"h": ids, "n": found})


def link_counts(members: DataFrame, threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """``(h, n)``: the weight of the other classes of its component that each class is linked with.

    ``members`` holds ``(h, w, v, root)``.  Nothing but counts leaves a task.
    """
    kept = stored(members, "members")
    sizes = kept.groupBy("root").agg(F.count("*").alias("size"))
    wide = stored(sizes.where(F.col("size") > cell), "wide")
    small = kept.join(F.broadcast(wide), "root", "left_anti") if _few(wide) else kept.join(wide, "root", "left_anti")
    columns = ["h", "w", "v", "root"]
    found = small.select(*columns).groupBy("root").applyInArrow(lambda rows: _counts(rows, rows, threshold), "h long, n long")
    if wide.isEmpty():
        return found

    # Components over one cell: the angle to a hub decides most pairs.
    hub = kept.where(F.col("h") == F.col("root")).select("root", F.col("v").alias("hub")).join(wide, "root")
    hub = hub.withColumnRenamed("size", "n_classes")
    large = kept.join(F.broadcast(hub) if _few(wide) else hub, "root")
    half = math.acos(threshold) / 2 - SLACK

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = np.einsum("ij,ij->i", unit_rows(batch), unit_rows(batch, "hub"))
                core = np.arccos(np.clip(cosine, -1, 1)) <= half
                yield batch.select(["h", "w", "v", "root", "n_classes"]).append_column("core", pa.array(core))

    large = stored(large.select(*columns, "n_classes", "hub").mapInArrow(
        angles, "h long, w long, v array<double>, root long, n_classes long, core boolean"), "angles")
    core = large.where("core").groupBy("root").agg(F.sum("w").alias("total"))
    inner = large.where("core").select("h", "w", "root").join(core, "root").select("h", (F.col("total") - F.col("w")).alias("n"))
    # Every class outside the core meets all classes of the component, block by block.
    blocks = F.ceil(F.col("n_classes") / cell).cast("int")
    block = F.pmod(F.xxhash64("h"), blocks).cast("int")
    outer = large.where("not core").select(*columns, block.alias("a"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("b"))
    every = large.select(*columns, "core", block.alias("b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("a"))

    def meet(rows: pa.Table, others: pa.Table) -> pa.Table:
        if not rows.num_rows or not others.num_rows:
            return pa.table({"h": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        mine = _counts(rows, others, threshold)
        core = others.filter(others.column("core"))
        return pa.concat_tables([mine, _counts(core, rows, threshold)]) if core.num_rows else mine

    key = ["root", "a", "b"]
    beside = outer.groupBy(*key).cogroup(every.groupBy(*key)).applyInArrow(meet, "h long, n long")
    return found.unionByName(inner).unionByName(beside)


def _few(wide: DataFrame) -> bool:
    """Components over a cell are few unless the table is very large; then they are joined by a shuffle."""
    return wide.count() <= 1000


def near_copies(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    passes: int | None = None,
    window: int = WINDOW,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of the table.

    ``n_links`` counts the other rows of the label at or over the threshold within
    the component; ``component_id`` is the smallest id reachable by links, and
    ``kept`` says that the row carries it.
    """
    rows, sets = classes(vectors, id_col, vector_col, label_col)
    sets = stored(sets, "classes")
    most = sets.groupBy("label", "width").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    passes = passes or passes_for(most or 0, threshold, window)
    groups = components(verified_edges(sets, passes, threshold, window))
    members = stored(sets.join(groups, sets.h == groups.node).select("h", "w", "low", "v", "root"), "linked")
    counts = link_counts(members.select("h", "w", "v", "root"), threshold).groupBy("h").agg(F.sum("n").alias("n"))
    lowest = members.groupBy("root").agg(F.min("low").alias("component"))
    linked = members.select("h", "root").join(lowest, "root").join(counts, "h", "left").select("h", "n", "component")
    info = stored(sets.select("h", "w", "low").join(linked, "h", "left").select(
        "h",
        (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.when(F.col("n").isNull(), F.col("low")).otherwise(F.col("component")).alias("component"),
    ), "classes-done")
    joined = rows.join(info, "h", "left")
    component = F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )

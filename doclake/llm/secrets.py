"""Secret scans with a ledger of what was scanned, in DataFrame operations only.

Every version of every text is addressed by its content.  The ledger remembers,
for each blob, the rules (with their versions) it was scanned by; a scan visits
only pairs of blob and rule that are not in it, and findings are joined back to
every path that holds, or ever held, the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclake.session import broadcast_if, fits_broadcast, lookup_join, stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, leftmost and non-overlapping, whose
    ``group`` has at least ``min_length`` characters.  A changed rule gets a new version."""

    kind: str
    pattern: str
    group: int
    min_length: int
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# A run of one class that must have a length is asked for with that length at
# once; that finds the same runs.  The assignment rule must see its short
# matches, as they use up text.
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)

SCANNED = "blob_id string, rules array<string>"
FINDINGS = "blob_id string, rule string, start long, end long"


def blob_id(text: Column) -> Column:
    """The address of a content; a null text is an empty one."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the ledger; a new ledger is empty."""
    names = [part.split(" ", 1) for part in schema.split(", ")]
    empty = spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in names))
    empty.write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def scan(versions: DataFrame, ledger: str, rules=RULES, path_col: str = "path", text_col: str = "text") -> None:
    """Scan what the ledger has not seen, and write findings and ledger.

    ``versions`` holds any number of versions of any number of paths.  One row is
    picked for each blob with an open rule (a partial aggregate, so a content
    that fills a third of the table costs no more than another), and only these
    rows are scanned.  Findings are written before the blobs are marked, so a
    run that breaks off is repeated, and readers drop findings written twice.

    Null texts count as empty; null paths and repeated rows are allowed; other
    columns are left out; an empty table adds nothing.
    """
    spark = versions.sparkSession
    rows = versions.select(
        F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("at"),
        blob_id(F.col(text_col)).alias("blob_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    seen = _table(spark, f"{ledger}/scanned", SCANNED).groupBy("blob_id")
    seen = seen.agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
    open_rules = F.array_except(
        F.array(*(F.lit(rule.key) for rule in rules)), F.coalesce("seen", F.array().cast("array<string>"))
    )
    fresh = (
        rows.groupBy("blob_id")
        .agg(F.min("at").alias("at"))
        .join(seen, "blob_id", "left")
        .select("blob_id", "at", open_rules.alias("rules"))
        .where(F.size("rules") > 0)
    )
    fresh = stored(fresh, "blobs")
    picked = rows.join(broadcast_if(fits_broadcast(fresh), fresh), ["blob_id", "at"])
    _table(spark, f"{ledger}/findings", FINDINGS)
    _spans(picked, rules).write.mode("append").parquet(f"{ledger}/findings")
    fresh.select("blob_id", "rules").write.mode("append").parquet(f"{ledger}/scanned")


def _spans(blobs: DataFrame, rules) -> DataFrame:
    """``(blob_id, rule, start, end)`` in code points, end exclusive.

    Splitting at a pattern gives what lies between the matches, extracting gives
    the matches; the running sum of both lengths is the place of each.
    """
    found = [_matches(rule) for rule in rules]
    matched = blobs.where(_any(F.col("text").rlike(rule.pattern) for rule in rules))
    each = matched.select("blob_id", F.posexplode_outer(F.concat(*found)).alias("n", "m")).select("blob_id", "n", "m.*")
    upto = Window.partitionBy("blob_id", "rule").orderBy("n")
    end = F.sum(F.col("gap") + F.coalesce("hit", F.lit(0))).over(upto)
    placed = each.withColumn("end", end).where("kept")
    return placed.select("blob_id", "rule", (F.col("end") - F.col("hit")).alias("start"), "end").distinct()


def _matches(rule: Rule) -> Column:
    """Per match the lengths of the text before it and of itself, and whether it counts."""
    zipped = F.arrays_zip(
        F.split("text", rule.pattern, -1),
        F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)),
        F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)),
    )

    def match(z: Column) -> Column:
        return F.struct(
            F.lit(rule.key).alias("rule"),
            F.length(z["0"]).cast("long").alias("gap"),
            F.length(z["1"]).cast("long").alias("hit"),
            (F.length(z["2"]) >= rule.min_length).alias("kept"),
        )

    none = F.array().cast("array<struct<rule:string,gap:bigint,hit:bigint,kept:boolean>>")
    asked = F.array_contains("rules", rule.key) & F.col("text").rlike(rule.pattern)
    return F.when(asked, F.transform(zipped, match)).otherwise(none)


def _any(conditions) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def findings(spark: SparkSession, ledger: str, rules=RULES) -> DataFrame:
    """``(blob_id, kind, kind_no, start, end)`` of the current rule versions."""
    found = _table(spark, f"{ledger}/findings", FINDINGS).distinct()
    current = F.create_map(*(x for n, rule in enumerate(rules) for x in (F.lit(rule.key), F.lit(n))))
    kinds = F.array(*(F.lit(rule.kind) for rule in rules))
    placed = found.withColumn("kind_no", F.try_element_at(current, F.col("rule"))).where("kind_no is not null")
    return placed.select("blob_id", kinds[F.col("kind_no")].alias("kind"), "kind_no", "start", "end")


def findings_by_path(versions: DataFrame, ledger: str, rules=RULES, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``(path, blob_id, n_<kind> for each rule, spans)``, one row per row of ``versions``.

    ``spans`` is ``kind:start:end`` by start, then in the order of the rules,
    joined by commas.  The findings of a blob are gathered into one row (a blob
    has no more than its text holds) before they meet the paths, so a blob with
    a third of all paths is one key of a lookup, never a group.
    """
    spark = versions.sparkSession
    counts = [F.count_if(F.col("kind_no") == n).alias(f"n_{rule.kind}") for n, rule in enumerate(rules)]
    spans = F.array_sort(F.collect_list(F.struct("start", "kind_no", F.concat_ws(":", "kind", "start", "end").alias("s"))))
    by_blob = (
        findings(spark, ledger, rules)
        .groupBy("blob_id")
        .agg(*counts, F.array_join(F.transform(spans, lambda x: x["s"]), ",").alias("spans"))
    )
    paths = versions.select(F.col(path_col).alias("path"), blob_id(F.col(text_col)).alias("blob_id"))
    return lookup_join(paths, by_blob, "blob_id", "left").select(
        "path",
        "blob_id",
        *(F.coalesce(f"n_{rule.kind}", F.lit(0).cast("long")).alias(f"n_{rule.kind}") for rule in rules),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )

"""Column expressions on file names and document ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions import fixed_values as fv
from doclake.functions.text import strip, title_case

HEX_PREFIX = "^[0-9a-fA-F]{32}_"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(name: Column) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]+\z", "$1")


def suffix(name: Column) -> Column:
    """Lower-case last suffix with its dot, or the empty string."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)\z", 1))


def is_supported(name: Column) -> Column:
    return suffix(name).isin(fv.SUPPORTED_SUFFIXES)


def payload_title(stem_col: Column) -> Column:
    return title_case(F.translate(stem_col, "_-", "  "))


def humanize_stem(stem_col: Column) -> Column:
    title = title_case(strip(F.translate(stem_col, "_-", "  ")))
    return F.when(title == "", F.lit(fv.DEFAULT_TITLE)).otherwise(title)


def original_filename(name: Column) -> Column:
    """Drop the prefix of 32 hex characters that an upload puts in front."""
    return F.regexp_replace(name, HEX_PREFIX, "")


def display_name(name: Column) -> Column:
    return humanize_stem(original_filename(stem(name)))


def _decompose_to_ascii(name: Column) -> Column:
    # Defined inside, so that it travels by value and executors need not have
    # this package installed.  Spark has no Unicode normalisation; both kernels
    # used here are vectorised.
    @F.arrow_udf("string")
    def decompose(values):
        import pyarrow.compute as pc

        return pc.replace_substring_regex(pc.utf8_normalize(values, "NFKD"), r"[^\x00-\x7F]", "")

    return decompose(name)


def sanitize_filename(name: Column) -> Column:
    """ASCII form of a name: accents dropped, other characters to single ``_``."""
    ascii_name = _decompose_to_ascii(name)
    return F.regexp_replace(F.regexp_replace(ascii_name, r"[^a-zA-Z0-9._-]", "_"), "_{2,}", "_")


def sanitize_upload_name(name: Column, source: Column) -> Column:
    """Weaker form used for uploads, with a 32-hex prefix made from the source path."""
    return F.concat_ws("_", F.md5(source), F.regexp_replace(name, r"[^a-zA-Z0-9._-]", "_"))


def category(document_id: Column) -> Column:
    key = F.upper(document_id)
    return (
        F.when(key.startswith("ORD_"), fv.CATEGORY_ORDINANCE)
        .when(key.startswith("RES_RC"), fv.CATEGORY_COUNCIL)
        .when(key.startswith("RES_RA"), fv.CATEGORY_MAYOR)
        .when(key.contains("CONCEJO") | key.contains("RC"), fv.CATEGORY_COUNCIL)
        .otherwise(fv.CATEGORY_MAYOR)
    )


def status_tag(is_scanned: Column, converted: Column) -> Column:
    return (
        F.when(is_scanned, fv.STATUS_SCANNED)
        .when(~converted, fv.STATUS_PENDING)
        .otherwise(fv.STATUS_READY)
    )


def duplicate_key(name: Column) -> Column:
    """The key that files with the same name up to spelling share."""
    known = "|".join(fv.DUPLICATE_SUFFIXES)
    bare = F.regexp_replace(F.lower(name), rf"(\.({known}))+\z", "")
    return F.btrim(F.replace(F.translate(bare, "- ", "__"), F.lit("__"), F.lit("_")), F.lit("_"))


def name_penalty(name: Column) -> Column:
    """How odd a name looks; among duplicates the lowest is kept."""
    low = F.lower(name)
    inner = F.left(low, F.greatest(F.length(low) - 4, F.lit(0)))
    return (
        F.when(low.contains(".pdf.pdf"), fv.PENALTY_DOUBLE_SUFFIX).otherwise(0)
        + F.when(inner.contains(".pdf"), fv.PENALTY_INNER_SUFFIX).otherwise(0)
        + F.when(name.endswith(".PDF"), fv.PENALTY_UPPER_SUFFIX).otherwise(0)
    )

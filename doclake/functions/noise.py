"""The noise rule: is a text mostly ruling lines and scraps, as from a bad scan?

The rule needs four numbers.  Each is a sum (or an *or*) over the parts of a
text as long as no part boundary cuts a run, so a document's verdict comes from
a plain aggregate over its fragments and its text is never put together.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions import fixed_values as fv
from doclake.functions.text import is_blank, or_empty


def metrics(col: Column) -> dict[str, Column]:
    text = or_empty(col)
    return {
        "total_len": F.length(text),
        "noise_len": F.length(text) - F.length(F.regexp_replace(text, fv.NOISE_RUN, "")),
        "words": F.regexp_count(text, F.lit(fv.WORD_RUN)),
        "has_text": ~is_blank(text),
    }


def is_noisy(total_len: Column, noise_len: Column, words: Column, has_text: Column) -> Column:
    share = F.try_divide(noise_len.cast("double"), total_len.cast("double"))
    few_words = (words < fv.NOISE_MIN_WORDS) & (total_len > fv.NOISE_WORDS_FROM_CHARS)
    return (
        F.when(~has_text | (total_len < fv.NOISE_MIN_CHARS), True)
        .when(share > fv.NOISE_MAX_SHARE, True)
        .otherwise(few_words)
    )


def is_text_noisy(col: Column) -> Column:
    return is_noisy(**metrics(col))

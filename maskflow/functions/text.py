"""Text helpers: name normaliser, street splitter, digit layout."""

from __future__ import annotations

import string
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskflow.functions.stage import Stage


@lru_cache(maxsize=1)
def ascii_folding() -> tuple[dict[str, str], dict[str, str]]:
    """Characters outside ASCII whose compatibility decomposition has letters, digits, dots, blanks or hyphens.

    Returns those that fold to one such character and those that fold to several.
    """
    single, several = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        folded = unicodedata.normalize("NFKD", char)
        kept = "".join(c for c in folded if c.isascii() and (c.isalnum() or c in ". -"))
        if len(kept) == 1:
            single[char] = kept
        elif kept:
            several[char] = kept
    return single, several


def normalise_name(stage: Stage, value: Column) -> Column:
    """Fold to ASCII, turn blanks and hyphens into dots, drop everything else, lower case."""
    single, several = ascii_folding()
    # One pass folds accents, lowers letters and drops ASCII punctuation: what has no counterpart is deleted.
    kept = {c: c.lower() for c in string.ascii_uppercase} | {" ": ".", "-": "."}
    kept |= {c: kept.get(f, f) for c, f in single.items()}
    dropped = "".join(chr(i) for i in range(1, 128) if not (chr(i).isalnum() or chr(i) in ". -"))
    folded = stage.keep(F.translate(value, "".join(kept) + dropped, "".join(kept.values())))
    rest = {c: "".join(kept.get(x, x) for x in f) for c, f in several.items()}
    spread = F.create_map(*[F.lit(x) for pair in rest.items() for x in pair])
    letters = F.transform(F.split(folded, ""), lambda c: F.coalesce(F.try_element_at(spread, c), c))
    # Deleting them tells whether there are any: a pattern of so many characters is slow.
    has_several = F.length(F.translate(folded, "".join(rest), "")) < F.length(folded)
    expanded = F.when(has_several, F.array_join(letters, "")).otherwise(folded)
    return F.when(folded.rlike("[^a-z0-9.]"), F.regexp_replace(expanded, "[^a-z0-9.]+", "")).otherwise(folded)


def is_filled(value: Column) -> Column:
    """Neither missing nor blank."""
    return value.isNotNull() & (F.trim(value.cast("string")) != "")


def split_street(value: Column) -> tuple[Column, Column]:
    """`Marktgasse 12` to (`Marktgasse`, `12`); without a trailing number (whole text, null)."""
    trimmed = F.regexp_replace(value, r"^\s+|\s+$", "")
    pattern = r"^(.*\S)\s+([0-9]+)$|^()\s+([0-9]+)$"
    number = F.nullif(F.regexp_extract(trimmed, pattern, 2), F.lit(""))
    street = F.when(number.isNotNull(), F.regexp_extract(trimmed, pattern, 1)).otherwise(trimmed)
    return street, number


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def replace_last_digits(stage: Stage, value: Column, count: int, replacement: Column) -> Column:
    """Write `replacement`, one character per digit, over the last `count` digits of `value`.

    A value with fewer digits takes the first characters of `replacement`.
    """
    value, replacement = stage.keep_all([value, replacement])
    # The last digits with what lies between them; the text before them is kept as it is.
    tail = stage.keep(F.regexp_extract(value, rf"((?:[0-9][^0-9]*){{1,{count}}})$", 1))
    gaps = stage.keep(F.split(tail, "[0-9]", -1))
    pieces: list[Column] = [F.substring(value, F.lit(1), F.length(value) - F.length(tail))]
    for i in range(count):
        # An empty text once the digits have run out.
        digit = F.substring(replacement, F.lit(i + 1), F.when(F.size(gaps) > i + 1, F.lit(1)).otherwise(F.lit(0)))
        pieces += [digit, F.coalesce(F.get(gaps, F.lit(i + 1)), F.lit(""))]
    return F.concat(*pieces)


def shuffle_last_digits(stage: Stage, value: Column, count: int, dg: Column) -> Column:
    """Permute the last `count` digits (at most seven) in place."""
    if count > 7:
        raise ValueError("one digest orders at most seven digits")
    digits = stage.keep(digits_of(value))
    tail = stage.keep(F.when(F.length(digits) > count, F.substring(digits, -count, count)).otherwise(digits))
    keyed = F.sort_array(
        F.array(
            *[
                F.struct(
                    F.substring(dg, 1 + 9 * i, 9).alias("k"),
                    F.lit(i).alias("i"),
                    F.substring(tail, i + 1, 1).alias("d"),
                )
                for i in range(count)
            ]
        )
    )
    return replace_last_digits(stage, value, count, F.array_join(keyed["d"], ""))


def fill_format(stage: Stage, pattern: Column, longest: int, digits: Column) -> Column:
    """Replace every `x` of a number format by the next digit."""
    gaps, digits = stage.keep_all([F.split(pattern, "x", -1), digits])
    pieces: list[Column] = [F.element_at(gaps, 1)]
    for i in range(longest):
        digit = F.substring(digits, F.lit(i + 1), F.when(F.size(gaps) > i + 1, F.lit(1)).otherwise(F.lit(0)))
        pieces += [digit, F.coalesce(F.get(gaps, F.lit(i + 1)), F.lit(""))]
    return F.concat(*pieces)

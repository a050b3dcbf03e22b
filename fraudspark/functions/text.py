"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, for use inside higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalized(name: Column) -> Column:
    return F.lower(F.trim(name))


def _code(character: Column) -> Column:
    return F.ascii(character).cast("long")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each word padded with two blanks before and one after.

    A trigram is given as one number made of its three code points of 21 bits, which loses nothing and
    makes sets of them cheap to compare.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def pieces(word: Column) -> Column:
        letters = F.transform(F.filter(F.split(F.concat(F.lit("  "), word, F.lit(" ")), ""), lambda c: c != ""), _code)
        return let(
            letters,
            lambda codes: F.transform(
                F.sequence(F.lit(1), F.size(codes) - 2),
                lambda i: F.shiftleft(F.element_at(codes, i), 42) + F.shiftleft(F.element_at(codes, i + 1), 21) + F.element_at(codes, i + 2),
            ),
        )

    return F.array_distinct(F.flatten(F.transform(words, pieces)))


def numbered_characters(text: Column) -> Column:
    """Each character with its occurrence number: sets whose overlap is the overlap of the letter bags."""
    letters = F.array_sort(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), _code))
    return let(
        letters,
        lambda ordered: F.transform(
            ordered, lambda c, i: F.shiftleft(c, 32) + i - F.array_position(ordered, c) + F.lit(2).cast("long")
        ),
    )

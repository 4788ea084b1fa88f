"""Value transforms of features, and colours and sizes of word clouds, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Transform = Callable[[Column], Column]

TRANSFORMS: dict[str, Transform] = {
    "identity": lambda x: x,
    "sqrt": lambda x: F.sqrt(x),
    "log": lambda x: F.log(x + F.lit(1.0)),
    "log2": lambda x: F.log2(x + F.lit(1.0)),
    "anscombe": lambda x: F.lit(2.0) * F.sqrt(x + F.lit(0.375)),
    "boolean": lambda x: F.lit(1.0),
}


def transform_tag(name: str) -> str:
    """How a transform shows in a table name: its value at 16."""
    import math

    at_16 = {"identity": 16, "sqrt": 4, "log": math.log(17), "log2": math.log2(17), "anscombe": 2 * math.sqrt(16.375), "boolean": 1}[name]
    return f"16to{round(at_16)}"


def rank_scale(value: Column, low: Column, high: Column, steps: int) -> Column:
    """value between low and high as a whole number from 0 to steps."""
    return F.when(high > low, F.floor((value - low) / (high - low) * steps)).otherwise(F.lit(steps)).cast("int")


def mix_colours(first: str, second: str, share: Column) -> Column:
    """Hex colour between two hex colours."""
    def channel(i: int) -> Column:
        a, b = int(first[i : i + 2], 16), int(second[i : i + 2], 16)
        return F.lpad(F.lower(F.hex(F.round(F.lit(float(a)) + share * (b - a)).cast("long"))), 2, "0")

    return F.concat(channel(0), channel(2), channel(4))


def censored(word: Column, replacements: dict[str, str]) -> Column:
    """word, or what a map has in its place."""
    if not replacements:
        return word
    table = F.create_map(*[F.lit(x) for pair in replacements.items() for x in pair])
    return F.coalesce(table[F.lower(word)], word)

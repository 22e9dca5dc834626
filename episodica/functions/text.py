"""String expressions: prompts, natural order, ids in names, discretised states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_prompt(text: Column) -> Column:
    """White space off both ends; underscores and newlines become blanks."""
    return F.translate(F.regexp_replace(text, r"^\s+|\s+$", ""), "_\n", "  ")


def is_blank(text: Column) -> Column:
    """Null, empty or white space alone."""
    return ~F.coalesce(text, F.lit("")).rlike(r"\S")


def name_to_prompt(name: Column, drop_last: bool) -> Column:
    """A demonstration's name as a prompt.

    The stem; if it holds SCENE, what follows the scene's one- or two-digit number; without the last token if drop_last, unless
    that leaves nothing; underscores become blanks.
    """
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")
    after = F.substr(stem, F.locate("SCENE", stem) + 5)
    tail = F.when(stem.contains("SCENE"), F.when(F.substring(after, 3, 1) == "_", F.substr(after, F.lit(4))).otherwise(F.substr(after, F.lit(3)))).otherwise(stem)
    if drop_last:
        shorter = F.when(tail.contains("_"), F.regexp_replace(tail, "_[^_]*$", "")).otherwise("")
        tail = F.when(shorter == "", tail).otherwise(shorter)
    return F.translate(tail, "_", " ")


def episode_number(path: Column, fallback: Column) -> Column:
    """The digits after `episode_` or `episode-` in a file's stem, else the fallback."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    digits = F.regexp_extract(stem, r"episode[_-](\d+)", 1)
    return F.when(digits != "", digits.cast("long")).otherwise(fallback)


def natural_key(text: Column, width: int = 20) -> Column:
    """A key whose order is natural: runs of digits compare as numbers (of up to `width` digits)."""
    padded = F.regexp_replace(text, r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, rf"0*(\d{{{width}}})(?!\d)", "$1")


def trailing_number(text: Column) -> Column:
    """The number that ends a name; -1 without one."""
    digits = F.regexp_extract(text, r"(\d+)$", 1)
    return F.when(digits != "", digits.cast("long")).otherwise(F.lit(-1).cast("long"))


def slug(text: Column, longest: int = 120) -> Column:
    return F.substring(F.translate(text, " /", "__"), 1, longest)


def discretise(x: Column, bins: int = 256) -> Column:
    """Bins of [-1, 1]: -1 below it, 0 .. bins - 1 inside, the last one above."""
    return F.least(F.floor((x + 1) / 2 * bins), F.lit(bins - 1)).cast("long")


def state_prompt(text: Column, state: Column) -> Column:
    """A prompt that spells out a discretised state."""
    levels = F.transform(state, lambda x: F.greatest(discretise(x), F.lit(-1).cast("long")).cast("string"))
    return F.concat(F.lit("Task: "), clean_prompt(text), F.lit(", State: "), F.array_join(levels, " "), F.lit(";\nAction: "))


def numbered_label(name: str, number: Column, width: int = 2) -> Column:
    """A name, an underscore and a number with leading zeros; longer numbers are kept."""
    digits = number.cast("string")
    return F.concat(F.lit(f"{name}_"), F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits))


def run_stamp(at: Column) -> Column:
    """A time in the form that run names carry, to the second."""
    return F.date_format(at, "yyyyMMdd_HHmmss")

"""Values of annotations: page ranges, colours, tags, sort keys and the defaults of margin notes."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# The eight colours that may be given by name
COLOURS = {"red": "#ff6666", "orange": "#f19837", "yellow": "#ffd400", "green": "#5fb236",
           "blue": "#2ea8e5", "purple": "#a28ae5", "magenta": "#e56eee", "gray": "#aaaaaa"}
OWN_TAGS = ("annolytics", "annolytics-legacy")     # the tags of annotations the tool wrote; a parameter everywhere
MARK_TYPES = ("highlight", "underline")


def page_range(page: str | Column, spec: str) -> Column:
    """Whether a page lies in ``N`` or ``N-M``."""
    m = re.match(r"^(\d+)(?:-(\d+))?$", spec)
    if not m:
        raise ValueError("a page range is N or N-M")
    return col(page).between(int(m[1]), int(m[2] or m[1]))


def colour(c: str | Column) -> Column:
    """A colour as #rrggbb in lower case, from a name of any case or a hexadecimal value."""
    key = F.lower(F.trim(col(c)))
    names = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    return F.coalesce(names[key], key)


def is_colour(c: str | Column) -> Column:
    return colour(c).rlike("^#[0-9a-f]{6}$")


def pick_colour(explicit, level, core, levels: dict[str, str], core_color="#ff6666", other_color="#ffd400") -> Column:
    """The colour of a highlight: its own, else its level's, else the core or the other colour."""
    by_level = (F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])[col(level)] if levels
                else F.lit(None).cast("string"))
    own = F.when(col(explicit) != "", col(explicit))
    return colour(F.coalesce(own, by_level, F.when(F.coalesce(col(core), F.lit(False)), core_color).otherwise(other_color)))


def clean_tags(*lists: str | Column) -> Column:
    """Trimmed tags without repeats, in order; null when one of them is empty."""
    tags = F.transform(F.concat(*[F.coalesce(col(c), F.array().cast("array<string>")) for c in lists]), lambda x: F.trim(x))
    return F.when(~F.exists(tags, lambda x: x == ""), F.array_distinct(tags))


def holds_own_tag(tags: str | Column, own: tuple[str, ...] = OWN_TAGS) -> Column:
    return F.arrays_overlap(F.coalesce(col(tags), F.array().cast("array<string>")), F.array(*[F.lit(x) for x in own]))


def is_own(tags: str | Column, own: tuple[str, ...] = OWN_TAGS) -> Column:
    """Whether an annotation carries one of the tool's tags."""
    return F.coalesce(holds_own_tag(tags, own), F.lit(False))


def is_mark(kind: str | Column = "type") -> Column:
    return col(kind).isin(*MARK_TYPES)


def sort_key(page, offset, top) -> Column:
    """``page|offset|top`` filled up to 5, 6 and 5 digits, longer ones whole; the offset stops at six digits."""
    parts = [c.cast("long") for c in (col(page), F.least(col(offset), F.lit(999999)), col(top))]
    return F.format_string("%05d|%06d|%05d", *parts)

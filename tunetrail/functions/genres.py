"""Genre lists: parsing, flags, dominant genre."""

from pyspark.sql import functions as F

from tunetrail.functions.text import literal_map, trim_all
from tunetrail.schema import GENRE_CONSOLIDATION, GENRE_PRIORITY

# One quoted Python string literal, and a whole list of them.
LITERAL = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\""""
WHOLE_LIST = rf"^\s*\[\s*(?:(?:{LITERAL})\s*(?:,\s*(?:{LITERAL})\s*)*+,?\s*)?\]\s*$"


def parse_list(c, on_error="single"):
    """Text of a Python list → array<string>; NULL → [].

    Text that is no list becomes one item (`single`), [] (`empty`) or NULL (`null`).
    """
    item = lambda g: trim_all(F.regexp_replace(F.substring(g, F.lit(2), F.length(g) - 2), r"\\(.)", "$1"))
    items = F.transform(F.regexp_extract_all(c, F.lit(LITERAL), F.lit(0)), item)
    none = F.array().cast("array<string>")
    otherwise = {"single": F.array(trim_all(c)), "empty": none, "null": F.lit(None).cast("array<string>")}[on_error]
    return F.when(c.isNull(), none).when(c.rlike(WHOLE_LIST), items).otherwise(otherwise)


def display_name(genre):
    """Title-cased genre name, as shown in reports."""
    return genre.replace("_", " ").title()


def column_name(genre):
    return "genre_" + genre.replace(" ", "_")


def genre_flags(df, genres, tags="genres_list"):
    """One 0/1 column per genre name."""
    return df.withColumns({column_name(g): F.array_contains(tags, g).cast("int") for g in genres})


def dominant_genre(tags, priority=None, default="Other", display=display_name):
    """First genre of the priority list found among the tags."""
    picked = F.lit(default)
    for genre in reversed(GENRE_PRIORITY if priority is None else priority):
        picked = F.when(F.array_contains(tags, genre), display(genre)).otherwise(picked)
    return picked


def consolidate(c, mapping=None):
    """Merge near-equal categories; names outside the mapping stay."""
    mapping = GENRE_CONSOLIDATION if mapping is None else mapping
    return F.coalesce(F.try_element_at(literal_map(mapping), c), c)

"""What counts as a value: stand-ins for missing ones, evenly spelt words, letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value, in lower case.
STAND_INS = (
    "null", "none", "nil", "nan", "n/a", "na", "n.a.", "undefined", "untitled", "unknown", "tbd", "tba", "-", "--", "---", "–", "—", "?", "??",
    "#", "about:blank", "[removed]", "[deleted]", "content unavailable", "not available", "no title",
    "please enable javascript to view this content.", "please enable javascript to view this content",
)

# Characters around a value that say nothing.
BLANKS = " \t\n\r\f\v\u00a0\u200b\ufeff"


def says_something(text: Column) -> Column:
    """Whether a text is not NULL, blank or a stand-in for a missing value. Never NULL."""
    t = F.lower(F.trim(text, F.lit(BLANKS)))
    return F.coalesce((t != "") & ~t.isin(*STAND_INS), F.lit(False))


def even_word(text: Column) -> Column:
    """A word without case, blanks, hyphens and underscores; NULL stays NULL."""
    return F.regexp_replace(F.lower(text), r"[\s _-]+", "")


def ranked(word: Column, order: dict[str, int], last: int) -> Column:
    """Rank of an evenly spelt word; unknown and NULL words get `last`."""
    table = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return F.coalesce(F.try_element_at(table, word), F.lit(last))


def is_stand_in(text: str | None) -> bool:
    """Python twin of `not says_something`."""
    if text is None:
        return True
    t = text.strip(BLANKS).lower()
    return t == "" or t in STAND_INS

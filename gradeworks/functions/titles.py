"""Titles and class mentions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeworks.schemas import GRADES

CLASS_PARAM = r"(?i)\bclass\s*=\s*([A-Za-z-]+)"
PAGE_URL = r"^(https?://)?(en\.(m\.)?wikipedia\.org)?/?(wiki/)?"


def class_mentions(text: Column) -> Column:
    """Distinct canonical grades named in ``class=`` parameters, in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CLASS_PARAM), F.lit(1))
    lower = F.array(*[F.lit(g.lower()) for g in GRADES])
    names = F.array(*[F.lit(g) for g in GRADES])
    canon = F.transform(found, lambda m: F.get(names, (F.array_position(lower, F.lower(m)) - 1).cast("int")))
    return F.array_distinct(F.array_compact(canon))


def normalise_title(title: Column) -> Column:
    """Page title from a URL, path or title: no host, no fragment, blanks and decoded escapes."""
    bare = F.regexp_replace(F.trim(title), PAGE_URL, "")
    spaced = F.replace(F.substring_index(bare, "#", 1), F.lit("_"), F.lit(" "))
    # form decoding reads '+' as a blank, a title keeps it
    kept = F.replace(spaced, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(kept), spaced)

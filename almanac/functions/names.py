"""Name normalisation and name comparison, all as native column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME_MATCH_SHARE = 0.65


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """All characters that fold to one ASCII letter or digit, found by rule from the Unicode data."""
    src, dst = [], []
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        low = base.lower()
        if len(low) == 1 and low != ch and low.isascii() and low.isalnum():
            src.append(ch)
            dst.append(low)
    return "".join(src), "".join(dst)


def fold_accents(col: Column) -> Column:
    """Drop accents from Latin letters (composed or combining) and lower-case."""
    src, dst = _fold_table()
    return F.lower(F.regexp_replace(F.translate(col, src, dst), r"\p{Mn}", ""))


def normal_name(col: Column) -> Column:
    """Accent-free, lower-case, ``[a-z0-9]`` words separated by single spaces."""
    words = F.regexp_replace(fold_accents(col), "[^a-z0-9]+", " ")
    return F.trim(words)


def name_tokens(normal: Column, stop: Sequence[str] = ()) -> Column:
    """Distinct words of a normalised name without stop words."""
    drop = F.array(*[F.lit(w) for w in ("", *stop)])
    return F.array_except(F.split(normal, " "), drop)


def token_share(a: Column, b: Column) -> Column:
    """Shared words over the larger word count; null when a side has no words."""
    larger = F.greatest(F.size(a), F.size(b))
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / larger)


def names_match(
    normal_a: Column,
    normal_b: Column,
    stop: Sequence[str] = (),
    share: float = NAME_MATCH_SHARE,
    equal_first: bool = True,
) -> Column:
    """Word-overlap rule, or plain equality when a side has only stop words.

    ``equal_first`` accepts equal names before looking at words; with the same
    stop list on both sides it never changes the answer, it only saves work.
    """
    score = token_share(name_tokens(normal_a, stop), name_tokens(normal_b, stop))
    rule = F.coalesce(score >= share, normal_a == normal_b)
    return ((normal_a == normal_b) | rule) if equal_first else rule


def state_compatible(left: Column, right: Column) -> Column:
    """No state on the left rules nothing out; a left state needs an equal right state."""
    blank_l = F.coalesce(left, F.lit("")) == ""
    blank_r = F.coalesce(right, F.lit("")) == ""
    return F.when(blank_l, True).when(blank_r, False).otherwise(F.upper(F.trim(left)) == F.upper(F.trim(right)))

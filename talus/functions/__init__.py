"""Scalar helpers as column expressions: rounding rules, presets, text measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_js(x: Column) -> Column:
    """Half goes up, for negative numbers too."""
    return F.floor(x + 0.5)


def contains_any(term: str, *columns: str) -> Column:
    """Case-folded substring search over several columns."""
    return reduce(lambda a, b: a | b, (F.lower(c).contains(term.lower()) for c in columns))


def optional_filters(**wanted) -> Column:
    """All of the given equalities; None and "all" ask for nothing."""
    tests = [F.col(c) == v for c, v in wanted.items() if v not in (None, "all")]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th ..."""
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd")
    return F.concat(n.cast("string"), end.otherwise("th"))


def custom_rank(x: Column, values: list[str]) -> Column:
    """Position in a list, 0 where absent."""
    return F.array_position(F.array(*map(F.lit, values)), x)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def word_tokens(text: Column, least: int = 3) -> Column:
    """Distinct lower-case words of letters and digits."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: F.length(w) >= least))


def minutes_since_midnight(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def nearby_bins(x: Column, width: int, first: int, last: int) -> Column:
    """The bin of ``width`` that holds ``x`` and its neighbours from ``first`` to ``last``, a row each."""
    own = F.floor(x / width)
    return F.explode(F.array(*(own + k for k in range(first, last + 1))))

"""Predicates of structured search, as Columns. A null field matches nothing unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(predicates: Iterable[Column | None]) -> Column:
    """AND of those that are there; without any, everything matches."""
    asked = [p for p in predicates if p is not None]
    return reduce(and_, asked) if asked else F.lit(True)


def any_of(predicates: Iterable[Column]) -> Column:
    """OR of the predicates; without any, nothing matches."""
    predicates = list(predicates)
    return reduce(or_, predicates) if predicates else F.lit(False)


def at_least(predicates: Iterable[Column], m: int) -> Column:
    """At least m of the predicates hold; null counts as not holding."""
    held = [F.coalesce(p, F.lit(False)).cast("int") for p in predicates]
    return reduce(lambda a, b: a + b, held, F.lit(0)) >= m


def term(column: Column, value: Any) -> Column | None:
    """Equality, or nothing to ask if no value is given."""
    return None if value is None else column == value


def term_lower(column: Column, value: str | None) -> Column | None:
    return None if value is None else column == value.lower()


def terms(column: Column, values: Iterable[Any]) -> Column | None:
    values = list(values)
    return column.isin(values) if values else None


def has_element(array: Column, value: Any) -> Column | None:
    return None if value is None else F.array_contains(array, value)


def between(column: Column, low: Any = None, high: Any = None) -> Column | None:
    """Both ends optional and inclusive; ends given in the wrong order are swapped."""
    if low is not None and high is not None:
        return column.between(*sorted((low, high)))
    if low is not None:
        return column >= low
    return None if high is None else column <= high


def half_open(column: Column, since: Any, until: Any = None) -> Column:
    """since <= column < until; without `until` the lower bound only."""
    return column >= since if until is None else (column >= since) & (column < until)


def either_way(left: Column, right: Column, a: Any = None, b: Any = None) -> Column | None:
    """a and b on the two sides, whichever way round; one of them alone on either side."""
    if a is not None and b is not None:
        return ((left == a) & (right == b)) | ((left == b) & (right == a))
    one = a if a is not None else b
    return None if one is None else (left == one) | (right == one)


WHITE, BLACK, DRAW = 1, 2, 3


def winner(white: Column, black: Column, color: Column, user: Any) -> Column | None:
    return None if user is None else ((white == user) & (color == WHITE)) | ((black == user) & (color == BLACK))


def loser(white: Column, black: Column, color: Column, user: Any) -> Column | None:
    return None if user is None else ((white == user) & (color == BLACK)) | ((black == user) & (color == WHITE))


def against_computer(level: Column, has_computer: bool | None, low: int | None = None, high: int | None = None) -> Column | None:
    """Games with (or without) a computer; the level's range says nothing where there must be none."""
    asked = None if has_computer is None else (level > 0 if has_computer else level == 0)
    levels = None if has_computer is False else between(level, low, high)
    return None if asked is None and levels is None else all_of([asked, levels])


def known_and_between(column: Column, low: Any = None, high: Any = None) -> Column | None:
    """A range over a column in which 0 says that the value is missing."""
    inside = between(column, low, high)
    return None if inside is None else (column > 0) & inside


#: Status ids that one status stands for when asked. Fixed values.
DRAWN_STATUS, DRAWN_GROUP = 34, (32, 34, 39)


def status_is(column: Column, status: int | None) -> Column | None:
    if status is None:
        return None
    return column.isin(list(DRAWN_GROUP)) if status == DRAWN_STATUS else column == status


def shown(hidden: Column, to_all: bool) -> Column | None:
    """Rows flagged as hidden are left out unless the caller may see them."""
    return None if to_all else ~hidden


def visible(public: Column, members: Column, user: str | None) -> Column:
    """Public, or the caller is a member; owning alone gives no right."""
    return public if user is None else public | F.array_contains(members, user)


def is_or_has(owner: Column, members: Column, text: str) -> Column:
    """The whole text is the owner, or one of the members."""
    return (owner == text) | F.coalesce(F.array_contains(members, text), F.lit(False))


def same_element(array: Column, test: Callable[[Column], Column]) -> Column:
    """One element of the array passes the whole test."""
    return F.coalesce(F.exists(array, lambda e: F.coalesce(test(e), F.lit(False))), F.lit(False))


def matches_any_word(text: Column, words: Iterable[str], tokens: Callable[[Column], Column]) -> Column:
    """The analysed text has at least one of the words."""
    return F.coalesce(F.arrays_overlap(tokens(text), F.array(*[F.lit(w) for w in words])), F.lit(False))

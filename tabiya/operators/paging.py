"""Pages in sort order that don't read what they don't show.

A page can begin after a key, the values that the last row of the page before had, instead of at a growing offset. And
where files are sorted by the column that a query sorts by, as a collection's are, a page of the newest documents is
looked for from the newest date on: quantiles that the collection keeps of that column give a date that enough rows are
expected to be after; the filter on it reaches the files, which skip all older rows; if the matches don't fill the page,
the next round goes further back. A round that fills the page has seen every match that could be on it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SIZE = 12
Key = tuple[Column, bool]  #: a sort column and whether it ascends; nulls are last


def ordered(keys: list[Key]) -> list[Column]:
    return [column.asc_nulls_last() if ascending else column.desc_nulls_last() for column, ascending in keys]


def after(keys: list[Key], values: tuple) -> Column:
    """Rows behind one with these values in the order of the keys and `_id`, whose value is the last."""
    tests, same = [], []
    for (column, ascending), value in zip([*keys, (F.col("_id"), True)], values, strict=True):
        if value is not None:
            beyond = (column > F.lit(value) if ascending else column < F.lit(value)) | column.isNull()
            tests.append(reduce(Column.__and__, same, beyond))
        same = [*same, column.eqNullSafe(F.lit(value))]
    return F.coalesce(reduce(Column.__or__, tests), F.lit(False))


def page(rows: DataFrame, keys: list[Key], offset: int = 0, size: int = DEFAULT_SIZE, behind: tuple | None = None) -> DataFrame:
    """A page in sort order, ended by `_id`: a negative offset is 0, a size below 1 the default; `behind`: the values of
    keys and `_id` of the row that the page begins after. Spark keeps offset + size rows of each partition and never
    sorts the rest."""
    rows = rows if behind is None else rows.where(after(keys, behind))
    return rows.orderBy(*ordered(keys), "_id").offset(max(0, offset)).limit(size if size > 0 else DEFAULT_SIZE)


def _thresholds(marks: list[list[int]], rows: list[int], wanted: int) -> list[int]:
    """Values of the sort column with about `wanted` rows above the first, four times as many above each next one; marks
    are quantiles of parts of the documents, rows how many there are in each."""
    above = sorted(((low, n / (len(m) - 1)) for m, n in zip(marks, rows, strict=True) for low in m[:-1]), reverse=True)
    found, seen, next_ = [], 0.0, float(wanted)
    for low, n in above:
        seen += n
        if seen >= next_:
            found.append(low)
            next_ = 4 * max(seen, next_)
    return found


def newest_page(collection, matches: Callable[[DataFrame], DataFrame], key: str, offset: int = 0, size: int = DEFAULT_SIZE, behind: tuple | None = None, spare: int = 4) -> DataFrame:
    """_id and the key of a page of a `Collection`'s documents that `matches` keeps, by `key` descending, which must be
    what the collection's layout sorts by. `spare`: how many times the page's rows the first round looks at."""
    if collection.layout is None or collection.layout.sort != key:
        raise ValueError(f"the collection is not sorted by {key}")
    offset, size = max(0, offset), size if size > 0 else DEFAULT_SIZE
    manifest = [r for r in collection.manifest() if r.marks]
    keys, documents = [(F.col(key), False)], collection.documents()
    if behind is not None and behind[0] is not None:
        documents = documents.where(F.col(key).isNull() | (F.col(key) <= behind[0]))  # reaches the files, as `after` does not
    rows, lows = [], _thresholds([r.marks for r in manifest], [r.rows for r in manifest], spare * (offset + size))
    lows = [low for low in lows if behind is None or behind[0] is None or low <= behind[0]]
    for low in [*lows, None]:
        part = documents if low is None else documents.where(F.col(key) >= low)
        rows = page(matches(part).select("_id", key), keys, 0, offset + size, behind).collect()  # a page of rows at most
        if len(rows) == offset + size:
            break
    return documents.sparkSession.createDataFrame(rows[offset:], documents.select("_id", key).schema)

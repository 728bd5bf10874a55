"""Search and count over the five collections.

A query object gives the matching rows of its collection, with `_score` where one is asked for, and its sort order;
`search` adds paging. The id ends every sort order, so results are the same in every run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabiya.functions import predicates as p
from tabiya.functions.analysis import english_query, standard_query
from tabiya.operators import fulltext
from tabiya.operators.paging import DEFAULT_SIZE, Key, page

ANALYSED_TAGS = ("event", "white", "black", "opening")
#: Chapter tags that are asked as whole values, and the fields of the index that hold them.
EXACT_TAGS, EXACT = ("variant", "eco", "white_fide_id", "black_fide_id"), "chapters.="
Range = tuple[object, object]


def split_box(text: str, keys: list[str]) -> tuple[str, dict[str, str]]:
    """One search box's text as (terms, filters); `analysis.parsed_prefixes` does the same for a column of them."""
    import re

    pieces = re.split("[ +]+", text.strip(" ").lower())
    while len(pieces) > 1 and pieces[-1] == "":
        pieces.pop()
    found = [(k, x) for x in pieces for k in keys[:1] + keys[1:] if x.startswith(f"{k}:")]
    filters = {k: x.removeprefix(f"{k}:") for k, x in found}
    return " ".join(x for x in pieces if not any(x.startswith(f"{k}:") for k in keys)), filters


@dataclass(frozen=True)
class GameQuery:
    """Structured search; an unset field asks nothing. Ranges are (low, high), either end may be None."""

    user1: str | None = None
    user2: str | None = None
    winner: str | None = None
    loser: str | None = None
    winner_color: int | None = None
    perf: list[int] = field(default_factory=list)
    source: int | None = None
    status: int | None = None
    turns: Range = (None, None)
    average_rating: Range = (None, None)
    has_ai: bool | None = None
    ai_level: Range = (None, None)
    rated: bool | None = None
    date: tuple[datetime | None, datetime | None] = (None, None)
    duration: Range = (None, None)
    clock_init: int | None = None
    clock_inc: int | None = None
    analysed: bool | None = None
    white_user: str | None = None
    black_user: str | None = None
    sort_by: str = "date"
    order: str = "desc"

    def predicate(self) -> Column:
        c, white, black, color = F.col, F.col("white_user"), F.col("black_user"), F.col("winner_color")
        seconds = [None if d is None else int(d.timestamp()) for d in self.date]
        return p.all_of(
            [
                p.either_way(white, black, self.user1, self.user2), p.winner(white, black, color, self.winner), p.loser(white, black, color, self.loser),
                p.term(color, self.winner_color), p.between(c("turns"), *self.turns), p.known_and_between(c("average_rating"), *self.average_rating),
                p.between(c("duration"), *self.duration), p.term(c("clock_init"), self.clock_init), p.term(c("clock_inc"), self.clock_inc), p.between(c("date"), *seconds),
                p.against_computer(c("ai"), self.has_ai, *self.ai_level), p.terms(c("perf"), self.perf), p.term(c("source"), self.source), p.term(c("rated"), self.rated),
                p.status_is(c("status"), self.status), p.term(c("analysed"), self.analysed), p.term_lower(white, self.white_user), p.term_lower(black, self.black_user),
            ]
        )

    def matches(self, games: DataFrame) -> DataFrame:
        return games.where(self.predicate())

    def keys(self) -> list[Key]:
        by = self.sort_by if self.sort_by in ("date", "turns", "average_rating") else "date"
        return [(F.col(by), self.order.lower() == "asc")]


@dataclass(frozen=True)
class ForumQuery:
    """Every word must be in body or topic, or be the author."""

    text: str
    troll: bool = False
    empty_text: str = "none"

    @staticmethod
    def index(posts: DataFrame) -> fulltext.Postings:
        return fulltext.postings(posts, {"body": F.col("body"), "topic": F.col("topic")})

    def matches(self, posts: DataFrame, index: fulltext.Index | None = None) -> DataFrame:
        terms, filters = split_box(self.text, ["user"])
        rows = posts.where(p.all_of([p.shown(F.col("troll"), self.troll), p.term(F.col("author"), filters.get("user"))]))
        if not terms and (filters or self.empty_text == "all"):
            return rows
        words = terms.split(" ")
        query = [[t for group in english_query(word) for t in group] for word in words]  # a word's parts are alternatives
        own = F.filter(F.array(*[F.when(F.col("author") == word, F.lit(i)) for i, word in enumerate(words)]), lambda i: i.isNotNull())
        by_author = rows.where(F.col("author").isin(words)).select("_id", F.explode(own).alias("position"))
        ids = fulltext.every_word_somewhere(self.index(posts) if index is None else index, query, {"body": 2, "topic": 5}, by_author)
        return rows.join(ids, "_id", "left_semi")

    def keys(self) -> list[Key]:
        return [(F.col("date"), False)]


@dataclass(frozen=True)
class TeamQuery:
    text: str

    @staticmethod
    def index(teams: DataFrame) -> fulltext.Postings:
        return fulltext.postings(teams, {"name": F.col("name"), "description": F.col("description")})

    def matches(self, teams: DataFrame, index: fulltext.Index | None = None) -> DataFrame:
        """A word that analysis leaves nothing of matches nothing."""
        query = [[t for group in english_query(word) for t in group] for word in split_box(self.text, [])[0].split(" ")]
        ids = fulltext.every_word_somewhere(self.index(teams) if index is None else index, query, {"name": 10, "description": 2})
        return teams.join(ids, "_id", "left_semi")

    def keys(self) -> list[Key]:
        return [(F.col("nb_members"), False)]


@dataclass(frozen=True)
class UblogQuery:
    """A query string: its clauses are words, `language:xx` and `quality:n`, each optional unless AND joins it to its
    neighbour. What `min_quality` and `language` ask is a filter."""

    text: str
    by: str = "score"
    min_quality: int | None = None
    language: str | None = None

    @staticmethod
    def index(posts: DataFrame) -> fulltext.Postings:
        return fulltext.postings(posts, {"text": F.col("text")}, english=False)

    def parts(self) -> tuple[list[list[str]], list[list[str]], list[tuple[str, object]], list[tuple[str, object]]]:
        """required and optional word positions, required and optional (column, value)"""
        from tabiya.functions.analysis import clean

        words = clean(self.text).split()
        required, optional, required_columns, optional_columns = [], [], [], []
        for i, word in enumerate(words):
            if word == "AND":
                continue
            joined = "AND" in words[max(0, i - 1) : i] + words[i + 1 : i + 2]
            name, _, value = word.partition(":")
            if name in ("language", "quality") and value:
                (required_columns if joined else optional_columns).append((name, int(value) if name == "quality" else value))
            elif group := [t for [t] in standard_query(word)]:
                (required if joined else optional).append(group)
        return required, optional, required_columns, optional_columns

    def _filters(self) -> Column:
        return p.all_of([p.between(F.col("quality"), self.min_quality), p.term(F.col("language"), self.language)])

    @staticmethod
    def _column_score(posts: DataFrame, name: str, value: object) -> Column:
        """What a clause on a column adds: 1 for a number, for a keyword what a word would that is in each post once."""
        met = F.coalesce(F.col(name) == F.lit(value), F.lit(False))
        if name != "language":
            return F.when(met, 1.0).otherwise(0.0)
        have, with_it = F.count(F.col(name)), F.count(F.when(met, 1))
        idf = posts.agg(F.log(1 + (have - with_it + 0.5) / (with_it + 0.5)).alias("idf")).scalar()
        return F.when(met, idf).otherwise(0.0)

    def matches(self, posts: DataFrame, index: fulltext.Index | None = None) -> DataFrame:
        """With `_score` if that is the order asked for; other orders score nothing."""
        required, optional, must, may = self.parts()
        rows, scored = posts.where(self._filters()), self.by == "score"
        met = lambda columns: [F.coalesce(F.col(name) == F.lit(value), F.lit(False)) for name, value in columns]
        if not (required or optional or must or may):
            rows = rows.where(F.lit(False))
            return rows.withColumn("_score", F.lit(0.0)) if scored else rows
        rows = rows.where(p.all_of(met(must)))
        found, words_needed = None, bool(required) or not (must or may)
        if required or optional and (scored or not must):
            found = fulltext.required_and_optional(self.index(posts) if index is None else index, required, optional, "text", scored)
            rows = rows.join(found.withColumn("_found", F.lit(True)), "_id", "inner" if words_needed else "left")
        if not required and not must and may:  # any clause will do
            rows = rows.where(p.any_of([*met(may), *([F.coalesce("_found", F.lit(False))] if found is not None else [])]))
        if scored:
            each = [self._column_score(posts, *clause) for clause in must + may]
            rows = rows.withColumn("_score", reduce(Column.__add__, each, F.coalesce("_score", F.lit(0.0)) if found is not None else F.lit(0.0)))
        return rows.select(*posts.columns, *(["_score"] if scored else []))

    def best(self, posts: DataFrame, index: fulltext.TextIndex, k: int) -> DataFrame | None:
        """`matches` of posts that can be among the k first by score, from parts of the posting lists; None where the
        whole lists are needed."""
        required, optional, must, may = self.parts()
        if self.by != "score" or must or may or not (required or optional) or any(len(group) > 1 for group in required + optional):
            return None
        rows = posts.where(self._filters())
        return rows.join(index.top(required, optional, "text", k, rows).rows, "_id")

    def keys(self) -> list[Key]:
        first = {"score": [(F.col("_score"), False)], "likes": [(F.col("likes"), False)]}.get(self.by, [])
        return [*first, (F.col("quality"), False), (F.col("date"), self.by == "oldest")]


@dataclass(frozen=True)
class ChapterFilter:
    """Conditions on one and the same chapter; pairs of players and of FIDE ids hold either way round."""

    variant: str | None = None
    eco: str | None = None
    opening: str | None = None
    event: str | None = None
    player1: str | None = None
    player2: str | None = None
    fide_id1: str | None = None
    fide_id2: str | None = None

    def matching(self, studies: DataFrame, index: fulltext.Index) -> DataFrame:
        """The studies with one chapter that meets all conditions. Conditions on words, which are analysed as English
        with synonyms, and on whole values are all asked of the postings, whose elements say which chapter they are of;
        no study is read for its chapters."""
        words = lambda text: english_query(text, synonyms=True)
        asked = {name: ([f"chapters.{name}"], words(text)) for name, text in (("opening", self.opening), ("event", self.event)) if text is not None}
        asked |= {name: ([EXACT + name], [[value]]) for name, value in (("variant", self.variant), ("eco", self.eco)) if value is not None}
        either: list[tuple[str, str, str, str]] = []  # four conditions: one way round, the other way round
        for name, (white, black), given, query in (
            ("player", ("chapters.white", "chapters.black"), (self.player1, self.player2), words),
            ("fide", (EXACT + "white_fide_id", EXACT + "black_fide_id"), (self.fide_id1, self.fide_id2), lambda value: [[value]]),
        ):
            values = [x for x in given if x is not None]
            if len(values) == 1:
                asked[name] = ([white, black], query(values[0]))
            elif values:
                pairs = {f"{name}-{side}{i}": ([place], query(x)) for side, place in (("white", white), ("black", black)) for i, x in enumerate(values)}
                asked |= pairs
                either.append((f"{name}-white0", f"{name}-black1", f"{name}-white1", f"{name}-black0"))

        def test(met: Callable[[str], Column]) -> Column:
            paired = {name for names in either for name in names}
            both = [(met(a) & met(b)) | (met(c) & met(d)) for a, b, c, d in either]
            return p.all_of([*[met(name) for name in asked if name not in paired], *both])

        return studies.join(fulltext.element_conditions(index, asked, test), "_id", "left_semi")


@dataclass(frozen=True)
class StudyQuery:
    """Text over the study's own fields, or its chapters as `chapter` says: None, "search_text" or a ChapterFilter.
    `owner:` and `member:` in the text restrict; only public studies and those the user is a member of are seen."""

    text: str
    user_id: str | None = None
    sort_by: str | None = None
    ascending: bool = False
    chapter: str | ChapterFilter | None = None
    owner_searches_chapters: bool = True
    empty_text: str = "none"

    @staticmethod
    def index(studies: DataFrame, only: set[str] | None = None) -> fulltext.Postings:
        """The study's own fields, and names, descriptions and tags of its chapters, some as words and some as whole
        values; `only` some of them."""
        own = {"name": F.col("name"), "topics": F.concat_ws(" ", "topics"), "description": F.col("description")}
        tag = lambda name: lambda c: c["tags"][name]
        inner = {"chapters.name": lambda c: c["name"], "chapters.description": lambda c: c["description"]} | {f"chapters.{t}": tag(t) for t in ANALYSED_TAGS}
        chosen = lambda fields: {name: of for name, of in fields.items() if only is None or name in only}
        values = {EXACT + t: tag(t) for t in EXACT_TAGS}
        parts = [fulltext.postings(studies, chosen(own))] if chosen(own) else []
        parts += [fulltext.element_values(studies, "chapters", chosen(values))] if chosen(values) else []
        parts += [fulltext.element_postings(studies, "chapters", chosen(inner))] if chosen(inner) else []
        return reduce(fulltext.Postings.plus, parts) if parts else fulltext.postings(studies.limit(0), own)

    def _fields(self, terms: str, by_owner: bool) -> dict[str, float]:
        """The fields that the text is looked for in, with their boosts."""
        if not terms:
            return {}
        inner = ["chapters.name", "chapters.description"] if self.chapter is not None or self._owner_chapters(by_owner) else []
        inner += [f"chapters.{t}" for t in ANALYSED_TAGS] if self._owner_chapters(by_owner) else []
        return {"name": 3.0, "topics": 2.0, "description": 1.0} | dict.fromkeys(inner, 1.0)

    def _owner_chapters(self, by_owner: bool) -> bool:
        return self.chapter is None and by_owner and self.owner_searches_chapters

    def matches(self, studies: DataFrame, index: fulltext.Index | None = None) -> DataFrame:
        """Statistics of the scores are over all studies, whoever asks."""
        terms, filters = split_box(self.text, ["owner", "member"])
        owner, member = filters.get("owner"), filters.get("member")
        filtered = isinstance(self.chapter, ChapterFilter) and self.chapter != ChapterFilter()
        fields = self._fields(terms, owner is not None)
        if index is None:
            index = self.index(studies, {*fields, *([*[f"chapters.{t}" for t in ANALYSED_TAGS], *[EXACT + t for t in EXACT_TAGS]] if filtered else [])})
        rows = studies.where(p.all_of([p.term(F.col("owner"), owner), p.has_element(F.col("members"), member), p.visible(F.col("public"), F.col("members"), self.user_id)]))
        if filtered:
            rows = self.chapter.matching(rows, index)
        if not terms and (filters or self.empty_text == "all"):
            return rows.withColumn("_score", F.lit(0.0))
        return rows.join(self._scores(rows, index, terms, fields, self._owner_chapters(owner is not None)), "_id")

    def _scores(self, rows: DataFrame, index: fulltext.Index, terms: str, boosts: dict[str, float], chapters_too: bool) -> DataFrame:
        query = english_query(terms, synonyms=True)
        others = rows.where(p.is_or_has(F.col("owner"), F.col("members"), terms)).select("_id", F.lit(1.0).alias("_score"))
        if chapters_too:
            exact = lambda c: p.any_of([c["tags"][t] == terms for t in ("variant", "white_fide_id", "black_fide_id", "eco")])
            others = others.unionByName(rows.where(p.same_element(F.col("chapters"), exact)).select("_id", F.lit(1.0).alias("_score")))
        inside = F.col("field").startswith("chapters.")  # any word in one chapter's field; all words in one of the study's own
        fields = fulltext.scored_fields(index, query, boosts).where(inside | (F.col("matched") == len(query)))
        best = fields.groupBy("_id", inside.alias("inside")).agg(F.max("score").alias("_score")).select("_id", "_score")
        return best.unionByName(others).groupBy("_id").agg(F.sum("_score").alias("_score"))

    def keys(self) -> list[Key]:
        by = {"name": F.lower("name"), "likes": F.col("likes"), "created_at": F.col("created_at"), "updated_at": F.col("updated_at"), "hot": F.col("rank")}
        first = [(by[self.sort_by], self.ascending)] if self.sort_by else []
        return [*first, (F.col("_score"), False)]


def search(collection: DataFrame, query, offset: int = 0, size: int = DEFAULT_SIZE, index: fulltext.Index | None = None, behind: tuple | None = None) -> DataFrame:
    """_id of the page's documents, in order (and `_score` where the query has one). Text queries read `index`, or
    make the postings of the whole collection where there is none. `behind`: the sort values and the id of the row that
    the page begins after (see `paging`)."""
    found = None
    if isinstance(query, UblogQuery) and isinstance(index, fulltext.TextIndex) and behind is None:
        found = query.best(collection, index, max(0, offset) + (size if size > 0 else DEFAULT_SIZE))
    if found is None:
        found = query.matches(collection) if index is None else query.matches(collection, index)
    kept = ["_id", "_score"] if "_score" in found.columns else ["_id"]
    return page(found, query.keys(), offset, size, behind).select(*kept)


def count(collection: DataFrame, query, index: fulltext.Index | None = None) -> DataFrame:
    found = query.matches(collection) if index is None else query.matches(collection, index)
    return found.agg(F.count("*").alias("count"))

"""Queries of structured search, sorting, paging and counting."""

from __future__ import annotations

from datetime import datetime, timezone
from pyspark.sql import functions as F

from tabiya.functions import predicates as p
from tabiya.operators.changes import DELETE, INDEX
from tabiya.operators.keywords import KeywordIndex, matching_count, matching_each
from tabiya.operators.paging import newest_page, page
from tabiya.operators.search import ChapterFilter, GameQuery, StudyQuery, count, search
from tabiya.plans.standins import GAMES_SQL, STUDIES_SQL, Catalogue, games, stored_index, studies, table
from tabiya.sources.collections import SPECS
from tabiya.sources.shared import new_path
from tabiya.streaming import jobs

CATALOGUE = Catalogue()
query = CATALOGUE.query


def _game(name: str, asked: GameQuery, where: str) -> None:
    """All games that a query matches."""
    query(name, GAMES_SQL + f"SELECT _id FROM g WHERE {where}")(lambda spark, d: asked.matches(games(spark, d)).select("_id"))


@query("game_search", GAMES_SQL + "SELECT _id FROM g WHERE rated AND perf IN (1, 2, 3) AND turns BETWEEN 20 AND 80 ORDER BY date DESC, _id LIMIT 50 OFFSET 10")
def game_search(spark, d):
    return search(games(spark, d), GameQuery(rated=True, perf=[1, 2, 3], turns=(80, 20)), 10, 50)


@query("game_search_all_groups", GAMES_SQL + """, p AS (SELECT * FROM g WHERE winner_color = 1 AND ai = 0 AND status = 34 AND average_rating > 0 ORDER BY average_rating DESC, _id LIMIT 1)
SELECT g._id FROM g, p WHERE ((g.white_user = p.white_user AND g.black_user = p.black_user) OR (g.white_user = p.black_user AND g.black_user = p.white_user)) AND g.winner_color = p.winner_color AND g.perf = p.perf
  AND g.source = p.source AND g.status IN (32, 34, 39) AND g.turns BETWEEN p.turns - 5 AND p.turns + 5 AND g.average_rating > 0 AND g.average_rating >= p.average_rating - 100 AND g.ai = 0 AND g.rated = p.rated
  AND g.date BETWEEN p.date - 86400 AND p.date AND g.duration BETWEEN p.duration - 9 AND p.duration + 9 AND g.clock_init = p.clock_init AND g.clock_inc = p.clock_inc AND g.analysed = p.analysed
  AND g.white_user = p.white_user AND g.black_user = p.black_user ORDER BY g.average_rating ASC NULLS LAST, g._id LIMIT 40""")
def game_search_all_groups(spark, d):
    """Every condition set, from one game of the table, which is found."""
    g = games(spark, d)
    p_ = g.where("winner_color = 1 AND ai = 0 AND status = 34 AND average_rating > 0").orderBy(F.desc("average_rating"), "_id").first()
    day = lambda seconds: datetime.fromtimestamp(seconds, timezone.utc)
    asked = GameQuery(
        user1=p_.black_user, user2=p_.white_user, winner=p_.white_user, loser=p_.black_user, winner_color=1, perf=[p_.perf], source=p_.source, status=34, turns=(p_.turns + 5, p_.turns - 5),
        average_rating=(p_.average_rating - 100, None), has_ai=False, ai_level=(3, 8), rated=p_.rated, date=(day(p_.date), day(p_.date - 86400)), duration=(p_.duration + 9, p_.duration - 9), clock_init=p_.clock_init,
        clock_inc=p_.clock_inc, analysed=p_.analysed, white_user=p_.white_user.upper(), black_user=p_.black_user, sort_by="average_rating", order="ASC",
    )
    return search(g, asked, -5, 40)


CHANGED_SQL = GAMES_SQL + """, v AS (SELECT _id, rated, perf, date, white_user, CASE WHEN status = 30 THEN turns + 7 ELSE turns END AS turns FROM g WHERE status <> 35) """


def changed_games(spark, d):
    """Games as a collection: a base of all, and two open deltas, one that changes some and one that deletes some."""
    spec, g = SPECS["game"], games(spark, d)
    collection = jobs.GAME.collection(spark, new_path(spark, "changed-games"))

    def applied(rows, action, seq):
        given = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in spec.schema.fields]
        version = F.struct(F.timestamp_seconds(F.lit(0)).alias("t"), F.lit(seq).cast("long").alias("seq")).alias("version")
        collection.apply(rows.select(*given, version, F.lit(action).alias("action")))

    applied(g, INDEX, 0)
    collection.compact(buckets=16)
    applied(g.where("status = 30").withColumn("turns", F.col("turns") + 7), INDEX, 1)
    applied(g.where("status = 35").select("_id"), DELETE, 1)
    return collection


@query("collection_search", CHANGED_SQL + "SELECT _id FROM v WHERE rated AND perf IN (1, 2, 3) AND turns BETWEEN 20 AND 80 ORDER BY date DESC, _id LIMIT 50 OFFSET 10")
def collection_search(spark, d):
    """A search of a base with open deltas laid over it."""
    return search(changed_games(spark, d).documents(), GameQuery(rated=True, perf=[1, 2, 3], turns=(80, 20)), 10, 50)


@query("collection_count", CHANGED_SQL + "SELECT count(*) AS count FROM v WHERE rated AND turns >= 90")
def collection_count(spark, d):
    return count(changed_games(spark, d).documents(), GameQuery(rated=True, turns=(90, None)))


@query("keyword_lookup", CHANGED_SQL.replace("white_user, CASE", "white_user, black_user, winner_color, analysed, CASE") + """SELECT 'pair' AS asked, _id FROM v WHERE (white_user = 'u899' AND black_user = 'u7') OR (white_user = 'u7' AND black_user = 'u899')
UNION ALL SELECT 'user', _id FROM v WHERE white_user = 'u5' OR black_user = 'u5' UNION ALL SELECT 'winner', _id FROM v WHERE (white_user = 'u11' AND winner_color = 1) OR (black_user = 'u11' AND winner_color = 2)
UNION ALL SELECT 'flags', _id FROM v WHERE rated AND perf IN (6, 11) AND analysed UNION ALL SELECT 'both', _id FROM v WHERE (white_user = 'u5' OR black_user = 'u5') AND rated AND turns >= 40""")
def keyword_lookup(spark, d):
    """Users from lists, flags from bitmaps, with the changes since the base laid over them."""
    collection = changed_games(spark, d)
    index = KeywordIndex(spark, new_path(spark, "keywords")).follow(collection)
    asked = {"pair": GameQuery(user1="u899", user2="u7"), "user": GameQuery(user1="u5"), "winner": GameQuery(winner="u11"), "flags": GameQuery(rated=True, perf=[6, 11], analysed=True), "both": GameQuery(user1="u5", rated=True, turns=(40, None))}
    return matching_each(collection, index, asked)


@query("keyword_count", CHANGED_SQL + "SELECT count(*) AS count FROM v WHERE rated AND perf IN (6, 11)")
def keyword_count(spark, d):
    """Counted in bitmaps, and in the changes since."""
    collection = changed_games(spark, d)
    index = KeywordIndex(spark, new_path(spark, "keywords")).follow(collection)
    return matching_count(collection, index, GameQuery(rated=True, perf=[6, 11]))


@query("collection_newest", CHANGED_SQL + "SELECT _id, date FROM v WHERE rated AND turns >= 40 ORDER BY date DESC, _id LIMIT 24 OFFSET 12")
def collection_newest(spark, d):
    """The second and third page of the newest games: the second after the first one's last key, in rounds from the
    newest date on."""
    collection, asked = changed_games(spark, d), GameQuery(rated=True, turns=(40, None))
    last = newest_page(collection, asked.matches, "date", 0, 12).collect()[-1]
    return newest_page(collection, asked.matches, "date", 0, 24, behind=(last["date"], last["_id"]))


@query("game_count", GAMES_SQL + "SELECT count(*) AS count FROM g WHERE rated AND perf IN (6, 11)")
def game_count(spark, d):
    return count(games(spark, d), GameQuery(rated=True, perf=[6, 11]))


@query("game_page_default", GAMES_SQL + "SELECT _id FROM g ORDER BY turns DESC, _id LIMIT 12")
def game_page_default(spark, d):
    return search(games(spark, d), GameQuery(sort_by="turns"), -1, 0)


_game("user_either_side", GameQuery(user1="u5"), "white_user = 'u5' OR black_user = 'u5'")
_game("user_pair", GameQuery(user1="u899", user2="u7"), "(white_user = 'u899' AND black_user = 'u7') OR (white_user = 'u7' AND black_user = 'u899')")
_game("winner_loser", GameQuery(winner="u11"), "(white_user = 'u11' AND winner_color = 1) OR (black_user = 'u11' AND winner_color = 2)")
_game("loser_side", GameQuery(loser="u11"), "(white_user = 'u11' AND winner_color = 2) OR (black_user = 'u11' AND winner_color = 1)")
_game("range_swapped", GameQuery(turns=(60, 40)), "turns BETWEEN 40 AND 60")
_game("range_open", GameQuery(duration=(7000, None)), "duration >= 7000")
_game("date_seconds", GameQuery(date=(None, datetime(1997, 1, 1, 12, 30, 15, 999_999, tzinfo=timezone.utc))), "date <= 852121815")
_game("status_group", GameQuery(status=34), "status IN (32, 34, 39)")
_game("status_exact", GameQuery(status=31), "status = 31")
_game("rating_nonzero", GameQuery(average_rating=(None, 900)), "average_rating > 0 AND average_rating <= 900")
_game("ai_tristate", GameQuery(has_ai=True, ai_level=(2, 6)), "ai > 0 AND ai BETWEEN 2 AND 6")
_game("ai_excluded", GameQuery(has_ai=False, ai_level=(2, 6)), "ai = 0")
_game("user_lower_cased", GameQuery(white_user="U42"), "white_user = 'u42'")


@query("bool_min_match", GAMES_SQL + "SELECT _id FROM g WHERE CAST(rated AS INT) + CAST(analysed AS INT) + CAST(ai > 0 AS INT) + CAST(perf = 11 AS INT) >= 3")
def bool_min_match(spark, d):
    c = F.col
    return games(spark, d).where(p.at_least([c("rated"), c("analysed"), c("ai") > 0, c("perf") == 11], 3)).select("_id")


@query("visibility", STUDIES_SQL + "SELECT _id FROM s WHERE public OR list_contains(members, 'system')")
def visibility(spark, d):
    return studies(spark, d).where(p.visible(F.col("public"), F.col("members"), "system")).select("_id")


@query("member_filter", STUDIES_SQL + "SELECT _id FROM s WHERE list_contains(members, 'assistant')")
def member_filter(spark, d):
    return studies(spark, d).where(p.has_element(F.col("members"), "assistant")).select("_id")


@query("study_prefixes_only", STUDIES_SQL + "SELECT _id FROM s WHERE owner = 'o3' AND list_contains(members, 'user') AND public ORDER BY lower(name) ASC NULLS LAST, _id LIMIT 500")
def study_prefixes_only(spark, d):
    return search(studies(spark, d), StudyQuery("owner:o3 member:user", sort_by="name", ascending=True), 0, 500).select("_id")


@query("study_full", STUDIES_SQL + """SELECT _id FROM s WHERE owner = 'o2' AND (public OR list_contains(members, 'system')) AND EXISTS (SELECT 1 FROM conversations c WHERE CAST(c.conv_id AS VARCHAR) = s._id
  AND role = 'user' AND 'B' || CAST(turn % 10 AS VARCHAR) = 'B2' AND (('p' || CAST(turn % 3 AS VARCHAR) = 'p0' AND 'p' || CAST((turn + 1) % 3 AS VARCHAR) = 'p2')
    OR ('p' || CAST(turn % 3 AS VARCHAR) = 'p2' AND 'p' || CAST((turn + 1) % 3 AS VARCHAR) = 'p0')))""")
def study_full(spark, d):
    chapter = ChapterFilter(variant="user", eco="B2", player1="p0", player2="p2")
    return StudyQuery("owner:o2", user_id="system", chapter=chapter).matches(studies(spark, d), stored_index(spark, d, "study")).select("_id")


@query("study_sort", STUDIES_SQL + "SELECT _id FROM s ORDER BY rank ASC NULLS LAST, _id LIMIT 80")
def study_sort(spark, d):
    asked = StudyQuery("", sort_by="hot", ascending=True, empty_text="all")
    return page(studies(spark, d).withColumn("_score", F.lit(0.0)), asked.keys(), 0, 80).select("_id")


@query("study_search", None)
def study_search(spark, d):
    """Text over names, topics, descriptions and chapters, stemmed, with synonyms: not SQL."""
    return search(studies(spark, d), StudyQuery("study 7", user_id="system", chapter="search_text"), 0, 100, stored_index(spark, d, "study"))


@query("study_chapter_words", None)
def study_chapter_words(spark, d):
    """Words of one chapter's opening and event, stemmed, and its exact tags; pytest holds it against plain Python."""
    asked = ChapterFilter(opening="Enings of the oner", player1="p1", eco="B1")
    return StudyQuery("owner:o1", user_id="system", chapter=asked).matches(studies(spark, d), stored_index(spark, d, "study")).select("_id")


def _orders_with_lines(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_quantity", "l_returnflag", "l_shipdate", "l_partkey")).alias("lines"))
    return table(spark, d, "orders").join(lines, "o_orderkey", "left")


@query("nested_any_match", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49 AND l_returnflag = 'R')")
def nested_any_match(spark, d):
    return _orders_with_lines(spark, d).where(p.same_element(F.col("lines"), lambda e: (e["l_quantity"] >= 49) & (e["l_returnflag"] == "R"))).select("o_orderkey")


@query("nested_wrong_pairing", """SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49 AND l_returnflag = 'R')""")
def nested_wrong_pairing(spark, d):
    lines = F.col("lines")
    many, returned = (lambda e: e["l_quantity"] >= 49), (lambda e: e["l_returnflag"] == "R")
    both = p.same_element(lines, lambda e: many(e) & returned(e))
    return _orders_with_lines(spark, d).where(p.same_element(lines, many) & p.same_element(lines, returned) & ~both).select("o_orderkey")

"""End-to-end cases on small collections."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tabiya.operators.fulltext import TextIndex
from tabiya.operators.search import ChapterFilter, ForumQuery, GameQuery, StudyQuery, TeamQuery, UblogQuery, count, search
from tabiya.sources.collections import CHAPTER, SPECS


def ids(frame):
    return [r["_id"] for r in frame.collect()]


@pytest.fixture(scope="module")
def forum(spark):
    return spark.createDataFrame([("forum_id", "a forum post", "chess", "chess", "ann1", False, 1), ("hidden", "a forum post", "chess", "chess", "ann1", True, 2)], SPECS["forum"].schema)


def test_forum(forum):
    assert ids(search(forum, ForumQuery("chess"))) == ["forum_id"]
    assert ids(search(forum, ForumQuery("ann1 posts"))) == ["forum_id"]
    assert ids(search(forum, ForumQuery("chess", troll=True))) == ["hidden", "forum_id"]
    assert ids(search(forum, ForumQuery("user:ann1"))) == ["forum_id"] and ids(search(forum, ForumQuery("user:else"))) == []
    assert ids(search(forum, ForumQuery(""))) == [] and ids(search(forum, ForumQuery("", empty_text="all"))) == ["forum_id"]
    assert ids(search(forum, ForumQuery("the"))) == []


def test_ublog(spark):
    posts = spark.createDataFrame([("abcdefgh", "tiny river, hello!", "en", 0, 5, 1), ("none", "tiny other", "en", 3, 6, None)], SPECS["ublog"].schema)
    assert ids(search(posts, UblogQuery("tiny river", "score", 1))) == ["abcdefgh"]
    assert ids(search(posts, UblogQuery("hello", "newest", 2))) == []
    assert ids(search(posts, UblogQuery("tiny and river", "likes"))) == ["abcdefgh"]
    assert ids(search(posts, UblogQuery("tiny", "newest"))) == ["abcdefgh", "none"]  # quality comes before the date
    assert ids(search(posts, UblogQuery("tiny quality:1", "likes"))) == ["none", "abcdefgh"] and ids(search(posts, UblogQuery("tiny and quality:1", "likes"))) == ["abcdefgh"]


def test_clauses_on_columns_are_optional_unless_joined(spark):
    posts = spark.createDataFrame([("a", "tiny", "en", 0, 5, 1), ("b", "other", "en", 0, 5, 2), ("c", "tiny", "fr", 0, 5, None), ("d", "other", "fr", 0, 5, 3)], SPECS["ublog"].schema)
    found = lambda text, by="newest": set(ids(search(posts, UblogQuery(text, by))))
    assert found("tiny language:en") == {"a", "b", "c"} == found("tiny language:en", "score")
    assert found("tiny and language:en") == {"a"} == found("language:en and tiny", "score") and found("language:en and quality:2") == {"b"}
    assert found("other tiny and language:fr") == {"c"} and found("quality:3 quality:1") == {"a", "d"} and found("language:de") == set()
    scores = {r["_id"]: r["_score"] for r in search(posts, UblogQuery("tiny language:en")).collect()}
    assert scores["a"] == pytest.approx(scores["b"] + scores["c"]) and scores["b"] == pytest.approx(0.6931, abs=1e-4)


def test_team(spark):
    teams = spark.createDataFrame([("team_id", "team name", "team description", 100)], SPECS["team"].schema)
    for text in ("team name", "team description", "TEAMS"):
        assert ids(search(teams, TeamQuery(text))) == ["team_id"]
    assert ids(search(teams, TeamQuery("team other"))) == []
    assert count(teams, TeamQuery("name")).first()["count"] == 1


@pytest.fixture(scope="module")
def studies(spark):
    tags = lambda *t: dict(zip([f.name for f in CHAPTER["tags"].dataType.fields], t, strict=True))
    sicilian = {"id": "c1", "name": "Najdorf main line", "description": "sharp theoretical line", "tags": tags("standard", "World Championship", "Magnus Carlsen", "Hikaru Nakamura", "1503014", "2016192", "B90", "Sicilian Najdorf")}
    petroff = {"id": "c2", "name": "Classical line", "description": "solid equalising line", "tags": tags("standard", "Candidates Tournament", "Fabiano Caruana", "Ian Nepomniachtchi", "2020009", "4168119", "C42", "Petroff Defense")}
    rows = [
        ("study_id", "study name", "study description", "study owner", ["member1", "member2"], ["topic1", "topic2"], None, 100, True, None, None, None),
        ("sicilian_study", "Sicilian Repertoire", None, "gm_owner", ["coach"], [], [sicilian], 10, True, "2020-01-02 00:00:00", None, None),
        ("petroff_study", "Petroff Repertoire", None, "other_owner", ["student"], [], [petroff], 5, True, "2020-01-01 00:00:00", None, None),
        ("private", "Secret Repertoire", None, "gm_owner", ["coach"], [], [sicilian, petroff], 5, False, None, None, None),
    ]
    return spark.createDataFrame(rows, SPECS["study"].schema)


@pytest.fixture(scope="module")
def index(spark, studies, tmp_path_factory):
    return TextIndex(spark, str(tmp_path_factory.mktemp("study-index")), StudyQuery.index).build(studies)


def test_chapter_words_are_english_with_synonyms(studies, index):
    found = lambda **asked: set(ids(search(studies, StudyQuery("Repertoire", chapter=ChapterFilter(**asked)), index=index)))
    assert found(opening="Defence") == found(opening="Defenses") == found(opening="the defense's") == {"petroff_study"}
    assert found(event="Candidates of London") == {"petroff_study"} and found(event="Cup of London") == found(event="of") == set()
    assert found(player1="carlsens", player2="NAKAMURA") == {"sicilian_study"} and found(player1="Carlsen", player2="Caruana") == set()
    assert found(player1="Carlsen", fide_id1="2020009") == set() and found(player1="Carlsen", fide_id2="1503014", eco="B90") == {"sicilian_study"}


@pytest.mark.parametrize("stored", [False, True])
def test_scores_do_not_depend_on_who_asks(spark, studies, stored, tmp_path):
    index = TextIndex(spark, str(tmp_path), StudyQuery.index).build(studies) if stored else None
    score = lambda user: {r["_id"]: r["_score"] for r in search(studies, StudyQuery("Repertoire", user_id=user), index=index).collect()}
    assert set(score("coach")) - set(score(None)) == {"private"} and score(None).items() <= score("coach").items()


def test_stored_postings_follow_the_collection(spark, tmp_path):
    post = lambda name, text: (name, text, "en", 0, 5, 1)
    schema, rng = SPECS["ublog"].schema, random.Random(2)
    words = "tiny river hello other boat".split()
    now = {f"d{i}": " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for i in range(30)}
    frame = lambda part: spark.createDataFrame([post(*kv) for kv in part.items()], schema)
    index = TextIndex(spark, str(tmp_path), UblogQuery.index).build(frame(now))
    for step in range(2):
        changed = {f"d{i}": " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for i in rng.sample(range(40), 8)}
        gone = [d for d in rng.sample(sorted(now), 3) if d not in changed]
        now = {d: t for d, t in (now | changed).items() if d not in gone}
        index.update(frame(changed), spark.createDataFrame([(d,) for d in gone], "_id string"))
        for text in ("tiny AND river", "boat hello absent"):
            got = {r["_id"]: round(r["_score"], 9) for r in search(frame(now), UblogQuery(text), 0, 99, index).collect()}
            assert got == {r["_id"]: round(r["_score"], 9) for r in search(frame(now), UblogQuery(text), 0, 99).collect()}
    assert index.generations() == [0, 1, 2]
    plan = index.postings().rows.where(F.col("term").isin(["tiny"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "EqualTo(term,tiny)" in plan


def test_study_text(studies):
    for text in ("name", "study description", "topic1", "study owner"):
        assert ids(search(studies, StudyQuery(text))) == ["study_id"]
    assert set(ids(search(studies, StudyQuery("Repertoire")))) == {"sicilian_study", "petroff_study"}
    assert set(ids(search(studies, StudyQuery("Repertoire", user_id="coach")))) == {"sicilian_study", "petroff_study", "private"}
    assert ids(search(studies, StudyQuery("Sicilian Petroff"))) == []  # both in one field
    assert ids(search(studies, StudyQuery(""))) == [] and len(ids(search(studies, StudyQuery("", empty_text="all")))) == 3


@pytest.mark.parametrize(
    "chapter",
    [
        ChapterFilter(eco="B90"), ChapterFilter(variant="standard", eco="B90"), ChapterFilter(opening="Najdorf"), ChapterFilter(player1="Carlsen"), ChapterFilter(player2="Nakamura"),
        ChapterFilter(player1="Nakamura", player2="Carlsen"), ChapterFilter(fide_id1="1503014"), ChapterFilter(fide_id2="2016192"), ChapterFilter(event="World Championship"),
    ],
)
def test_study_chapter_filters(studies, chapter):
    assert ids(search(studies, StudyQuery("Repertoire", chapter=chapter))) == ["sicilian_study"]


def test_study_conditions_hold_on_one_chapter(studies):
    assert ids(search(studies, StudyQuery("Repertoire", chapter=ChapterFilter(eco="A00")))) == []
    assert ids(search(studies, StudyQuery("Repertoire", user_id="coach", chapter=ChapterFilter(eco="B90", opening="Petroff")))) == []


def test_study_chapter_text(studies, index):
    found = lambda query: search(studies, query, index=index)
    assert "sicilian_study" in ids(found(StudyQuery("Najdorf", chapter="search_text")))
    assert "sicilian_study" not in ids(found(StudyQuery("Najdorf")))
    assert ids(found(StudyQuery("owner:gm_owner Najdorf"))) == ["sicilian_study"]
    assert ids(found(StudyQuery("owner:gm_owner Najdorf", owner_searches_chapters=False))) == []
    assert ids(found(StudyQuery("owner:gm_owner b90"))) == []  # exact fields keep their case
    assert ids(found(StudyQuery("owner:gm_owner 1503014"))) == ["sicilian_study"]
    assert ids(found(StudyQuery("owner:gm_owner"))) == ["sicilian_study"]
    assert ids(found(StudyQuery("member:student", sort_by="hot"))) == ["petroff_study"]


def test_study_sorts(studies, index):
    by = lambda field, up: ids(search(studies, StudyQuery("", sort_by=field, ascending=up, empty_text="all")))
    assert by("likes", False)[0] == "study_id" and by("name", True) == ["petroff_study", "sicilian_study", "study_id"]
    assert by("hot", True) == ["petroff_study", "sicilian_study", "study_id"]


@pytest.fixture(scope="module")
def games(spark):
    at = lambda year: int(datetime(year, 10, 20, 12, 20, 20, tzinfo=timezone.utc).timestamp())
    columns = "_id string, status int, turns int, rated boolean, perf int, winner_color int, average_rating int, ai int, date long, duration int, clock_init int, clock_inc int, analysed boolean, white_user string, black_user string, source int"
    draw = lambda name, status: (name, status, 100, True, 2, 3, 150, 0, at(2001), 50, 50, 50, True, "white", "black", 1)
    rows = [("game_id", 1, 100, True, 1, 1, 150, 0, at(1999), 100, 100, 200, True, "white", "black", 1), draw("draw_stalemate", 32), draw("draw_normal", 34), draw("draw_insufficient", 39)]
    return spark.createDataFrame(rows, columns)


@pytest.mark.parametrize(
    "query",
    [
        GameQuery(perf=[1]), GameQuery(loser="black"), GameQuery(duration=(99, 101)), GameQuery(duration=(101, 99)), GameQuery(clock_init=100), GameQuery(clock_inc=200),
        GameQuery(date=(None, datetime(1999, 10, 20, 12, 20, 21, tzinfo=timezone.utc))), GameQuery(winner="white", user1="black"), GameQuery(winner_color=1),
    ],
)
def test_game_filters(games, query):
    assert ids(search(games, query)) == ["game_id"]


def test_game_sorting_and_groups(games):
    assert len(ids(search(games, GameQuery(sort_by="unknown", order="asc")))) == 4
    assert ids(search(games, GameQuery(order="ASC"), 0, 1)) == ["game_id"]
    assert set(ids(search(games, GameQuery(status=34)))) == {"draw_stalemate", "draw_normal", "draw_insufficient"}
    assert ids(search(games, GameQuery(user1="white", user2="nobody"))) == []
    assert search(games, GameQuery()).limit(1).columns == ["_id"]
    assert games.where(F.lit(True)).count() == 4

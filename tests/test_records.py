from datetime import datetime, timezone

from pyspark.sql import functions as F

from tabiya.functions import games as g
from tabiya.operators import translate as tr
from tabiya.operators.enrich import bot_accounts, with_bot_flags

import pytest

COLUMNS = "_id string, players array<string>, winner string, created_at timestamp, moved_at timestamp, ply int, analysed boolean, white_rating int, black_rating int, white_ai int, black_ai int, status int, clock binary, rated boolean, variant int, source int, white_won boolean, chess960_pos int, white_bot boolean, black_bot boolean"
START = datetime(2020, 1, 1, tzinfo=timezone.utc)


def _records(spark, **changed):
    """One record for each value of the changed fields."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    base = dict.fromkeys(names) | {"_id": "x", "players": ["w", "b"], "created_at": START, "ply": 10, "status": 30, "chess960_pos": 1000, "white_bot": False, "black_bot": False}
    n = len(next(iter(changed.values())))
    rows = [tuple((base | {k: v[i] for k, v in changed.items()} | {"_id": str(i)})[name] for name in names) for i in range(n)]
    return spark.createDataFrame(rows, COLUMNS)


def _column(frame, name):
    return [r[name] for r in sorted(frame.collect(), key=lambda r: int(r["_id"]))]


def test_turns_and_winner(spark):
    assert _column(tr.games(_records(spark, ply=[0, 1, 2, 3])), "turns") == [0, 1, 1, 2]
    rows = _records(spark, status=[32, 34, 38, 20, 30, 30], white_won=[None, None, None, None, True, False])
    assert _column(tr.games(rows), "winner_color") == [0, 3, 0, 0, 1, 2]
    assert _column(tr.game_csv(rows), "winner_color") == [3, 3, 3, 3, 1, 2]


def test_ratings_and_durations(spark):
    rows = _records(spark, white_rating=[1600, 1600, None], black_rating=[1700, None, None])
    assert _column(tr.games(rows), "average_rating") == [1650, 0, 0]
    assert _column(tr.game_csv(rows), "average_rating") == ["1650", "1550", ""]
    after = lambda s: datetime.fromtimestamp(START.timestamp() + s, timezone.utc)
    rows = _records(spark, moved_at=[after(-5), after(43199), after(43200), None], clock=[b"\x05\x03"] * 4)
    assert _column(tr.games(rows), "duration") == [0, 43199, 43201, 0]
    assert _column(tr.game_csv(rows), "duration") == ["-5", "43199", "", "0"]


def test_clocks(spark):
    rows = _records(spark, clock=[b"\x05\x03", b"\xb4\x00", b"\xb5\x0a", b"\x05", None])
    assert list(zip(_column(tr.games(rows), "clock_init"), _column(tr.games(rows), "clock_inc"), strict=True)) == [(300, 3), (10800, 0), (15, 10), (-1, -1), (-1, -1)]
    assert _column(tr.game_csv(rows), "clock_init") == ["300", "10800", "15", "", ""]
    assert _column(tr.games(rows), "perf") == [2, 3, 2, 4, 4]  # estimates of 420, 10800 and 415 seconds


def test_loser_and_players(spark):
    rows = _records(spark, players=[["w", "b"], ["w", "b"], ["w", "b"], ["w"], None], winner=["w", "b", None, "w", None])
    assert _column(tr.game_csv(rows), "loser") == ["b", "w", "w", "", ""]
    assert _column(tr.games(rows), "black_user") == ["b", "b", "b", "", ""]


def test_bots(spark):
    accounts = spark.createDataFrame([("w", "BOT"), ("", "BOT"), ("b", None)], "_id string, title string")
    rows = spark.createDataFrame([("1", "w", "b"), ("2", "", "w")], "_id string, white_user string, black_user string")
    got = {r["_id"]: (r.white_bot, r.black_bot) for r in with_bot_flags(rows, bot_accounts(accounts)).collect()}
    assert got == {"1": (True, False), "2": (False, True)}
    with pytest.raises(ValueError):
        bot_accounts(accounts.where("title = 'GM'"))


def test_tags(spark):
    lists = [["ECO:B90", "ECO:C42", "Opening:A: b"], [], None, ["broken"]]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, tags array<string>").select("i", tr.tag_struct(F.col("tags")).alias("t"), tr.bad_tags(F.col("tags")).alias("bad"))
    got = {r.i: r for r in rows.collect()}
    assert got[0].t.eco == "C42" and got[0].t.opening == "A: b" and got[0].t.white is None
    assert got[1].t is None and got[2].t is None and got[3].bad == 1


def test_start_positions_are_the_published_ones():
    ranks = [g.start_rank(n) for n in range(960)]
    assert ranks[518] == "RNBQKBNR" and len(set(ranks)) == 960
    for rank in ranks:
        a, b = (i for i, p in enumerate(rank) if p == "B")
        r1, r2 = (i for i, p in enumerate(rank) if p == "R")
        assert (a + b) % 2 == 1 and r1 < rank.index("K") < r2

"""Rules of game records, as Columns."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the record format.
STALEMATE, UNKNOWN_FINISH, FINISHED, IMPORTED = 32, 38, 30, 7
LONG_SECONDS, TOO_LONG = 43_200, 43_201
STANDARD, FROM_POSITION = 1, 3
PERF_OF_SPEED = {"ultraBullet": 0, "bullet": 1, "blitz": 2, "classical": 3, "correspondence": 4, "rapid": 6}
PERF_OF_VARIANT = {2: 11, 4: 12, 6: 13, 7: 14, 5: 15, 8: 16, 9: 17, 10: 18}
SPEED_BELOW = (("ultraBullet", 30), ("bullet", 180), ("blitz", 480), ("rapid", 1500), ("classical", 21600))
NO_START, DEFAULT_RATING = 1000, 1500


def eligible(status: Column, source: Column, players: Column) -> Column:
    """Finished, not imported (an unknown source passes), with players."""
    return (status >= FINISHED) & ((source != IMPORTED) | source.isNull()) & F.coalesce(F.size(players) > 0, F.lit(False))


def turns(ply: Column) -> Column:
    return F.floor((ply + 1) / 2).cast("int")


def winner_color(white_won: Column, status: Column) -> Column:
    """1 white, 2 black, 3 drawn, 0 unknown. Without a winner only a status above stalemate counts as drawn."""
    drawn = (status > STALEMATE) & (status != UNKNOWN_FINISH)
    return F.when(white_won, 1).when(~white_won, 2).when(drawn, 3).otherwise(0)


def mean_rating(white: Column, black: Column) -> Column:
    """0 unless both are known."""
    w, b = F.coalesce(white, F.lit(0)), F.coalesce(black, F.lit(0))
    return F.when((w > 0) & (b > 0), F.floor((w + b) / 2)).otherwise(0).cast("int")


def export_rating(white: Column, black: Column) -> Column:
    """The exported mean takes a default for an unknown side and is blank only if both are unknown."""
    w, b = F.coalesce(white, F.lit(DEFAULT_RATING)), F.coalesce(black, F.lit(DEFAULT_RATING))
    return F.when(white.isNull() & black.isNull(), "").otherwise(F.floor((w + b) / 2).cast("string"))


def duration(seconds: Column, has_clock: Column) -> Column:
    return F.when(~has_clock | seconds.isNull() | (seconds <= 0), 0).when(seconds < LONG_SECONDS, seconds).otherwise(TOO_LONG).cast("int")


def export_duration(seconds: Column) -> Column:
    return F.when(seconds.isNull() | (seconds >= LONG_SECONDS), "").otherwise(seconds.cast("string"))


def clock_limit(clock: Column) -> Column:
    """Seconds from the first of two bytes; null for fewer bytes."""
    b = F.conv(F.hex(F.substring(clock, 1, 1)), 16, 10).cast("int")
    return F.when(F.length(clock) >= 2, F.when(b < 181, b * 60).otherwise((b - 180) * 15))


def clock_increment(clock: Column) -> Column:
    return F.when(F.length(clock) >= 2, F.conv(F.hex(F.substring(clock, 2, 1)), 16, 10).cast("int"))


def speed(limit: Column, increment: Column) -> Column:
    """By the estimated length of a game of forty moves; no clock is correspondence."""
    estimate = limit + 40 * increment
    out = F.when(estimate.isNull(), "correspondence")
    for name, below in SPEED_BELOW:
        out = out.when(estimate < below, name)
    return out.otherwise("correspondence")


def perf(variant: Column, speed_name: Column) -> Column:
    """The variant's own id, or the speed's for standard games; an unknown variant is standard."""
    by_variant = F.create_map(*[F.lit(x) for kv in PERF_OF_VARIANT.items() for x in kv])
    by_speed = F.create_map(*[F.lit(x) for kv in PERF_OF_SPEED.items() for x in kv])
    return F.coalesce(F.try_element_at(by_variant, variant), F.try_element_at(by_speed, speed_name), F.lit(-1))


def player(players: Column, place: int) -> Column:
    return F.coalesce(F.try_element_at(players, F.lit(place)), F.lit(""))


def loser(players: Column, winner: Column) -> Column:
    """The first player who isn't the winner; of a draw, the first player."""
    return F.try_element_at(F.filter(players, lambda x: ~x.eqNullSafe(winner)), F.lit(1))


def start_rank(number: int) -> str:
    """Back rank of one of the 960 start positions by Scharnagl's numbering: bishops, queen, the pair of knights, then
    rook, king and rook on the squares that are left."""
    rank: list[str | None] = [None] * 8
    number, light = divmod(number, 4)
    number, dark = divmod(number, 4)
    rank[2 * light + 1] = rank[2 * dark] = "B"
    pair, queen = divmod(number, 6)
    empty = lambda: [i for i, piece in enumerate(rank) if piece is None]
    rank[empty()[queen]] = "Q"
    for square in list(itertools.combinations(empty(), 2))[pair]:
        rank[square] = "N"
    for square, piece in zip(empty(), "RKR", strict=True):
        rank[square] = piece
    return "".join(p or "" for p in rank)


def start_positions(spark: SparkSession) -> DataFrame:
    """number and rank: the table of 960 rows."""
    return spark.createDataFrame([(n, start_rank(n)) for n in range(960)], "number int, rank string")


def with_start_number(games: DataFrame, back_rank: str = "back_rank") -> DataFrame:
    """chess960_pos by the white back rank; 1000 where there is none or it is no start position."""
    table = F.broadcast(start_positions(games.sparkSession).select(F.col("rank").alias(back_rank), F.col("number").alias("chess960_pos")))  # 960 rows
    return games.join(table, back_rank, "left").withColumn("chess960_pos", F.coalesce("chess960_pos", F.lit(NO_START)))

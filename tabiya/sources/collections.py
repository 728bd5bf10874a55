"""What a collection is: columns, the role of each, and how its files are laid out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, IntegerType, LongType, ShortType, StringType, StructField, StructType

TEXT, KEYWORD, DATE, NUMBER, BOOL, NESTED = "text", "keyword", "date", "number", "bool", "nested"


@dataclass(frozen=True)
class CollectionSpec:
    name: str
    schema: StructType
    partitions: int = 5
    sort: str | None = None
    compression: str = "snappy"
    roles: dict[str, str] = field(default_factory=dict)

    def of_role(self, role: str) -> list[str]:
        return [f.name for f in self.schema.fields if (f.metadata or {}).get("role") == role]


def _col(name: str, kind: DataType, role: str, **more: object) -> StructField:
    return StructField(name, kind, True, {"role": role, **more})


def _spec(name: str, *columns: StructField, **layout: object) -> CollectionSpec:
    return CollectionSpec(name, StructType([_col("_id", StringType(), KEYWORD), *columns]), **layout)


_S, _I, _H, _L, _B = StringType(), IntegerType(), ShortType(), LongType(), BooleanType()
TAGS = StructType([StructField(t, _S) for t in ("variant", "event", "white", "black", "white_fide_id", "black_fide_id", "eco", "opening")])
CHAPTER = StructType([StructField("id", _S), StructField("name", _S), StructField("description", _S), StructField("tags", TAGS)])

FORUM = _spec("forum", _col("body", _S, TEXT, boost=2), _col("topic", _S, TEXT, boost=5), _col("topic_id", _S, KEYWORD), _col("author", _S, KEYWORD), _col("troll", _B, BOOL), _col("date", _L, DATE, encoding="epoch_millis"))
GAME = _spec(
    "game",
    *[_col(n, _I, KEYWORD) for n in ("status", "perf", "winner_color", "source", "chess960_pos")], _col("turns", _H, NUMBER), _col("rated", _B, BOOL), _col("average_rating", _H, NUMBER),
    _col("ai", ByteType(), NUMBER), _col("date", _L, DATE, encoding="epoch_second"), _col("duration", _I, NUMBER), _col("clock_init", _H, NUMBER), _col("clock_inc", _H, NUMBER),
    _col("analysed", _B, BOOL), _col("white_user", _S, KEYWORD), _col("black_user", _S, KEYWORD), _col("white_rating", _H, NUMBER), _col("black_rating", _H, NUMBER), _col("white_bot", _B, BOOL),
    _col("black_bot", _B, BOOL), partitions=25, sort="date", compression="zstd",
)
STUDY = _spec(
    "study", _col("name", _S, TEXT, boost=3, sort="lower"), _col("description", _S, TEXT), _col("owner", _S, KEYWORD), _col("members", ArrayType(_S), KEYWORD), _col("topics", ArrayType(_S), TEXT),
    _col("chapters", ArrayType(CHAPTER), NESTED), _col("likes", _I, NUMBER), _col("public", _B, BOOL), *[_col(n, _S, DATE, encoding="yyyy-MM-dd HH:mm:ss") for n in ("rank", "created_at", "updated_at")],
)
TEAM = _spec("team", _col("name", _S, TEXT, boost=10), _col("description", _S, TEXT, boost=2), _col("nb_members", _H, NUMBER))
UBLOG = _spec("ublog", _col("text", _S, TEXT, analyzer="standard"), _col("language", _S, KEYWORD), _col("likes", _H, NUMBER), _col("date", _L, DATE, encoding="epoch_millis"), _col("quality", _H, NUMBER))
SPECS = {spec.name: spec for spec in (FORUM, GAME, STUDY, TEAM, UBLOG)}


def create(spark: SparkSession, spec: CollectionSpec, path: str, replace: bool = False) -> None:
    """An empty collection; one that is there stays unless it is to be replaced."""
    spark.createDataFrame([], spec.schema).write.mode("overwrite" if replace else "ignore").parquet(path)


def laid_out(documents: DataFrame, spec: CollectionSpec, partitions: int | None = None) -> DataFrame:
    """Dealt by id, sorted inside files so that ranges of the sort column skip row groups. Without `partitions` the
    size of the rows decides how many files there are."""
    rows = documents.repartition(partitions, "_id") if partitions else documents.repartition("_id")
    return rows.sortWithinPartitions(rows[spec.sort].desc_nulls_last()) if spec.sort else rows


def write(documents: DataFrame, spec: CollectionSpec, path: str, partitions: int | None = None) -> None:
    """The collection in its layout, in as many files as the collection's spec says unless told otherwise."""
    laid_out(documents, spec, partitions or spec.partitions).write.mode("overwrite").option("compression", spec.compression).parquet(path)

"""What making postings sends and holds: it must not grow faster than the collection."""

import re

from oracle import SMALL
from pyspark.sql import functions as F

from tabiya.operators import fulltext
from tabiya.operators.fulltext import TextIndex
from tabiya.plans import standins
from tabiya.plans.catalogue import QUERIES


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString(), frame._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_where_the_text_is(spark):
    docs = spark.createDataFrame([("a", "Ann's boats, ann boat the boat", ["x"]), ("b", "", ["y"]), ("c", None, None), ("d", "the with", ["z z"])], "_id string, text string, many array<string>")
    for english in (True, False):
        made = fulltext.postings(docs, {"text": F.col("text"), "many": F.concat_ws(" ", "many")}, english)
        logical, physical = _plan(made.rows)
        assert "Exchange" not in physical and logical.count("regexp_extract_all") == 1
        assert _plan(made.lengths)[0].count("regexp_extract_all") == 1
        assert {(r["_id"], r.field): r.length for r in made.lengths.collect()} == {(r["_id"], r.field): r.length for r in made.rows.collect()}
    found = {(r["_id"], r.field, r.term, r.tf, r.length) for r in fulltext.postings(docs, {"text": F.col("text"), "many": F.concat_ws(" ", "many")}).rows.collect()}
    assert found == {("a", "text", "ann", 2, 5), ("a", "text", "boat", 3, 5), ("a", "many", "x", 1, 1), ("b", "many", "y", 1, 1), ("d", "many", "z", 2, 2)}


def test_postings_are_dealt_over_tasks_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "TASK_ROWS", 100)
    docs = spark.createDataFrame([(f"d{i}", " ".join(f"w{(i * 7 + j) % 50}" for j in range(20))) for i in range(100)], "_id string, text string")
    index = TextIndex(spark, str(tmp_path / "index"), lambda rows: fulltext.postings(rows, {"text": F.col("text")}, english=False)).build(docs)
    stored = spark.read.parquet(str(tmp_path / "index" / "postings=0-0"))
    per_file = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert sum(per_file) == 2000 and len(per_file) >= 15 and max(per_file) <= 300
    assert not list((tmp_path / "index").glob("words=*")) and index.segments()[0].rows == 2000


def test_texts_are_taken_apart_once(spark):
    for name in ("stem_terms", "stop_possessive", "querystring_required"):
        logical, _ = _plan(QUERIES[name](spark, SMALL))
        assert logical.count("regexp_extract_all") == 1, name


def test_common_words_are_tried_first_and_are_the_same():
    from tabiya.functions import words

    texts = ["naïve café. über, don't a.b 3.14 x_1 _y __ éa fin­", "Straße! (o'brien) 1,2 a​b l’été ça: va ; .x ,y  z a b", "ab́ cd̀. x\ny µm ªb"]
    slow = words._expression(lambda name: rf"\p{{Script={name}}}", r"\p{Alphabetic}", r"\p{Ideographic}", lambda a, b: f"[[{a}]--[{b}]]")
    for part in (rf"(?![{words.NO_BEGINNING}])", rf"[{words.LATIN}]++(?![^{words.ENDS}])|"):
        assert part in slow
        slow = slow.replace(part, "")
    for text in texts:
        assert words.words_of(text) == words.regex.findall(slow, text, words.regex.V1)
    assert re.fullmatch(r"[\w.']+", words.words_of("don't")[0])


def test_lengths_are_dealt_over_tasks_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "TASK_ROWS", 100)
    docs = spark.createDataFrame([(f"d{i}", "two words" if i % 3 else "", ["b", "the", "", "c c"]) for i in range(300)], "_id string, text string, many array<string>")
    many = docs.withColumn("many", F.transform("many", lambda t: F.struct(t.alias("t"))))
    make = lambda rows: fulltext.postings(rows, {"text": F.col("text")}).plus(fulltext.element_postings(rows, "many", {"many.t": lambda c: c["t"]})).plus(fulltext.element_values(rows, "many", {"many.=t": lambda c: c["t"]}))
    TextIndex(spark, str(tmp_path / "index"), make).build(many)
    stored = spark.read.parquet(str(tmp_path / "index" / "lengths=0-0"))
    per_file = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert len(per_file) >= 10 and max(per_file) <= 150
    found = {(r["_id"], r.field): (r.n_docs, r.total) for r in stored.collect()}
    assert len(found) == stored.count() == 800 and found["d1", "text"] == (1, 2) and found["d0", "many.t"] == (2, 3) and found["d0", "many.=t"] == (4, 4)

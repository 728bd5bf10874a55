import pytest
from pyspark.sql import functions as F

from tabiya.functions import analysis
from tabiya.functions.porter import stem

#: Pairs from the published description of the algorithm.
PUBLISHED = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
    "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "valenci": "valenc", "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "hopefulness": "hope",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "airliner": "airlin",
    "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "homologous": "homolog", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
}


@pytest.mark.parametrize("word", PUBLISHED)
def test_stems(word):
    assert stem(word) == PUBLISHED[word]


def test_columns_and_query_are_analysed_alike(spark):
    text = "The King's Defences weren't in it: organisation of 12 mates"
    rows = spark.createDataFrame([(text,)], "text string").select(F.explode(analysis.english_tokens(F.col("text"))).alias("token"))
    terms = {r.token for r in analysis.stemmed(rows).collect()}
    assert terms == {t for group in analysis.english_query(text) for t in group}
    assert analysis.english_query("checkmate", synonyms=True) == [["checkmat", "mate"]]
    assert analysis.english_query("the of") == []


def test_search_boxes(spark):
    boxes = ["Owner:Bob foo  BAR+baz", "+foo", "a b +", "owner:a owner:b", "", "member:x:y"]
    rows = spark.createDataFrame(list(enumerate(boxes)), "i int, box string").select("i", analysis.parsed_prefixes(F.col("box"), ["owner", "member"]).alias("q"))
    got = {r.i: (r.q.terms, r.q.owner, r.q.member) for r in rows.collect()}
    assert got[0] == (["foo", "bar", "baz"], "bob", None)
    assert got[1][0] == ["", "foo"] and got[2][0] == ["a", "b"] and got[4][0] == [""]
    assert got[3] == ([], "b", None) and got[5][2] == "x:y"


def test_cleaned_queries_agree(spark):
    texts = [" Foo and (bar)+baz: x language:en quality:2 quality:9 ", "a-b", 'say "x"/y']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(analysis.cleaned_query(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == [analysis.clean(t) for t in texts]
    assert analysis.clean(texts[0]) == r"foo AND \(bar\) AND baz  x language:en quality:2 quality 9"


def test_hostile_texts_are_analysed(spark):
    """No pattern recurses: a text of any length is safe."""
    texts = ["a'" * 100_000, "a" * 200_000, "' " * 100_000, "a’b" * 50_000, "_" * 200_000, "1." * 100_000 + "a_" * 50_000, "e\u0301" * 100_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(analysis.english_tokens(F.col("t"))).alias("n"), F.size(analysis.standard_tokens(F.col("t"))).alias("m")).collect()
    assert [r.n for r in rows] == [1, 1, 0, 1, 0, 2, 1] == [r.m for r in rows]


#: Texts and their words by the published rules and the examples beside them.
SEGMENTED = {
    "The quick (“brown”) fox can’t jump 32.3 feet, right?": ["the", "quick", "brown", "fox", "can’t", "jump", "32.3", "feet", "right"], "3.14 foo_bar U.S.A. x": ["3.14", "foo_bar", "u.s.a", "x"],
    "e\u0301te\u0301 a": ["e\u0301te\u0301", "a"], "हिन्दी भाषा": ["हिन्दी", "भाषा"], "漢字かな": ["漢", "字", "か", "な"], "カタカナー x": ["カタカナー", "x"], "can't o’neil": ["can't", "o’neil"], "1,000.5; a.b 2.c": ["1,000.5", "a.b", "2", "c"],
    "__ _a_ a3.5b": ["_a_", "a3.5b"], "ภาษาไทย": ["ภาษาไทย"], "א\"ב ג'": ['א"ב', "ג'"], "한국어 😀": ["한국어"], "a:b c-d x\u00adyz p\u200bq": ["a:b", "c", "d", "x\u00adyz", "p", "q"], "32.3°f": ["32.3", "f"], "": [], "!?": [],
}


def test_words_are_those_of_the_boundary_rules_in_columns_and_queries(spark):
    rows = spark.createDataFrame([(t,) for t in SEGMENTED], "t string").select("t", analysis.standard_tokens(F.col("t")).alias("w")).collect()
    assert {r.t: r.w for r in rows} == SEGMENTED
    assert {t: [w for [w] in analysis.standard_query(t)] for t in SEGMENTED} == SEGMENTED


def test_the_two_box_readers_agree(spark):
    from tabiya.operators.search import split_box

    boxes = ["Owner:Bob foo  BAR+baz", "+foo", " a b + ", "owner:a owner:b", "", "member:x:y\tz", "\ta\n", "+", "  "]
    rows = spark.createDataFrame([(b,) for b in boxes], "b string").select(analysis.parsed_prefixes(F.col("b"), ["owner", "member"]).alias("q")).collect()
    for box, row in zip(boxes, rows, strict=True):
        terms, filters = split_box(box, ["owner", "member"])
        assert (terms, filters) == (" ".join(row.q.terms), {k: row.q[k] for k in ("owner", "member") if row.q[k] is not None}), box

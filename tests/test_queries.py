import collections
import math
import re

import pytest
from oracle import SMALL, same

from tabiya.functions.analysis import STOP_WORDS
from tabiya.functions.porter import stem
from tabiya.functions.words import words_of
from tabiya.plans import standins
from tabiya.plans.catalogue import ORACLES, QUERIES


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def _stems(text):
    words = [re.sub("['’]s$", "", w) for w in words_of((text or "").lower())]
    return [stem(w) for w in words if w not in STOP_WORDS]


def _ids(spark, name):
    return [r["_id"] for r in QUERIES[name](spark, SMALL).collect()]


def test_queries_without_sql_are_held_against_plain_python():
    assert set(QUERIES) - set(ORACLES) == {"stem_terms", "forum_search", "team_search", "study_search", "study_chapter_words"}


def test_stem_terms(spark):
    want = collections.Counter(s for r in standins.table(spark, SMALL, "documents").collect() for s in _stems(r.text))
    assert {r.stem: r.n for r in QUERIES["stem_terms"](spark, SMALL).collect()} == want


def test_forum_search(spark):
    rows = standins.forum(spark, SMALL).collect()
    has = lambda r, word: stem(word) in {*_stems(r.body), *_stems(r.topic)} or r.author == word
    want = sorted((-r.date, r["_id"]) for r in rows if not r.troll and has(r, "en") and has(r, "src3"))
    assert want and _ids(spark, "forum_search") == [i for _, i in want[:200]]


def test_team_search(spark):
    rows = standins.teams(spark, SMALL).collect()
    want = sorted((-r.nb_members, r["_id"]) for r in rows if {"ring", "promo"} <= {*_stems(r.name), *_stems(r.description)})
    assert want and _ids(spark, "team_search") == [i for _, i in want[:100]]


def _bm25(docs, query):
    """docs: field texts as lists of stems by (id, field, element)."""
    n, total, often = collections.Counter(), collections.Counter(), collections.Counter()
    for (_, field, _), words in docs.items():
        if words:
            n[field] += 1
            total[field] += len(words)
            often.update((field, q) for q in query if q in words)
    idf = lambda f, q: math.log(1 + (n[f] - often[f, q] + 0.5) / (often[f, q] + 0.5))
    weight = lambda tf, size, f: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size * n[f] / total[f]))
    return {key: {q: idf(key[1], q) * weight(words.count(q), len(words), key[1]) for q in query if q in words} for key, words in docs.items()}


def test_study_search(spark):
    rows, docs, query = standins.studies(spark, SMALL).collect(), {}, ["studi", "7"]
    for r in rows:
        docs |= {(r["_id"], "name", -1): _stems(r.name), (r["_id"], "topics", -1): _stems(" ".join(r.topics)), (r["_id"], "description", -1): _stems(r.description)}
        docs |= {(r["_id"], f, i): _stems(c[f.split(".")[1]]) for i, c in enumerate(r.chapters) for f in ("chapters.name", "chapters.description")}
    boost, best = {"name": 3, "topics": 2}, collections.defaultdict(dict)
    for (i, field, _), found in _bm25(docs, query).items():
        inside = field.startswith("chapters.")
        if found and (inside or len(found) == 2):
            best[i][inside] = max(best[i].get(inside, 0), boost.get(field, 1) * sum(found.values()))
    seen = {r["_id"] for r in rows if r.public or "system" in r.members}
    want = sorted((-round(sum(v.values()), 9), i) for i, v in best.items() if i in seen)[:100]
    got = [(-round(r["_score"], 9), r["_id"]) for r in QUERIES["study_search"](spark, SMALL).collect()]
    assert len(got) == len(want) and sorted(got) == got and [s for s, _ in got] == pytest.approx([s for s, _ in want])


def test_study_chapter_words(spark):
    def fits(c):
        white, black, opening = (_stems(c.tags[t]) for t in ("white", "black", "opening"))
        return c.tags.eco == "B1" and ("p1" in white or "p1" in black) and bool({stem("enings"), stem("oner")} & set(opening))

    want = {r["_id"] for r in standins.studies(spark, SMALL).collect() if r.owner == "o1" and (r.public or "system" in r.members) and any(map(fits, r.chapters))}
    assert set(_ids(spark, "study_chapter_words")) == want


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_files(spark):
    plan = QUERIES["range_open"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan.split("ReadSchema")[1]
    plan = QUERIES["backfill_open"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan

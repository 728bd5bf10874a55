"""Segments of a stored index, and the best documents from parts of posting lists."""

import random

import pytest
from pyspark.sql import functions as F

from tabiya.operators import fulltext
from tabiya.operators.fulltext import Segment, TextIndex, segments_to_merge
from tabiya.operators.search import UblogQuery, search
from tabiya.sources.collections import SPECS


def test_many_updates_leave_few_segments():
    for size, updates in ((10**9, 200), (100, 200), (10**9, 2000)):
        segments, written = [Segment(0, 0, 1 << 20, size, 1)], 0
        for i in range(1, updates + 1):
            segments.append(Segment(i, i, 0, 10, 1))
            while n := segments_to_merge(segments):
                old = segments[-n:]
                written += sum(g.rows for g in old)
                segments[-n:] = [Segment(old[0].first, old[-1].last, old[0].level if n == len(segments) else old[-1].level + 1, sum(g.rows for g in old), 1)]
            assert len(segments) <= (11 if updates == 200 else 15)
            assert [g.first for g in segments[1:]] == [g.last + 1 for g in segments[:-1]]
        assert written <= 10 * updates * (8 if size > 100 else 40)


def _posts(spark, texts):
    return spark.createDataFrame([(k, t, "en" if int(k[1:]) % 3 else "fr", 0, int(k[1:]), 1 + int(k[1:]) % 3) for k, t in texts.items()], SPECS["ublog"].schema)


def test_merged_segments_score_as_a_fresh_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "BLOCK_LEAST", 5)
    monkeypatch.setattr(fulltext, "PART_DOCS", 8)
    rng, words = random.Random(7), "tiny river hello other boat".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))
    now = {f"d{i}": text() for i in range(300)}
    index = TextIndex(spark, str(tmp_path / "index"), UblogQuery.index).build(_posts(spark, now))
    for _ in range(4):
        changed = {f"d{i}": text() for i in rng.sample(range(320), 3)}
        gone = rng.choice([d for d in sorted(now) if d not in changed])
        now = {d: t for d, t in (now | changed).items() if d != gone}
        index.update(_posts(spark, changed), spark.createDataFrame([(gone,)], "_id string"))
    assert [(g.first, g.last) for g in index.segments()] == [(0, 0), (1, 3), (4, 4)]
    fresh = TextIndex(spark, str(tmp_path / "fresh"), UblogQuery.index).build(_posts(spark, now))
    posts = _posts(spark, now)

    def same(query, size):
        got, want = ([(r["_id"], round(r["_score"], 9)) for r in search(posts, query, 0, size, i).collect()] for i in (index, fresh))
        whole = [(r["_id"], round(r["_score"], 9)) for r in search(posts, query, 0, size).collect()]
        assert got == want == whole, query

    same(UblogQuery("tiny AND river boat"), 10)
    same(UblogQuery("boat hello absent", min_quality=2), 25)
    before = sorted(p.name for p in (tmp_path / "index").iterdir())
    index.drop_merged()
    after = sorted(p.name for p in (tmp_path / "index").iterdir())
    assert len(after) < len(before) / 2
    same(UblogQuery("other tiny", language="fr"), 5)
    index.merge(len(index.segments()))
    assert [(g.first, g.last) for g in index.segments()] == [(0, 4)]
    same(UblogQuery("other tiny"), 400)


@pytest.mark.parametrize("text", ["often rare", "often", "rare AND often", "often rare uncommon"])
def test_the_best_are_found_without_reading_all_blocks(spark, tmp_path_factory, text):
    rng = random.Random(11)
    texts = {f"d{i}": " ".join(["often"] * (1 + (rng.random() < 0.02)) + ["filler"] * rng.randrange(40) + (["rare"] if i % 1000 == 7 else []) + (["uncommon"] if i % 50 == 3 else [])) for i in range(20_000)}
    posts = _posts(spark, texts)
    found = getattr(test_the_best_are_found_without_reading_all_blocks, "index", None)
    if found is None:
        old, fulltext.PART_DOCS = fulltext.PART_DOCS, 64
        try:
            found = TextIndex(spark, str(tmp_path_factory.mktemp("best")), UblogQuery.index).build(posts)
        finally:
            fulltext.PART_DOCS = old
        test_the_best_are_found_without_reading_all_blocks.index = found
    query = UblogQuery(text)
    required, optional, _, _ = query.parts()
    top = found.top(required, optional, "text", 10)
    blocks = lambda parts: parts.agg(F.sum("blocks")).first()[0]
    whole = {r["_id"]: round(r["_score"], 9) for r in fulltext.required_and_optional(found, required, optional, "text").collect()}
    got = {r["_id"]: round(r["_score"], 9) for r in top.rows.collect()}
    least = sorted(whole.values(), reverse=True)[9]
    assert {k: v for k, v in whole.items() if v > least}.items() <= got.items() <= whole.items() and len(got) >= 10
    assert [r["_id"] for r in search(posts, query, 0, 10, found).collect()] == [k for k, _ in sorted(whole.items(), key=lambda kv: (-kv[1], -(1 + int(kv[0][1:]) % 3), -int(kv[0][1:]), kv[0]))][:10]
    if text == "often rare":
        assert blocks(top.read) < blocks(top.parts) / 3

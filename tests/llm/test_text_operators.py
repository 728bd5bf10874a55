"""Near duplicates, line dedup, packing, token counts, search and the classifier on small inputs."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tabiya.llm import jaccard_join as jj, line_dedup as ld, packing, token_counts as tc, tokens, topk, weak_labels as wl
from tabiya.llm.common import written


def _sets(rows):
    out = []
    for text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def _components(ids, sets):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)].append(d)
    return [min(least[root(i)], default=None) if sets[i] else ids[i] for i in range(len(ids))]


def _held_against_brute_force(docs):
    rows = docs.collect()
    sets = _sets([r.text for r in rows])
    want = collections.Counter(zip([r.doc_id for r in rows], map(len, sets), _components([r.doc_id for r in rows], sets), strict=True))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jj.near_duplicates(docs).collect())
    assert got == want


@pytest.mark.parametrize("short, block", [(jj.SHORT_LIST, jj.BLOCK), (1, 4)])
def test_jaccard_join_equals_brute_force(spark, awkward, nothing, monkeypatch, short, block):
    monkeypatch.setattr(jj, "SHORT_LIST", short)
    monkeypatch.setattr(jj, "BLOCK", block)
    rng = random.Random(5)
    vocabulary, texts = [f"w{i}" for i in range(300)], []
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 40, 120]))] + (passage if rng.random() < 0.4 else [])
        for _ in range(rng.choice([1, 1, 2, 6, 12])):  # copies that drift away from one another
            texts.append(" ".join(base))
            for _ in range(rng.choice([0, 1, 1, 3])):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
    _held_against_brute_force(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))
    _held_against_brute_force(awkward)
    assert jj.near_duplicates(nothing).count() == 0


def test_copies_are_one_class_and_representatives_stay(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(i, text) for i in range(5, 60)] + [(2, text + " x"), (1, "something else"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.component_id for r in jj.near_duplicates(docs).where("doc_id <> 1").collect()} == {2}
    assert sorted(r.doc_id for r in jj.representatives(docs).collect() if r.doc_id is not None) == [1, 2]


def test_one_row_of_each_component_stays(spark):
    x, y, z, u = (" ".join(f"{c}{i}" for i in range(50)) for c in "xyzu")
    rows = [(3, x, "a"), (5, x, "b"), (5, y, "c"), (6, y + " more", "d"), (7, z, "e"), (7, z, "e"), (None, z, "f"), (None, u, "g"), (None, u, "g"), (8, "", "h"), (8, "", "h"), (None, None, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string").repartition(4)
    want = [(3, x, "a"), (5, y, "c"), (7, z, "e"), (None, u, "g"), (8, "", "h"), (8, "", "h"), (None, None, "i")]
    assert jj.representatives(docs).columns == docs.columns
    assert collections.Counter(map(tuple, jj.representatives(docs).collect())) == collections.Counter(want)


def test_frequency_structures_are_sized_by_the_corpus_and_bounded():
    assert jj.sizes(0) == jj.sizes(1 << 27) == (1 << 27, 1 << 20) and jj.sizes((1 << 27) + 1)[0] == 1 << 28
    assert jj.sizes(1 << 29) == (1 << 29, 1 << 22) and jj.sizes(1 << 60) == (1 << 30, 1 << 23)


def test_a_prefix_never_misses():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 62, n // 12).astype(np.uint64)]))
        level = lambda s: (s % np.uint64(5)).astype(np.int64) + 1
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 80 * (len(a) + len(b) - both):
            (la, pa), (lb, pb) = jj.adaptive_prefix(a, level(a)), jj.adaptive_prefix(b, level(b))
            assert len(np.intersect1d(pa, pb)) >= min(la, lb)


def test_chains_and_stars_are_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201)]
    got = {r.node: r.label for r in jj.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
    assert jj.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _deduped(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20 and doc_id is not None:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or (doc_id is not None and doc_id == max(holders[key(x)]))]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return collections.Counter(out)


def _state(index):
    return {(r.hi, r.lo, r.n_docs, r.max_doc) for r in index.holders.collect()}


def test_line_dedup_is_exact_and_reversible(spark, awkward, nothing, monkeypatch):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    index = ld.LineIndex.of(awkward)
    got = collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in ld.dedup(awkward, index).collect())
    assert got == _deduped(rows)
    monkeypatch.setattr(ld, "LEAST_REFERENCES", 2)
    monkeypatch.setattr(ld.LineIndex, "filters", property(lambda self: ld._newest(self.filter_parts, ["shard"]).withColumn("slots", F.lit(0))))  # every shard is dealt over several tasks
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in ld.dedup(awkward, index).collect()) == got
    monkeypatch.undo()
    clash = awkward.selectExpr("*", "1 AS n_lines", "'c' AS n_dropped", "2 AS kept_sha256")
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in ld.dedup(clash, index).collect()) == got
    assert ld.deduped_documents(clash).columns == clash.columns and {r.n_dropped for r in ld.deduped_documents(clash).collect()} == {"c"}
    line = "This is a line of at least twenty characters"
    more = spark.createDataFrame([(i, f"{line} {i % 4}\nand {line} {i}") for i in range(20, 40)], "doc_id long, text string")
    grown = index.insert(more)
    everything = awkward.select("doc_id", "text").unionByName(more)
    assert _state(grown) == _state(ld.LineIndex.of(everything)) != _state(index)
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in ld.dedup(everything, grown).collect()) == _deduped(rows + [(r.doc_id, r.text) for r in more.collect()])
    assert _state(grown.delete(more)) == _state(index) == _state(grown.delete(more).compacted())
    monkeypatch.setattr(ld, "FULL", 0.0)  # every filter that is touched is built anew
    again = index.insert(more)
    assert _state(again) == _state(grown)
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in ld.dedup(everything, again).collect()) == collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in ld.dedup(everything, grown).collect())
    one = grown.delete(more.where("doc_id = 39"))
    assert _state(one) == _state(ld.LineIndex.of(everything.where("doc_id IS NULL OR doc_id <> 39")))
    assert ld.dedup(nothing, ld.LineIndex.of(nothing)).count() == 0
    assert ld.deduped_documents(awkward).columns == awkward.columns


def test_a_change_writes_what_it_changes(spark):
    line = "This is a line of at least twenty characters"
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(line), F.col("id") % 700, F.lit(f"\n{line}")).alias("text"))
    index = ld.LineIndex.of(docs)
    few = spark.createDataFrame([(9000, f"{line} 5"), (9001, f"{line} of its own"), (None, line)], "doc_id long, text string")
    for changed in (index.insert(few), index.insert(few).delete(few)):
        assert changed.reference_parts[-1].count() == 3 and changed.holder_parts[-1].count() <= 2 and changed.filter_parts[-1].count() <= 2
    assert _state(index.insert(few).delete(few)) == _state(index)


def test_filters_and_shards_grow_with_the_keys(spark, monkeypatch):
    monkeypatch.setattr(ld, "LEAST_SHARDS", 1)
    monkeypatch.setattr(ld, "KEYS_A_SHARD", 64)
    line = "This is a line of at least twenty characters"
    some = lambda n: spark.range(4 * n).select(F.col("id").alias("doc_id"), F.concat(F.lit(line), F.col("id") % n).alias("text"))
    small = ld.LineIndex.of(some(40))
    grown = small.insert(some(160).withColumn("doc_id", F.col("doc_id") + 10_000))
    assert small.shards == 1 and grown.shards == 1 and grown.filters.first().n_keys == 160 and small.filters.first().slots < grown.filters.first().slots
    assert not ld.CuckooFilter.from_bytes(bytes(grown.filters.first().blob)).stash
    large = small.insert(some(900).withColumn("doc_id", F.col("doc_id") + 10_000))
    assert large.shards == 16 and len(large.filter_parts) == 1 and large.filters.agg(F.sum("n_keys")).first()[0] == 900


def test_cuckoo_filters_never_miss_and_forget_what_is_deleted():
    rng = np.random.default_rng(7)
    hi, lo = (rng.integers(0, 1 << 63, 4000).astype(np.uint64) for _ in range(2))
    made = ld.CuckooFilter(500)  # far too small: the rest goes to the stash
    made.insert(hi, lo)
    assert made.contains(hi, lo).all() and made.stash
    made.delete(hi[:2000], lo[:2000])
    back = ld.CuckooFilter.from_bytes(made.to_bytes())
    assert back.contains(hi[2000:], lo[2000:]).all() and back.contains(hi[:2000], lo[:2000]).mean() < 0.2
    big = ld.CuckooFilter(4000)
    big.insert(hi, lo)
    assert not big.stash and big.contains(lo, hi).mean() < 0.01
    big.delete(hi, lo)
    assert not big.table.any()


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(tokens.vocabulary_path())
    made.encode_special_tokens = True
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers(tokenizer):
    odd = ["", None, "a  b\n\n\n c \t x", "<|endoftext|> hi", "I'll we've  日本語 word", " x y  ", "don't\r\n\r\n  z  ", "   ", " a", " \x1cb", "a \x85b c", "x\n y .b 12 3", "é è’s", "½ ²x 12½", "a  b"]
    assert [np.frombuffer(b, "<u4").tolist() for b in tokens.encoded(odd, tokens.vocabulary_path())] == [tokenizer(t) for t in odd]


def _packed(docs, tokenizer):
    ids = collections.defaultdict(list)
    for r in docs.collect():
        ids[r.doc_id].append(np.array(tokenizer(r.text) + [0], "<u4"))
    covered, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(docs).collect():
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {d: sum(n for _, n in x) for d, x in covered.items()} == {d: sum(map(len, x)) for d, x in ids.items()}
    for d, pieces in covered.items():
        if len(ids[d]) == 1:
            assert [s for s, _ in sorted(pieces)] == np.cumsum([0, *[n for _, n in sorted(pieces)]])[:-1].tolist()
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding


def test_packing_is_whole_gapless_and_tight(spark, awkward, nothing, tokenizer):
    assert _packed(awkward, tokenizer) < 4 * 1024
    for length in (1, 3, 200, 300, 600, 1023, 1024, 1500):
        docs = spark.createDataFrame([(i, " ".join(["the"] * (length if i % 5 else 40))) for i in range(60)], "doc_id long, text string").repartition(3)
        assert _packed(docs, tokenizer) < 4 * 1024
    assert packing.pack(nothing).count() == 0


def test_steps_hold_equally_many_tokens(spark):
    docs = spark.createDataFrame([(i, " ".join(["the"] * (i * 37 % 1400))) for i in range(300)], "doc_id long, text string")
    steps = packing.pack(docs).groupBy("context_size", "step").agg(F.countDistinct("sequence_id").alias("n")).collect()
    for size in {r.context_size for r in steps}:
        last = max(r.step for r in steps if r.context_size == size)
        assert {r.n * size for r in steps if r.context_size == size and r.step < last} <= {packing.STEP_TOKENS}


def test_token_counts_equal_brute_force(spark, awkward, nothing, tokenizer, tmp_path):
    flat = written(tc.flat_table(awkward, block_ids=64), "flat-test")
    counted = tc.scan(flat.where("ids IS NOT NULL"))
    names = flat.where("doc_ids IS NOT NULL").select("file", "block", F.posexplode("doc_ids").alias("at", "doc_id")).select("file", (F.col("block") + F.col("at")).alias("ordinal"), "doc_id")
    got = collections.Counter((r.doc_id, r.n_tokens) for r in counted.join(names, ["file", "ordinal"]).collect())
    assert got == collections.Counter((r.doc_id, len(tokenizer(r.text))) for r in awkward.collect())
    assert tc.scan(tc.flat_table(nothing).where("ids IS NOT NULL")).count() == 0
    ids = np.array([5, 5, tc.SEPARATOR, tc.SEPARATOR, 7, tc.SEPARATOR] + [9] * 21, "<u2")
    ids.tofile(tmp_path / "one.bin")
    for size in (1, 2, 3, 7, 100):
        rows = tc.scan(tc.flat_files(spark, str(tmp_path / "*.bin"), block_ids=size, blocks_a_task=2)).orderBy("ordinal").collect()
        assert [(r.n_tokens, r.ended) for r in rows] == [(2, True), (0, True), (1, True), (21, False)]


@pytest.mark.parametrize("run", [1, 3, 4096])
def test_stitching_over_runs_of_blocks_and_tasks(spark, monkeypatch, run):
    """Files of many small blocks in any order over several tasks, with documents that span blocks and whole runs."""
    monkeypatch.setattr(tc, "RUN", run)
    rng, rows, want = np.random.default_rng(run), [], collections.Counter()
    for file in range(4):
        ids = np.where(rng.random(400) < (0.01, 0.1, 0.6, 0)[file], 9, rng.integers(0, 9, 400)).astype("<u2")
        rows += [(file, i, ids[5 * i : 5 * i + 5].tobytes()) for i in range(80)]
        cuts = np.flatnonzero(ids == 9)
        lengths = (np.diff(np.concatenate([[-1], cuts])) - 1).tolist()
        want.update((file, i, n, True) for i, n in enumerate(lengths))
        if (rest := 399 - (cuts[-1] if len(cuts) else -1)) > 0:
            want[file, len(lengths), rest, False] += 1
    blocks = spark.createDataFrame(rows, "file int, block long, ids binary").repartition(7, F.rand(3))
    assert collections.Counter(tuple(r) for r in tc.scan(blocks, separator=9).collect()) == want


def test_ids_that_do_not_fit_are_an_error():
    assert tc.narrowed(np.array([0, 65_535], "<u4")) == b"\0\0\xff\xff"
    with pytest.raises(ValueError):
        tc.narrowed(np.array([65_536], "<u4"))


def test_search_equals_brute_force_on_odd_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (1 + 40 * (i % 3))]) for i in range(150)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] + [0.0] * 5), (203, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (40, [1.0, 2.0]), (220, []), (7, rows[7][1]), (60, rows[60][1]), (300, [0.0] * 6)]
    frame = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<double>, label string").repartition(3)
    fit = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (i, q) in enumerate(fit):
        if i % 20 == 0:
            found = sorted((-int(q @ v), j) for b, (j, v) in enumerate(fit) if a != b and len(v) == len(q))[:20]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(topk.scaled(frame), F.col("vec_id") % 20 == 0, 20).collect()]
    assert sorted(got) == sorted(want)
    assert topk.search(topk.scaled(frame.limit(0)), F.col("vec_id") % 20 == 0, 20).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_coarse_cells_lose_nothing(spark, bits, monkeypatch):
    monkeypatch.setattr(topk, "CELLS_A_GROUP", 1)  # several rounds
    monkeypatch.setattr(topk, "QUERIES_A_GROUP", 1)
    monkeypatch.setattr(topk, "query_blocks", lambda queries, f=topk.query_blocks: f(queries, 2))
    rng = np.random.default_rng(9)
    frame = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=5)]) for i in range(90)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "cells", lambda vectors, f=topk.cells: f(vectors, bits, 16))
    exact = topk.scaled(frame).select("vec_id", "v").collect()
    got = {(r.query_id, r.rank): r.score for r in topk.search(topk.scaled(frame), F.col("vec_id") % 20 == 0, 3).collect()}
    for r in exact:
        if r.vec_id % 20 == 0:
            scores = sorted((sum(x * y for x, y in zip(r.v, o.v, strict=True)) for o in exact if o.vec_id != r.vec_id), reverse=True)
            assert [got[r.vec_id, k] for k in (1, 2, 3)] == scores[:3]


def test_pairs_grow_with_the_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELLS_A_GROUP", 1)
    rng, sizes = np.random.default_rng(11), {}
    for n in (400, 3200):
        frame = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(n)], "vec_id long, embedding array<double>").repartition(2)
        exact = written(topk.scaled(frame), "test-vectors")
        blocks = written(topk.query_blocks(exact.where("vec_id < 40")), "test-blocks")
        sizes[n] = topk.possible_pairs(blocks, written(topk.cells(exact, 8, 50), "test-cells"), 5).count()
    assert 40 * 5 <= sizes[400] and sizes[3200] <= 1.5 * sizes[400]


def test_label_model_finds_planted_accuracies():
    rng = np.random.default_rng(10)
    good = rng.random(20_000) < 0.8
    on_good, on_bad = [0.99, 0.97, 0.98, 0.95], [0.7, 0.5, 0.8, 0.3]
    votes = [np.where(rng.random(len(good)) < 0.2, wl.NONE, np.where(good, rng.random(len(good)) < g, rng.random(len(good)) >= b)) for g, b in zip(on_good, on_bad, strict=True)]
    task = wl.Task("t", tuple(lambda m: 0 for _ in votes))
    patterns = sum(v.astype(int) * 3**i for i, v in enumerate([*votes, np.full(len(good), wl.NONE)]))
    model = wl.LabelModel.fit(task, dict(collections.Counter(patterns.tolist())))
    assert abs(model.balance - 0.8) < 0.05
    assert np.abs(model.right_on_good[:4] - on_good).max() < 0.03 and np.abs(model.right_on_bad[:4] - on_bad).max() < 0.12


def _plain_score(made, text):
    """good and toxic of a text, word by word."""
    m, words = wl.measure(text)
    crc, w = (lambda x: zlib.crc32(x) % wl.FEATURES), made.weights
    good = w["quality"][-1] + sum(4 / len(words) * w["quality"][crc(x)] for x in words)
    for name in wl._STATS:
        good += 0.3 * w["quality"][crc(f"{name}={round(np.log2(m[name] * 128 + 1) * 2)}".encode())]
    good += 0.3 * w["quality"][crc(f"words={round(np.log2(m['words'] + 1) * 2)}".encode())]
    marks = set()
    for word in words:
        bare = word.strip(b".,!?;:\"'()#*$%&|<>")
        marks |= {zlib.crc32(bare, 1) % wl.FEATURES} | {zlib.crc32(bare[:n], 2) % wl.FEATURES for n in (4, 6) if len(bare) > n}
    clean = w["toxicity"][-1] + sum(w["toxicity"][x] for x in marks)
    return 1 / (1 + np.exp(-good)), 1 - 1 / (1 + np.exp(-clean))


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    made = wl.Classifier.fit(docs, labels.where(~held))
    rows = made.score(docs.join(labels.where(held), "doc_id", "left_semi")).join(labels, "doc_id").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    clean, junk = [r for r in rows if r.quality == 1 and r.toxic == 0], [r for r in rows if r.quality == 0]
    assert sum(r.keep for r in clean) >= 0.98 * len(clean) and sum(not r.keep for r in junk) >= 0.85 * len(junk)
    toxic, other = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    listed = [r for r in toxic if wl.measure(r.text)[0]["insults"]]
    assert sum(r.toxic_score >= 0.5 for r in listed) >= 0.95 * len(listed) > 0.4 * len(toxic)
    assert sum(r.toxic_score >= 0.5 for r in toxic) >= 0.72 * len(toxic) and sum(r.toxic_score >= 0.5 for r in other) <= 0.01 * len(other)
    foreign = [r for r in toxic if not wl.measure(r.text)[0]["insults"] and r.quality == 1]  # words that no list holds
    assert sum(r.toxic_score >= 0.5 for r in foreign) >= 0.5 * len(foreign) > 20
    for r in rows[:200]:
        assert np.allclose((r.good_score, r.toxic_score), _plain_score(made, r.text), atol=1e-9)
    again = {r.doc_id: (r.good_score, r.toxic_score) for r in wl.Classifier.fit(docs.repartition(5), labels.where(~held)).score(docs.where("doc_id < 500")).collect()}
    assert all(np.allclose(again[r.doc_id], (r.good_score, r.toxic_score), atol=1e-9) for r in rows if r.doc_id in again)


@pytest.mark.parametrize("folder, least", [("/root/testdata/sf0.01", 0.55), ("/root/testdata/sf0.1", 0.55)])
def test_toxic_texts_are_found_without_labels_of_people(spark, folder, least):
    """The labellers' own knowledge, by the same training at both sizes: they know the insults of one language."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = wl.Classifier.fit(docs).score(docs.join(labels, "doc_id", "left_semi")).join(labels, "doc_id").collect()
    toxic, other = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.toxic_score >= 0.5 for r in toxic) >= least * len(toxic) and sum(r.toxic_score >= 0.5 for r in other) <= 0.005 * len(other)


def test_documents_that_labellers_know_nothing_of_have_no_weight():
    model = wl.LabelModel(np.array([0.99, 0.99]), np.array([0.9, 0.5]), 0.9)
    assert model.moved(np.array([0.9, 1.0, 0.0, 0.95])).round(6).tolist() == [0, 1, 1, 0.5]
    rng, words = np.random.default_rng(4), np.arange(1000)
    bad = rng.random(3000) < 0.1
    rows = [np.unique(np.concatenate([rng.choice(words[10:], 20), rng.choice(words[:10], 3) if b else words[:0]])) for b in bad]
    task = wl.Task("t", (lambda m: 0, lambda m: 0))
    people = np.where(np.arange(3000) < 600, np.where(bad, wl.BAD, wl.GOOD), wl.NONE)
    patterns = wl.NONE + 3 * wl.NONE + 9 * people  # only people speak, about a fifth
    fitted = wl.LabelModel.fit(task, dict(collections.Counter(patterns.tolist())))
    w = wl.trained_together(fitted, patterns, rows)
    toxic = np.array([w[wl.FEATURES] + w[r].sum() < 0 for r in rows])
    assert toxic[600:][bad[600:]].mean() > 0.9 and toxic[600:][~bad[600:]].mean() < 0.02


def test_classifier_without_labels_and_on_odd_tables(spark, awkward, nothing):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = wl.Classifier.fit(docs).score(docs).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    clean, english = [r for r in rows if r.quality == 1 and r.toxic == 0], [r for r in rows if r.toxic == 1 and r.lang == "en"]
    assert sum(r.keep for r in clean) >= 0.98 * len(clean) and sum(r.toxic_score >= 0.5 for r in english) >= 0.5 * len(english)
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (8, None, None), (8, None, 1), (None, 1, 1), (77, 0, 1)], "doc_id long, quality int, toxic int")
    people = {r.doc_id: (r.of_quality, r.of_toxicity) for r in wl.people_votes(odd).collect()}
    assert people == {1: (wl.NONE, wl.GOOD), 8: (wl.NONE, wl.BAD), 77: (wl.BAD, wl.BAD)}
    for given in (None, odd, odd.limit(0)):
        got = wl.Classifier.fit(awkward, given).score(awkward).collect()
        assert collections.Counter(r.doc_id for r in got) == collections.Counter(r.doc_id for r in awkward.collect())
        assert len({r.good_score for r in got if r.doc_id == 8}) == 1 and len({(r.votes, r.good_score, r.toxic_score) for r in got if r.doc_id in (1, 2)}) == 1
        assert {r.votes for r in got if r.doc_id in (1, 2)} == {"0" + "2" * 9}
        assert wl.Classifier.fit(nothing, given).score(nothing).count() == 0


def test_pipeline_stage_by_stage(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, folder), f"test-{name}")
        kept[name] = (before, docs)
        assert name == "packing" or docs.columns == columns
    before, after = kept["quality_rules"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect() if _fine(r.text)}
    before, after = kept["line_dedup"]
    want = _deduped([(r.doc_id, r.text) for r in before.collect()])
    assert {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in after.collect()} == {(d, s) for d, _, _, s in want}
    before, after = kept["ngram_jaccard_join"]
    rows = before.collect()
    sets = _sets([r.text for r in rows])
    assert {r.doc_id for r in after.collect()} == {c for c, s in zip(_components([r.doc_id for r in rows], sets), sets, strict=True)} | {r.doc_id for r, s in zip(rows, sets, strict=True) if not s}
    before, after = kept["mixing"]
    texts = {r.doc_id: r.text for r in before.collect()}
    times = collections.Counter(r.doc_id for r in after.collect())
    assert all(texts[r.doc_id].startswith(r.text) or r.text in texts[r.doc_id] for r in after.collect()) and max(times.values()) <= 3
    before, _ = kept["packing"]
    assert _packed(before, tokenizer) < 4 * 1024
    assert corpus_pipeline.run(spark, folder).count() == kept["packing"][1].count()


def _roots(sets):
    """For each row the first row of its component."""
    return _components(list(range(len(sets))), sets)


def test_every_stage_on_odd_tables(spark, awkward, nothing):
    """Nulls, repeated ids with equal and with other texts, ties, clashing names; rows are what is kept or dropped."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, awkward, "")
        assert out.columns == awkward.columns and stage(spark, nothing, "").count() == 0
        before, after = (collections.Counter(map(tuple, frame.collect())) for frame in (awkward, out))
        assert name in ("line_dedup", "mixing") or after <= before
        assert name != "line_dedup" or after.total() == before.total()
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, "").count() == 0


def test_representatives_equal_brute_force_by_row(spark):
    rng = random.Random(12)
    base = [" ".join(f"{c}{rng.randrange(9)}" for _ in range(40)) for c in "pqrs"]
    texts = [b + (" " + rng.choice("xyz")) * rng.randrange(2) for b in base for _ in range(8)] + ["", None]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 11]), rng.choice(texts), i) for i in range(90)] + [(3, "t " * 9, 90), (11, "t " * 9, 91), (11, "u v w x y z", 92)]
    got = [tuple(r) for r in jj.representatives(spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(5)).collect()]
    sets = _sets([r[1] for r in rows])
    root, kept, want = _roots(sets), collections.defaultdict(list), {}
    for r in got:
        kept[root[r[2]]].append(r[0])
    for (doc_id, _, i), s in zip(rows, sets, strict=True):
        if s:
            want.setdefault(root[i], []).append(doc_id)
    assert {c: kept.pop(c) for c in want} == {c: [min((d for d in ids if d is not None), default=None)] for c, ids in want.items()}
    assert sum(map(len, kept.values())) == sum(not s for s in sets)


def _fine(text):
    return len((text or "").split()) >= 50

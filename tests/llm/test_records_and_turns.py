"""Repair of conversations, fill in middle, and archives, on small inputs."""

import collections
import gzip
import hashlib
import io
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tabiya.llm import dialogue_repair as dr, fill_in_middle as fim, warc
from tabiya.llm.common import written

TURNS = "conv_id long, turn long, role string, text string"


def _damaged(rows):
    known = lambda v: " " if v is None else str(v)
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv] += []
        kind, role, text = zlib.crc32(f"{known(conv)}:{known(turn)}".encode()) % 20, known(role), known(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    order = lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), hashlib.sha256(v[2].encode()).digest())
    return {conv: sorted(turns, key=order) for conv, turns in out.items()}


STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
NAMES = {"u": "user", "a": "assistant"}


def _cheapest(turns, faults):
    """Least (cost, audit) of all edits, from the last turn back, with what each state's repair gives."""

    def with_inserts(best):
        for _ in range(3):
            for (state, initial), to in STEP.items():
                if initial in NAMES and to in best:
                    cost, audit, made = best[to]
                    best[state] = min(best.get(state, (1 << 60,)), (cost + 3, "I" + audit, ((NAMES[initial], ""), *made)), key=lambda b: b[:2])
        return best

    best = with_inserts({"": (0, "", ()), "a": (0, "", ())})
    for (_, role, text), fault in reversed(list(zip(turns, faults, strict=True))):
        new = {}
        for state in ("", "s", "u", "a"):
            options = [(best[state][0] + 4, "D" + best[state][1], best[state][2])] if state in best else []
            for initial, made, cost, letter in ((role[:1], role, 0, "K"), ("u", "user", 3, "R"), ("a", "assistant", 3, "R")):
                to = STEP.get((state, initial))
                if fault not in ("blank", "duplicate") and to in best:
                    options.append((best[to][0] + cost + 3 * (fault == "truncated"), letter + best[to][1], ((made, text), *best[to][2])))
            if options:
                new[state] = min(options, key=lambda o: o[:2])
        best = with_inserts(new)
    return best[""]


def _repaired(rows):
    for conv, turns in _damaged(rows).items():
        seen, faults = set(), []
        for _, role, text in turns:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers, initials = [t for t, _, _ in turns if t is not None], [role[:1] for _, role, _ in turns]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit, made = _cheapest(turns, faults)
        digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in made).encode()).hexdigest()
        yield conv, gaps, *map(faults.count, ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, digest


def _odd_turns():
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", "unknown", None, *["user", "assistant"] * 3], ["Hi.", "ok", "", "  \t", "What? ", "x.", None, "A\nB!", "…", "yes \x0b"]
    rows = [(rng.choice([None, *range(1, 14)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(400)]
    return rows + [(77, i, "user" if i % 2 == 0 else "assistant", "Fine.") for i in range(60)] + [(78, i // 3, "user", "So.") for i in range(30)]


@pytest.mark.parametrize("piece", [dr.PIECE, 3, 1])
def test_repair_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(dr, "PIECE", piece)
    docs = spark.createDataFrame(_odd_turns(), TURNS).withColumn("fault", F.lit("clash")).withColumn("n", F.lit(7)).repartition(3)
    rows = dr.damaged(docs)
    found = dr.audits(written(dr.turns(rows), "turns"))
    want = collections.Counter(_repaired([tuple(r)[:4] for r in docs.collect()]))
    assert collections.Counter(tuple(r) for r in dr.repaired_digests(rows, found).collect()) == want
    if piece != 3:
        return
    by_conversation = collections.defaultdict(list)
    for r in sorted(dr.repaired_turns(rows, found).collect(), key=lambda r: (r.conv_id or 0, r.place)):
        by_conversation[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(made).encode()).hexdigest() for c, made in by_conversation.items()} == {w[0]: w[-1] for w in want if w[-1] != hashlib.sha256(b"").hexdigest()}


def test_repaired_conversations_are_sound_and_nothing_crashes(spark):
    rows = dr.damaged(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    found = dr.audits(written(dr.turns(rows), "turns"))
    made = dr.repaired_turns(rows, found).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "role"))), lambda r: F.substring(r["role"], 1, 1)), "").alias("roles"))
    assert made.where(~F.col("roles").rlike("^s?(ua)+$")).count() == 0
    empty = dr.damaged(spark.createDataFrame([], TURNS))
    assert dr.repaired_digests(empty, dr.audits(written(dr.turns(empty), "turns"))).count() == 0


def test_the_agenda_looks_at_the_way_through_only():
    pushed, real = [], dr.heapq.heappush
    clean = [("u" if i % 2 == 0 else "a", dr.SOUND) for i in range(1000)]
    dr.heapq.heappush = lambda heap, item: (pushed.append(item), real(heap, item))
    try:
        assert dr.lightest(clean, dict.fromkeys(dr.FINAL, 0), (dr.START,))[dr.START][:2] == (0, "K" * 1000)
    finally:
        dr.heapq.heappush = real
    assert len(pushed) < 10 * len(clean)
    one = dr.lightest([("a", dr.TRUNCATED)], dict.fromkeys(dr.FINAL, 0), (dr.START,))
    assert one[dr.START][:2] == (4, "D")


# Fill in middle


def _texts():
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdé 漢\U0001f600 \n") for _ in range(30_000))
    near = ["<P", "P>", "<", ">", "<S>", "x<M>y", "a<", "é"]
    return ["", None, "x", "<P>", passage, "intro " + passage, passage[:9000] + "<S>" + passage[9000:], *near, *["".join(rng.choice("<PSM>é ") for _ in range(rng.randrange(1, 9))) for _ in range(60)], passage * 30]


@pytest.mark.parametrize("unit", ["point", "word"])
def test_fill_in_middle_equals_brute_force(spark, unit):
    rows = [(None if i == 3 else i, t) for i, t in enumerate(_texts())] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("form", F.lit("clash")).repartition(4)
    got = fim.filled(docs, unit=unit).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()

    def want(doc_id, text):
        text = text or ""
        units = list(text) if unit == "point" else re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
        lead = "" if unit == "point" else text[: len(text) - len("".join(units))]
        h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            return doc_id, len(units), "plain", None, None, text, text
        low, high = sorted(x % (len(units) + 1) for x in h[:2])
        cut = lambda k: 0 if k == 0 else len(lead) + len("".join(units[:k]))
        a, b = cut(low), cut(high)
        pre, mid, suf = text[:a], text[a:b], text[b:]
        spm = h[3] % 100 < 20
        return doc_id, len(units), "spm" if spm else "psm", low, high - low, f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}", text

    assert collections.Counter(map(tuple, got)) == collections.Counter(want(*r) for r in rows)
    assert {"plain", "spm", "psm"} == {r.form for r in got}


def test_shared_passages_are_looked_at_once():
    rng = random.Random(1)
    passage = bytes(rng.randrange(97, 123) for _ in range(200_000))
    summaries = fim.Summaries()
    first = fim.Document(passage, summaries)
    chunks, before = len(first.ends), summaries.looked_at
    assert all(fim.LEAST <= b - a <= fim.MOST for a, b in zip([0, *first.ends[:-2]], first.ends[:-1], strict=True)) and chunks > 100
    for i in range(5):  # wherever the passage stands, its chunks come again after the first few
        fim.Document(b"another beginning " * (7 * i + 1) + passage + b" end", summaries)
    assert summaries.looked_at - before < chunks / 2
    assert first.n == len(passage) and first.offset(12_345) == 12_345


def test_summaries_are_bounded_and_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(fim, "KEPT_BYTES", 10_000)
    rng, summaries = random.Random(2), fim.Summaries("word")
    for _ in range(20):
        text = " ".join("é" * rng.randrange(1, 900) for _ in range(rng.randrange(60)))
        doc = fim.Document(text.encode(), summaries)
        assert doc.n == len(text.split()) and summaries.held <= 10_000
        k = rng.randrange(doc.n + 1)
        assert text.encode()[doc.offset(k) :].decode().split() == text.split()[k:]


def test_fill_in_middle_on_odd_tables(spark, awkward, nothing):
    assert fim.filled(awkward).count() == awkward.count() and fim.filled(nothing).count() == 0


# Archives


def _pages():
    long = "é" * 700
    rows = [(1, "http://a/x y\r\nX: 1", long), (2, None, long), (None, "http://b", long), (3, "http://c", "short"), (4, "http://d", "short"), (5, "http://e", None), (6, "http://f", "x" * 1000), (6, "http://f", "x" * 1000), (7, "u", "y" * 999), (8, "u", "y" * 999)]
    return rows + [(100 + i, f"http://g/{i}", f"\r\n\r\n{i}" + "z" * 2000) for i in range(40)]


def test_archives_equal_brute_force(spark):
    pages = spark.createDataFrame(_pages(), "page_id long, url string, html string").withColumn("row", F.lit("clash")).withColumn("digest", F.lit(1)).repartition(3)
    files = warc.write(warc.with_revisits(pages), archive_bytes=3000)
    found = warc.read(files).where("type <> 'warcinfo'").withColumn("page_id", warc.page_id_of(F.col("record_id"))).withColumn("of", warc.page_id_of(F.col("refers_to")))
    payload = lambda html: (html or "").encode()
    top = {html: max(p for p, _, h in _pages() if h == html and p is not None) for _, _, html in _pages()}
    want, seen = collections.Counter(), set()
    for page_id, _, html in sorted(_pages(), key=lambda r: -(r[0] or 0)):
        again = len(payload(html)) >= 1000 and html in seen
        seen.add(html)
        want[page_id, len(payload(html)), hashlib.sha1(payload(html)).hexdigest(), "revisit" if again else "response", top[html] if again else None] += 1
    rows = found.collect()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.type, r.of) for r in rows) == want
    assert not any(r.error for r in rows) and files.count() > 3
    assert {r.page_id: r.target_uri for r in rows}[1] == "http://a/x%20y%0D%0AX:%201" and {r.page_id: r.target_uri for r in rows}[2] is None
    assert collections.Counter((r.page_id, bytes(r.payload)) for r in warc.resolved(found).collect()) == collections.Counter((p, payload(h)) for p, _, h in _pages())
    nothing = warc.with_revisits(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read(warc.write(nothing)).count() == 0


def _archive():
    return [warc.page_record(f"urn:x-page:{i}:{i}", f"http://x/{i}", (b"payload %d " % i) * 500) for i in range(5)]


@pytest.mark.parametrize("piece", [7, 1000, 1 << 18])
def test_members_are_read_in_pieces_of_any_size(piece):
    rows = list(warc.records(io.BytesIO(b"".join(_archive())), piece=piece))
    assert [r[7] for r in rows] == [(b"payload %d " % i) * 500 for i in range(5)] and not any(r[-1] for r in rows)
    assert [r[0] for r in rows] == [sum(map(len, _archive()[:i])) for i in range(5)]


@pytest.mark.parametrize("piece", [50, 1 << 18])
def test_damage_is_an_error_of_its_record_only(piece):
    members = _archive()
    plain = gzip.decompress(members[1])
    ids = lambda parts: [(r[2], r[-1]) for r in warc.records(io.BytesIO(b"".join(parts)), piece=piece)]
    other_payload = gzip.compress(plain.replace(b"payload 1 ", b"payload X ", 1))
    assert [e for _, e in ids([members[0], other_payload, members[2]])] == [None, "block digest differs; payload digest differs", None]
    too_long = gzip.compress(plain + b"more")
    assert "does not end" in ids([too_long, members[2]])[0][1] and ids([too_long, members[2]])[1][1] is None
    too_short = gzip.compress(plain[:-300])
    assert "shorter" in ids([too_short, members[2]])[0][1] and ids([too_short, members[2]])[1] == ("urn:x-page:2:2", None)
    broken = members[1][:60] + bytes(40) + members[1][100:]
    assert [r for r in ids([members[0], broken, members[2]]) if r[1] is None] == [("urn:x-page:0:0", None), ("urn:x-page:2:2", None)]
    assert "ends inside" in ids([members[0], members[1][:-20]])[1][1]
    assert "no content length" in ids([gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n")])[0][1]
    assert "no WARC header" in ids([gzip.compress(b"HTTP/1.1\r\n\r\n")])[0][1]
    assert ids([b"rubbish before", members[3]])[-1] == ("urn:x-page:3:3", None)
    assert ids([]) == []


def test_digest_lines():
    raw = hashlib.sha1(b"x").digest()
    assert warc.bare(warc.labelled(raw)) == raw.hex() == warc.bare("SHA1:" + raw.hex()) and warc.bare("md5:abc") is None and warc.bare(None) is None and warc.bare("sha1:???") is None

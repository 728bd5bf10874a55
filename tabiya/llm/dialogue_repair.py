"""Repair of conversations whose turns are damaged, by lightest derivations.

A sound conversation is an optional system turn and then pairs of a user's and an assistant's turn, or nothing. A
repair is a sequence of edits, one for each turn (keep, give another role, delete) with insertions between them. It is
deduced: the item (i, state) says that the turns from i on can be repaired from a state of the conversation on, and each
edit is a rule that makes an item of the one behind it, prepending its letter to the audit and its weight to the cost.
Rules are superior and monotone in (cost, turns covered, audit), so Knuth's generalisation of Dijkstra's search applies:
an agenda pops the lightest item, which is then final, until the goal is final; clean conversations never look at
anything but the way through. Two rules that make the same item have different letters, so equal costs are decided by
the first letter, and an item needs no copy of its audit.

A conversation may be most of the table, so none is collected. Turns (without their texts, of which a digest is enough)
are range-sorted by conversation and turn and pass a task in order. A piece of a conversation, at most PIECE turns in
one task, is deduced by itself for each state at its end and each at its beginning; where a conversation has several
pieces, a rule with two antecedents (what is behind the piece, and the piece) joins these few numbers. Only then are the
texts sorted, once, each conversation's audit before its turns, and repaired as they pass; the digest of a whole
conversation is serial work by its nature, but holds one batch at a time.

Defined results: nulls are one space; turns with the same number are ordered by role and then by the digest of their
text, so repeated rows are adjacent; a null conversation id is a conversation of its own; role initials are what counts,
so a turn of an unknown role is kept if its initial fits; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabiya.llm.common import table, written

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3  # costs; the last is of an undeleted truncated turn
PIECE = 4096
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = ("su", "ua", "au")
#: States: nothing yet, after the system's turn, after a user's, after an assistant's; a conversation may end in two.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, FINAL = range(4), (START, ASSISTANT)
#: Where a kept turn of an initial leads; and what a turn is that is given another role, or inserted.
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
_BEFORE = {initial: {to: [s for s in by if by[s] == to] for to in STATES} for initial, by in AFTER.items()}
_BEFORE_NEXT = {to: [s for s in STATES if NEXT[s] == to] for to in STATES}
_LETTERS = "DIKR"

Item = tuple[int, int]


def lightest(turns: list[tuple[str, int]], axioms: dict[int, int], goals: tuple[int, ...], inserts_at_end: bool = True) -> dict[int, tuple[int, str, int]]:
    """The lightest derivations of the goals (states before the first turn): cost, audit and the state at the end.
    turns: initial and fault of each; axioms: costs of the states at the end. Without `inserts_at_end` nothing is
    inserted behind the last turn, which is the next piece's beginning."""
    n = len(turns)
    final: dict[Item, tuple[int, int, Item | None]] = {}  # cost, letter, and the item it is made of
    agenda = [(cost, 0, 0, state, -1) for state, cost in axioms.items()]  # cost, turns covered, letter, state, state behind
    heapq.heapify(agenda)
    open_goals = set(goals)
    while agenda and open_goals:
        cost, covered, letter, state, behind = heapq.heappop(agenda)
        i = n - covered
        if (i, state) in final:
            continue
        final[i, state] = cost, letter, None if behind < 0 else ((i, behind) if letter == 1 else (i + 1, behind))
        if i == 0:
            open_goals.discard(state)
        if covered or inserts_at_end:
            for s in _BEFORE_NEXT[state]:
                if (i, s) not in final:
                    heapq.heappush(agenda, (cost + INSERT, covered, 1, s, state))
        if i:
            initial, fault = turns[i - 1]
            heapq.heappush(agenda, (cost + DELETE, covered + 1, 0, state, state))
            if fault not in (BLANK, DUPLICATE):
                more = cost + (UNFINISHED if fault == TRUNCATED else 0)
                for s in _BEFORE.get(initial, {}).get(state, ()):
                    heapq.heappush(agenda, (more + KEEP, covered + 1, 2, s, state))
                for s in _BEFORE_NEXT[state]:
                    heapq.heappush(agenda, (more + REROLE, covered + 1, 3, s, state))
    out = {}
    for goal in goals:
        if (0, goal) in final:
            item, letters = (0, goal), []
            while (behind := final[item][2]) is not None:
                letters.append(_LETTERS[final[item][1]])
                item = behind
            out[goal] = final[0, goal][0], "".join(letters), item[1]
    return out


def joined(pieces: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, str]:
    """Cost and audit of a conversation from its pieces' derivations, by states before and behind. Audits of one piece
    have one letter for each turn and end with one, so none begins another, and comparing them decides."""
    behind = {s: (0, ()) for s in FINAL}
    for piece in reversed(pieces):
        made: dict[int, tuple[int, str, tuple]] = {}
        for (before, end), (cost, audit) in piece.items():
            if end in behind:
                new = (cost + behind[end][0], audit, behind[end][1])
                if before not in made or new[:2] < made[before][:2]:
                    made[before] = new
        behind = {s: (cost, (audit, rest)) for s, (cost, audit, rest) in made.items()}
    cost, rest = behind[START]
    audit = []
    while rest:
        audit.append(rest[0])
        rest = rest[1]
    return cost, "".join(audit)


# Turns


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, conv_id, turn, role and text, by a checksum of conversation and turn; `dropped` ones are
    still there, so that no conversation is lost."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    damage = F.crc32(F.concat_ws(":", known("conv_id"), known("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), known("role").alias("role"), known("text").alias("text"), damage.alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("damage") == 0).alias("dropped"), "damage")
    return rows.withColumn("copy", F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("damage", "copy")


def _ended(text: Column) -> Column:
    """SOUND, BLANK or TRUNCATED by the text alone."""
    last = F.right(F.rtrim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), F.lit(1))
    return F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, initial, digest (of the text), n (equal rows), fault (of the first of them) and dropped. Equal
    rows are counted before the shuffle."""
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    each = rows.select("conv_id", "turn", "role", "dropped", digest.alias("digest"), _ended(F.col("text")).alias("fault"))
    each = each.groupBy("conv_id", "dropped", "turn", "role", "digest", "fault").agg(F.count("*").alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    first = each.where("NOT dropped").groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.min(place).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    again = ~(F.col("first").eqNullSafe(place))
    fault = F.when(F.col("dropped") | (F.col("fault") == BLANK) | ~again, F.col("fault")).otherwise(DUPLICATE)
    return each.join(first, same, "left").select("conv_id", "dropped", "turn", "role", "digest", "n", fault.alias("fault"))


ORDER = ("conv_id", "dropped", "turn", "role", "digest")
PIECES = "conv_id long, whole boolean, task int, number long, low long, high long, distinct long, blank long, duplicate long, truncated long, illegal long, first string, last string, made string"


class _Piece:
    """A piece of a conversation as its turns pass."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.copies = conv_id, [], []
        self.low = self.high = None
        self.distinct = self.illegal = 0
        self.counts = [0, 0, 0, 0]
        self.first = self.last = None

    def take(self, turn: int | None, initial: str, n: int, fault: int) -> None:
        if turn is not None and turn != self.high:  # nulls come first
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.illegal += n - 1
        self.counts[fault] += 1
        self.counts[BLANK if fault == BLANK else DUPLICATE] += n - 1
        self.first, self.last = initial if self.first is None else self.first, initial
        self.turns.append((initial, fault))
        self.copies.append(n - 1)

    def _full(self, audit: str) -> str:
        """The audit with the deletions of the further copies, at once behind their first: there D comes before I."""
        if not any(self.copies):
            return audit
        out, left = [], iter(self.copies)
        for letter in audit:
            out.append(letter if letter == "I" else letter + "D" * next(left))
        return "".join(out)

    def row(self, whole: bool, task: int, number: int) -> tuple:
        more = DELETE * sum(self.copies)
        if whole:
            [(cost, audit, _)] = lightest(self.turns, dict.fromkeys(FINAL, 0), (START,)).values()
            made = f"{START}{ASSISTANT} {cost + more} {self._full(audit)}"
        else:
            found = [(end, start, *one) for end in STATES for start, one in lightest(self.turns, {end: 0}, tuple(STATES), inserts_at_end=False).items()]
            made = ";".join(f"{start}{end} {cost + more} {self._full(audit)}" for end, start, cost, audit, _ in found)
        return self.conv_id, whole, task, number, self.low, self.high, self.distinct, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, self.first, self.last, made


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_PIECES = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[kind]) for name, kind in (c.split() for c in PIECES.split(", "))])


def pieces(found: DataFrame) -> DataFrame:
    """Pieces of the sorted turns. All but a task's first and last conversations are surely whole in it; these, and
    longer ones, come as derivations between all states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held, out = TaskContext.get().partitionId(), 0, None, []
        edge = True  # the conversation is at the task's beginning, or longer than a piece
        for batch in batches:
            for conv_id, dropped, turn, initial, n, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held is None or held.conv_id != conv_id or len(held.turns) >= PIECE:
                    if held is not None:
                        longer = held.conv_id == conv_id
                        out.append(held.row(not (edge or longer), task, number))
                        number, edge = number + 1, longer
                    held = _Piece(conv_id)
                if not dropped:
                    held.take(turn, initial, n, fault)
            if len(out) >= 1000:
                yield _batch(out, _PIECES)
                out = []
        if held is not None:
            out.append(held.row(False, task, number))
        yield _batch(out, _PIECES)

    ordered = found.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return ordered.select("conv_id", "dropped", "turn", F.substring("role", 1, 1).alias("initial"), "n", "fault").mapInArrow(run, PIECES)


AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _together(rows: pd.DataFrame) -> tuple:
    """A conversation's row of AUDITS from its pieces."""
    low = high = last = None
    distinct = illegal = 0
    derivations = []
    for one in rows.sort_values(["task", "number"]).itertuples(index=False):
        illegal += one.illegal
        if one.first is not None:
            illegal += last is not None and last + one.first not in LEGAL
            last = one.last
            derivations.append({(int(k[0]), int(k[1])): (int(cost), audit) for k, cost, audit in (d.split(" ") for d in one.made.split(";"))})
        if pd.notna(one.low):
            distinct += one.distinct - (high is not None and int(one.low) == high)
            low, high = int(one.low) if low is None else low, int(one.high)
    end = {(s, f): (cost, audit) for f in FINAL for s, (cost, audit, _) in lightest([], {f: 0}, tuple(STATES)).items()}  # insertions behind the last turn
    cost, audit = joined([*derivations, end])
    conv_id = rows["conv_id"].iloc[0]
    return None if pd.isna(conv_id) else int(conv_id), 0 if low is None else high - low + 1 - distinct, int(rows["blank"].sum()), int(rows["duplicate"].sum()), int(rows["truncated"].sum()), int(illegal), cost, audit


def audits(found: DataFrame) -> DataFrame:
    """AUDITS of each conversation."""
    made = written(pieces(found), "pieces")
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("distinct"))
    own = F.split("made", " ")
    whole = made.where("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", own[1].cast("long").alias("cost"), own[2].alias("audit"))
    names = [c.split()[0] for c in AUDITS.split(", ")]
    parts = made.where("NOT whole").groupBy("conv_id").applyInPandas(lambda rows: pd.DataFrame([_together(rows)], columns=names).convert_dtypes(), AUDITS)
    return whole.unionByName(parts)


REPAIRED = AUDITS + ", repaired_sha256 string"


class _Repair:
    """The edits of an audit made to turns as they pass."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _made(self) -> str:
        self.state = NEXT[self.state]
        return ROLE[self.state]

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._made(), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """What comes of a turn: role and text of inserted turns, and its own unless it is deleted."""
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = AFTER[role[:1]][self.state]
            yield role, text
        elif edit == "R":
            yield self._made(), text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        if self.at != len(self.audit) or self.state not in FINAL:
            raise ValueError("an audit that is not its conversation's")


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Turns with texts, each conversation's audit before them, in order; the one shuffle of the texts."""
    columns = [c.split() for c in AUDITS.split(", ")]
    live = rows.where("NOT dropped").select("conv_id", F.lit(True).alias("is_turn"), "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "text")
    both = live.unionByName(found.withColumn("is_turn", F.lit(False)), allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "is_turn", "turn", "role", "digest")
    return ordered.select("is_turn", *[n for n, _ in columns], "turn", "role", "text")


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role and text of the repaired conversations."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, repair, place = None, None, 0
        for batch in batches:
            out = []

            def put(made: Iterator[tuple[str, str]]) -> None:
                nonlocal place
                for role, text in made:
                    out.append((conv_id, place, role, text))  # noqa: B023
                    place += 1

            for row in batch.to_pylist():
                if row["is_turn"]:
                    put(repair.turn(row["role"], row["text"]))
                else:
                    if repair is not None:
                        put(repair.end())
                    conv_id, repair, place = row["conv_id"], _Repair(row["audit"]), 0
            yield _batch(out, schema)
        if repair is not None:
            yield _batch([(conv_id, place + i, *made) for i, made in enumerate(repair.end())], schema)

    return _with_audits(rows, found).mapInArrow(run, "conv_id long, place long, role string, text string")


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """REPAIRED of each conversation: its audit, and the digest of the repaired turns, which pass and aren't kept."""
    schema = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (c.split() for c in REPAIRED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, repair, digest, some = None, None, None, False

        def put(made: Iterator[tuple[str, str]]) -> None:
            nonlocal some
            for role, text in made:
                digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = []
            for is_turn, *values, _, role, text in zip(*columns, strict=True):
                if is_turn:
                    put(repair.turn(role, text))
                    continue
                if about is not None:
                    put(repair.end())
                    out.append((*about, digest.hexdigest()))
                about, repair, digest, some = values, _Repair(values[-1]), hashlib.sha256(), False
            yield _batch(out, schema)
        if about is not None:
            put(repair.end())
            yield _batch([(*about, digest.hexdigest())], schema)

    return _with_audits(rows, found).mapInArrow(run, REPAIRED)


def op11_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return repaired_digests(rows, audits(written(turns(rows), "turns")))

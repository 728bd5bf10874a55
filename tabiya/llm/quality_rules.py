"""Quality rules kept as a ledger of bits.

Every rule is evaluated once for a document. The ledger holds the measurements and one failure bit for each rule.
A policy is a named, versioned set of rules, hence one integer mask: applying another policy, or asking what a rule
costs, reads the ledger and never the texts again.

Defined results: a null or empty text has no words and fails `few_words`; repeated rows get equal ledger rows;
a table without rows gives none; other columns stay out of the ledger unless named in `keep`; a column of the input
that has a measurement's name is not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabiya.llm.common import SPACES, let, table, words

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_full_lines")

#: Rule name, and its failing condition over the measurements; the place in this list is the bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_heavy", "10 * n_symbols > 2 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 60 * n_full_lines"),
)
BIT = {name: 1 << place for place, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of what must not fail."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[name] for name in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STANDARD = Policy("standard-1", tuple(BIT))


def _repeated_words(tokens: Column) -> Column:
    """Words covered by three-word windows that occur at least twice. Windows are hashed; only a text with equal
    hashes sorts them to find the places."""

    def places(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda rows, a, b: F.coalesce(F.get(rows, a)["h"] == F.get(rows, b)["h"], F.lit(False))
        hit = lambda rows: F.filter(rows, lambda _, i: same(rows, i, i - 1) | same(rows, i, i + 1))
        return let(by_hash, lambda rows: F.sort_array(F.transform(hit(rows), lambda row: row["i"])))

    def covered(starts: Column) -> Column:
        step = F.transform(starts, lambda s, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - s, F.lit(3))))
        return F.aggregate(step, F.lit(0), lambda a, b: a + b)

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(places(hashes), covered))

    windows = lambda ws: F.transform(
        F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2))
    )
    return let(windows(tokens), count)


def _measured(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    of_words = let(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), _repeated_words(ws).cast("long").alias("n_repeat_words")))
    of_lines = let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n_full_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))
    return F.struct(
        of_words.alias("w"), of_lines.alias("l"), F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols")
    )


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, the measurements and `fail_bits`: one row for each row, without a shuffle."""
    taken = docs.select(*[F.col(c).alias(f"_keep_{c}") for c in keep], _measured(F.col("text")).alias("_m"))
    flat = taken.select(
        *[F.col(f"_keep_{c}") for c in keep],
        F.col("_m.w.n_words"), F.col("_m.word_chars"), F.col("_m.n_symbols"),
        F.col("_m.l.n_dup_lines"), F.col("_m.w.n_repeat_words"), F.col("_m.l.n_full_lines"),
    )
    bits = [F.when(F.expr(failing), F.lit(BIT[name])).otherwise(F.lit(0)) for name, failing in RULES]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return flat.select(*[F.col(f"_keep_{c}").alias(c) for c in keep], *MEASURES, total.cast("long").alias("fail_bits"))


def passes(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def apply_policies(rows: DataFrame, policies: tuple[Policy, ...]) -> DataFrame:
    """A boolean column `kept_<version>` for each policy."""
    return rows.select("*", *[passes(p).alias(f"kept_{p.version}") for p in policies])


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, and documents that only it rejects. The ledger is first
    counted by its bits, which leaves at most 2**len(RULES) rows."""
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in policy.rules])).alias("r")
    hit, alone = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits") == F.col("r.bit")
    return (
        patterns.select("bits", "n", rules)
        .groupBy(F.lit(policy.version).alias("policy"), F.col("r.rule").alias("rule"))
        .agg(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("failing"), F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("only_this"))
    )


def kept_documents(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    bits = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    judged = ledger(docs.select(bits, F.col("text")), keep=("_row",))
    return judged.where(passes(policy)).select("_row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *MEASURES[:5], (~passes(BASE)).alias("base_failed"), (passes(BASE) & passes(STANDARD)).alias("kept"), "fail_bits")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, ws[i], ws[i + 1], ws[i + 2]) AS n FROM p),
r AS (SELECT k, count(DISTINCT i + o.o) AS n_repeat FROM g, (VALUES (0), (1), (2)) AS o(o) WHERE n >= 2 GROUP BY k),
l AS (SELECT k, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_full_lines
  FROM d JOIN w USING (k) JOIN l USING (k) LEFT JOIN r USING (k)),
b AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 2 * n_words)::INT
   + 8 * (word_chars < 2 * n_words)::INT + 16 * (word_chars > 20 * n_words)::INT + 32 * (100 * n_dup_lines > 60 * n_full_lines)::INT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

"""Text analysis: what a text and a query are broken into.

The column versions run inside the plan. English analysis is tokens, possessive 's, lower case, stop words, stem; stems
are found for the distinct tokens of an Arrow batch, from a bounded cache of those seen before (`stemmed`). The same
chain for the few words of a query is `english_query`.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

from tabiya.functions.porter import stem
from tabiya.functions.words import JAVA_WORD, words_of

#: English stop words of the usual search analyzers. Fixed values.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
#: Words that a query takes for each other. Fixed values.
SYNONYMS = (
    ("defence", "defense"), ("colour", "color"), ("centre", "center"), ("analyse", "analyze"), ("organise", "organize"),
    ("centralisation", "centralization"), ("recognise", "recognize"), ("specialise", "specialize"), ("mate", "checkmate"),
)

def standard_tokens(text: Column) -> Column:
    """Words by the rules of `words`, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(JAVA_WORD), F.lit(0))


def _bare(token: Column) -> Column:
    """A token without its possessive."""
    return F.when(F.endswith(token, F.lit("s")), F.regexp_replace(token, "['’＇]s$", "")).otherwise(token)


def english_tokens(text: Column) -> Column:
    """Lower-cased tokens without possessive and stop words, not yet stemmed."""
    return F.filter(F.transform(standard_tokens(text), _bare), lambda t: ~t.isin(STOP_WORDS))


def english_counts(text: DataFrame, column: str = "text") -> DataFrame:
    """token and n: how often each of `english_tokens` occurs in a text column. Possessives and stop words are looked at
    once for each distinct token."""
    counted = text.select(F.explode(standard_tokens(F.col(column))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    bare = counted.select(_bare(F.col("token")).alias("token"), "n").where(~F.col("token").isin(STOP_WORDS))
    return bare.groupBy("token").agg(F.sum("n").alias("n"))


def joined_words(text: Column) -> Column:
    """The tokens of a text as one string; no token has a line feed."""
    return F.array_join(standard_tokens(text), "\n")


@lru_cache(1 << 17)
def _stem(word: str) -> str:
    return stem(word)


@lru_cache(1 << 17)
def _english(token: str) -> str | None:
    bare = re.sub("['’＇]s$", "", token) if token.endswith("s") else token
    return None if bare in STOP_WORDS else stem(bare)


def _counted(batch: pa.RecordBatch, english: bool) -> pa.RecordBatch:
    """A row for each distinct word of each row of `words`; what makes a word English is done once for each distinct one."""
    batch = batch.filter(pc.not_equal(batch["words"], ""))
    tokens = pc.split_pattern(batch["words"], "\n")
    row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy(zero_copy_only=False))
    coded = tokens.flatten().dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    if english:
        coded = pa.array([_english(w) for w in names.to_pylist()], pa.string()).dictionary_encode()
        names, codes = coded.dictionary, coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)[codes]
        row, codes = row[codes >= 0], codes[codes >= 0]
    lengths = np.bincount(row, minlength=len(tokens))
    found, tf = np.unique(row * max(1, len(names)) + codes, return_counts=True)
    at, terms = np.divmod(found, max(1, len(names)))
    of = batch.select(["_id", "field", "element"]).take(pa.array(at))
    first = np.diff(at, prepend=-1) != 0
    return pa.RecordBatch.from_arrays([*of.columns, names.take(pa.array(terms)), pa.array(tf, pa.int64()), pa.array(lengths[at], pa.int32()), pa.array(first)], [*of.schema.names, "term", "tf", "length", "first"])


def counted_words(rows: DataFrame, english: bool) -> DataFrame:
    """rows (_id, field, element, words), words as `joined_words` gives them, to (_id, field, element, term,
    tf, length, first): a row for each distinct word of a field, or in English for each stem, one of them marked as the
    field's first. Nothing is sent; a task holds the words of one batch."""
    schema = StructType([rows.schema[name] for name in ("_id", "field", "element")]).add("term", StringType()).add("tf", LongType()).add("length", IntegerType()).add("first", BooleanType())
    return rows.select("_id", "field", "element", "words").mapInArrow(lambda batches: (_counted(batch, english) for batch in batches), schema)


@F.arrow_udf(StringType())
def _stem_of(words: pa.Array) -> pa.Array:
    coded = words.dictionary_encode()
    return pa.array([_stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def stemmed(rows: DataFrame, token: str = "token") -> DataFrame:
    """rows with the token replaced by its stem; null tokens go."""
    return rows.where(F.col(token).isNotNull()).withColumn(token, _stem_of(F.col(token)))


def _english_word(word: str) -> str | None:
    bare = re.sub("['’＇]s$", "", word.lower())
    return None if bare in STOP_WORDS else bare


def english_query(text: str, synonyms: bool = False) -> list[list[str]]:
    """One list of alternatives for each position of a query; stop words leave no position."""
    words = [w for w in map(_english_word, words_of(text)) if w]
    alike = lambda w: next((list(group) for group in SYNONYMS if w in group), [w]) if synonyms else [w]
    return [sorted({stem(a) for a in alike(w)}) for w in words]


def standard_query(text: str) -> list[list[str]]:
    return [[w] for w in words_of(text.lower())]


def parsed_prefixes(text: Column, keys: list[str]) -> Column:
    """A search box as struct<terms, filters>: trimmed and lower-cased, split at runs of blanks and plus signs; a piece
    `key:value` of a known key is a filter (the last of a key wins), all others are terms. Trailing empty pieces go, a
    leading one stays."""
    one = lambda value, body: F.transform(F.array(value), body)[0]  # a lambda variable: computed once for a row
    trimmed = lambda raw: F.when((F.size(raw) > 1) & (F.element_at(raw, -1) == ""), F.slice(raw, F.lit(1), F.size(raw) - 1)).otherwise(raw)
    keyed = lambda piece, key: F.startswith(piece, F.lit(f"{key}:"))

    def parsed(pieces: Column) -> Column:
        known = lambda piece: reduce(Column.__or__, [keyed(piece, key) for key in keys])
        last = lambda key: F.try_element_at(F.filter(pieces, lambda piece: keyed(piece, key)), F.lit(-1))
        value = lambda key: one(last(key), lambda found: F.substring(found, F.lit(len(key) + 2), F.length(found)))
        return F.struct(F.filter(pieces, lambda piece: ~known(piece)).alias("terms"), *[value(key).alias(key) for key in keys])

    return one(one(F.split(F.lower(F.trim(text)), "[ +]+"), trimmed), parsed)


#: Characters with a meaning in query strings; `+` isn't among them, as it becomes AND. Fixed values.
SPECIAL_CLASS = r'[\-=&|><!(){}\[\]^"~*?\\/]'


def cleaned_query(text: Column) -> Column:
    """A query string made safe: trimmed, lower-cased, special characters escaped, ` and ` and `+` become AND; colons
    stay in language:xx and quality:n, elsewhere they become blanks."""
    safe = F.regexp_replace(F.lower(F.trim(text)), f"({SPECIAL_CLASS})", r"\\$1")
    joined = F.regexp_replace(F.regexp_replace(safe, " and ", " AND "), r"\+", " AND ")
    words = F.transform(F.split(joined, r"\s+"), lambda w: F.when(w.rlike(r"^(?:language:[a-z]{2}|quality:[1-3])$"), w).otherwise(F.replace(w, F.lit(":"), F.lit(" "))))
    return F.array_join(words, " ")


def clean(text: str) -> str:
    """`cleaned_query` for one string."""
    safe = re.sub(f"({SPECIAL_CLASS})", r"\\\1", text.strip().lower())
    words = re.split(r"\s+", safe.replace(" and ", " AND ").replace("+", " AND "))
    return " ".join(w if re.fullmatch("language:[a-z]{2}|quality:[1-3]", w) else w.replace(":", " ") for w in words)

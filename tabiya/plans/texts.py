"""Full-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabiya.functions import analysis, predicates as p
from tabiya.operators import fulltext
from tabiya.operators.fulltext import TextIndex
from tabiya.operators.paging import page
from tabiya.operators.search import ForumQuery, TeamQuery, UblogQuery, search
from tabiya.plans.standins import BLOGS_SQL, FORUM_SQL, STUDIES_SQL, TEAMS_SQL, Catalogue, blogs, forum, stored_index, studies, table, teams
from tabiya.sources.shared import new_path

CATALOGUE = Catalogue()
query = CATALOGUE.query
#: Words of Latin texts by the boundary rules, for an engine without possessive groups; a quote in SQL is two.
LETTERS, NUMBERS = r"(?:\p{L}\p{M}*)+(?:[:.·''’]\p{M}*(?:\p{L}\p{M}*)+)*", r"(?:\p{Nd}\p{M}*)+(?:[,;.''’]\p{M}*(?:\p{Nd}\p{M}*)+)*"
SQL_WORD = f"_*(?:{LETTERS}|{NUMBERS})+(?:_+(?:{LETTERS}|{NUMBERS})+)*_*"
T = lambda column: f"regexp_extract_all(lower({column}), '{SQL_WORD}')"


@query("forum_all_terms", FORUM_SQL + f"""SELECT _id FROM f WHERE NOT troll AND (list_contains({T('body')}, 'the') OR list_contains({T('topic')}, 'the')) AND (list_contains({T('body')}, 'with') OR list_contains({T('topic')}, 'with'))
  ORDER BY date DESC, _id LIMIT 100""")
def forum_all_terms(spark, d):
    posts = forum(spark, d)
    index = fulltext.postings(posts, {"body": F.col("body"), "topic": F.col("topic")}, english=False)
    ids = fulltext.every_word_somewhere(index, analysis.standard_query("the with"), {"body": 2, "topic": 5})
    return page(posts.where(p.shown(F.col("troll"), False)).join(ids, "_id", "left_semi"), ForumQuery("").keys(), 0, 100).select("_id")


@query("forum_search", None)
def forum_search(spark, d):
    """Every word in body, topic or as author, in stemmed English: not SQL."""
    return search(forum(spark, d), ForumQuery("en SRC3"), 0, 200, stored_index(spark, d, "forum"))


@query("team_any_field", TEAMS_SQL + f"""SELECT _id FROM t WHERE list_contains(list_concat({T('name')}, {T('description')}), 'blue') AND list_contains(list_concat({T('name')}, {T('description')}), 'promo') ORDER BY nb_members DESC, _id LIMIT 60""")
def team_any_field(spark, d):
    found = teams(spark, d)
    index = fulltext.postings(found, {"name": F.col("name"), "description": F.col("description")}, english=False)
    ids = fulltext.every_word_somewhere(index, analysis.standard_query("blue promo"), {"name": 10, "description": 2})
    return page(found.join(ids, "_id", "left_semi"), TeamQuery("").keys(), 0, 60).select("_id")


@query("team_search", None)
def team_search(spark, d):
    return search(teams(spark, d), TeamQuery("Rings promo"), 0, 100, stored_index(spark, d, "team"))


@query("best_field_and", TEAMS_SQL + f"SELECT _id FROM t WHERE list_has_all({T('name')}, ['small', 'ring']) OR list_has_all({T('description')}, ['small', 'ring'])")
def best_field_and(spark, d):
    found = teams(spark, d)
    index = fulltext.postings(found, {"name": F.col("name"), "description": F.col("description")}, english=False)
    return fulltext.best_field(index, analysis.standard_query("small ring"), {"name": 3, "description": 1}, every_word=True).select("_id")


@query("keyword_whole_string", STUDIES_SQL + "SELECT _id FROM s WHERE owner = 'o1' OR list_contains(members, 'o1')")
def keyword_whole_string(spark, d):
    return studies(spark, d).where(p.is_or_has(F.col("owner"), F.col("members"), "o1")).select("_id")


def bm25_sql(source: str, fields: dict[str, float], words: list[str]) -> str:
    """The scores of the words' documents in each field, in SQL."""
    each = " UNION ALL ".join(f"SELECT _id, '{name}' AS field, {boost}::DOUBLE AS boost, {T(name)} AS ts FROM {source}" for name, boost in fields.items())
    listed = ", ".join(f"('{w}')" for w in words)
    return f"""x AS (SELECT * FROM ({each}) WHERE len(ts) > 0), a AS (SELECT field, count(*) AS n, avg(len(ts)) AS mean FROM x GROUP BY field),
h AS (SELECT _id, field, boost, w, len(ts) AS length, len(list_filter(ts, lambda y: y = w)) AS tf FROM x, (VALUES {listed}) AS q(w) WHERE list_contains(ts, w)),
o AS (SELECT field, w, count(*) AS n_with FROM h GROUP BY field, w),
r AS (SELECT _id, field, sum(boost * ln(1 + (n - n_with + 0.5) / (n_with + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean)))) AS score
  FROM h JOIN o USING (field, w) JOIN a USING (field) GROUP BY _id, field) """


@query("bm25_scores", BLOGS_SQL + ", " + bm25_sql("b", {"text": 1}, ["the", "with", "nicht"]) + "SELECT _id, round(score, 6) AS score FROM r")
def bm25_scores(spark, d):
    found = fulltext.best_field(stored_index(spark, d, "ublog"), analysis.standard_query("the with nicht"), {"text": 1})
    return found.select("_id", F.round("_score", 6).alias("score"))


@query("bm25_topk", BLOGS_SQL + ", " + bm25_sql("b", {"text": 1}, ["from", "they"]) + "SELECT _id, round(score, 6) AS score FROM r JOIN b USING (_id) ORDER BY r.score DESC, quality DESC NULLS LAST, date DESC, _id LIMIT 30")
def bm25_topk(spark, d):
    """The best posts, from the parts of the posting lists that can hold them."""
    return search(blogs(spark, d), UblogQuery("from they", by="score"), 0, 30, stored_index(spark, d, "ublog")).select("_id", F.round("_score", 6).alias("score"))


@query("boosted_best_field", TEAMS_SQL + ", " + bm25_sql("t", {"name": 10, "description": 2}, ["small", "blue"]) + "SELECT _id, round(max(score), 6) AS score FROM r GROUP BY _id")
def boosted_best_field(spark, d):
    index = fulltext.postings(teams(spark, d), {"name": F.col("name"), "description": F.col("description")}, english=False)
    return fulltext.best_field(index, analysis.standard_query("small blue"), {"name": 10, "description": 2}).select("_id", F.round("_score", 6).alias("score"))


@query("synonym_any", f"""SELECT doc_id, len(list_filter({T('text')}, lambda y: y IN ('the', 'der', 'los'))) AS tf FROM documents WHERE list_has_any({T('text')}, ['the', 'der', 'los'])""")
def synonym_any(spark, d):
    """Alternatives share one position: their occurrences count together."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("_id"), "text")
    index = fulltext.postings(docs, {"text": F.col("text")}, english=False)
    return fulltext.hits(index, [["the", "der", "los"]], {"text": 1}).select(F.col("_id").alias("doc_id"), "tf")


STOPPED = ", ".join(f"'{w}'" for w in analysis.STOP_WORDS)


@query("index_update", BLOGS_SQL + ", v AS (SELECT _id, text || ' ' || CASE WHEN CAST(_id AS BIGINT) % 10 = 1 THEN 'nicht the' ELSE '' END AS text FROM b WHERE CAST(_id AS BIGINT) % 10 <> 2), " + bm25_sql("v", {"text": 1}, ["the", "nicht"]) + "SELECT _id, round(score, 6) AS score FROM r")
def index_update(spark, d):
    """A stored index brought forward: some documents get words, some go; scores are those of an index built anew."""
    found, number = blogs(spark, d), F.col("_id").cast("long")
    index = TextIndex(spark, new_path(spark, "index-update"), UblogQuery.index).build(found)
    index.update(found.where(number % 10 == 1).withColumn("text", F.concat("text", F.lit(" nicht"))), found.where(number % 10 == 2))
    index.update(found.where(number % 10 == 1).withColumn("text", F.concat("text", F.lit(" nicht the"))))
    return fulltext.best_field(index, analysis.standard_query("the nicht"), {"text": 1}).select("_id", F.round("_score", 6).alias("score"))


@query("index_statistics", BLOGS_SQL + f"SELECT 'text' AS field, count(*) AS n_docs, CAST(sum(len({T('text')})) AS BIGINT) AS total FROM b WHERE len({T('text')}) > 0")
def index_statistics(spark, d):
    """An index of all posts, built anew, and its statistics."""
    return TextIndex(spark, new_path(spark, "index-new"), UblogQuery.index).build(blogs(spark, d)).postings().statistics()


@query("stop_possessive", rf"""WITH t AS (SELECT regexp_replace(unnest({T('text')}), '[''’]s$', '') AS token FROM documents)
SELECT token, count(*) AS n FROM t WHERE token NOT IN ({STOPPED}) GROUP BY token""")
def stop_possessive(spark, d):
    return analysis.english_counts(table(spark, d, "documents"))


@query("stem_terms", None)
def stem_terms(spark, d):
    """Occurrences of each stem. Stemming is an algorithm on letters; pytest holds it against published pairs."""
    counted = analysis.english_counts(table(spark, d, "documents"))
    return analysis.stemmed(counted).groupBy(F.col("token").alias("stem")).agg(F.sum("n").alias("n"))


@query("nested_text", f"SELECT DISTINCT CAST(conv_id AS VARCHAR) AS _id FROM conversations WHERE role = 'user' AND list_has_any({T('text')}, ['the', 'nicht'])")
def nested_text(spark, d):
    found = studies(spark, d)
    index = fulltext.element_postings(found, "chapters", {"description": lambda c: c["description"]}, english=False)
    hit = fulltext.in_one_element(index, [["the"], ["nicht"]], {"description": 1})
    by_user = found.select("_id", F.posexplode("chapters").alias("element", "c")).where(F.col("c.name") == "user")
    return by_user.join(hit, ["_id", "element"], "left_semi").select("_id").distinct()


BOX = "concat('Owner:', lang, ' ', text, '+member:', source, ' member:x', CAST(doc_id % 3 AS STRING), ' ')"
PIECES = "list_filter(regexp_split_to_array(lower(trim(box)), '[ +]+'), lambda x: true)"


@query("querylog_prefixes", f"""WITH q AS (SELECT doc_id, {BOX} AS box FROM documents), s AS (SELECT doc_id, {PIECES} AS ps FROM q)
SELECT doc_id, array_to_string(list_filter(ps, lambda x: NOT starts_with(x, 'owner:') AND NOT starts_with(x, 'member:')), '|') AS terms,
  regexp_replace(list_filter(ps, lambda x: starts_with(x, 'owner:'))[-1], '^owner:', '') AS owner, regexp_replace(list_filter(ps, lambda x: starts_with(x, 'member:'))[-1], '^member:', '') AS member FROM s""")
def querylog_prefixes(spark, d):
    log = table(spark, d, "documents").select("doc_id", F.expr(BOX).alias("box"))
    parsed = log.select("doc_id", analysis.parsed_prefixes(F.col("box"), ["owner", "member"]).alias("q"))
    return parsed.select("doc_id", F.array_join("q.terms", "|").alias("terms"), "q.owner", "q.member")


DIRTY = "concat(' ', text, ' and (', lang, ') + language:', lang, ' quality:2 x:y ')"


@query("querylog_cleanup", f"""WITH q AS (SELECT doc_id, regexp_replace(lower(trim({DIRTY})), '([\\-=&|><!(){{}}\\[\\]^"~*?\\\\/])', '\\\\\\1', 'g') AS safe FROM documents)
SELECT doc_id, array_to_string(list_transform(regexp_split_to_array(replace(replace(safe, ' and ', ' AND '), '+', ' AND '), '\\s+'),
  lambda w: CASE WHEN regexp_full_match(w, 'language:[a-z]{{2}}|quality:[1-3]') THEN w ELSE replace(w, ':', ' ') END), ' ') AS cleaned FROM q""")
def querylog_cleanup(spark, d):
    return table(spark, d, "documents").select("doc_id", analysis.cleaned_query(F.expr(DIRTY)).alias("cleaned"))


@query("querystring_required", f"SELECT doc_id FROM documents WHERE list_has_all({T('text')}, ['the', 'with'])")
def querystring_required(spark, d):
    """`the AND with nicht`: the last word is optional."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("_id"), "text")
    index = fulltext.postings(docs, {"text": F.col("text")}, english=False)
    required, optional, _, _ = UblogQuery("the AND with nicht").parts()
    return fulltext.required_and_optional(index, required, optional, "text", scored=False).select(F.col("_id").alias("doc_id"))


@query("ublog_sort", BLOGS_SQL + f"""SELECT _id FROM b WHERE quality >= 1 AND (language = 'fr' OR list_has_any({T('text')}, ['the', 'with'])) ORDER BY likes DESC NULLS LAST, quality DESC NULLS LAST, date DESC NULLS LAST, _id LIMIT 400""")
def ublog_sort(spark, d):
    return search(blogs(spark, d), UblogQuery("the with language:fr", by="likes", min_quality=1), 0, 400, stored_index(spark, d, "ublog")).select("_id")


@query("querystring_clauses", BLOGS_SQL + f"""SELECT 'any' AS asked, _id FROM b WHERE language = 'fr' OR quality = 1 OR list_contains({T('text')}, 'nicht')
UNION ALL SELECT 'both', _id FROM b WHERE language = 'de' AND list_contains({T('text')}, 'nicht')
UNION ALL SELECT 'one', _id FROM b WHERE language = 'en'""")
def querystring_clauses(spark, d):
    """`language:` and `quality:` are clauses like words: optional, unless AND joins them to a neighbour."""
    posts, index = blogs(spark, d), stored_index(spark, d, "ublog")
    asked = {"any": "nicht language:fr quality:1", "both": "nicht AND language:de", "one": "nicht language:en AND language:en"}
    found = [UblogQuery(text, by="newest").matches(posts, index).select(F.lit(name).alias("asked"), "_id") for name, text in asked.items()]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query("ublog_oldest", BLOGS_SQL + f"""SELECT _id FROM b WHERE list_has_any({T('text')}, ['nicht', 'und']) ORDER BY quality DESC NULLS LAST, date ASC NULLS LAST, _id LIMIT 40 OFFSET 5""")
def ublog_oldest(spark, d):
    return search(blogs(spark, d), UblogQuery("nicht und", by="oldest"), 5, 40, stored_index(spark, d, "ublog")).select("_id")

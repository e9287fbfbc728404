"""Queries of the text path: cleaning, embedding, discovery, tables and their pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsift.functions import text as X
from colsift.operators import discover as D
from colsift.plans.search import SQL, query
from colsift.runtime import table
from colsift.sources import text as sources

_CELLS = """t AS (SELECT DISTINCT table_id, relation FROM raw_tables WHERE table_id IS NOT NULL AND relation IS NOT NULL),
cols AS (SELECT table_id, CAST(UNNEST(RANGE(LEN(relation))) AS INT) AS set_id, relation FROM t),
cells AS (SELECT table_id, set_id, CAST(UNNEST(RANGE(LEN(relation[set_id + 1]))) AS INT) AS pos, relation FROM cols),
cell AS (SELECT table_id, set_id, pos, relation[set_id + 1][pos + 1] AS cell FROM cells)"""
_KEEP = r"cell IS NOT NULL AND LENGTH(cell) > 0 AND cell <> 'nan' AND NOT REGEXP_MATCHES(cell, '^-?[0-9]+$')"
_TOKENS = rf"""tokens AS (SELECT DISTINCT table_id, set_id, REGEXP_REPLACE(LOWER(cell), '[^\p{{L}}\p{{N}}\p{{M}}_\x{{200C}}\x{{200D}}]+', ' ', 'g') AS token FROM cell WHERE {_KEEP})"""
#: Columns whose ids end in 0 make the query side of the text searches: a stated set against all columns.
_ASKED = "table_id % 20 = 0"
DIM = 16


def cells(spark, sf_dir):
    df = table(spark, sf_dir, "raw_tables").where("table_id is not null and relation is not null").select("table_id", "relation").distinct()
    cols = df.select("table_id", F.posexplode("relation").alias("set_id", "cells"))
    return cols.select("table_id", "set_id", F.posexplode("cells").alias("pos", "cell"))


def tokens(spark, sf_dir):
    return D.clean_cells(cells(spark, sf_dir), ["table_id", "set_id"])


@query(f"WITH {_CELLS} SELECT table_id, set_id, COUNT(*) AS cells, COUNT(*) FILTER ({_KEEP}) AS kept FROM cell GROUP BY table_id, set_id")
def f6_text_cells(spark, sf_dir):
    kept = X.keeps_cell(F.col("cell"))
    return cells(spark, sf_dir).groupBy("table_id", "set_id").agg(F.count("*").alias("cells"), F.count_if(kept).alias("kept"))


@query(f"WITH {_CELLS}, {_TOKENS} SELECT table_id, set_id, COUNT(*) AS tokens, SUM(LENGTH(token))::BIGINT AS letters FROM tokens GROUP BY table_id, set_id")
def u1_distinct_tokens(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy("table_id", "set_id").agg(F.count("*").alias("tokens"), F.sum(F.length("token")).alias("letters"))


@query(f"WITH {_CELLS} SELECT DISTINCT cell, LOWER(cell) AS lowered FROM cell WHERE cell IS NOT NULL")
def x16_all_lowered(spark, sf_dir):
    return cells(spark, sf_dir).where("cell is not null").select("cell", F.lower("cell").alias("lowered")).distinct()


@query("""SELECT DISTINCT table_id, CAST(LEN(relation) AS INT) AS n_cols, CAST(COALESCE(LIST_MAX(LIST_TRANSFORM(relation, lambda c: COALESCE(LEN(c), 0))), 0) AS INT) AS n_rows,
COALESCE(has_header AND header_position = 'FIRST_ROW', FALSE) AS has_first_row FROM raw_tables WHERE relation IS NOT NULL""")
def s15_table_shapes(spark, sf_dir):
    raw = table(spark, sf_dir, "raw_tables").where("relation is not null").dropDuplicates(["table_id"])
    first = raw.select("table_id", X.has_header_row(F.col("has_header"), F.col("header_position")).alias("has_first_row"))
    return sources.table_shapes(raw).drop("header").join(first, "table_id")


@query("""SELECT DISTINCT table_id, ARRAY_TO_STRING(LIST_TRANSFORM(relation, lambda c: COALESCE(c[1], '')), '|') AS header FROM raw_tables
WHERE relation IS NOT NULL AND LEN(relation) > 0 AND has_header AND header_position = 'FIRST_ROW'""")
def f9_header(spark, sf_dir):
    raw = table(spark, sf_dir, "raw_tables").where("relation is not null and size(relation) > 0").dropDuplicates(["table_id"])
    heads = sources.table_shapes(raw.where(X.has_header_row(F.col("has_header"), F.col("header_position"))))
    return heads.select("table_id", F.concat_ws("|", F.transform("header", lambda h: F.coalesce(h, F.lit("")))).alias("header"))


@query("""WITH t AS (SELECT DISTINCT table_id, relation, CASE WHEN has_header AND header_position = 'FIRST_ROW' THEN 1 ELSE 0 END AS skip FROM raw_tables WHERE relation IS NOT NULL AND LEN(relation) > 0),
l AS (SELECT *, LIST_MAX(LIST_TRANSFORM(relation, lambda c: COALESCE(LEN(c), 0))) AS longest FROM t),
r AS (SELECT table_id, relation, skip, UNNEST(RANGE(skip, longest)) AS i FROM l WHERE longest > skip)
SELECT table_id, CAST(i - skip AS INT) AS row_no, ARRAY_TO_STRING(LIST_TRANSFORM(relation, lambda c: COALESCE(c[i + 1], '')), '|') AS cells FROM r""")
def f10_table_rows(spark, sf_dir):
    raw = table(spark, sf_dir, "raw_tables").where("relation is not null").dropDuplicates(["table_id"])
    return sources.table_rows(raw).select("table_id", F.col("row_no").cast("int").alias("row_no"), F.concat_ws("|", F.transform("cells", lambda c: F.coalesce(c, F.lit("")))).alias("cells"))


@query("""WITH p AS (SELECT DISTINCT table_id, page_title, url FROM table_meta), o AS (SELECT table_id, MAX(overlap_size) AS overlap FROM result_sids WHERE overlap_size IS NOT NULL GROUP BY table_id),
h AS (SELECT DISTINCT table_id, CASE WHEN has_header AND header_position = 'FIRST_ROW' THEN CAST(LEN(relation) AS INT) END AS heads FROM raw_tables)
SELECT o.table_id, overlap, page_title, url, COALESCE(heads, 0) AS n_heads FROM o LEFT JOIN p USING (table_id) LEFT JOIN h USING (table_id)""")
def j6_metadata(spark, sf_dir):
    ranked = table(spark, sf_dir, "result_sids").where("overlap_size is not null").groupBy("table_id").agg(F.max("overlap_size").alias("overlap"))
    found = D.with_metadata(ranked, table(spark, sf_dir, "table_meta"), table(spark, sf_dir, "raw_tables"))
    return found.select("table_id", "overlap", "page_title", "url", F.coalesce(F.when(F.col("header").isNotNull(), F.size("header")), F.lit(0)).alias("n_heads"))


_WORDS = rf"""words AS (SELECT DISTINCT word FROM (SELECT UNNEST(STRING_SPLIT(token, ' ')) AS word FROM tokens) WHERE word <> ''),
lex AS (SELECT word, LIST_TRANSFORM(RANGE({DIM}), lambda i: ('0x' || SUBSTR(MD5(word || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 2 - 1) AS vec FROM words)"""


@query(f"WITH {_CELLS}, {_TOKENS}, {_WORDS} SELECT word, ROUND(vec[1], 6) AS first, ROUND(LIST_SUM(vec), 6) AS total FROM lex")
def j11_whole_lexicon(spark, sf_dir):
    words = tokens(spark, sf_dir).select(F.explode(F.split("token", " ")).alias("word")).where("word <> ''").distinct()
    lex = D.hash_lexicon(words, DIM)
    return lex.select("word", F.round(F.col("vec")[0], 6).alias("first"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_EMBED = f"""unit AS (SELECT word, LIST_TRANSFORM(vec, lambda x: x / SQRT(LIST_DOT_PRODUCT(vec, vec))) AS u FROM lex),
parts AS (SELECT table_id, set_id, token, UNNEST(STRING_SPLIT(token, ' ')) AS word FROM tokens),
cv AS (SELECT table_id, set_id, token, {", ".join(f"AVG(u[{i + 1}]) AS v{i}" for i in range(DIM))} FROM parts JOIN unit USING (word) GROUP BY table_id, set_id, token)"""


@query(f"WITH {_CELLS}, {_TOKENS}, {_WORDS}, {_EMBED} SELECT table_id, set_id, COUNT(*) AS n, ROUND(SUM(v0), 5) AS s0, ROUND(SUM(v{DIM - 1}), 5) AS s{DIM - 1} FROM cv GROUP BY table_id, set_id")
def a9_all_cell_vectors(spark, sf_dir):
    keys = ["table_id", "set_id"]
    v = D.hash_embedder(keys, DIM)(tokens(spark, sf_dir))
    return v.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum(F.col("v")[0]), 5).alias("s0"), F.round(F.sum(F.col("v")[DIM - 1]), 5).alias(f"s{DIM - 1}"))


@query(f"""WITH {_CELLS}, {_TOKENS}, q AS (SELECT table_id AS q_table_id, set_id AS q_set_id, token FROM tokens WHERE {_ASKED})
SELECT q_table_id, q_set_id, t.table_id, t.set_id, COUNT(*) AS overlap FROM q JOIN tokens t USING (token) WHERE t.table_id <> q_table_id GROUP BY ALL""")
def w5_token_overlaps(spark, sf_dir):
    cols = table(spark, sf_dir, "raw_tables").where("table_id is not null").select("table_id", F.posexplode("relation").alias("set_id", "cells"))
    cell = cols.select("table_id", "set_id", F.explode(F.array_distinct("cells")).alias("cell"))
    return D.token_overlaps(cell.where(X.keeps_cell(F.col("cell"))).select("table_id", "set_id", X.normalise(F.col("cell")).alias("token")), _ASKED)


_KEYWORDS = "price of grain water level"


def keyword_tables(spark, sf_dir):
    """The tables nearest to a keyword query over hash-embedded cells."""
    keys = ["table_id", "set_id"]
    lake = D.hash_embedder(keys, DIM)(tokens(spark, sf_dir))
    return D.discover_by_keywords(sources.keyword_cells(spark, _KEYWORDS), lake, D.hash_embedder(keys, DIM), 10, 10)


@query()
def w6_keyword_search(spark, sf_dir):
    return keyword_tables(spark, sf_dir).withColumn("min_distance", F.round("min_distance", 6))


@query(f"""WITH {_CELLS}, {_TOKENS}, q AS (SELECT token FROM tokens WHERE table_id = (SELECT MIN(table_id) FROM tokens WHERE {_ASKED}) AND set_id = 0)
SELECT table_id, set_id, COUNT(*) AS overlap FROM tokens JOIN (SELECT DISTINCT token FROM q) USING (token)
WHERE table_id <> (SELECT MIN(table_id) FROM tokens WHERE {_ASKED}) GROUP BY table_id, set_id ORDER BY overlap DESC, table_id, set_id LIMIT 10""")
def discover_exact_column(spark, sf_dir):
    everything = tokens(spark, sf_dir)
    first = everything.where(_ASKED).agg(F.min("table_id").alias("q"))
    asked = everything.join(first, F.col("table_id") == F.col("q")).where("set_id = 0").select("q", "token")
    found = everything.join(asked, "token").where("table_id <> q")
    return found.groupBy("table_id", "set_id").agg(F.count("*").alias("overlap")).orderBy(F.desc("overlap"), "table_id", "set_id").limit(10)


@query("SELECT DISTINCT doc_id, UNNEST(STRING_SPLIT(title, ' ')) AS token FROM documents WHERE title IS NOT NULL")
def s14_keyword_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("title is not null").select("doc_id", F.explode(X.keywords(F.col("title"))).alias("token")).distinct()




@query(f"WITH {_CELLS}, {_TOKENS}, c AS (SELECT DISTINCT table_id, set_id FROM cols), k AS (SELECT table_id, set_id, COUNT(*) AS n FROM tokens GROUP BY table_id, set_id) SELECT table_id, set_id, COALESCE(n, 0) > 0 AS is_text FROM c LEFT JOIN k USING (table_id, set_id)")
def f11_text_columns(spark, sf_dir):
    """Which columns can be asked for: the others are what ``require_text`` refuses."""
    raw = table(spark, sf_dir, "raw_tables").where("table_id is not null and relation is not null").select("table_id", F.posexplode("relation").alias("set_id", "cells"))
    kept = tokens(spark, sf_dir).select("table_id", "set_id").distinct().withColumn("is_text", F.lit(True))
    return raw.select("table_id", "set_id").distinct().join(kept, ["table_id", "set_id"], "left").withColumn("is_text", F.coalesce("is_text", F.lit(False)))


@query(rf"""WITH {_CELLS}, {_TOKENS}, g AS (SELECT table_id, set_id, token, SUBSTR('<' || token || '>', CAST(UNNEST(RANGE(1, GREATEST(2, LENGTH(token) + 1))) AS INT), 3) AS word FROM tokens),
w AS (SELECT DISTINCT word FROM g), lex AS (SELECT word, LIST_TRANSFORM(RANGE({DIM}), lambda i: ('0x' || SUBSTR(MD5(word || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 2 - 1) AS vec FROM w),
v AS (SELECT table_id, set_id, token, AVG(vec[1]) AS v0, AVG(vec[{DIM}]) AS v15 FROM g JOIN lex USING (word) GROUP BY table_id, set_id, token)
SELECT table_id, set_id, COUNT(*) AS n, ROUND(SUM(v0), 5) AS s0, ROUND(SUM(v15), 5) AS s15 FROM v GROUP BY table_id, set_id""")
def a9b_token_vectors(spark, sf_dir):
    """Columns embedded by whole tokens, from their n-grams."""
    keys = ["table_id", "set_id"]
    v = D.subword_embedder(keys, DIM)(tokens(spark, sf_dir))
    return v.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum(F.col("v")[0]), 5).alias("s0"), F.round(F.sum(F.col("v")[DIM - 1]), 5).alias("s15"))


@query(SQL["discover_exact_column"])
def discover_joinable_columns(spark, sf_dir):
    """From an uploaded column to ranked columns by ``discover_by_column``: clean, embed, join exactly, rank."""
    keys = ["table_id", "set_id"]
    everything = tokens(spark, sf_dir)
    first = everything.where(_ASKED).agg(F.min("table_id")).first()[0]
    upload = cells(spark, sf_dir).where((F.col("table_id") == first) & (F.col("set_id") == 0)).select(F.col("table_id").alias("q_table_id"), "cell")
    embed = D.subword_embedder(keys, DIM)
    rounded = lambda df: embed(df).withColumn("v", F.transform("v", lambda x: F.round(x, 12)))  # noqa: E731  sums of any order agree
    return D.discover_by_column(upload, rounded(everything), rounded, 10, 10, exact=True).select(*keys, "overlap")

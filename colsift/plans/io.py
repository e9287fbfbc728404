"""Queries of sources and sinks: each writes into the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsift.functions import text as X
from colsift.functions.distance import usable
from colsift.operators import blocks, knn
from colsift.plans.data import BLOCKS, DIM, ENDS, LAKE, corpus, knn_sql, lake, pairs_sql, uploads
from colsift.plans.index import placed
from colsift.plans.search import matches, query
from colsift.plans.text import _CELLS, _TOKENS, tokens
from colsift.runtime import shared_path, table
from colsift.sources import results, text, vectors_bin
from colsift.streaming import ingest

_ORDINAL = f"""{LAKE}, o AS (SELECT table_id, DENSE_RANK() OVER (PARTITION BY table_id ORDER BY set_id) - 1 AS set_id, ROW_NUMBER() OVER (PARTITION BY table_id, set_id ORDER BY pos) - 1 AS pos, v FROM lake)"""


def _written(spark, sf_dir):
    path = shared_path(spark, "lake")
    done = vectors_bin.write_vectors(lake(spark, sf_dir), path, DIM)
    done.agg(F.sum("bytes")).first()
    return path


@query(f"WITH {_ORDINAL} SELECT table_id, CAST(set_id AS INT) AS set_id, CAST(pos AS INT) AS pos, ROUND(LIST_SUM(v), 6) AS total FROM o")
def s1_vector_files(spark, sf_dir):
    back = vectors_bin.read_vectors(spark, _written(spark, sf_dir), DIM)
    return back.select("table_id", "set_id", "pos", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query(f"WITH {_ORDINAL} SELECT table_id, COUNT(*) AS n FROM o WHERE table_id IN (SELECT DISTINCT table_id FROM o ORDER BY table_id LIMIT 5) GROUP BY table_id")
def s5_first_tables(spark, sf_dir):
    back = vectors_bin.read_vectors(spark, _written(spark, sf_dir), DIM, n_tables=5)
    return back.groupBy("table_id").agg(F.count("*").alias("n"))


@query(f"""WITH {LAKE}, s AS (SELECT table_id, set_id, COUNT(*) AS n FROM lake GROUP BY table_id, set_id)
SELECT CAST(SUM(n) AS BIGINT) AS vectors, COUNT(*) AS columns, COUNT(DISTINCT table_id) AS tables, CAST(SUM(4 + n * {4 * DIM}) AS BIGINT) AS bytes, CAST(ROUND(SUM(4 + n * {4 * DIM}) / 1073741824) AS BIGINT) AS gb FROM s""")
def s7_lake_cardinality(spark, sf_dir):
    return vectors_bin.lake_cardinality(vectors_bin.lake_files(spark, _written(spark, sf_dir)))


_NAME = r"data_size(\d+)_t(\d+)c(\d+)_len(\d+)_noznorm"


@query(f"""SELECT DISTINCT raw_data_file, {", ".join(f"CAST(REGEXP_EXTRACT(raw_data_file, '{_NAME}', {i}) AS INT) AS {c}" for i, c in enumerate(("n_vectors", "table_id", "n_cols", "dim"), 1))} FROM cell_vectors WHERE raw_data_file IS NOT NULL""")
def s3_file_names(spark, sf_dir):
    names = table(spark, sf_dir, "cell_vectors").where("raw_data_file is not null").select("raw_data_file").distinct()
    return names.select("raw_data_file", *X.parse_file_name(F.col("raw_data_file")))


@query(f"SELECT table_id, COUNT(*) AS vectors, COUNT(*) FILTER (vec_values IS NULL OR LEN(vec_values) <> {DIM}) AS wrong FROM cell_vectors GROUP BY table_id")
def s6_dimension_report(spark, sf_dir):
    wrong = F.coalesce(F.size("vec_values") != DIM, F.lit(True))
    return table(spark, sf_dir, "cell_vectors").groupBy("table_id").agg(F.count("*").alias("vectors"), F.count_if(wrong).alias("wrong"))


@query(f"""SELECT COUNT(*) AS vectors, COUNT(*) FILTER (vec_values IS NOT NULL AND LEN(vec_values) = {DIM} AND LEN(LIST_FILTER(vec_values, lambda x: x IS NULL OR ISNAN(x))) = 0 AND LEN(LIST_FILTER(vec_values, lambda x: x <> 0)) > 0) AS usable FROM cell_vectors""")
def f8_usable_vectors(spark, sf_dir):
    return table(spark, sf_dir, "cell_vectors").agg(F.count("*").alias("vectors"), F.count_if(usable(F.col("vec_values"), DIM)).alias("usable"))


@query("SELECT vec_id, ROUND(LIST_SUM(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings")
def s10_ascii_vectors(spark, sf_dir):
    path = shared_path(spark, "ascii")
    df = table(spark, sf_dir, "embeddings").select(F.concat_ws(" ", F.col("vec_id").cast("string"), F.transform("embedding", lambda x: x.cast("string"))))
    df.write.text(path)
    back = vectors_bin.read_ascii(spark, path)
    return back.select(F.col("v")[0].cast("long").alias("vec_id"), F.round(F.aggregate(F.slice("v", 2, 64), F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query("SELECT CAST(label AS INT) AS file, CAST(ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS pos, label, ROUND(LIST_SUM(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings")
def s11_labelled_vectors(spark, sf_dir):
    """Flat files, one a label, with their twins of labels: the format is a whole file, so one task writes each."""
    import numpy as np
    import pandas as pd

    path = shared_path(spark, "flat")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        fs, inside = vectors_bin.open_folder(path)
        for name, raw in (("v", np.stack(pdf["embedding"].to_numpy()).astype("<f4").tobytes()), ("gt", pdf["label"].to_numpy().astype("u1").tobytes())):
            fs.create_dir(f"{inside}/{name}", recursive=True)
            with fs.open_output_stream(f"{inside}/{name}/part{pdf['label'].iloc[0]}.{name}") as out:
                out.write(raw)
        return pd.DataFrame({"n": [len(pdf)]})

    table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").groupBy("label").applyInPandas(write, "n long").count()
    back = vectors_bin.read_labelled(spark, f"{path}/v", f"{path}/gt", 64)
    file = F.regexp_extract("raw_data_file", r"part(\d+)\.v", 1).cast("int")
    return back.select(file.alias("file"), "pos", "label", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query("SELECT n_name AS cell FROM nation")
def s12_upload_column(spark, sf_dir):
    path = shared_path(spark, "upload")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").coalesce(1).write.csv(path, header=True)
    return text.upload_column(spark, path, 2).select("cell")


@query("WITH m AS (SELECT DISTINCT TRIM(tq_q) AS t FROM match_rows WHERE TRIM(tq_q) <> '') SELECT 't' || SPLIT_PART(t, ':', 1) || '.csv' AS name, CAST(SPLIT_PART(t, ':', 1) AS INT) AS q_table_id FROM m UNION ALL SELECT 'upload.csv', 0")
def s13_upload_ids(spark, sf_dir):
    names = table(spark, sf_dir, "match_rows").select(F.trim("tq_q").alias("t")).where("t <> ''").distinct().select(F.concat(F.lit("t"), F.split("t", ":")[0], F.lit(".csv")).alias("name"))
    names = names.unionByName(spark.range(1).select(F.lit("upload.csv").alias("name")))
    return names.select("name", X.upload_table_id(F.col("name")).alias("q_table_id"))


@query("SELECT label AS word, ROUND(AVG(embedding[1]), 5) AS first FROM embeddings GROUP BY label")
def s16_lexicon(spark, sf_dir):
    path = shared_path(spark, "lexicon")
    words = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.avg(F.col("embedding")[0]).alias("x"))
    words.select(F.format_string("%d %.9f %.9f", "label", "x", F.lit(0.5))).write.text(path)
    return text.read_lexicon(spark, path).select(F.col("word").cast("int").alias("word"), F.round(F.col("vec")[0].cast("double"), 5).alias("first"))


@query("""WITH t AS (SELECT DISTINCT table_id, LEN(relation) AS n_cols FROM raw_tables WHERE relation IS NOT NULL), c AS (SELECT n_cols, COUNT(*) AS n_tables FROM t GROUP BY n_cols)
SELECT CAST(n_cols AS INT) AS n_cols, n_tables, CAST(n_cols * n_tables AS BIGINT) AS weighted FROM c""")
def s22_column_counts(spark, sf_dir):
    path = shared_path(spark, "counts")
    shapes = table(spark, sf_dir, "raw_tables").where("relation is not null").dropDuplicates(["table_id"]).groupBy(F.size("relation").alias("n")).count()
    shapes.select(F.format_string("Key : %d Value : %d", "n", "count")).write.text(path)
    return text.read_column_counts(spark, path).withColumn("weighted", F.col("n_cols") * F.col("n_tables"))


@query("SELECT CAST(SUM(LEN(relation)) AS BIGINT) AS total_columns, COUNT(*) AS tables FROM (SELECT DISTINCT table_id, relation FROM raw_tables WHERE relation IS NOT NULL)")
def a7_total_columns(spark, sf_dir):
    """The sum of label x value over a statistics file: all columns of the lake."""
    return s22_column_counts(spark, sf_dir).agg(F.sum("weighted").alias("total_columns"), F.sum("n_tables").alias("tables"))


@query(f"WITH {LAKE}, {pairs_sql()}, {knn_sql()} SELECT q_table_id, q_set_id, q_pos, table_id, set_id, pos, CAST(k AS INT) AS k, CAST(0.5 AS DOUBLE) AS time FROM knn JOIN (SELECT UNNEST([1, 5, 10]) AS k) ON rank <= k")
def k2_results_by_k(spark, sf_dir):
    path = shared_path(spark, "results")
    results.write_results(knn.slices(matches(spark, sf_dir), [1, 5, 10]), path, by_k=True, seconds=0.5)
    return results.read_results(spark, path).select(*knn.QUERY_KEY, "table_id", "set_id", "pos", "k", "time")


@query(f"WITH {LAKE}, {pairs_sql()}, {knn_sql()} SELECT q_table_id, q_set_id, q_pos, table_id, set_id, pos FROM knn")
def s20_result_files(spark, sf_dir):
    path = shared_path(spark, "results")
    results.write_results(matches(spark, sf_dir), path)
    return results.read_results(spark, path).drop("d")


@query("""SELECT DISTINCT CAST(SPLIT_PART(TRIM(tq_q), ':', 1) AS INT) AS q_table_id, CAST(SPLIT_PART(TRIM(tq_q), ':', 2) AS INT) AS q_set_id, k FROM match_rows WHERE TRIM(tq_q) <> ''""")
def s24_run_facts(spark, sf_dir):
    """Facts from result file names, made here from the match log in the form the files have."""
    runs = table(spark, sf_dir, "match_rows").select(F.trim("tq_q").alias("t"), "k").where("t <> ''").distinct()
    parts = F.split("t", ":")
    path = F.format_string("/x/%dnn/tree_l200_10q_min5_max10/TQ%s_Q%s_qsize7_l200_dlsize1_len50_runtime0.25_ndistcalc_dataaccess9.csv", "k", parts[0], parts[1])
    facts = results.run_facts(runs.select(path.alias("path")))
    return facts.select("q_table_id", "q_set_id", F.regexp_extract("path", r"/(\d+)nn/", 1).cast("int").alias("k"))


def _stored(spark, sf_dir):
    path = shared_path(spark, "index")
    at = placed(spark, sf_dir)
    results.write_index(at, blocks.summarise(at, ENDS), path)
    return results.read_index(spark, path)[0].select("block_id", "vec_id")


@query(f"WITH {LAKE}, {BLOCKS} SELECT block_id, vec_id FROM placed WHERE block_id < 8")
def s18_stored_index(spark, sf_dir):
    """Part of the stored index, read through a filter; ``s18_whole_index`` returns all of it."""
    return _stored(spark, sf_dir).where("block_id < 8")


@query(f"WITH {LAKE}, {BLOCKS} SELECT block_id, vec_id FROM placed")
def s18_whole_index(spark, sf_dir):
    return _stored(spark, sf_dir)


@query(f"WITH {LAKE}, {BLOCKS} SELECT block_id, n, ROUND(mx0, 6) AS mx0, ROUND(mn0, 6) AS mn0 FROM syn")
def streaming_ingest(spark, sf_dir):
    """New vectors arrive as a stream of files; the merged synopses equal those of a batch build."""
    path = shared_path(spark, "stream")
    fresh = corpus(spark, sf_dir).select("table_id", "set_id", "pos", F.col("v").alias("vec_values"))
    fresh.repartition(3).write.parquet(f"{path}/in")
    stream = ingest.ingest(spark, f"{path}/in", "table_id int, set_id int, pos int, vec_values array<float>", f"{path}/lake", f"{path}/state", DIM, ENDS, [0.0] * len(ENDS))
    stream.awaitTermination()
    return ingest.summaries(spark, f"{path}/lake", ENDS).select("block_id", "n", F.round(F.col("syn")[0]["mu_max"], 6).alias("mx0"), F.round(F.col("syn")[0]["mu_min"], 6).alias("mn0"))


@query(f"WITH {_CELLS}, {_TOKENS} SELECT table_id, CAST(DENSE_RANK() OVER (PARTITION BY table_id ORDER BY set_id) - 1 AS INT) AS col, COUNT(*) OVER (PARTITION BY table_id, set_id) AS size, token FROM tokens")
def k5_whole_snapshot(spark, sf_dir):
    """Cleaned tables as JSON documents {id, ncols, cols}, one line each, read back; columns without text are left out."""
    path = shared_path(spark, "clean")
    cols = tokens(spark, sf_dir).groupBy("table_id", "set_id").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    docs = cols.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("set_id", "tokens"))).alias("cols"), F.count("*").alias("ncols"))
    docs.select(F.col("table_id").alias("id"), "ncols", F.transform("cols", lambda c: c["tokens"]).alias("cols")).write.json(path)
    back = spark.read.schema("id int, ncols long, cols array<array<string>>").json(path)
    flat = back.select(F.col("id").alias("table_id"), F.posexplode("cols").alias("col", "tokens"))
    return flat.select("table_id", "col", F.size("tokens").cast("long").alias("size"), F.explode("tokens").alias("token"))


@query("SELECT k, n FROM (SELECT k, COUNT(*) AS n FROM match_rows GROUP BY k) CROSS JOIN (SELECT UNNEST([1, 2]))")
def k7_metrics_append(spark, sf_dir):
    path = shared_path(spark, "metrics")
    rows = table(spark, sf_dir, "match_rows").groupBy("k").agg(F.count("*").alias("n"))
    for _ in range(2):
        results.append_metrics(rows, path)
    return spark.read.csv(path, header=True, schema="k int, n long")


@query("""WITH d AS (SELECT CAST(FLOOR(distance * 4) AS INT) AS bin FROM query_results WHERE distance IS NOT NULL AND NOT ISNAN(distance) AND distance BETWEEN 0 AND 100),
c AS (SELECT bin, COUNT(*) AS n FROM d GROUP BY bin) SELECT (bin + 1) / 4.0::DOUBLE AS x, ROUND(SUM(n) OVER (ORDER BY bin) / SUM(n) OVER (), 9) AS y FROM c""")
def s21_distance_histogram(spark, sf_dir):
    """A cumulative distance histogram, written in its file form and read back; at most 401 bins."""
    from pyspark.sql import Window

    path = shared_path(spark, "hist")
    d = table(spark, sf_dir, "query_results").where("distance between 0 and 100 and not isnan(distance)")
    bins = d.groupBy(F.floor(F.col("distance") * 4).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(F.lit(1)).orderBy("bin")
    share = F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy(F.lit(1)))
    pairs = bins.select("bin", F.format_string("%s %s", ((F.col("bin") + 1) / 4).cast("string"), F.round(share, 9).cast("string")).alias("p"))
    one = pairs.agg(F.sort_array(F.collect_list(F.struct("bin", "p"))).alias("s"))
    one.select(F.concat_ws("\n", F.size("s").cast("string"), F.transform("s", lambda x: x["p"])).alias("value")).coalesce(1).write.text(path)
    return text.read_histogram(spark, path).select("x", F.round("y", 9).alias("y"))


@query(f"""WITH {LAKE}, {pairs_sql()}, {knn_sql()}, s AS (SELECT COUNT(*) AS q_size FROM lake WHERE table_id = 0), t AS (SELECT COUNT(DISTINCT table_id) AS n_tables FROM lake WHERE table_id <> 0), v AS (SELECT COUNT(*) AS vectors FROM lake WHERE table_id <> 0)
SELECT k, CAST(COUNT(*) AS BIGINT) AS rows, 'scan' AS algorithm, CAST(ANY_VALUE(q_size) AS BIGINT) AS q_size, CAST(ANY_VALUE(n_tables) AS BIGINT) AS n_tables, {DIM} AS dim, CAST(ANY_VALUE(q_size) * ANY_VALUE(vectors) AS BIGINT) AS distances
FROM knn JOIN (SELECT CAST(UNNEST([1, 10]) AS INT) AS k) ON rank <= k, s, t, v GROUP BY k""")
def k3_run_log(spark, sf_dir):
    """Runs with their settings and sizes as a table, in place of facts in file names."""
    lake_ = corpus(spark, sf_dir).agg(F.count("*").alias("vectors"), F.countDistinct("table_id").alias("n_tables")).first()
    q_size = uploads(spark, sf_dir).count()
    runs = knn.slices(matches(spark, sf_dir), [1, 10]).groupBy("k").agg(F.count("*").alias("rows"))
    return results.run_log(runs, algorithm="scan", q_size=q_size, n_tables=lake_["n_tables"], dim=DIM, distances=q_size * lake_["vectors"])


@query("""SELECT DISTINCT CAST(SPLIT_PART(TRIM(tq_q), ':', 1) AS INT) AS q_table_id, CAST(SPLIT_PART(TRIM(tq_q), ':', 2) AS INT) AS q_set_id, k, 'tree' AS algorithm, 0.25::DOUBLE AS seconds, 9 AS data_access FROM match_rows WHERE TRIM(tq_q) <> ''""")
def s24_walked_directory(spark, sf_dir):
    """Experiment directories are made from the match log, walked, and their names read."""
    path = shared_path(spark, "runs")
    runs = table(spark, sf_dir, "match_rows").select(F.trim("tq_q").alias("t"), "k").where("t <> ''").distinct()

    def touch(pdfs):
        for pdf in pdfs:
            for t, k in zip(pdf["t"], pdf["k"]):
                fs, inside = vectors_bin.open_folder(path)
                folder = f"{inside}/{k}nn/tree_l200_10q_min5_max10"
                fs.create_dir(folder, recursive=True)
                with fs.open_output_stream(f"{folder}/TQ{t.split(':')[0]}_Q{t.split(':')[1]}_qsize7_l200_dlsize1_len50_runtime0.25_ndistcalc_dataaccess9.csv") as out:
                    out.write(b"TQ:Q\n")
            yield pdf

    runs.mapInPandas(touch, "t string, k int").count()
    facts = results.walk_runs(spark, path)
    return facts.select("q_table_id", "q_set_id", F.regexp_extract("path", r"/(\d+)nn/", 1).cast("int").alias("k"), "algorithm", "seconds", F.col("data_access").cast("int").alias("data_access"))


@query("""SELECT table_id, CAST(LEN(ANY_VALUE(relation)) AS INT) AS n_cols, COALESCE(ANY_VALUE(has_header), FALSE) AS has_header, ANY_VALUE(title) AS title
FROM raw_tables WHERE relation IS NOT NULL AND table_id IS NOT NULL GROUP BY table_id""")
def s15_raw_table_files(spark, sf_dir):
    """Raw tables written as JSON documents, one a file, and read back."""
    path = shared_path(spark, "raw")
    raw = table(spark, sf_dir, "raw_tables").where("relation is not null and table_id is not null").dropDuplicates(["table_id"])
    names = {"has_header": "hasHeader", "header_position": "headerPosition", "page_title": "pageTitle", "text_before_table": "textBeforeTable", "text_after_table": "textAfterTable", "last_modified": "lastModified"}
    doc = F.to_json(F.struct("relation", *[F.col(c).alias(n) for c, n in names.items()], "title", "url"))

    def write(pdfs):
        for pdf in pdfs:
            fs, inside = vectors_bin.open_folder(path)
            fs.create_dir(inside, recursive=True)
            for table_id, text_ in zip(pdf["table_id"], pdf["doc"]):
                with fs.open_output_stream(f"{inside}/t{table_id}_c1.json") as out:
                    out.write(text_.encode())
            yield pdf[["table_id"]]

    raw.select("table_id", doc.alias("doc")).mapInPandas(write, "table_id int").count()
    back = text.read_raw_tables(spark, path)
    number = F.regexp_extract("raw_data_file", r"t(\d+)_c", 1).cast("int")
    return back.select(number.alias("table_id"), F.size("relation").alias("n_cols"), F.coalesce("has_header", F.lit(False)).alias("has_header"), "title")


@query("""WITH d AS (SELECT CAST(FLOOR(distance * 4) AS INT) AS bin FROM query_results WHERE distance IS NOT NULL AND NOT ISNAN(distance) AND distance BETWEEN 0 AND 100),
c AS (SELECT bin, COUNT(*) AS n FROM d GROUP BY bin), h AS (SELECT (bin + 1) / 4.0::DOUBLE AS x, ROUND(SUM(n) OVER (ORDER BY bin) / SUM(n) OVER (), 9) AS y FROM c), q AS (SELECT UNNEST([0.25, 0.5, 0.75, 0.95])::DOUBLE AS delta),
lo AS (SELECT delta, MAX(y) AS y0 FROM q JOIN h ON y < delta GROUP BY delta), hi AS (SELECT delta, MIN(y) AS y1 FROM q JOIN h ON y >= delta GROUP BY delta)
SELECT delta, ROUND(a.x + (b.x - a.x) * (delta - y0) / (y1 - y0), 6) AS radius FROM lo JOIN hi USING (delta)
JOIN (SELECT y, MAX(x) AS x FROM h GROUP BY y) a ON a.y = y0 JOIN (SELECT y, MIN(x) AS x FROM h GROUP BY y) b ON b.y = y1""")
def x19_radius_at(spark, sf_dir):
    """Radii below which shares of the logged distances lie, by interpolation on the histogram (at most 401 bins)."""
    histogram = s21_distance_histogram(spark, sf_dir)
    found = [(d, text.radius_at(histogram, d)) for d in (0.25, 0.5, 0.75, 0.95)]
    return spark.createDataFrame([x for x in found if x[1] is not None], "delta double, radius double").withColumn("radius", F.round("radius", 6))


@query(f"""SELECT table_id, COUNT(*) FILTER (vec_values IS NULL OR LEN(vec_values) <> {DIM}) = 0 AS accepted FROM cell_vectors GROUP BY table_id""")
def s6_rejected_tables(spark, sf_dir):
    """Which tables the dimension check lets in: a file that declares another dimension raises."""
    rows = table(spark, sf_dir, "cell_vectors").groupBy("table_id").agg(F.max(F.coalesce(F.size("vec_values") != DIM, F.lit(True))).alias("bad"))
    return rows.select("table_id", (~F.col("bad")).alias("accepted"))

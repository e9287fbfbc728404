import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from colsift.operators import blocks
from colsift.sources import results, text, vectors_bin
from colsift.streaming import ingest


def test_vector_files(spark, tmp_path):
    cols = [np.array([[1, 2], [3, 4]]), np.zeros((0, 2)), np.array([[0.5, -1]])]
    (tmp_path / "data_size3_t7c3_len2_noznorm.bin").write_bytes(vectors_bin.encode_columns(cols))
    (tmp_path / "data_size1_t3c1_len2_noznorm.bin").write_bytes(vectors_bin.encode_columns([np.array([[9, 9]])]))
    (tmp_path / "notes.txt").write_text("x")
    got = sorted((r.table_id, r.set_id, r.pos, list(r.v)) for r in vectors_bin.read_vectors(spark, str(tmp_path), 2).collect())
    assert got == [(3, 0, 0, [9.0, 9.0]), (7, 0, 0, [1.0, 2.0]), (7, 0, 1, [3.0, 4.0]), (7, 2, 0, [0.5, -1.0])]
    assert {r.table_id for r in vectors_bin.read_vectors(spark, str(tmp_path), 2, n_tables=1).collect()} == {3}
    assert tuple(vectors_bin.lake_cardinality(vectors_bin.lake_files(spark, str(tmp_path))).first())[:3] == (4, 4, 2)
    with pytest.raises(ValueError):
        vectors_bin.read_vectors(spark, str(tmp_path), 3)


def test_broken_vector_file():
    with pytest.raises(ValueError):
        list(vectors_bin.decode_columns(np.uint32(5).tobytes() + b"\0" * 8, 2))


def test_flat_labelled_and_ascii(spark, tmp_path):
    m = np.arange(6, dtype="<f4").reshape(3, 2)
    for name, raw in (("v", m.tobytes()), ("gt", bytes([1, 0, 255]))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x").write_bytes(raw)
    got = sorted((r.pos, r.label, list(r.v)) for r in vectors_bin.read_labelled(spark, str(tmp_path / "v"), str(tmp_path / "gt"), 2).collect())
    assert got == [(0, 1, [0.0, 1.0]), (1, 0, [2.0, 3.0]), (2, 255, [4.0, 5.0])]
    (tmp_path / "a.txt").write_text("1 2.5\n\n -3  4 \n")
    assert [list(r.v) for r in vectors_bin.read_ascii(spark, str(tmp_path / "a.txt")).collect()] == [[1.0, 2.5], [-3.0, 4.0]]


def test_uploads_and_keywords(spark, tmp_path):
    (tmp_path / "t12.csv").write_text('a,b\n1,"x, y"\n2,z\n')
    assert [tuple(r) for r in text.upload_column(spark, str(tmp_path / "t12.csv"), 2).collect()] == [(12, "x, y"), (12, "z")]
    with pytest.raises(ValueError):
        text.upload_column(spark, str(tmp_path / "t12.csv"), 3)
    assert [r.cell for r in text.keyword_cells(spark, "a  b").collect()] == ["a", "", "b"]


def test_raw_tables(spark, tmp_path):
    raw = {"relation": [["h1", "a", "b"], ["h2", "c"]], "hasHeader": True, "headerPosition": "FIRST_ROW", "pageTitle": "P", "url": "u"}
    (tmp_path / "t1_c2.json").write_text(json.dumps(raw))
    df = text.read_raw_tables(spark, str(tmp_path)).withColumn("table_id", F.lit(1))
    assert [tuple(r) for r in text.table_shapes(df).collect()] == [(1, 2, 3, ["h1", "h2"])]
    assert [(r.row_no, r.cells) for r in text.table_rows(df).orderBy("row_no").collect()] == [(0, ["a", "c"]), (1, ["b", None])]


def test_lexicon_counts_histogram(spark, tmp_path):
    (tmp_path / "g.txt").write_text("the 0.5 1\nnan_word nan 1\n")
    assert [(r.word, list(r.vec)) for r in text.read_lexicon(spark, str(tmp_path / "g.txt")).collect()] == [("the", [0.5, 1.0])]
    (tmp_path / "s.txt").write_text("Key : 3 Value : 7\nother\n")
    assert [tuple(r) for r in text.read_column_counts(spark, str(tmp_path / "s.txt")).collect()] == [(3, 7)]
    (tmp_path / "h.txt").write_text("3\n1 0.2\n2 0.6\n4 1.0\n")
    hist = text.read_histogram(spark, str(tmp_path / "h.txt"))
    assert [tuple(r) for r in hist.collect()] == [(1.0, 0.2), (2.0, 0.6), (4.0, 1.0)]
    assert text.radius_at(hist, 0.8) == pytest.approx(3.0) and text.radius_at(hist, 0.1) is None


def test_result_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("TQ:Q, TS:S, qindex, sindex, q, s, d\n4:1, 5:0, 2, 3, [], [], 0.250\n")
    assert [tuple(r) for r in results.read_results(spark, str(tmp_path / "r.csv")).collect()] == [(4, 1, 2, 5, 0, 3, 0.25)]
    name = "/r/10nn/bf_l200_10q_min5_max9/TQ4_Q1_qsize6_l200_dlsize1_len50_runtime0.362_ndistcalc_dataaccess61458.csv"
    facts = results.run_facts(spark.createDataFrame([(name,), ("/x/y/z.csv",)], "path string")).collect()
    assert [tuple(r)[1:] for r in facts] == [("bf", 4, 1, 6, 200, 1, 50, 0.362, 61458)]


def test_index_is_not_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0, [1.0, 2.0])], "table_id int, set_id int, pos int, v array<float>")
    placed = blocks.with_stats(df, [1, 2]).withColumn("block_id", F.lit(5).cast("long"))
    results.write_index(placed, blocks.summarise(placed, [1, 2]), str(tmp_path / "i"))
    vectors, syn = results.read_index(spark, str(tmp_path / "i"))
    assert vectors.where("block_id = 5").count() == 1 and syn.first().n == 1
    with pytest.raises(Exception, match="(?i)already exists"):
        results.write_index(placed, blocks.summarise(placed, [1, 2]), str(tmp_path / "i"))


def test_streamed_synopses_equal_a_batch_build(spark, tmp_path):
    ends, cuts = [2, 4], [0.0, 0.0]
    rng = np.random.default_rng(3)
    rows = [(i, 0, 0, [float(x) for x in rng.normal(size=4)]) for i in range(40)] + [(99, 0, 0, [0.0] * 4), (98, 0, 0, None)]
    df = spark.createDataFrame(rows, "table_id int, set_id int, pos int, vec_values array<float>")
    schema = "table_id int, set_id int, pos int, vec_values array<float>"
    for part in (df.where("table_id < 20"), df.where("table_id >= 20")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "lake"), str(tmp_path / "state"), 4, ends, cuts).awaitTermination()
    streamed = {r.block_id: (r.n, r.syn) for r in ingest.summaries(spark, str(tmp_path / "lake"), ends).collect()}
    whole = ingest.place(df.where("table_id < 90").select("table_id", "set_id", "pos", F.col("vec_values").alias("v")), ends, cuts)
    assert streamed == {r.block_id: (r.n, r.syn) for r in blocks.summarise(whole, ends).collect()}

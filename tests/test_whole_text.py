"""Queries over all words, cells, tables and blocks, against brute force on a fixture."""

import hashlib

import pytest

from colsift.plans import io, text

CELLS = ["Straße", "ÉCOLE 12", "Ωmega", "你好", "plain", "B2B x", "été", "PLAIN"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(t, [CELLS, [c + " q" for c in CELLS]]) for t in (3, 20, 41)], "table_id int, relation array<array<string>>").write.parquet(f"{path}/raw_tables.parquet")
    return path


def _vector(word):
    return [int(hashlib.md5(f"{word}:{i}".encode()).hexdigest()[:8], 16) / 2**32 * 2 - 1 for i in range(text.DIM)]


def test_all_words_and_cells(spark, tables):
    words = {w for c in CELLS for w in c.lower().split(" ")} | {"q"}
    got = {r.word: (r.first, r.total) for r in text.j11_whole_lexicon(spark, tables).collect()}
    assert got == {w: (pytest.approx(_vector(w)[0], abs=1e-6), pytest.approx(sum(_vector(w)), abs=2e-6)) for w in words}
    cells = {c for c in CELLS} | {c + " q" for c in CELLS}
    assert {(r.cell, r.lowered) for r in text.x16_all_lowered(spark, tables).collect()} == {(c, c.lower()) for c in cells}


def test_all_tables(spark, tables):
    tokens = [{c.lower() for c in CELLS}, {c.lower() + " q" for c in CELLS}]
    got = {(r.table_id, r.col, r.token) for r in io.k5_whole_snapshot(spark, tables).collect()}
    assert got == {(t, s, c) for t in (3, 20, 41) for s in (0, 1) for c in tokens[s]}
    got = {(r.table_id, r.set_id): (r.n, r.s0) for r in text.a9_all_cell_vectors(spark, tables).collect()}
    unit = lambda w: _vector(w)[0] / sum(x * x for x in _vector(w)) ** 0.5
    s0 = [sum(sum(map(unit, c.split(" "))) / len(c.split(" ")) for c in tokens[s]) for s in (0, 1)]
    assert got == {(t, s): (len(tokens[s]), pytest.approx(s0[s], abs=2e-5)) for t in (3, 20, 41) for s in (0, 1)}


def test_all_blocks_of_the_stored_index(spark, tmp_path):
    signs = [[1.0 if b >> i & 1 else -1.0 for i in range(5)] for b in range(32)]
    rows = [(b, 1, 0, b, [x for x in signs[b] for _ in range(10)]) for b in range(32)]
    spark.createDataFrame(rows, "vec_id long, table_id int, set_id int, pos int, vec_values array<float>").write.parquet(f"{tmp_path}/cell_vectors.parquet")
    assert sorted(tuple(r) for r in io.s18_whole_index(spark, str(tmp_path)).collect()) == [(b, b) for b in range(32)]

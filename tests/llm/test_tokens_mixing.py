import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colsift.llm import mixing, tokens

tiktoken = pytest.importorskip("tiktoken")
RANKS = tokens.load_ranks(f"{tokens.TOKENIZER_DIR}/{tokens.RANK_FILE}")
ORACLE = tiktoken.Encoding("own", pat_str=tokens.SPLIT_PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_the_library(text):
    assert tokens.PieceEncoder(RANKS).encode(text) == ORACLE.encode_ordinary(text)


def test_long_piece_of_one_letter_run():
    text = "".join(random.Random(1).choice("abcde") for _ in range(20_000))
    assert tokens.PieceEncoder(RANKS).encode(text) == ORACLE.encode_ordinary(text)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    enc = tokens.PieceEncoder(RANKS)
    text = "qwxz vbnk plmt rtgh yjuk wsxq"
    assert enc.encode(text) == ORACLE.encode_ordinary(text) and len(enc.cache) <= 3


def test_corpus_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Grüße, 世界 <|endoftext|>", "x"), (3, "Grüße, 世界 <|endoftext|>", "x"), (None, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in tokens.encode_corpus(df).collect()), key=str)
    want = sorted(((i, ORACLE.encode_ordinary(t) if t else []) for i, t, _ in rows), key=str)
    assert got == want
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_count_replaces_a_clashing_column(spark):
    df = spark.createDataFrame([(1, "a b", 99), (2, None, 99)], "doc_id long, text string, n_tokens int")
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()} == {1: 2, 2: 0}


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def test_mix_reaches_shares_and_repeats(spark):
    rng = random.Random(2)
    rows = [(i, "big" if i % 3 else "small", rng.randint(1, 50)) for i in range(3000)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("gone", 0.2, 1)], "source string, target_share double, max_repeats int")
    docs = _docs(spark, rows + rows[:5] + [(9999, None, 10), (9998, "other", 10), (9997, "big", 0)])
    mix = mixing.mix_sources(docs, targets, bucket_records=100).collect()
    size = {s: sum(n for _, x, n in rows if x == s) for s in ("big", "small")}
    used = {s: sum(r.n_tokens for r in mix if r.source == s) for s in ("big", "small")}
    total = min(size["big"] / 0.5, size["small"] * 3 / 0.5)
    for s in used:
        assert 0 <= total * 0.5 - used[s] < 51
    uses = {}
    for r in mix:
        uses.setdefault((r.source, r.doc_id), set()).add(r.epoch)
    assert max(len(e) for (s, _), e in uses.items() if s == "big") == 1
    assert max(len(e) for (s, _), e in uses.items() if s == "small") <= 3
    assert len(mix) == sum(map(len, uses.values())), "a record occurs once an epoch"
    # Before a record is repeated in the last epoch, all are used in the earlier ones.
    small = [e for (s, _), e in uses.items() if s == "small"]
    assert max(map(len, small)) - min(map(len, small)) <= 1


def test_mix_does_not_depend_on_buckets_and_reports(spark):
    rows = [(i, "a" if i % 2 else "b", 1 + i % 7) for i in range(500)]
    targets = spark.createDataFrame([("a", 0.25, 2), ("b", 0.75, 2), ("c", 0.1, 1)], "source string, target_share double, max_repeats int")
    one = {tuple(r) for r in mixing.mix_sources(_docs(spark, rows), targets).collect()}
    many = {tuple(r) for r in mixing.mix_sources(_docs(spark, rows), targets, bucket_records=10).collect()}
    assert one == many
    report = {r.source: r for r in mixing.mix_report(_docs(spark, rows), targets, total_tokens=100).collect()}
    assert report["c"].used_tokens == 0 and abs(report["a"].actual_share - 0.25) < 0.08
    assert report["a"].used_tokens <= report["a"].budget == 25


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    assert mixing.mix_sources(_docs(spark, []), targets).count() == 0
    assert mixing.mix_sources(_docs(spark, [(1, "a", 5)]), targets).count() == 0

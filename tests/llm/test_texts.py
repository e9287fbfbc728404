import math
import random

import numpy as np
import pyarrow as pa
import pytest

from colsift.llm import boilerplate, language, sentences, skeleton

# ---- skeletons


def test_skeleton_of_look_alikes():
    for text in ["Ｄｅｎ Ｌｏ", "Dеn Lо", "D​en Lo", "﻿Den Lo "]:
        assert skeleton.skeleton(text) == skeleton.skeleton("Den Lo")
    assert skeleton.skeleton("Tür") == skeleton.skeleton("Tür") == skeleton.skeleton("Tu‍̈r")
    assert skeleton.skeleton("oﬃce") == "office"
    for a, b in (x.split() for x in ["ϲat cat", "Ϲat Cat", "ıpe ipe", "ɪpe ipe", "ꓮꓳ AO", "ᗅx Ax", "𐊠x Ax", "ᴏne one", "x´s x's", "ꞌx 'x", "ǃx !x", "Іane lane", "lane Iane", "rnore more", "1O l0", "″x ”x"]):
        assert skeleton.skeleton(a) == skeleton.skeleton(b), (a, b)
    assert skeleton.skeleton(None) is None and skeleton.skeleton(" 　") == ""


def test_visible_differences_stay():
    plain = skeleton.skeleton("Dento Lo")
    for other in ["dento Lo", "Dentó Lo", "Dentö Lo", "Dento Lo x", "Denro Lo", "Dento  Lo"]:
        assert skeleton.skeleton(other) != plain


def test_skeleton_is_its_own_form():
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(chr(rng.choice([rng.randint(32, 0x24F), rng.randint(0x370, 0x4FF), rng.randint(0xFF01, 0xFF5E), rng.randint(0x2000, 0x206F)])) for _ in range(8))
        once = skeleton.skeleton(text)
        assert skeleton.skeleton(once) == once


def test_cells_that_look_like_labels(spark):
    rows = [(1, [["Den Lo", "Dеn Lo", None, ""], ["den Lo"]]), (1, [["Den Lo", "Dеn Lo", None, ""], ["den Lo"]]), (2, None), (None, [["Dеn Lo"]])]
    raw = spark.createDataFrame(rows, "table_id int, relation array<array<string>>")
    refs = spark.createDataFrame([(7, "Den Lo"), (7, "Den Lo"), (8, None), (9, " ")], "item_id int, label string")
    got = [tuple(r)[:4] for r in skeleton.look_alike_cells(raw, refs).collect()]
    assert got == [(1, 0, 1, 7)]
    groups = {r.skeleton: (r.n_forms, r.n_cells) for r in skeleton.same_looking(spark.createDataFrame([("a",), ("а",), ("a",), (None,)], "cell string")).collect()}
    assert groups == {"a": (2, 3), None: (1, 1)}
    assert skeleton.look_alike_cells(raw.limit(0), refs).count() == 0


# ---- sentences

_EN = ["The clerk kept the list.", "Nobody saw Dr. Miller near the mill.", "It cost 3.50 dollars at 4 p.m. on Monday.", "Why did the train stop?", '"Is it open?" asked the guard.', "He wrote: \"The bridge is old.\"", "We met Dr. Smith again.", "The old road ends here.", "They left the house."]


def _corpus(spark, n=120, lower=False):
    rng = random.Random(6)
    rows, truth = [], {}
    for i in range(n):
        text, spans = "", []
        for p in range(4):
            for s in rng.sample(_EN, 3):
                s = s[0].lower() + s[1:] if lower else s
                spans.append((len(text), len(text) + len(s)))
                text += s + " "
            text = text[:-1] + rng.choice(["\n\n", "\r\n\r\n", "\n \n"])
        rows.append((i, text))
        truth[i] = spans
    return spark.createDataFrame(rows, "doc_id long, text string"), truth


def test_sentences_of_prose(spark):
    df, truth = _corpus(spark)
    got = {}
    for r in sentences.split_documents(df).collect():
        got.setdefault(r.doc_id, set()).add((r.start_at, r.end_at))
    hit = sum(len(got[i] & set(t)) for i, t in truth.items())
    assert hit / sum(map(len, truth.values())) > 0.97 and hit / sum(map(len, got.values())) > 0.97


@pytest.fixture(scope="module")
def model(spark):
    return sentences.local_model(_corpus(spark)[0])


def _units(text, model):
    return [text[a:b] for a, b in sentences.split(text, *model)]


def test_code_lists_and_lines(model):
    text = "Look here:\n\n```\nx = 1. Then.\n```\n\n1. The first entry\n2. The second entry\n\n    indented code. Here.\n\nThe clerk kept\nthe list. The old road ends here.\n\n<pre><code>a. B.\n</code></pre>\n\nThanks!"
    assert _units(text, model) == ["Look here:", "1. The first entry", "2. The second entry", "The clerk kept\nthe list.", "The old road ends here.", "Thanks!"]


def test_scripts_without_blanks_or_marks(model):
    assert _units("他说：“水很深。”桥很旧。为什么？", model) == ["他说：“水很深。”", "桥很旧。", "为什么？"]
    assert _units("गाड़ी आई। वह गया।", model) == ["गाड़ी आई।", "वह गया।"]
    assert len(_units("ครูเก่าคนหนึ่งนับชื่อ 9 ครั้งหลังน้ำท่วม สมาคมของเราแสดงราคาข้าว", model)) == 2


def test_addresses_and_numbers_are_not_split(model):
    assert _units("See http://a.test/x.htm?id=4 for more. The value is 3.141.", model) == ["See http://a.test/x.htm?id=4 for more.", "The value is 3.141."]


def test_sentence_edges(spark, model):
    rows = [(1, None), (2, ""), (3, " \n\t\n "), (4, "```\ncode.\n```"), (5, "+1"), (6, "word " * 50_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start_at int")
    got = [tuple(r) for r in sentences.split_documents(df).collect()]
    assert sorted(got) == [(5, 0, 2), (6, 0, 249_999)]
    assert sentences.split_documents(df.limit(0)).count() == 0
    text = "First one. (Second, in brackets.) Third… “Fourth!” \r\n\r\nFifth"
    spans = sentences.split(text, *model)
    assert all(0 <= a < b <= len(text) and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))


# ---- main content

_NAV = "Home | News | Contact | Imprint"
_PROSE = ["The survey of {} began in spring. It ended before the winter came to the valley.", "Visitors of {} often ask about the old bridge. Nobody knows who built it."]


def _site(spark, hosts=12, pages=9):
    rng = random.Random(7)
    rows, n = [], 0
    for h in range(hosts):
        for p in range(pages):
            n += 1
            name = "".join(rng.choice("abcdefgh") for _ in range(7)).title()
            text = "\r\n".join([_NAV, rng.choice(_PROSE).format(name), "", "We use cookies to improve your visit to this site.", f"the height of {name} = {rng.random():.3f}", f"Copyright 20{h:02d} SITE{h}", "<li><a href=\"/x\">News</a></li>"])
            rows.append((n, f"http://www.site{h}.test/{p}", text, None if n % 4 else ""))
    return spark.createDataFrame(rows + rows[:3], "table_id int, url string, text_before_table string, text_after_table string")


def test_main_blocks_of_sites(spark):
    got = {}
    for r in boilerplate.main_blocks(_site(spark)).collect():
        got.setdefault((r.table_id, r.side), set()).add(r.block_no)
    prose = sum(1 in got.get((i, "before"), ()) for i in range(1, 109))
    assert prose == 108
    assert not any({0, 2, 4, 5} & v for v in got.values()), "menus, notices, rights and markup go"


def test_main_blocks_edges(spark):
    rows = [(1, None, None, None), (2, "no url", "", "  \n "), (None, "http://a.test/", "x", "y")]
    df = spark.createDataFrame([(*r, "b") for r in rows], "table_id int, url string, text_before_table string, text_after_table string, block string")
    assert boilerplate.main_blocks(df).count() == 0
    assert boilerplate.main_blocks(df.limit(0)).count() == 0
    assert boilerplate.blocks("a\r\n\r\n b \n\t\nc") == ["a", "b", "c"]


def _key(block, style, host="site.test"):
    at, key = boilerplate.features(pa.array([block]), np.array([style], np.int8), [host])
    return key.tolist()


def _pages(spark, texts, host="site.test"):
    rows = [(i, f"http://{host}/{i}", t, "") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "table_id int, url string, text_before_table string, text_after_table string")


def test_importance_is_entropy_of_the_tree(spark):
    """100 pages: a sentence on each, one on 9 of them, one that a page holds 9 times and two hold once, and one of each page's own."""
    texts = []
    for p in range(100):
        own = "".join(chr(97 + int(d)) for d in f"{p:02d}")
        texts.append("\n".join(["Everywhere.", f"Own {own}."] + ["On nine."] * (p < 9) + ["In heaps."] * (9 if p == 0 else p < 3)))
    got = {r.key: r.importance for r in boilerplate.style_tree(boilerplate.pages_of(_pages(spark, texts))).collect()}
    (everywhere,), (own_aa,), (on_nine,), (in_heaps,) = (_key(b, boilerplate.SENTENCES) for b in ("Everywhere.", "Own aa.", "On nine.", "In heaps."))
    heaps = 1 - (math.log(11) - 9 * math.log(9) / 11) / math.log(100)
    nine = 1 - math.log(9) / math.log(100)
    assert got[everywhere] == pytest.approx(0, abs=1e-9) and got[on_nine] == pytest.approx(nine) and got[in_heaps] == pytest.approx(heaps)
    assert own_aa not in got and got[0] == 100
    counts = [100, 9, 11] + [1] * 100
    t = sum(counts)
    varied = (math.log(t) - sum(c * math.log(c) for c in counts) / t) / math.log(t)
    mean = (100 * 0 + 100 * 1 + 9 * nine + 11 * heaps) / t
    rest = boilerplate.DECAY ** len(counts)
    assert got[boilerplate.SENTENCES] == pytest.approx((1 - rest) * varied + rest * mean)


def test_presentations_and_features():
    style = {"Home | News | Contact": 2, "<li>x</li>": 1, "f(x);": 1, "A sentence. And more": 3, "Back to top": 4, "the height = 3.14": 5, "the height = 3": 4, "a, b, c": 2, "a, b, c.": 3}
    assert boilerplate.styles(pa.array(list(style))).tolist() == list(style.values())
    assert sorted(_key("News | Home", 2)) == sorted(_key("Home | News", 2)) and len(_key("Home | News", 2)) == 2
    assert _key("Page 12 of site", 4) == _key("Page 7 of SITE", 4) and _key("a", 3) != _key("a", 4)
    assert _key("The value was 3.5.", 3) != _key("The value was 3.6.", 3) and _key("It took 3 days.", 3) == _key("It took 4 days.", 3)
    assert len(_key("|||", 2)) == 1
    at, key = boilerplate.features(pa.array([], pa.string()), np.zeros(0, np.int8), [])
    assert len(at) == len(key) == 0


def test_the_tree_alone_removes_shuffled_menus(spark):
    rng = random.Random(11)
    items = ["Home", "News", "Contact", "Imprint", "Archive", "Search", "Members", "Help"]
    texts = []
    for i in range(60):
        name = "".join(rng.choice("abcdefgh") for _ in range(9)).title()
        texts.append("\n".join([" | ".join(rng.sample(items, 6)), f"The survey of {name} began in spring.", "window." + name + ".push({});", "Subscribe now to our letter!"]))
    df = _pages(spark, texts)
    for fallback in (False, True):
        got = boilerplate.main_blocks(df, fallback=fallback).collect()
        assert {(r.table_id, r.side, r.block_no) for r in got} == {(i, "before", 1) for i in range(60)} and len(got) == 60
    shares = boilerplate.deciders(df).groupBy("by_tree").sum("blocks").collect()
    assert {r[0]: r[1] for r in shares}[True] >= 180
    before = boilerplate.CHUNK_PAGES
    try:
        boilerplate.CHUNK_PAGES = 7
        assert boilerplate.main_blocks(df, fallback=False).count() == 60, "parts of a host are judged by the whole host"
    finally:
        boilerplate.CHUNK_PAGES = before


# ---- languages

_SAMPLES = {
    "en": ["The harbour office counts the old bridges with great care.", "Every village keeps a list of the water level."],
    "de": ["Die Gemeinde zählt die alten Brücken mit großer Sorgfalt.", "Jedes Dorf führt eine Liste der Wasserstände."],
    "ja": ["港の事務所は古い橋を数えました。", "村は水位の一覧を持っています。"],
}


def _model():
    from collections import Counter

    return language.Model({code: Counter(w for s in texts for w in language.split_words(s)) for code, texts in _SAMPLES.items()})


def test_words_come_before_ngrams():
    m = _model()
    assert m.classify(language.split_words("the old village"))[0] == "en"
    assert m.classify(language.split_words("die Brücken der Gemeinde"))[0] == "de"
    assert m.classify(language.split_words("橋の一覧"))[0] == "ja"
    assert m.word("brückenliste") is not None and m.known("brückenliste") == 0
    assert m.classify([]) == (None, 0.0, 0.0) and m.classify(["☃"])[0] is None


def test_declared_spellings():
    assert [language.declared(x) for x in ("EN", "en-US", "English", "eng", " de-AT", "und", "", "??", None, "xx")] == ["en", "en", "en", "en", "de", None, None, None, None, None]


def test_wrong_labels(spark):
    samples = spark.createDataFrame([(c, s) for c, t in _SAMPLES.items() for s in t] + [("en", None), (None, "x")], "lang string, sample_text string")
    en, de, ja = ("\n".join(t * 3) for t in _SAMPLES.values())
    meta = spark.createDataFrame(
        [(1, "http://a.test/1", en, None, "en"), (2, "http://a.test/2", de, None, "English"), (3, "http://b.test/3", f"{en}\n{ja}", None, "eng"), (4, "http://b.test/4", de, "", None), (5, "http://c.test/5", None, None, "de"), (5, "http://c.test/5", None, None, "de")],
        "table_id int, url string, text_before_table string, text_after_table string, lang string",
    )
    phrases = ["die alten Brücken", "eine Liste der Wasserstände", "die Gemeinde zählt", "x", None]
    raw = spark.createDataFrame([(1, [phrases, ["12", "13"], ["Kalo Mi", "Tavu Re", "Lomi Ka"]], "en"), (2, [phrases], "de"), (3, None, "de"), (4, [[], None], None)], "table_id int, relation array<array<string>>, lang string")
    got = {tuple(r) for r in language.wrong_labels(meta, raw, samples).collect()}
    assert got == {(2, "text_before_table", "de"), (3, "text_before_table", "en"), (3, "text_before_table", "ja"), (4, "text_before_table", "de"), (1, "relation", "de")}
    assert language.wrong_labels(meta.limit(0), raw.limit(0), samples).count() == 0


# ---- hostile lengths


@pytest.mark.parametrize("text", ["(" * 60_000 + "a. B " * 20_000, "[" * 30_000 + ")" * 30_000, "(" * 30_000 + "." + ")" * 30_000 + " A.", '"' * 50_001, "桥很旧。" * 30_000, "( " + ". " * 40_000 + ")", "a.b" * 50_000, "```\n" * 5_001, "http://a.test/" + "x." * 40_000, "www." * 30_000 + " x. Y"])
def test_long_texts_take_linear_time(model, text):
    import time

    began = time.perf_counter()
    spans = sentences.split(text, *model)
    assert time.perf_counter() - began < 20
    assert all(0 <= a < b <= len(text) for a, b in spans)


def test_long_blocks_and_words():
    for block in ["{" * 50_000, "f(" * 50_000, "<a" * 50_000, "a" + " " * 50_000 + "b", "1," * 50_000, "x " * 50_000 + "."]:
        one = pa.array([block])
        boilerplate.features(one, boilerplate.styles(one), ["site"])
        boilerplate.layout(one)
    m = _model()
    many = [f"w{chr(97 + i % 26)}{'abcdefgh'[i % 8]}{'ij'[i // 26 % 2] * (i // 1000 % 40)}q{'xyz'[i % 3] * (i % 50)}" for i in range(2000)] * 60
    language.CACHE_WORDS, before = 500, language.CACHE_WORDS
    try:
        assert _model().classify(many)[0] == m.classify(many)[0]
    finally:
        language.CACHE_WORDS = before


def test_all_blocks_teach_words(spark, monkeypatch):
    """A word of few blocks is learned from a corpus of more blocks than were once sampled."""
    from collections import Counter

    from colsift.llm import language

    monkeypatch.setattr(language, "LEARN_BLOCKS", 10, raising=False)
    seed = {"en": Counter("the house is on the hill and we see it every day".split()), "de": Counter("das haus ist auf dem berg und wir sehen es jeden tag".split())}
    texts = [f"the house is on the hill and we see the w{chr(97 + i % 20)}{chr(97 + i // 20)}o every day" for i in range(200)]
    blocks = spark.createDataFrame([(t,) for t in texts * 4], "block string")
    known = language.learn(blocks, seed).words
    assert all(f"w{chr(97 + i % 20)}{chr(97 + i // 20)}o" in known for i in range(200))

"""Languages of documents, tables and mixed-in parts by word-first backoff.

A known word is scored by its log-frequency in each language. A word no language knows is
scored by its character n-grams, the longest length first, falling back to shorter ones until
some are known. Scripts without blanks have no known words and start at the n-grams. The
frequencies come from samples with a trusted language and, as these are few, from the corpus:
the words of all its sentences whose language the trusted samples settle beyond doubt are
counted and the tables made anew. Every text is then read once more.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsift.llm.boilerplate import main_blocks
from colsift.runtime import ship, written

# The corpus' languages (ISO 639-1) with their ISO 639-2 codes and English names.
CODES = {
    "en": "eng english", "de": "deu ger german", "nl": "nld dut dutch", "fr": "fra fre french", "es": "spa spanish", "pt": "por portuguese",
    "ru": "rus russian", "ja": "jpn japanese", "zh": "zho chi chinese", "hi": "hin hindi", "th": "tha thai", "ar": "ara arabic",
}
_BY_NAME = {name: code for code, names in CODES.items() for name in [code, *names.split()]}

#: Longest n-gram, trusted samples read at most, least confidence and share of known words of a sentence that does. Of what they teach, words that
#: make up this share of their language's are learned, rarer ones are mostly names.
LONGEST = 5
MOST_SAMPLES = 50_000
SURE = 0.999
SURE_KNOWN = 0.5
WORD_SHARE = 1 / 20_000
WORD_LEAST = 4
#: Least confidence of a reported language.
CONFIDENT = 0.80
#: A sentence that speaks another language than most of its block needs so many words, this
#: confidence and this share of known words.
ALONE_WORDS = 6
ALONE_CONFIDENT = 0.999
ALONE_KNOWN = 0.7
#: Least share of known words in a cell of a column of phrases.
PHRASE_KNOWN = 0.35

_ASCII_WORD = re.compile(r"[a-z]+(?:'[a-z]+)*")
#: Indic vowel signs stay inside their word.
_WORD = re.compile(r"(?:[^\W\d_]|[ऀ-ःऺ-ॏ])+(?:['’](?:[^\W\d_])+)*")
_PACKED = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿]")
#: The same with the breaks between cells kept.
_ASCII_LINE, _LINE = re.compile(_ASCII_WORD.pattern + r"|\n"), re.compile(_WORD.pattern + r"|\n")
_CUT = re.compile(r"(?<=[.!?…।؟۔])[\"'”“»)\]]*\s+|(?<=[。！？])[”」』）]*")
_FACT = re.compile(r"(?:[–=:]|\s-)\s*[\d.,]+\s*$")
_CODE = re.compile(r"(?=.*\d)[A-Za-z]{0,4}[-_./]?\d[\w.\-/]*$")


#: Words a worker keeps rows of besides the known ones; emptied when full.
CACHE_WORDS = 100_000


def declared(lang: str | None) -> str | None:
    """Two-letter code of a declared language in any spelling; None if it names none of the corpus'."""
    name = (lang or "").strip().lower()
    return _BY_NAME.get(name) or _BY_NAME.get(re.split(r"[-_]", name)[0])


def split_words(text: str) -> list[str]:
    """Words in small letters."""
    low = text.lower()
    return _ASCII_WORD.findall(low) if low.isascii() else _WORD.findall(low)


def _grams(word: str, n: int) -> list[str]:
    """n-grams of a word; those at its ends are marked, in packed scripts not."""
    w = word if n == 1 or _PACKED.match(word) else f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)] if len(w) >= n else []


class Model:
    """Per-language log-frequencies of words and n-grams, as rows of matrices."""

    def __init__(self, counts: dict[str, Counter]):
        self.langs = sorted(counts)
        at = {code: i for i, code in enumerate(self.langs)}
        words = {(w, code): c for code, of in counts.items() for w, c in of.items() if not _PACKED.match(w)}
        self.words, self.rows = self._table(words, at)
        self.grams = []
        for n in range(1, LONGEST + 1):
            seen: Counter = Counter()
            for code, of in counts.items():
                for w, c in of.items():
                    for g in _grams(w, n):
                        seen[g, code] += c
            self.grams.append(self._table(seen, at))
        self._empty_cache()

    @staticmethod
    def _table(seen: dict[tuple[str, str], int], at: dict[str, int]) -> tuple[dict[str, int], np.ndarray]:
        total = np.zeros(len(at))
        for (_, code), c in seen.items():
            total[at[code]] += c
        # A language with few units of this kind must not owe a high score to that.
        total = np.maximum(total, max(1.0, total.mean() if len(at) else 1.0))
        floor = math.log(0.02 / total.max()) if len(at) else 0.0
        index: dict[str, int] = {}
        for unit, _ in seen:
            index.setdefault(unit, len(index))
        rows = np.full((len(index), len(at)), floor)
        for (unit, code), c in seen.items():
            rows[index[unit], at[code]] = max(floor, math.log(c / total[at[code]]))
        return index, rows

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}, "_all": None, "_known": None}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._empty_cache()

    def _empty_cache(self) -> None:
        """Rows of words met so far: the known ones, and up to ``CACHE_WORDS`` others."""
        n = len(self.words)
        self._all = np.zeros((n + CACHE_WORDS + 1, len(self.langs)))
        self._all[:n] = self.rows
        self._known = np.zeros(n + CACHE_WORDS + 1)
        self._known[:n] = 1.0
        self._seen: dict[str, int] = {}

    def known(self, word: str) -> float:
        """1 for a known word, else 0; of a packed run the share of its trigrams that are known."""
        if _PACKED.match(word):
            grams = _grams(word, 3) or _grams(word, len(word))
            of = self.grams[min(3, len(word)) - 1][0]
            return sum(g in of for g in grams) / max(1, len(grams))
        return float(word in self.words)

    def word(self, word: str) -> np.ndarray | None:
        """Log-scores of a word, by the longest units that are known; None if none are."""
        if (at := self.words.get(word)) is not None:
            return self.rows[at]
        for n in range(LONGEST, 0, -1):
            index, rows = self.grams[n - 1]
            hits = [at for g in _grams(word, n) if (at := index.get(g)) is not None]
            if hits:
                score = rows[hits].sum(axis=0)
                # A run of a packed script counts by its length, any other unknown word as half a known one.
                return score if _PACKED.match(word) else 0.5 * score / len(hits)
        return None

    def _index(self, word: str) -> int:
        """Row of an unknown word in the cache; -1 if it says nothing."""
        at = self._seen.get(word)
        if at is None:
            row = self.word(word)
            at = -1
            if row is not None:
                at = len(self.words) + len(self._seen)
                if at >= len(self._all):  # one text of more words than the cache holds
                    self._all = np.concatenate([self._all, np.zeros_like(self._all)])
                    self._known = np.concatenate([self._known, np.zeros_like(self._known)])
                self._all[at], self._known[at] = row, self.known(word)
            self._seen[word] = at
        return at

    def classify_all(self, texts: list[list[str]]) -> list[tuple[str | None, float, float]]:
        """(language, confidence, share of known words) of bags of words, all in one pass of matrix sums."""
        out: list[tuple[str | None, float, float]] = []
        flat: list[int] = []
        ends: list[int] = []

        def flush() -> None:
            if not ends:
                return
            starts = np.array([0, *ends[:-1]])
            sizes = np.diff([0, *ends])
            full = sizes > 0
            score = np.zeros((len(ends), len(self.langs)))
            known = np.zeros(len(ends))
            if flat and self.langs:
                at = np.array(flat)
                score[full] = np.add.reduceat(self._all[at], starts[full], axis=0)
                known[full] = np.add.reduceat(self._known[at], starts[full])
            if self.langs:
                best = score.argmax(axis=1)
                sure = 1 / np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -50.0)).sum(axis=1)
            for i in range(len(ends)):
                out.append((self.langs[best[i]], float(sure[i]), float(known[i] / lengths[i])) if self.langs and full[i] else (None, 0.0, 0.0))
            flat.clear()
            ends.clear()
            lengths.clear()

        lengths: list[int] = []
        for words in texts:
            if len(self._seen) + len(words) >= CACHE_WORDS:
                flush()
                self._empty_cache()
            for w in words:
                at = self.words.get(w)
                if at is None:
                    at = self._index(w)
                if at >= 0:
                    flat.append(at)
            ends.append(len(flat))
            lengths.append(max(1, len(words)))
        flush()
        return out

    def classify(self, words: list[str]) -> tuple[str | None, float, float]:
        return self.classify_all([words])[0]


def sample_counts(samples: DataFrame, lang_col: str = "lang", text_col: str = "sample_text") -> dict[str, Counter]:
    """Word counts per language of the trusted samples, a table of fixed size read up to ``MOST_SAMPLES``."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in samples.where(F.col(text_col).isNotNull()).orderBy(lang_col, text_col).limit(MOST_SAMPLES).select(lang_col, text_col).collect():
        if code := declared(r[0]):
            counts[code].update(split_words(r[1]))
    return dict(counts)


def sentences_of(block: str) -> list[list[str]]:
    """Words of each sentence of a block; pieces of fewer than three words join the next one."""
    out: list[list[str]] = []
    held: list[str] = []
    for piece in _CUT.split(block):
        words = split_words(piece or "")
        held += words
        if len(held) >= 3 or sum(len(w) for w in held if _PACKED.match(w)) >= 6:
            out.append(held)
            held = []
    if held and out:
        out[-1] = out[-1] + held
    elif held:
        out.append(held)
    return out


def units(word: str) -> list[str]:
    """What a word teaches: itself; of a packed run its windows of ``LONGEST`` characters."""
    if len(word) <= LONGEST or not _PACKED.match(word):
        return [word]
    return [word[i : i + LONGEST] for i in range(len(word) - LONGEST + 1)]


def learn(blocks: DataFrame, seed: dict[str, Counter], block_col: str = "block") -> Model:
    """Model from the samples and from all sentences of the blocks whose language they settle.

    Counts are partial sums over all blocks; only words of a share of their language come to the driver.
    """
    spark = blocks.sparkSession
    ship(spark)
    first = spark.sparkContext.broadcast(Model(seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            rows = [(code, w, n) for code, of in counts.items() for w, n in of.items()]
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])
            counts.clear()
            return out

        for batch in batches:
            spoken = [words for block in batch.column(0).to_pylist() for words in sentences_of(block or "")]
            for words, (code, sure, known) in zip(spoken, first.value.classify_all(spoken)):
                if code and sure >= SURE and known >= SURE_KNOWN:
                    if any(map(_PACKED.match, words)):
                        words = [x for w in words for x in units(w)]
                    counts[code].update(words)
            if sum(map(len, counts.values())) > CACHE_WORDS:
                yield flush()
        yield flush()

    per = blocks.select(block_col).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # Summed once, read twice; there is one row of ``whole`` a language.
    per = written(per, "words")
    whole = per.groupBy("lang").agg(F.sum("n").alias("whole"))
    rows = per.join(F.broadcast(whole), "lang").where(F.col("n") >= F.greatest(F.lit(float(WORD_LEAST)), WORD_SHARE * F.col("whole"))).collect()
    grown: dict[str, Counter] = {}
    for code, of in seed.items():
        grown[code] = Counter()
        for w, c in of.items():
            for x in units(w):
                grown[code][x] += c
    for r in rows:
        grown[r["lang"]][r["word"]] += r["n"]
    return Model(grown)


def block_languages(blocks: DataFrame, model: Model) -> DataFrame:
    """(table_id, part_no, sentence_no, lang, confidence) of the sentences of main-body blocks; facts are none."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows, numbers, langs, sure = [], [], [], []
            texts = [[] if not block or _FACT.search(block) else sentences_of(block) for block in batch.column(2).to_pylist()]
            settled = iter(m.classify_all([words for of in texts for words in of]))
            for i, of in enumerate(texts):
                found = [(words, *next(settled)) for words in of]
                sizes = [len(words) + sum(len(w) // 2 for w in words if _PACKED.match(w)) for words in of]
                weight: Counter = Counter()
                for size, (_, code, conf, _) in zip(sizes, found):
                    weight[code] += conf * size
                for k, (size, (_, code, conf, known)) in enumerate(zip(sizes, found)):
                    apart = len(found) > 1 and weight[code] < max(weight.values())
                    keep = not apart or (size >= ALONE_WORDS and conf >= ALONE_CONFIDENT and known >= ALONE_KNOWN)
                    if code and known > 0 and keep:
                        rows.append(i)
                        numbers.append(k)
                        langs.append(code)
                        sure.append(conf)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], names=["table_id", "part_no", "sentence_no", "lang", "confidence"])

    kind = blocks.schema["table_id"].dataType.simpleString()
    return blocks.select("table_id", "block_no", "block").mapInArrow(run, f"table_id {kind}, part_no int, sentence_no int, lang string, confidence double")


def phrase_words(cells: list[str | None], model: Model) -> list[str] | None:
    """Words of a column of phrases; None for columns of names, codes, numbers or fillers."""
    filled = [c for c in cells if c]
    everything = "\n".join(filled).lower()
    if everything.count("\n") >= max(1, len(filled)):
        everything = "\n".join(c.replace("\n", " ") for c in filled).lower()
    # Two words a cell need a blank, but for scripts without blanks.
    if " " not in everything and not _PACKED.search(everything):
        return None
    flat = (_ASCII_LINE if everything.isascii() else _LINE).findall(everything)
    known = model.words.__contains__
    packed = bool(_PACKED.search(everything))
    # Columns without a share of known words are told apart at once; phrases have far more.
    if not packed and sum(map(known, flat)) < 0.1 * max(1, len(flat) - len(filled)):
        return None
    words, of, wordy, spoken, solid, at = [], [], 0, 0, 0, 0
    for w in [*flat, "\n"]:
        if w != "\n":
            of.append(w)
            continue
        c = filled[at]
        at += 1
        solid += c[0].isalnum() or any(map(str.isalnum, c))
        if of and len(c) >= 3 and not (len(c) < 20 and _CODE.match(c)):
            words += of
            if len(of) >= 2 or (packed and sum(max(1, len(x) // 3) for x in of if _PACKED.match(x)) >= 2):
                wordy += 1
                spoken += sum(map(model.known if packed else known, of)) >= PHRASE_KNOWN * len(of)
        of = []
    # Under a header in words, a column of names has one cell that is spoken language.
    return words if spoken >= 2 and wordy >= 0.5 * solid and spoken >= 0.6 * wordy else None


def worded_columns(relations: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[str | None]]]:
    """(row, set_id, cells) of the columns of ``relations`` that can hold phrases.

    A column of phrases has two words in half of its cells that are more than signs. Here a
    letter after a sign that follows a letter counts as a second word, and so does any character
    of a script without blanks: at least as many cells as ``phrase_words`` counts.
    """
    cols, row = pc.list_flatten(relations), pc.list_parent_indices(relations).to_numpy()
    start = np.nonzero(np.r_[True, row[1:] != row[:-1]])[0] if len(row) else np.zeros(0, np.int64)
    set_id = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
    cells, of = pc.fill_null(pc.list_flatten(cols), ""), pc.list_parent_indices(cols).to_numpy()
    has = lambda pattern: np.bincount(of, pc.match_substring_regex(cells, pattern).to_numpy(zero_copy_only=False), minlength=len(cols))
    wordy, solid = has(r"\p{L}[^\p{L}]+\p{L}|" + _PACKED.pattern), has(r"[\p{L}\p{N}]")
    at = np.nonzero((wordy >= 2) & (wordy >= 0.5 * solid))[0]
    return row[at], set_id[at], cols.take(pa.array(at)).to_pylist()


def column_languages(raw_tables: DataFrame, model: Model) -> DataFrame:
    """(table_id, part_no, lang, confidence) of every column of phrases; part_no is the set_id."""
    shared = raw_tables.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows, sets, langs, sure = [], [], [], []
            found = [(i, k, words) for i, k, cells in zip(*worded_columns(batch.column(1))) if (words := phrase_words(cells, m))]
            for (i, k, _), (code, conf, _) in zip(found, m.classify_all([words for _, _, words in found])):
                if code:
                    rows.append(i)
                    sets.append(k)
                    langs.append(code)
                    sure.append(conf)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sets, pa.int32()), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], names=["table_id", "part_no", "lang", "confidence"])

    src = raw_tables.where("table_id is not null and relation is not null").select("table_id", "relation")
    kind = src.schema["table_id"].dataType.simpleString()
    return src.mapInArrow(run, f"table_id {kind}, part_no int, lang string, confidence double").distinct()


def languages(table_meta: DataFrame, raw_tables: DataFrame, samples: DataFrame) -> DataFrame:
    """(table_id, field_name, part_no, sentence_no, lang, confidence): every part with its language.

    Parts of text_before_table are the sentences of its main body, parts of relation its
    columns of phrases. Null, empty and wordless parts have none; repeated rows are one.
    """
    blocks = written(main_blocks(table_meta, with_text=True), "main")
    model = learn(blocks, sample_counts(samples))
    text = block_languages(blocks.where("side = 'before'"), model).withColumn("field_name", F.lit("text_before_table"))
    cells = column_languages(raw_tables, model).withColumn("field_name", F.lit("relation")).withColumn("sentence_no", F.lit(0))
    order = ["table_id", "field_name", "part_no", "sentence_no", "lang", "confidence"]
    return text.select(*order).unionByName(cells.select(*order))


def _declared(df: DataFrame, field: str) -> DataFrame:
    """(table_id, field_name, code): the declared language of each table; repeated rows are one."""
    name = F.lower(F.trim(F.coalesce(F.col("lang"), F.lit(""))))
    known = F.create_map(*[F.lit(x) for pair in _BY_NAME.items() for x in pair])
    code = F.coalesce(F.try_element_at(known, name), F.try_element_at(known, F.split(name, "[-_]")[0]))
    one = df.where("table_id is not null").groupBy("table_id").agg(F.max("lang").alias("lang"))
    return one.select("table_id", F.lit(field).alias("field_name"), code.alias("code"))


def wrong_labels(table_meta: DataFrame, raw_tables: DataFrame, samples: DataFrame) -> DataFrame:
    """(table_id, field_name, lang): the languages held where the declared one is missing, wrong or not alone."""
    held = languages(table_meta, raw_tables, samples).where(F.col("confidence") >= CONFIDENT).select("table_id", "field_name", "lang")
    # Partial sets before the exchange; a text or table holds at most as many as there are languages.
    sets = held.groupBy("table_id", "field_name").agg(F.collect_set("lang").alias("langs"))
    said = _declared(table_meta, "text_before_table").unionByName(_declared(raw_tables, "relation"))
    both = sets.join(said, ["table_id", "field_name"], "left")
    wrong = F.col("code").isNull() | ~F.array_contains("langs", F.col("code")) | (F.size("langs") >= 2)
    return both.where(wrong).select("table_id", "field_name", F.explode("langs").alias("lang"))

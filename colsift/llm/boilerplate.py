"""Main content of web pages by a site style tree.

The pages of a host are merged into one tree: host, presentation of a block (markup, list of
items, sentences, line, measured fact), content. The contents below a presentation are its
features: sentences and facts are one feature each, as they stand; markup, lists and lines
are told by their single words, since their items come in any order and number. Digits and
the host's own name are masked. All hosts hang below one root, so content that hosts share is
merged there as well.

The importance of a feature is one minus the entropy of its spread over the pages, to the base
of the number of pages: what many pages repeat carries no information about any of them. It is
the smaller one of that in the host's tree and in the tree below the root. A presentation has
the entropy of its features, joined by ``DECAY`` with their mean importance. A block has the
mean importance of its features, and a share of its presentation's. Blocks up to ``LOW``
(``LOW_LINE`` for lines) are furniture, blocks from ``HIGH`` on are main body.

Between the two, and on hosts of fewer than ``LEAST_PAGES`` pages, which show no repetition, a
logistic model decides: it is fitted on blocks that the tree settles, from about ``FIT_PAGES``
pages, and sees a block's layout and the odds of its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsift.runtime import ship, written

#: A presentation of l features weighs their entropy with 1 - DECAY ** l and their mean
#: importance with the rest; a block's features weigh OWN_SHARE, its presentation the rest.
DECAY = 0.9
OWN_SHARE = 0.7
#: Nats that make an importance of 1 in trees of more than e ** MOST_NATS (6,000) pages: contents on the
#: same share of the pages have the same importance however many pages there are.
MOST_NATS = 8.7
#: Importance up to which a block is furniture, up to which a line is, whose few words are the
#: prose's as well, from which on any block is main body, and the lines between where no model is asked.
LOW, LOW_LINE = 0.60, 0.40
HIGH = 0.86
MIDDLE, MIDDLE_LINE = 0.64, 0.52
#: Pages of a host from which on its tree alone can settle a block as main body.
LEAST_PAGES = 20
#: Pages the model is fitted on, about.
FIT_PAGES = 6_000
#: Pages that are judged together; a host with more is judged in parts against the same tree.
CHUNK_PAGES = 4_096

SIDES = (("before", "text_before_table"), ("after", "text_after_table"))
MARKUP, LIST, SENTENCES, LINE, FACT = range(1, 6)

# Patterns of Arrow's matcher, whose classes of letters are spelled out.
_SEP = r"[\s\p{Z}]+[|/›»·•>‹][\s\p{Z}]+|[\s\p{Z}]{2,}|,[\s\p{Z}]+|、|\|"
_MARKUP = r"</?[A-Za-z!][^<>]*>?|//\]\]>|&[a-z]+;|^@[a-z]|[{};]$|\{[^{}]*:[^{}]*\}|[A-Za-z]\([^()]*\)\s*;"
_END = r"[.!?…。！？।؟۔][)\]»”“\"'’」』）\s\p{Z}]*$"
_INNER = r"[.!?…।؟۔][)\]»”\"'’」』）]*[\s\p{Z}]|[。！？]"
_FACT = r"(?:[\s\p{Z}][–=\-]|:)[\s\p{Z}]*\d[\d.,]*$"
_MEASURED = r"\d[.,]\d"
_CUT = r"[\s\p{Z}|/›»·•‹,、<>\"'“”(){}\[\];=:.!?*#&@_\-]+"
_PACKED_RUN = r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿]"
_WORDS = r"[\p{L}\p{M}]+"
#: A run of a script without blanks that is longer than a label is prose, end mark or not.
_LONG_RUN = _PACKED_RUN + "{14}"
#: Scripts written without blanks between words; their words for the model are character trigrams.
_PACKED = re.compile(_PACKED_RUN + "+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def blocks(text: str | None) -> list[str]:
    """Lines with a non-blank character, in order, without the blanks around them."""
    return split_blocks(pa.array([text], pa.string()))[2].to_pylist()


def host_of(url: Column) -> Column:
    """Host of a URL in small letters; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


@lru_cache(maxsize=4096)
def host_names(host: str) -> tuple[str, ...]:
    """Forms in which a host writes its own name, the longest first."""
    parts = {p for p in re.split(r"[.\-]", host) if len(p) > 3}
    parts |= {p.split(".")[0] for p in [host.removeprefix("www.").removeprefix("my.")]} - {""}
    return tuple(sorted(parts, key=lambda p: (-len(p), p)))


def _has(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)


def _filled(texts: pa.Array) -> np.ndarray:
    return pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def split_blocks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number, block) of all blocks of ``texts``; blocks of a text are numbered from 0."""
    lists = pc.split_pattern_regex(texts.cast(pa.string()), r"\r\n|\n|\r")
    flat, row = pc.utf8_trim_whitespace(pc.list_flatten(lists)), pc.list_parent_indices(lists).to_numpy()
    kept = _filled(flat)
    flat, row = flat.filter(pa.array(kept)), row[kept]
    start = np.nonzero(np.r_[True, row[1:] != row[:-1]])[0] if len(row) else np.zeros(0, np.int64)
    number = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
    return row, number.astype(np.int32), flat


def styles(texts: pa.Array) -> np.ndarray:
    """Presentation of each block."""
    end = _has(texts, _END)
    many = pc.count_substring_regex(texts, _SEP).to_numpy() >= 2
    kinds = [_has(texts, _MARKUP), _has(texts, _FACT) & _has(texts, _MEASURED), many & ~end, end | _has(texts, _INNER) | _has(texts, _LONG_RUN)]
    return np.select(kinds, [MARKUP, FACT, LIST, SENTENCES], LINE).astype(np.int8)


def _masked_names(low: pa.Array, hosts: list[str]) -> pa.Array:
    """Small-letter blocks with the name of each one's host replaced."""
    texts, changed = low.to_pylist(), False
    for i, (text, host) in enumerate(zip(texts, hosts)):
        for name in host_names(host):
            if name in text:
                text = texts[i] = text.replace(name, "@")
                changed = True
    return pa.array(texts, pa.string()) if changed else low


def features(texts: pa.Array, style: np.ndarray, hosts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(block, key) of every feature of every block: hashes of presentation and content, one at least.

    Whole numbers are masked; sentences and facts with a measured value keep their numbers,
    and so do the measured values among the words of lines.
    """
    low = _masked_names(pc.utf8_lower(texts), hosts)
    bare = pc.replace_substring_regex(low, r"\d+", "0")
    whole = (style == SENTENCES) | (style == FACT)
    alone, parted = np.nonzero(whole)[0], np.nonzero(~whole)[0]
    standing = pc.if_else(pa.array(_has(low, _MEASURED)), low, bare).take(pa.array(alone))
    source = pc.if_else(pa.array(style == LINE), pc.replace_substring_regex(low, r"(\d)[.,](\d)", r"\1٫\2"), bare)
    lists = pc.split_pattern_regex(source.take(pa.array(parted)), _CUT)
    words, at = pc.list_flatten(lists), parted[pc.list_parent_indices(lists).to_numpy()]
    kept = _filled(words)
    words, at = words.filter(pa.array(kept)), at[kept]
    words = pc.if_else(pc.match_substring(words, "٫"), words, pc.replace_substring_regex(words, r"\d+", "0"))
    rest = np.setdiff1d(parted, at)
    at = np.concatenate([alone, at, rest])
    unit = pa.concat_arrays([x.cast(pa.string()) for x in (standing, words, bare.take(pa.array(rest)))])
    signed = pc.binary_join_element_wise(pa.array(style[at]).cast(pa.string()), unit, "")
    known = signed.dictionary_encode()
    keys = np.array([xxhash.xxh64_intdigest(x) for x in known.dictionary.to_pylist()], np.uint64)
    return at, keys[known.indices.to_numpy()].view(np.int64) if len(keys) else np.zeros(0, np.int64)


def parse(table: pa.Table) -> dict:
    """Blocks of a table of pages (host, text_before_table, text_after_table), with presentations and features."""
    parts = [split_blocks(table.column(c).combine_chunks() if isinstance(table.column(c), pa.ChunkedArray) else table.column(c)) for _, c in SIDES]
    row, number = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    side = np.repeat([0, 1], [len(p[0]) for p in parts])
    texts = pa.concat_arrays([p[2].cast(pa.string()) for p in parts])
    hosts = table.column("host").to_pylist()
    style = styles(texts)
    at, key = features(texts, style, [hosts[i] for i in row.tolist()])
    return {"row": row, "number": number, "side": side, "text": texts, "style": style, "at": at, "key": key, "hosts": hosts}


def pages_of(table_meta: DataFrame) -> DataFrame:
    """One row per page: table_id, host, the two texts and its chunk; written once, laid out by host.

    Repeated rows of a table_id are one page; rows of one table_id with different hosts, which
    aren't repeats, stay pages of their hosts. The range partitioning cuts a hot host over many
    partitions, and the rows of a chunk lie in one of them.
    """
    pages = table_meta.where("table_id is not null").select("table_id", host_of(F.col("url")).alias("host"), *(F.col(c).cast("string").alias(c) for _, c in SIDES))
    placed = pages.repartitionByRange("host", "table_id").dropDuplicates(["host", "table_id"]).sortWithinPartitions("host")
    return written(placed.withColumn("chunk", (F.monotonically_increasing_id() / CHUNK_PAGES).cast("long")), "pages")


def spreads(pages: DataFrame) -> DataFrame:
    """(host, style, key, n, c, l): pages n with a feature, its number c on them, and the sum of c_j log c_j; written once."""
    ship(pages.sparkSession)

    def run(batches):
        for batch in batches:
            p = parse(batch)
            names, host = np.unique(np.array(p["hosts"], dtype=object).astype(str), return_inverse=True) if batch.num_rows else ([], np.zeros(0, int))
            keys, key = np.unique(p["key"], return_inverse=True)
            style = np.zeros(len(keys), np.int32)
            style[key] = p["style"][p["at"]]
            page = p["row"][p["at"]].astype(np.int64)
            seen, c = np.unique(page * len(keys) + key, return_counts=True)
            both, to = np.unique(host[seen // max(1, len(keys))].astype(np.int64) * len(keys) + seen % max(1, len(keys)), return_inverse=True)
            at = both % max(1, len(keys))
            n, total, surprise = np.bincount(to, minlength=len(both)), np.bincount(to, c, minlength=len(both)), np.bincount(to, c * np.log(c), minlength=len(both))
            named = pa.DictionaryArray.from_arrays(pa.array((both // max(1, len(keys))).astype(np.int32)), pa.array(list(names), pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [named, pa.array(style[at]), pa.array(keys[at]), pa.array(n.astype(np.int64)), pa.array(total.astype(np.int64)), pa.array(surprise.astype(np.float64))],
                names=["host", "style", "key", "n", "c", "l"],
            )

    flat = pages.select("host", *(c for _, c in SIDES)).mapInArrow(run, "host string, style int, key long, n long, c long, l double")
    return written(flat.groupBy("host", "style", "key").agg(*(F.sum(x).alias(x) for x in ("n", "c", "l"))), "spreads")


def _entropy(c: str, l: str) -> Column:  # noqa: E741
    return F.greatest(F.lit(0.0), F.log(F.col(c).cast("double")) - F.col(l) / F.col(c))


def _share(entropy: Column, of: str) -> Column:
    """What the entropy leaves of that of ``of`` pages, as a share of the latter, up to ``MOST_NATS``; one where there is one page."""
    most = F.log(F.col(of).cast("double"))
    return F.when(F.col(of) > 1, F.least(F.lit(1.0), (most - entropy) / F.least(most, F.lit(MOST_NATS)))).otherwise(F.lit(1.0))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, key, importance): the features of each host that any other page has too, and its presentations.

    The key of a presentation is its number. A feature that stands on one page in all is not
    listed: its importance is 1. Hosts without a name have no tree of their own.
    """
    spread = spreads(pages)
    sizes = pages.groupBy("host").agg(F.count("*").alias("m"))
    total = F.lit(pages.count()).cast("long")
    own = F.when(F.col("host") == "", F.lit(1.0)).otherwise(_share(_entropy("c", "l"), "m"))
    leaves = spread.join(sizes, "host").withColumn("own", own)
    surprise = F.sum(F.col("c") * F.log(F.col("c").cast("double")))
    inner = leaves.groupBy("host", "style").agg(F.count("*").alias("kinds"), F.sum("c").alias("t"), surprise.alias("l"), (F.sum(F.col("c") * F.col("own")) / F.sum("c")).alias("mean"))
    varied = F.when(F.col("t") > 1, _entropy("t", "l") / F.log(F.col("t").cast("double"))).otherwise(F.lit(1.0))
    rest = F.pow(F.lit(DECAY), F.col("kinds"))
    inner = inner.select("host", F.col("style").cast("long").alias("key"), ((1 - rest) * varied + rest * F.col("mean")).alias("importance"))
    # Below the root the same feature of all hosts is one; most features stand on one page and end here.
    root = spread.groupBy("key").agg(*(F.sum(x).alias(f"r_{x}") for x in ("n", "c", "l"))).where("r_n > 1").withColumn("total", total)
    listed = leaves.join(root, "key").select("host", "key", F.least("own", _share(_entropy("r_c", "r_l"), "total")).alias("importance"))
    sized = sizes.select("host", F.lit(0).cast("long").alias("key"), F.col("m").cast("double").alias("importance"))
    return written(listed.unionByName(inner).unionByName(sized), "tree")


class Judge:
    """Importance of the blocks of a chunk of pages by the tree of their hosts."""

    def __init__(self, pages: pa.Table, tree: pa.Table):
        self.p = p = parse(pages)
        names, at = np.unique(np.array(tree.column("host").to_pylist(), dtype=object).astype(str), return_inverse=True) if tree.num_rows else (np.array([], str), np.zeros(0, int))
        index = {h: i for i, h in enumerate(names.tolist())}
        host = np.array([index.get(h, -1) for h in p["hosts"]], np.int64)
        # One number for host and key; two that coincide would need equal 64-bit sums.
        mix = lambda h, k: k + h.astype(np.uint64).astype(np.int64) * np.int64(0x1E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            known, own = mix(at, tree.column("key").to_numpy()), host[p["row"]]
            order = np.argsort(known)
            known, value = known[order], tree.column("importance").to_numpy()[order]

            def find(keys: np.ndarray, default: float) -> np.ndarray:
                if not len(known):
                    return np.full(len(keys), default)
                to = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                return np.where(known[to] == keys, value[to], default)

            leaf = find(mix(own[p["at"]], p["key"]), 1.0)
            above = find(mix(own, p["style"].astype(np.int64)), 1.0)
            self.pages = find(mix(own, np.zeros(len(own), np.int64)), 0.0)
        n = np.bincount(p["at"], minlength=len(own))
        mean = np.bincount(p["at"], leaf, minlength=len(own)) / np.maximum(n, 1)
        self.importance = OWN_SHARE * mean + (1 - OWN_SHARE) * above
        named = np.array([bool(h) for h in p["hosts"]], bool)[p["row"]] if len(own) else np.zeros(0, bool)
        #: 1 furniture, 0 main body, -1 not settled by the tree.
        self.line = p["style"] == LINE
        self.settled = np.where(self.importance <= np.where(self.line, LOW_LINE, LOW), 1, np.where((self.importance >= HIGH) & (self.pages >= LEAST_PAGES) & named, 0, -1)).astype(np.int8)


def _chunked(pages: DataFrame, tree: DataFrame):
    """Chunks of pages beside the trees of their hosts."""
    held = tree.join(pages.select("host", F.col("chunk").alias("of_chunk")).distinct(), "host")
    return pages.groupBy("chunk").cogroup(held.groupBy("of_chunk"))


# ---- the model for blocks that the tree doesn't settle


def tokens(block: str) -> list[str]:
    """Words of a block; trigrams where the script doesn't part words."""
    if block.isascii():
        return [w for w in _WORD.findall(block.lower()) if len(w) > 1]
    out = []
    for m in _WORD.finditer(block):
        w = m.group().lower()
        if _PACKED.match(w):
            out += [w[i : i + 3] for i in range(max(1, len(w) - 2))]
        elif len(w) > 1:
            out.append(w)
    return out


def layout(texts: pa.Array) -> np.ndarray:
    """Language-independent features of how blocks are laid out, one row each."""
    letters = pc.replace_substring_regex(texts, r"[^\p{L}\p{M}]+", "")
    size = lambda x: pc.utf8_length(x).to_numpy().astype(float)
    n, words, pieces = size(texts), pc.count_substring_regex(texts, _WORDS).to_numpy(), pc.count_substring_regex(texts, r"[^\s]+").to_numpy()
    numbers, singles = pc.count_substring_regex(texts, r"\d+").to_numpy(), pc.count_substring_regex(texts, r"(?:^|\s)\S(?:\s\S)*(?:\s|$)").to_numpy()
    packed = pc.count_substring_regex(texts, _PACKED_RUN).to_numpy()
    end, many = _has(texts, _END), pc.count_substring_regex(texts, _SEP).to_numpy() >= 2
    return np.column_stack([
        _has(texts, _MARKUP), end, _has(texts, _INNER), many & ~end, _has(texts, r"\|"), _has(texts, r"[›·©#]|\(c\)|[\s]»[\s]") & ~_has(texts, "«"),
        np.log1p(words), np.log1p(n), size(letters) / np.maximum(1, n), numbers > 0, _has(texts, r"\(\d+\)"), _has(texts, _FACT), _has(texts, _MEASURED),
        (singles > 0) & (pieces >= 5) & (2 * words >= pieces) & (n <= 2.6 * pieces), (packed > 0) & (n >= 18 * np.maximum(1, pieces)), (numbers >= 3) & ~end, packed > 0,
    ]).astype(float)


class Scorer:
    """Word odds and weights; a positive score is furniture."""

    def __init__(self, odds: dict[str, tuple[int, int]]):
        self.odds = odds
        self.low, self.high = (max(1, sum(v[i] for v in odds.values())) for i in (0, 1))
        self.weights = np.zeros(0)
        self.logs = {w: self._log(b, m) for w, (b, m) in odds.items()}

    def _log(self, b: int, m: int) -> float:
        v = math.log((b + 0.2) / self.low) - math.log((m + 0.2) / self.high)
        return max(-6.0, min(6.0, v))

    def _words(self, block: str, own: tuple[int, int] | None = None) -> list[float]:
        """``own``: (class, copies) of a training block, whose own words are taken out of the counts."""
        logs, unknown = [], 0
        words = tokens(block)
        seen = Counter(words) if own is not None else {}
        for w in words:
            if own is None:
                v = self.logs.get(w)
            else:
                b, m = self.odds.get(w, (0, 0))
                gone = seen[w] * own[1]
                b, m = (max(0, b - gone), m) if own[0] else (b, max(0, m - gone))
                v = self._log(b, m) if b + m else None
            if v is None:
                unknown += 1
            else:
                logs.append(v)
        mean = sum(logs) / len(logs) if logs else 0.0
        return [1.0, mean, min(logs, default=0.0), unknown / max(1, len(words)), float(not words)]

    def rows(self, texts: pa.Array, own: list[tuple[int, int]] | None = None) -> np.ndarray:
        blocks_ = texts.to_pylist()
        words = np.array([self._words(b, own[i] if own else None) for i, b in enumerate(blocks_)]).reshape(len(blocks_), 5)
        return np.column_stack([words, layout(texts)])

    def furniture(self, texts: pa.Array) -> np.ndarray:
        """Whether each block is furniture; without anything learned none is."""
        if not len(texts) or not len(self.weights):
            return np.zeros(len(texts), bool)
        known = texts.dictionary_encode()
        return (self.rows(known.dictionary) @ self.weights > 0)[known.indices.to_numpy()]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights by Newton steps, both classes of equal weight."""
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (weight * (q - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


#: Prose of a training block that lost its end mark teaches that the mark is no need.
_LAST_MARK = re.compile(r"[.!?…。！？।؟۔]+[)\]»”“\"'’」』）\s]*$")


def train(pages: DataFrame, tree: DataFrame) -> Scorer:
    """The model, fitted on the blocks that the tree settles in a sample of pages drawn by a hash of their id.

    On small hosts, where the tree settles little, blocks above ``HIGH`` in a presentation of
    prose or facts count as main body and lists and markup as furniture.
    """
    total = pages.count()
    some = pages.where(F.pmod(F.xxhash64("table_id"), F.lit(1_000_003)) <= math.ceil(1_000_003 * FIT_PAGES / max(FIT_PAGES, total)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        j = Judge(left, right)
        style = j.p["style"]
        prose = (style == SENTENCES) | (style == FACT)
        label = np.where((j.settled == 1) | (style == MARKUP), 1, np.where((j.importance >= HIGH) & prose, 0, -1))
        label = np.where((label < 0) & (j.pages < LEAST_PAGES) & (style == LIST), 1, label)
        kept = label >= 0
        known = j.p["text"].filter(pa.array(kept)).dictionary_encode()
        both, n = np.unique(known.indices.to_numpy().astype(np.int64) * 2 + label[kept], return_counts=True)
        return pa.table({"block": known.dictionary.take(pa.array(both // 2)), "y": pa.array((both % 2).astype(np.int32)), "n": pa.array(n.astype(np.int64))})

    found = _chunked(some, tree).applyInArrow(run, "block string, y int, n long").groupBy("block", "y").agg(F.sum("n").alias("n")).toArrow()
    texts, y, n = found.column("block").to_pylist(), found.column("y").to_numpy(), found.column("n").to_numpy()
    odds: dict[str, list[int]] = {}
    for block, label, copies in zip(texts, y.tolist(), n.tolist()):
        for w in tokens(block):
            odds.setdefault(w, [0, 0])[1 - label] += copies
    scorer = Scorer({w: (b, m) for w, (b, m) in odds.items() if b + m > 1})
    if len(y) and 0 < y.sum() < len(y):
        own = list(zip(y.tolist(), n.tolist()))
        bare = [i for i, t in enumerate(texts) if not y[i] and _LAST_MARK.search(t)][::4]
        more = pa.array([_LAST_MARK.sub("", texts[i]) for i in bare], pa.string())
        x = np.concatenate([scorer.rows(found.column("block").combine_chunks(), own), scorer.rows(more, [own[i] for i in bare])])
        scorer.weights = fit(x, np.concatenate([y, np.zeros(len(bare))]).astype(float))
    return scorer


def _judged(table_meta: DataFrame, schema: str, out, fallback: bool = True) -> DataFrame:
    """``out(pages, judge, furniture)`` of every chunk of pages, as a table of ``schema``."""
    spark = table_meta.sparkSession
    pages = pages_of(table_meta)
    tree = style_tree(pages)
    model = spark.sparkContext.broadcast(train(pages, tree) if fallback else None)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        j = Judge(left, right)
        gone = j.settled == 1
        open_ = np.nonzero(j.settled < 0)[0]
        if model.value is None:
            gone[open_] = (j.importance < np.where(j.line, MIDDLE_LINE, MIDDLE))[open_]
        else:
            gone[open_] = model.value.furniture(j.p["text"].take(pa.array(open_)))
        return out(left, j, gone)

    return _chunked(pages, tree).applyInArrow(run, schema)


def main_blocks(table_meta: DataFrame, with_text: bool = False, fallback: bool = True) -> DataFrame:
    """(table_id, side, block_no[, block]): the blocks of each page's two texts that are main body.

    Null, empty and blank texts have no blocks; a page without URL has no host and is judged by
    the tree below the root; repeated rows of a table_id are one page. Texts are used whole.
    Without ``fallback`` the tree alone decides.
    """

    def out(pages: pa.Table, j: Judge, gone: np.ndarray) -> pa.Table:
        at = pa.array(np.nonzero(~gone)[0])
        take = lambda x: pa.array(x).take(at)
        cols = {"table_id": pages.column("table_id").combine_chunks().take(take(j.p["row"])), "side": pa.array(["before", "after"]).take(take(j.p["side"])), "block_no": take(j.p["number"])}
        return pa.table(cols | ({"block": j.p["text"].take(at)} if with_text else {}))

    kind = table_meta.schema["table_id"].dataType.simpleString()
    return _judged(table_meta, f"table_id {kind}, side string, block_no int" + ", block string" * with_text, out, fallback)


def deciders(table_meta: DataFrame) -> DataFrame:
    """(style, by_tree, main, blocks): how many blocks of each presentation the tree and the model settle, and how."""

    def out(pages: pa.Table, j: Judge, gone: np.ndarray) -> pa.Table:
        code, n = np.unique(j.p["style"].astype(np.int64) * 4 + 2 * (j.settled >= 0) + ~gone, return_counts=True)
        return pa.table({"style": pa.array((code // 4).astype(np.int32)), "by_tree": pa.array(code % 4 >= 2), "main": pa.array(code % 2 == 1), "n": pa.array(n.astype(np.int64))})

    found = _judged(table_meta, "style int, by_tree boolean, main boolean, n long", out)
    return found.groupBy("style", "by_tree", "main").agg(F.sum("n").alias("blocks"))

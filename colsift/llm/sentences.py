"""Sentence units of documents in any of the corpus' languages and scripts.

A text is cut into paragraphs (blank lines, list entries; set-off code gives none). Inside a
paragraph every end mark, with the closing quotes and brackets after it, is a candidate
boundary, and so is a blank between two words of a script that writes no end marks. Marks
inside matched quotes, brackets, code spans and addresses are none. A maximum-entropy
classifier decides each candidate from the tokens around it: how often the token before the
mark ends paragraphs, how often the token after it starts them, case, digits, length, script
and the quotes.

It is trained on boundaries that need no judgement: the end of one paragraph and the start of
the next make a true boundary; a mark before a comma, before a small letter in a text that
writes capitals, inside a number or name, or after a token that carries many dots and hardly
ever ends a paragraph, a false one. The counts cover all documents and all tokens; the
classifier is fitted on at most ``FIT_DOCUMENTS`` documents, drawn by a hash of their id.

Every text is read once: the reading pass writes the paragraphs and candidates of each document
as packed numbers, its tokens as hashes, and the counts of what it read. Chunks of documents
then meet the counts of the tokens they hold, and all their candidates are classified at once.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsift.runtime import ship, written

#: Documents the classifier is fitted on, and documents that are classified together.
FIT_DOCUMENTS = 4_000
CHUNK_DOCUMENTS = 8_192
#: Dots a token must carry to count as a sure abbreviation in training, and the share of them
#: that may end a paragraph all the same.
SURE_DOTS = 20
SURE_SHARE = 0.01
#: A run without blanks of more characters is no word but one of a kind of its own.
LONG_TOKEN = 60

_MARKS = re.compile(r"[.!?…。！？．｡।॥؟۔]+")
_FULL = set("。！？．｡।॥؟۔")
_OPEN = {"(": ")", "[": "]", "«": "»", "„": "“”", "“": "”", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "‹": "›"}
_QUOTING = re.compile("[" + re.escape("".join({*_OPEN, *"".join(_OPEN.values()), '"', "`"})) + "]")
#: Marks, closing signs and blanks, as they stand after the last word of a sentence.
_TRAIN = re.compile("[\\s.!?…。！？．｡।॥؟۔" + re.escape(")]»”“\"'’」』）】》›") + "]+")
_CLOSERS = set(")]»”“\"'’」』）】》›")
_OPENERS = "([«„“\"'‘「『（【《¿¡‹*_`"
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_LIST = re.compile(r"[ \t]*(?:[-*•–]|\d{1,3}[.)]|[a-z][)])[ \t]+(?=\S)")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|$)")
_NUMBER = re.compile(r"[\d.,:/%+\-−–]+$")
_RUN = re.compile(r"\S+")
_FENCE = re.compile(r"[ \t]{0,3}(```|~~~)")
_CLOSES = {f: re.compile(rf"(?m)^[ \t]*{f}") for f in ("```", "~~~")}
#: A mark with what closes after it, the blanks and the next sign: all of a candidate where nothing is quoted.
_PLAIN = re.compile(f"({_MARKS.pattern}+)[" + re.escape("".join(sorted(_CLOSERS))) + f"]*+(?:{_MARKS.pattern}+)?+" + r"(\s*+)(\S)")
#: Scripts without blanks between words: their tokens are the first or last characters of a run.
_NO_BLANKS = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]")
#: Scripts among them in which a blank, not a mark, ends a sentence.
_BLANK_ENDS = re.compile(r"(?<=[ก-๛ກ-ໟក-៿])[  \n\r]+(?=[ก-๛ກ-ໟក-៿])")


def _no_blanks(ch: str) -> bool:
    return ch >= "฀" and _NO_BLANKS.match(ch) is not None


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Spans of prose: lines up to a blank line, one list entry, without set-off code."""
    spans: list[tuple[int, int]] = []
    start = end = -1
    blank_before, in_list, fence = True, False, ""

    def close() -> None:
        nonlocal start
        if start >= 0:
            spans.append((start, end))
        start = -1

    pre = False
    for m in _LINE.finditer(text):
        a, b = m.span()
        if a == b and a == len(text):
            break
        line = m.group()
        if fence:
            if line.strip().startswith(fence):
                fence, blank_before = "", True
            continue
        if pre or "<pre" in line:
            close()
            while True:
                if pre:
                    at = line.find("</pre>")
                    if at < 0:
                        break
                    pre, a, line = False, a + at + 6, line[at + 6 :]
                else:
                    at = line.find("<pre")
                    piece = line if at < 0 else line[:at]
                    if piece.strip():
                        spans.append((a, a + len(piece)))
                    if at < 0:
                        break
                    pre, a, line = True, a + at, line[at:]
            blank_before = True
            continue
        if not line.strip():
            close()
            blank_before = True
            continue
        if f := _FENCE.match(line):
            close()
            blank_before = True
            if _CLOSES[f.group(1)].search(text, b):
                fence = f.group(1)
            continue
        if blank_before and (line.startswith("    ") or line.startswith("\t")):
            close()
            continue
        item = bool(_LIST.match(line))
        if start >= 0 and item and in_list:
            close()
        if start < 0:
            start, in_list = a, item
        end, blank_before = b, False
    close()
    return spans


def _pairs(p: str) -> tuple[list[int], dict[int, int]]:
    """For every character the start of the outermost matched pair around it (-1: none), and closer to opener.

    Linear in the paragraph: a closer is looked up only if its opener is on the stack, and what
    lies above that is popped.
    """
    stack: list[tuple[str, int]] = []
    waiting: Counter = Counter()
    matched: list[tuple[int, int]] = []

    def match(ch: str, i: int) -> bool:
        if not waiting[ch]:
            return False
        while True:
            closers, at = stack.pop()
            waiting.subtract(closers)
            if ch in closers:
                matched.append((at, i))
                return True

    def push(closers: str, i: int) -> None:
        stack.append((closers, i))
        waiting.update(closers)

    for m in _QUOTING.finditer(p):
        i, ch = m.start(), m.group()
        if ch in '"`':
            if not match(ch, i) and (ch == "`" or i + 1 < len(p) and not p[i + 1].isspace()):
                push(ch, i)
        elif not match(ch, i) and ch in _OPEN:
            push(_OPEN[ch], i)
    around, end = [-1] * len(p), -1
    for a, b in sorted(matched):
        if a > end:
            around[a : b + 1] = [a] * (b + 1 - a)
            end = b
    return around, {b: a for a, b in matched}


def _previous(p: str, i: int) -> str:
    """The token that ends before position ``i``."""
    run = p[max(0, i - LONG_TOKEN - 1) : i]
    if not run or run[-1].isspace():
        return ""
    if _no_blanks(run[-1]):
        a = i
        while a > max(0, i - 4) and _no_blanks(p[a - 1]):
            a -= 1
        return p[a:i]
    run = run.rsplit(None, 1)[-1]
    if len(run) > LONG_TOKEN:
        return "<long>"
    run = run.lstrip(_OPENERS)
    if _NUMBER.fullmatch(run):
        return "<num>"
    if len(run) == 1 and run.isupper():
        return "<initial>"
    return run.lower()


def _next(p: str, i: int) -> str:
    """The token that starts at or after position ``i``, past opening signs."""
    while i < len(p) and (p[i].isspace() or p[i] in _OPENERS):
        i += 1
    if i >= len(p):
        return ""
    if _no_blanks(p[i]):
        return p[i : i + 3]
    m = _WORD.match(p, i)
    if not m:
        return p[i]
    return "<num>" if m.group()[0].isdigit() else m.group().lower()


def word_tokens(w: str) -> list[str]:
    """Tokens of a word as the counts see them."""
    if _no_blanks(w[0]):
        return [w[:3], w[-4:]] if len(w) > 4 else [w[:3]]
    return ["<num>" if w[0].isdigit() else "<initial>" if len(w) == 1 and w.isupper() else w.lower()]


@dataclass
class Candidate:
    at: int  # end of the left unit: past marks and closers
    mark: str
    before: str
    after: str
    gap: str
    following: str  # first character of the right unit
    closer: bool = False
    colon: bool = False  # the closed quote was opened after a colon
    opened: int = -1
    bracket: bool = False  # the closed pair is one of brackets


def _before_colon(p: str, i: int) -> bool:
    while i > 0 and p[i - 1].isspace():
        i -= 1
    return i > 0 and p[i - 1] in ":："


def _is_plain(p: str) -> bool:
    """Whether nothing is quoted, linked, or ended by a blank in a paragraph."""
    return not (_QUOTING.search(p) or "://" in p or "www." in p or (not p.isascii() and _BLANK_ENDS.search(p)))


def candidates(p: str) -> list[Candidate]:
    """Possible boundaries inside one paragraph, in order; linear in the paragraph."""
    out: list[Candidate] = []
    end = len(p.rstrip())
    skip_to = m.end() if (m := _LIST.match(p)) else 0
    if _is_plain(p):
        for m in _PLAIN.finditer(p, skip_to):
            mark, gap, first = m.groups()
            at, e = m.start(2), m.end(1)
            out.append(Candidate(at, mark, _previous(p, m.start()), _next(p, m.start(3)), gap, first, at > e))
        return out
    packed = not p.isascii() and _BLANK_ENDS.search(p) is not None
    linked = "://" in p or "www." in p
    marks = _MARKS.finditer(p, skip_to)
    around, opened = _pairs(p) if _QUOTING.search(p) else (None, {})
    addresses: deque = deque()
    if linked:
        addresses = deque(m.span() for m in _RUN.finditer(p) if "://" in m.group() or m.group().startswith("www."))
    #: For every train of signs: its end and its last closer of a pair that opened before it.
    train_end, closer = -1, -1
    for m in marks:
        a, e = m.span()
        was, at = -1, e
        if around is not None and around[a] >= 0:
            # Inside a pair only its very end can be a boundary, past its closer.
            if a >= train_end:
                t = _TRAIN.match(p, a)
                train_end = min(t.end(), end)
                closer = next((k for k in range(train_end - 1, a, -1) if opened.get(k, a) < a), -1)
            if closer >= e:
                was, at = opened[closer], closer + 1
            if was < 0 or (at < len(p) and around[at - 1] != was and around[at - 1] >= 0):
                continue
        while at < end and p[at] in _CLOSERS and at not in opened and (around is None or around[at] < 0):
            at += 1
        if at < end and (m2 := _MARKS.match(p, at)):
            at = m2.end()
        if at >= end:
            continue
        # Marks inside an address belong to it, but for one at its end.
        while addresses and addresses[0][1] <= a:
            addresses.popleft()
        if addresses and addresses[0][0] <= a and addresses[0][1] > e:
            continue
        g = at
        while g < end and p[g].isspace():
            g += 1
        out.append(Candidate(at, m.group(), _previous(p, a), _next(p, at), p[at:g], p[g], was >= 0 or at > e, was >= 0 and _before_colon(p, was), was, was >= 0 and p[was] in "([（【"))
    if packed:
        for m in _BLANK_ENDS.finditer(p):
            if around is None or around[m.start()] < 0:
                i = m.start()
                out.append(Candidate(i, " ", _previous(p, i), _next(p, m.end()), m.group(), p[m.end()]))
        out.sort(key=lambda c: c.at)
    return out


#: Bits of a candidate's flags.
(_DOT, _ASKS, _IS_FULL, _DOTS, _BLANK, _NO_GAP, _BREAKS, _LOWER, _UPPER, _DIGIT, _LETTER, _SIGN, _OPENS, _CLOSED, _COLON, _PAIR, _BRACKET, _NUM, _INITIAL, _DOTTED, _SHORT, _LOW_TEXT) = (1 << i for i in range(22))
_KINDS = ("dot", "final", "start", "total")


@lru_cache(maxsize=100_000)
def token_hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token) - (1 << 63)


@lru_cache(maxsize=4096)
def _following(ch: str) -> int:
    if ch.islower():
        return _LOWER
    if ch.isupper():
        return _UPPER
    if ch.isdigit():
        return _DIGIT
    if ch.isalpha():
        return _LETTER
    return _OPENS if ch in _OPENERS else _SIGN


def flags(c: Candidate, low_text: bool) -> int:
    """All of a candidate but its positions and tokens."""
    first, out = c.mark[0], _following(c.following)
    if first == ".":
        out |= _DOT if len(c.mark) == 1 else _DOTS * (c.mark[1] == ".")
        if len(c.mark) == 1:
            out |= _DOTTED * ("." in c.before) | _SHORT * (len(c.before) <= 3) | _NUM * (c.before == "<num>") | _INITIAL * (c.before == "<initial>")
    elif first in "!?":
        out |= _ASKS
    elif first == "…":
        out |= _DOTS
    elif first == " ":
        out |= _BLANK
    if first in _FULL:
        out |= _IS_FULL
    if not c.gap:
        out |= _NO_GAP
    elif "\n" in c.gap:
        out |= _BREAKS
    return out | _CLOSED * c.closer | _COLON * c.colon | _PAIR * (c.opened >= 0) | _BRACKET * c.bracket | _LOW_TEXT * low_text


@lru_cache(maxsize=20_000)
def _plain_flags(mark: str, gap: str, first: str, closed: bool) -> int:
    return flags(Candidate(0, mark, "word", "", gap, first, closed), False)


def _read_plain(p: str, skip: int, a: int, low: bool, out: list[tuple], dots: Counter | None, total: Counter | None) -> None:
    """The candidates of a plain paragraph as ``read`` gives them, without an object each."""
    low_bit = _LOW_TEXT * low
    for m in _PLAIN.finditer(p, skip):
        mark, gap, first = m.groups()
        at, start = m.start(2), m.start(3)
        before = _previous(p, m.start())
        f = _plain_flags(mark, gap, first, at > m.end(1)) | low_bit
        if f & _DOT:
            if "." in before:
                f |= _DOTTED
            if len(before) <= 3:
                f |= _SHORT
            if before == "<num>":
                f |= _NUM
            elif before == "<initial>":
                f |= _INITIAL
            if dots is not None and (gap or f & _CLOSED):
                dots[before] += 1
        if total is not None and "." in before:
            total[before] += 1
        out.append((a + at, a + start, -1, f, token_hash(before), token_hash(_next(p, start))))


@dataclass
class Counts:
    """Per token, by its hash: before a dot, at a paragraph's end before its dot, at a paragraph's start, overall."""

    keys: np.ndarray  # sorted
    of: np.ndarray  # one row of four a key
    totals: np.ndarray

    def look(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((len(keys), 4))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys)[:, None], self.of[at], 0.0)


def no_counts() -> Counts:
    return Counts(np.zeros(0, np.int64), np.zeros((0, 4)), np.ones(4))


def features(f: np.ndarray, before: np.ndarray, after: np.ndarray, at_start: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The classifier's view of candidates: flags, counts of the tokens around, and whether the closed pair began the sentence."""
    is_ = lambda bit: (f & bit) != 0
    dots, finals, starts, total = np.maximum(totals, 1)
    d, e, t, s, u = before[:, 0], before[:, 1], before[:, 3], after[:, 2], after[:, 3]
    log = lambda x, y: np.clip(np.log(x / y), -4.0, 3.0)
    final = log(e + 0.5, d * finals / dots + 0.5)
    begins = log(s + 0.3, u * starts / total + 0.3)
    bare = log(np.maximum(0, t - d) + 1.0, d + 1.0)
    dot, gapless, lower, low, colon, pair = is_(_DOT), is_(_NO_GAP), is_(_LOWER), is_(_LOW_TEXT), is_(_COLON), is_(_PAIR)
    at_start = at_start & pair
    return np.column_stack([
        np.ones(len(f)), dot, is_(_ASKS), is_(_IS_FULL), is_(_DOTS), is_(_BLANK), gapless, gapless & dot, is_(_BREAKS), lower & ~low, lower & low,
        is_(_UPPER), is_(_DIGIT), is_(_LETTER), is_(_SIGN), is_(_OPENS), is_(_CLOSED), colon, at_start & ~colon & ~is_(_BRACKET), at_start & is_(_BRACKET), pair & ~at_start & ~colon,
        dot & is_(_NUM), dot & is_(_INITIAL), dot & is_(_DOTTED), dot & is_(_SHORT),
        final * dot, begins, bare * dot, begins * dot, begins * is_(_CLOSED), begins * gapless, begins * (dot & is_(_NUM)),
    ])


def careless(text: str, spans: list[tuple[int, int]]) -> bool:
    """Whether a text doesn't start its sentences with capitals."""
    low = high = 0
    for a, b in spans:
        m = _LETTERS.search(text, a, b)
        if m and m.group().islower():
            low += 1
        elif m and m.group().isupper():
            high += 1
    return 2 * low >= high and low > 0


_LETTERS = re.compile(r"[^\W\d_]")
_STRIPPED = "".join(_CLOSERS)


def read(text: str, into: dict[str, Counter] | None = None) -> tuple[list[int], list[tuple]]:
    """One text: (start, end, ...) of its paragraphs without blanks at either end, and its candidates
    as (at, next, opened, flags, before, after), tokens as hashes, positions from the text's start.

    ``into`` gets the counts: of tokens by kind, of words as they stand under 'words'.
    """
    spans = paragraphs(text)
    low = careless(text, spans)
    ends: list[int] = []
    out: list[tuple] = []
    for a, b in spans:
        p = text[a:b]
        bare = p.rstrip()
        lead = len(p) - len(p.lstrip())
        if not bare:
            continue
        ends += [a + lead, a + len(bare)]
        skip = m.end() if (m := _LIST.match(p)) else 0
        found: list[Candidate] = []
        if _is_plain(p):
            _read_plain(p, skip, a, low, out, into and into["dot"], into and into["total"])
        else:
            found = candidates(p)
        for c in found:
            out.append((a + c.at, a + c.at + len(c.gap), a + c.opened if c.opened >= 0 else -1, flags(c, low), token_hash(c.before), token_hash(c.after)))
        if into is None:
            continue
        into["words"].update(_WORD.findall(p, skip) if skip else _WORD.findall(p))
        into["start"][_next(p, skip)] += 1
        tail = bare.rstrip(_STRIPPED).rstrip()
        if tail.endswith(".") and not tail.endswith("..") and len(tail) > skip:
            i = len(tail) - 1
            last = _previous(tail, i)
            into["dot"][last] += 1
            into["final"][last] += 1
        for c in found:
            if c.mark == "." and (c.gap or c.closer):
                into["dot"][c.before] += 1
            if "." in c.before:
                into["total"][c.before] += 1
    return ends, out


def new_counters() -> dict[str, Counter]:
    return {k: Counter() for k in ("dot", "final", "start", "total", "words")}


def gathered(into: dict[str, Counter]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts by kind) of what ``read`` counted; words become tokens once each."""
    total = into["total"]
    for w, n in into["words"].items():
        for t in word_tokens(w):
            total[t] += n
    tokens = list(set().union(*(into[k] for k in _KINDS)))
    return np.array([token_hash(t) for t in tokens], np.int64), np.array([[into[k][t] for k in _KINDS] for t in tokens], np.int64).reshape(len(tokens), 4)


def training_rows(text: str) -> Iterator[tuple[int, str, str, bool, bool, int]]:
    """(flags, before, after, own, at_start, kind) of sure boundaries (kind 1), of candidates that are none
    if their tokens say so (kind 0), and of those that are none in any case (kind -1)."""
    spans = paragraphs(text)
    parts = [text[a:b] for a, b in spans]
    low = careless(text, spans)
    for k, p in enumerate(parts):
        body = p[m.end() :] if (m := _LIST.match(p)) else p
        inner = candidates(body)
        # True: this paragraph's end, as if the next paragraph followed after a blank, or after none.
        if k + 1 < len(parts) and not _LIST.match(parts[k + 1]):
            left, right = body.rstrip(), parts[k + 1].lstrip()
            thai = bool(_BLANK_ENDS.match(left[-1:] + " " + right[:1], 1))
            closed = left.rstrip(_STRIPPED).rstrip()
            m = re.search(r"[.!?…。！？．｡।॥؟۔]+$", closed)
            if m or thai:
                for gap in (" ", "", " "):
                    if thai and not gap:
                        continue
                    _, opened = _pairs(left)
                    was = opened.get(len(left) - 1, -1) if m else -1
                    i = m.start() if m else len(closed)
                    c = Candidate(len(left), m.group() if m else " ", _previous(closed, i), _next(right, 0), gap, right[0], bool(m) and len(closed) < len(left), was >= 0 and _before_colon(left, was), was, was >= 0 and left[was] in "([（【")
                    start = max([x.at for x in inner if x.at < len(left)] + [0])
                    while start < len(left) and left[start].isspace():
                        start += 1
                    yield flags(c, low), c.before, c.after, True, c.opened <= start, 1
        start = 0
        for c in inner:
            ch = c.following
            sure = ch in ",;:)%，；：、" or (not c.gap and c.mark == "." and not c.closer and (ch.islower() or ch.isdigit()))
            sure = sure or (bool(c.gap) and ch.islower() and not low)
            yield flags(c, low), c.before, c.after, False, c.opened <= start, -1 if sure else 0
            if not sure:
                start = c.at + len(c.gap)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of the maximum-entropy (logistic) model by Newton steps; classes weigh the same."""
    if len(y) == 0 or y.min() == y.max():
        # Nothing to learn from: marks followed by a blank end a sentence.
        w = np.zeros(x.shape[1])
        w[[0, 6, 9]] = 1.0, -4.0, -4.0
        return w
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (q - y)) + ridge * w
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_rows(rows: list[tuple[int, str, str, bool, bool, int]], n: Counts) -> np.ndarray:
    """The classifier from training rows and the counts of their tokens."""
    f, own, at_start, kind = (np.array([r[i] for r in rows], t) for i, t in ((0, np.int64), (3, bool), (4, bool), (5, np.int64)))
    before, after = (n.look(np.array([token_hash(r[i]) for r in rows], np.int64)) for i in (1, 2))
    dot, num = (f & _DOT) != 0, (f & _NUM) != 0
    # A sure abbreviation hardly ever ends a paragraph; no number starts one after a numbered dot.
    short = dot & ((f & _CLOSED) == 0) & (before[:, 0] >= SURE_DOTS) & (before[:, 1] <= SURE_SHARE * before[:, 0])
    rank = dot & num & (after[:, 3] >= SURE_DOTS) & (after[:, 2] <= SURE_SHARE * after[:, 3] / 10)
    kept = (kind != 0) | short | rank
    y = (kind == 1).astype(float)
    # A boundary's own paragraph is taken out of the counts.
    before, after = before.copy(), after.copy()
    before[own] = np.maximum(0, before[own] - np.array([1, 1, 0, 1]))
    after[own] = np.maximum(0, after[own] - np.array([0, 0, 1, 1]))
    return fit(features(f, before, after, at_start, n.totals)[kept], y[kept])


def boundaries(spans: list[np.ndarray], found: list[np.ndarray], tokens: list[np.ndarray], n: Counts, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the sentences of texts, from what ``read`` gives of each as arrays."""
    found = [x.reshape(-1, 4) for x in found]
    sizes, edges = np.array([len(x) for x in found], np.int64), np.array([len(x) // 2 for x in spans], np.int64)
    c = np.concatenate(found).astype(np.int64) if len(found) else np.zeros((0, 4), np.int64)
    k = np.concatenate([x.reshape(-1, 2) for x in tokens]) if len(tokens) else np.zeros((0, 2), np.int64)
    text = np.repeat(np.arange(len(found)), sizes)
    para = np.concatenate(spans).reshape(-1, 2).astype(np.int64) if len(spans) else np.zeros((0, 2), np.int64)
    of = np.repeat(np.arange(len(spans)), edges)
    before, after = n.look(k[:, 0]), n.look(k[:, 1])
    score = features(c[:, 3], before, after, np.zeros(len(c), bool), n.totals) @ w
    accepted = score > 0
    pair = np.nonzero(c[:, 2] >= 0)[0]
    if len(pair):
        # Whether a pair began its sentence depends on the boundary before; all others stand.
        at_start = features(c[pair, 3], before[pair], after[pair], np.ones(len(pair), bool), n.totals) @ w > 0
        # Paragraph of each candidate: the last that starts at or before it.
        width = int(max(para.max(initial=0), c[:, :2].max(initial=0))) + 1
        home = np.searchsorted(of * width + para[:, 0], text[pair] * width + c[pair, 0], side="right") - 1
        for i, h, first in zip(pair.tolist(), home.tolist(), at_start.tolist()):
            j, lead = i - 1, int(para[h, 0])
            while j >= 0 and text[j] == text[i] and c[j, 0] > lead and not accepted[j]:
                j -= 1
            if j >= 0 and text[j] == text[i] and c[j, 0] > lead:
                lead = int(c[j, 1])
            if c[i, 2] <= lead:
                accepted[i] = first
    cut = np.nonzero(accepted)[0]
    starts, ends = np.concatenate([para[:, 0], c[cut, 1]]), np.concatenate([c[cut, 0], para[:, 1]])
    by_start, by_end = np.concatenate([of, text[cut]]), np.concatenate([text[cut], of])
    order, last = np.lexsort((starts, by_start)), np.lexsort((ends, by_end))
    a, b, row = starts[order], ends[last], by_start[order]
    kept = a < b
    return row[kept], a[kept], b[kept]


def split(text: str, n: Counts, w: np.ndarray) -> list[tuple[int, int]]:
    """Sentences of one text as code point offsets, end exclusive, without blanks at either end."""
    ends, found = read(text)
    rows = np.array(found, np.int64).reshape(-1, 6)
    _, a, b = boundaries([np.array(ends, np.int64)], [rows[:, :4]], [rows[:, 4:]], n, w)
    return list(zip(a.tolist(), b.tolist()))


def _binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in parts], pa.binary())


def read_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document (id, chunk, spans, found, tokens), and rows without an id that hold the counts
    (found: keys, tokens: counts) and the tokens that a chunk needs (tokens); written once."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_")).withColumn("chunk", (F.monotonically_increasing_id() / CHUNK_DOCUMENTS).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id_", "part", "chunk", "spans", "found", "tokens"]
        for batch in batches:
            into = new_counters()
            spans, found, tokens = [], [], []
            for text in batch.column(1).to_pylist():
                ends, rows = read(text, into) if text else ([], [])
                rows = np.array(rows, np.int64).reshape(-1, 6)
                spans.append(np.array(ends, np.int32))
                found.append(rows[:, :4].astype(np.int32))
                tokens.append(np.ascontiguousarray(rows[:, 4:]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.zeros(len(spans), np.int32)), batch.column(2), _binary(spans), _binary(found), _binary(tokens)], names=names)
            chunk = batch.column(2).to_numpy(zero_copy_only=False)
            chunks = np.unique(chunk)
            need = [np.unique(np.concatenate([tokens[i].ravel() for i in np.nonzero(chunk == x)[0]])) for x in chunks]
            keys, counts = gathered(into)
            nothing = [np.zeros(0, np.int32)] * len(need)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(need) + 1, batch.schema.field(0).type), pa.array(np.r_[np.full(len(need), 2), 1].astype(np.int32)), pa.array(np.r_[chunks, -1].astype(np.int64)), _binary([*nothing, nothing[0] if nothing else np.zeros(0, np.int32)]), _binary([*nothing, keys]), _binary([*need, counts])],
                names=names,
            )

    return written(src.mapInArrow(run, f"id_ {kind}, part int, chunk long, spans binary, found binary, tokens binary"), "sentences")


def _numbers(x: pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(v, kind) for v in x.to_pylist()]


def corpus_counts(parsed: DataFrame) -> DataFrame:
    """(key, dot, final, start, total) of all tokens of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(_numbers(batch.column(0), np.int64), _numbers(batch.column(1), np.int64)):
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.ascontiguousarray(c)) for c in counts.reshape(-1, 4).T)], names=["key", *_KINDS])

    flat = parsed.where("part = 1").select("found", "tokens").mapInArrow(run, "key long, dot long, final long, start long, total long")
    return flat.groupBy("key").agg(*(F.sum(k).alias(k) for k in _KINDS))


def _chunk_tokens(parsed: DataFrame) -> DataFrame:
    """(of_chunk, key): the tokens next to the candidates of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _numbers(batch.column(1), np.int64)
            chunk = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))], names=["of_chunk", "key"])

    return parsed.where("part = 2").select("chunk", "tokens").mapInArrow(run, "of_chunk long, key long").distinct()


def _as_counts(rows: pa.Table, totals: np.ndarray) -> Counts:
    keys = rows.column("key").to_numpy()
    order = np.argsort(keys)
    return Counts(keys[order], np.column_stack([rows.column(k).to_numpy() for k in _KINDS])[order].astype(float).reshape(-1, 4), totals)


def train(docs: DataFrame, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(counts of all tokens by kind, weights): the classifier, fitted on a bounded sample of the documents."""
    spark = docs.sparkSession
    totals = np.array([float(x or 0) for x in counts.agg(*(F.sum(k) for k in _KINDS)).first()])
    some = docs.where(F.length(text_col) > 0).orderBy(F.xxhash64(id_col), id_col).limit(FIT_DOCUMENTS).select(text_col).toPandas()
    rows = [r for text in some[text_col] for r in training_rows(text)]
    # The sample bounds the tokens asked for.
    keys = spark.createDataFrame(pa.table({"key": pa.array(sorted({token_hash(t) for r in rows for t in r[1:3]}), pa.int64())})) if rows else None
    n = _as_counts(counts.join(keys, "key").toArrow(), totals) if rows else no_counts()
    return totals, fit_rows(rows, n)


def local_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Counts, np.ndarray]:
    """The whole model in memory, to split single texts with: for small collections."""
    counts = corpus_counts(read_documents(docs, id_col, text_col))
    totals, w = train(docs, counts, id_col, text_col)
    return _as_counts(counts.toArrow(), totals), w


def split_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, start_at INT, end_at INT), one row per sentence of every document.

    Null, empty and blank texts and texts of code alone have none; repeated rows of a document
    come out repeated, null ids stay null. The text is read once and never shuffled.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    parsed = read_documents(docs, id_col, text_col)
    counts = written(corpus_counts(parsed), "counts")
    model = spark.sparkContext.broadcast(train(docs, counts, id_col, text_col))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        totals, w = model.value
        row, a, b = boundaries(*(_numbers(left.column(c), t) for c, t in (("spans", np.int32), ("found", np.int32), ("tokens", np.int64))), _as_counts(right, totals), w)
        return pa.table({"id_": left.column("id_").combine_chunks().take(pa.array(row)), "start_at": pa.array(a.astype(np.int32)), "end_at": pa.array(b.astype(np.int32))})

    held = _chunk_tokens(parsed).join(counts, "key")
    kind = docs.schema[id_col].dataType.simpleString()
    found = parsed.where("part = 0").groupBy("chunk").cogroup(held.groupBy("of_chunk")).applyInArrow(run, f"id_ {kind}, start_at int, end_at int")
    return found.withColumnRenamed("id_", id_col)

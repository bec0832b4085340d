"""Noise of scanned pages: broken words, wrongly read characters, running lines and page marks; and repair of the text.

A noisy channel, fitted on the corpus itself. Spark counts words, pairs of words and Han trigrams over all texts; the
language model are all forms that occur ``LEAST`` times. Its ``WORDS``, ``PAIRS`` and ``TRIGRAMS`` most frequent are
broadcast, and a sketch of at most ``SKETCH`` bits of the rest: a text that asks for a form of the rest is set aside
with what it asks for, gets those counts by a join, and is read again, until it asks for nothing more. The probability of each character confusion is estimated by Spark from the counts: rare words one confusion away from a
frequent one, and rare Han trigrams that differ in the middle from a trigram that dominates their context. A record's
lines are read one by one; running lines and page marks fall out, broken words are joined, and where a word or a Han
trigram is improbable the line is decoded by Viterbi over the candidates that the confusions allow; words without
candidates have one state, at which the search falls apart, so only runs of doubtful words are decoded. How often a form
occurs counts only beside its candidates, never by itself, so that a misreading stays one however large the corpus.

Defined results
* null, empty and blank texts have no noise, and their repaired text is the same; every other text comes out with its
  wrapped lines joined and each wrong character mended, whether or not that makes a noise;
* a line of less than ``WRAPPED`` of the widest one's width, and one that begins a list or a table, ends with its line;
* a page mark is a line of nothing but a page number in one of its usual writings; a number that ends a sentence is none;
* a running line is a line that repeats the document's title, cut or in capitals, misread or not, with or without a
  page number, a company before it or a note after it; a sentence that cites the title is none;
* one wrongly read character alone, and wrong characters in running lines, are no ``misread``; neither are words with
  letters of other scripts;
* rows of one id count once with the noise of all its texts; texts are read whole; empty tables give no rows.
"""

from __future__ import annotations

import difflib
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.spans import pieces
from quire.tables import cut

#: Entries of the language model that are broadcast, and bits of the sketch of the rest, at most.
WORDS, PAIRS, TRIGRAMS, SKETCH = 200_000, 400_000, 500_000, 1 << 27
#: How much more frequent a word or trigram has to be than its misread form, and occurrences a model entry needs.
RATIO, LEAST = 25, 3
#: The part of a page's widest line that a line has at least if the text runs on in the next.
WRAPPED = 0.4
#: Words and stretches of Han characters whose decoding a task remembers.
KEPT = 200_000
#: The log probability of a confusion that the corpus doesn't show, and the gain a correction has to bring.
UNSEEN, GAIN = math.log(1e-5), 2.0
#: Latin shapes that scanning confuses, what is read and what stood there.
SHAPES = [
    ("rn", "m"), ("m", "rn"), ("vv", "w"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("li", "h"), ("nn", "m"), ("0", "o"), ("0", "O"), ("1", "l"), ("1", "i"), ("1", "I"), ("l", "i"), ("i", "l"), ("I", "l"),
    ("l", "I"), ("5", "s"), ("5", "S"), ("9", "g"), ("6", "b"), ("8", "B"), ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("f", "t"), ("t", "f"), ("n", "u"), ("u", "n"), ("q", "g"), ("g", "q"), ("v", "y"), ("a", "o"), ("o", "a"), ("2", "z"),
]
#: Han characters that scanning confuses, what is read before what stood there.
HAN_SHAPES = "坏环 庄压 夭天 科料 料科 侧测 测侧 品晶 捡检 纸低 休体 攻改 顶预 没设 淘陶 读续 堤提 待持 持待 徽微 坪评 未末 末未 土士 士土 己已 已己 日曰 人入 入人 大太 干千 千干 乌鸟 木术 析折 折析 侯候 候侯 住往 往住 拔拨 拨拔 治冶 冶治 晴睛 代伐 免兔 令今 今令 母毋 白自 自白 问间 间问 圆园 历厉 厉历 找我 栽裁 贷货 货贷 辨辩 狠狼 刀力 力刀 甲申 申甲 田由 由田 王主 主王 目日 率卒 向问 线钱 值植 植值".split()

_BREAK = re.compile(r"\r\n|\n|\r")
_NUMBER = r"\d{1,4}"
_CORE = rf"第\s*{_NUMBER}\s*页(?:\s*[,，/]?\s*共\s*{_NUMBER}\s*页)?|(?:page|pg|p)\s*\.?\s*{_NUMBER}(?:\s*(?:of|/)\s*{_NUMBER})?|{_NUMBER}\s*/\s*{_NUMBER}|{_NUMBER}\s+of\s+{_NUMBER}|{_NUMBER}\s*页?"
PAGE_MARK = re.compile(rf"[-–—·•~*|=〔\[【(（<〈\s]*(?:{_CORE})[-–—·•~*|=〕\]】)）>〉\s]*", re.I)
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑–¬­][ \t]*\n[ \t]*(?=[^\W\d_])")
_LATIN = re.compile(r"[0-9A-Za-zÀ-ɏ]*[A-Za-zÀ-ɏ][0-9A-Za-zÀ-ɏ]*")
_LETTERS = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[​-‏⁠-⁤﻿]")
_PLAIN = re.compile(r"[\W_]+")
_WRAPPED = re.compile(r"[^\s.。|：:!?！？;；]\r?\n[^\s|\-•*#\d]")
_KEEP = re.compile(r"\s*(?:[-*•●·▪|>#]|\d+[.)、]\s|\d+\.\d+\s|（[一二三四五六七八九十]+）)")


def plain_title(title: str) -> str:
    """A title or file name without ending, hash and punctuation, in lower case."""
    stem = re.sub(r"\.(?:pptx?|docx?|pdf)$", "", title, flags=re.I)
    return _PLAIN.sub("", re.sub(r"_[0-9a-f]{8}$", "", stem)).lower()


def is_page_mark(line: str) -> bool:
    s = line.strip()
    return 0 < len(s) <= 28 and PAGE_MARK.fullmatch(s) is not None


def is_running_line(line: str, title: str) -> bool:
    """Whether a line is the running line of a document with this plain title."""
    s = line.strip()
    if len(title) < 6 or not 6 <= len(s) <= len(title) + 90:
        return False
    rest, marks = s, 0
    for pattern in (rf"^{_NUMBER}\s*[|·]\s*", rf"(?:\s{{2,}}|\s*[|·]\s*){_NUMBER}$", r"\s*\|\s*[^|]{2,30}$", r"^[^·|]{2,40}\s·\s"):
        rest, n = re.subn(pattern, "", rest)
        marks += n
    r = _PLAIN.sub("", rest).lower()
    if len(r) < (5 if re.search(r"[一-鿿]", r) else 10) or not marks and len(r) < 0.75 * len(title) or len(r) > len(title) + 4:
        return False
    head = title[: len(r)]
    if r == head:
        return True
    wrong = sum(a != b for a, b in zip(r, head))
    return wrong <= max(1, len(r) // 6) or difflib.SequenceMatcher(None, r, title[: len(r) + 1], autojunk=False).ratio() >= 0.84


# --- counting -------------------------------------------------------------------------------------------------------


def han_stream(texts: list[str]) -> np.ndarray:
    """Code points of all texts without white space, numbers as one 0, texts apart by a zero."""
    points = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    digit = (points >= 48) & (points < 58) | (points == 44) | (points == 46)
    points = np.where(digit, np.uint32(48), points)
    space = (points == 32) | (points == 10) | (points == 13) | (points == 9) | (points == 0x3000)
    points = points[~space]
    return points[np.concatenate([[True], (points[1:] != 48) | (points[:-1] != 48)])] if len(points) else points


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter[str] = Counter()
    pairs: Counter[tuple[str, str]] = Counter()
    han: dict[str, dict[int, int]] = {"h": defaultdict(int), "s": defaultdict(int)}

    def out(kind: str, keys: list[str], n: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(keys), pa.string()), "gram": pa.array(keys, pa.string()), "n": pa.array(n, pa.int64())})

    def flush() -> Iterator[pa.RecordBatch]:
        yield out("w", list(words), list(words.values()))
        yield out("p", [f"{a} {b}" for a, b in pairs], list(pairs.values()))
        for kind, grams in han.items():
            yield out(kind, [chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF) for k in grams], list(grams.values()))
            grams.clear()
        words.clear(), pairs.clear()

    for batch in batches:
        for part in pieces(batch, 0, 4_000_000):
            texts = part.column(0).to_pylist()
            for text in texts:
                tokens = _LATIN.findall(_HYPHEN.sub("", text) if "\n" in text else text)
                if tokens:
                    words.update(tokens)
                    pairs.update(zip(tokens, tokens[1:]))
            for kind, own in (("h", texts), ("s", [t for t in texts if _WRAPPED.search(t)])):
                s = han_stream(own).astype(np.uint64)
                if len(s) > 2:
                    mid = (s[1:-1] >= 0x4E00) & (s[1:-1] < 0xA000) & (s[:-2] > 0) & (s[2:] > 0)
                    code, n = np.unique((s[:-2] << np.uint64(42) | s[1:-1] << np.uint64(21) | s[2:])[mid], return_counts=True)
                    grams = han[kind]
                    for k, c in zip(code.tolist(), n.tolist()):
                        grams[k] += c
            if len(words) + len(pairs) + sum(map(len, han.values())) > 1_500_000:
                yield from flush()
    yield from flush()


def gram_counts(texts: DataFrame) -> DataFrame:
    """``(kind, gram, n)`` over all texts: w words, p pairs of words, h Han trigrams, s those of texts with wrapped lines."""
    return texts.mapInArrow(_counts, "kind string, gram string, n long").groupBy("kind", "gram").agg(F.sum("n").alias("n"))


def replacements(word: str) -> Iterator[tuple[str, tuple[str, str]]]:
    """Words one confusion away, and the confusion."""
    for read, true in SHAPES:
        at = word.find(read)
        while at >= 0:
            yield word[:at] + true + word[at + len(read) :], (read, true)
            at = word.find(read, at + 1)


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(word, n, c, *shape) for word, n in zip(*(c.to_pylist() for c in batch.columns)) for c, shape in replacements(word)]
        columns = zip(*rows) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["gram", "n", "other", "read", "true"])


def misread_words(words: DataFrame) -> DataFrame:
    """``(gram, n, read, true)`` of words one confusion away from one that is ``RATIO`` times as frequent, the most frequent of these."""
    frequent = words.where(F.col("n") >= RATIO).select(F.col("gram").alias("other"), F.col("n").alias("m"))
    found = words.select("gram", "n").mapInArrow(_replaced, "gram string, n long, other string, read string, true string").join(frequent, "other").where(F.col("m") >= RATIO * F.col("n"))
    return found.groupBy("gram", "n").agg(F.max(F.struct("m", "read", "true")).alias("top")).select("gram", "n", "top.read", "top.true")


def han_confusions(grams: DataFrame) -> DataFrame:
    """``(read, true, n)``: middles of rare trigrams under the middle that dominates their context.

    A confusion belongs to scanned pages: four fifths of its occurrences have to stand in texts with wrapped lines.
    """
    wrapped = grams.where("kind = 's'").select("gram", F.col("n").alias("wrapped"))
    whole = grams.where("kind = 'h'").join(wrapped, "gram", "left")
    middle = whole.select(F.substring("gram", 1, 1).alias("a"), F.substring("gram", 2, 1).alias("read"), F.substring("gram", 3, 1).alias("b"), "n", F.coalesce("wrapped", F.lit(0)).alias("wrapped"))
    top = middle.groupBy("a", "b").agg(F.max(F.struct("n", "read")).alias("top")).where(f"top.n >= {RATIO}")
    rare = middle.join(top, ["a", "b"]).where(f"n * {RATIO} <= top.n")
    pairs = rare.groupBy("read", F.col("top.read").alias("true")).agg(F.sum("n").alias("n"), F.sum("wrapped").alias("wrapped"))
    return pairs.where(f"n >= {LEAST} AND wrapped >= 0.8 * n").select("read", "true", "n")


class Model:
    """The language model and the channel."""

    def __init__(self, words: dict[str, int], pairs: dict[str, int], trigrams: dict[str, int], latin: dict[tuple[str, str], float], han: dict[str, dict[str, float]], floors: tuple[int, int] = (0, 0), total: int | None = None, sketch: bytes | None = None):
        self.words, self.pairs, self.trigrams, self.latin, self.han, self.floors = words, pairs, trigrams, latin, han, floors
        self.most = max(words.values(), default=0)
        self.total = (sum(words.values()) if total is None else total) + 1
        self.sketch, self.known, self.missing = sketch, {}, []  # of the rest: its sketch, the counts at hand, and what was asked for beside
        self.suspects = re.compile("[" + re.escape("".join(han)) + "]") if han else None
        self.options: dict[str, list[tuple[str, float, int]]] = {}
        self.asked: dict[str, list[str]] = {}
        self.decoded: dict[tuple[str, tuple[int, ...]], list[tuple[int, str]]] = {}

    def rest(self, kind: str, gram: str) -> int:
        """The count of a form that is not among those broadcast."""
        if self.sketch is None:
            return 0
        n = self.known.get(kind + gram)
        if n is None and all(self.sketch[at >> 3] >> (at & 7) & 1 for at in sketch_places(kind + gram, 8 * len(self.sketch))):
            self.missing.append(kind + gram)
        return n or 0

    def word(self, word: str) -> int:
        return self.words.get(word) or self.rest("w", word)

    def trigram(self, gram: str) -> int:
        return self.trigrams.get(gram) or self.rest("h", gram)

    def count(self, word: str) -> int:
        n = self.word(word)
        if word[:1].isupper():
            n = max(n, self.word(word.lower()), self.word(word.capitalize()) if word.isupper() else 0)
        return n

    def candidates(self, word: str) -> list[tuple[str, float, int]]:
        """Words that may have stood there: the word, its channel log probability, and confusions undone."""
        options = self.options.get(word)
        if options is None:
            if len(self.options) > KEPT:
                self.options.clear()
            asked = self.asked.get(word)
            if asked and not all(key in self.known for key in asked):  # as before, in vain
                self.missing += asked
                return [(word, 0.0, 0)]
            before, options = len(self.missing), self._candidates(word)
            if len(self.missing) == before:
                self.options[word] = options
            else:
                if len(self.asked) > KEPT:
                    self.asked.clear()
                self.asked[word] = list(dict.fromkeys(self.missing[before:]))
        return options

    def _candidates(self, word: str) -> list[tuple[str, float, int]]:
        own = self.count(word) or self.floors[0]
        found = {word: (0.0, 0)}
        if self.most < RATIO * own:
            return [(word, 0.0, 0)]
        front = {word: (0.0, 0)}
        for _ in range(3):
            step: dict[str, tuple[float, int]] = {}
            for w, (p, k) in front.items():
                for c, shape in replacements(w):
                    q = p + self.latin.get(shape, UNSEEN)
                    if c not in found and (c not in step or step[c][0] < q):
                        step[c] = (q, k + 1)
            good = {c: v for c, v in step.items() if self.count(c) >= RATIO * max(own, 0.2)}
            found |= good
            if good:
                break
            front = step
        return [(c, p, k) for c, (p, k) in found.items()]

    def word_score(self, before: str, word: str) -> float:
        pair = self.pairs.get(f"{before} {word}") or self.rest("p", f"{before} {word}")
        n = self.count(word)
        return math.log((pair + 0.5 * (n + 0.01) / self.total * 100) / (self.count(before) + 50)) if before else math.log((n + 0.01) / self.total)


def viterbi(options: list[list[tuple[str, float, int]]], score) -> list[tuple[str, float, int]]:
    """The most probable path through candidates under a score of neighbours."""
    best = [(p + score("", c), None) for c, p, _ in options[0]]
    back = [best]
    for prev, now in zip(options, options[1:]):
        best = [max((back[-1][i][0] + score(a[0], c) + p, i) for i, a in enumerate(prev)) for c, p, _ in now]
        back.append(best)
    at = max(range(len(options[-1])), key=lambda i: back[-1][i][0])
    path = []
    for opts, scores in zip(reversed(options), reversed(back)):
        path.append(opts[at])
        at = scores[at][1] if scores[at][1] is not None else 0
    return path[::-1]


def correct_latin(line: str, model: Model) -> tuple[str, int]:
    """The line with misread words replaced, and how many characters were wrong."""
    spans = [m.span() for m in _LATIN.finditer(line)]
    words = [line[a:b] for a, b in spans]
    odd = [i for i, w in enumerate(words) if len(w) > 2 and _suspicious(line, spans[i], w, model)]
    if not odd:
        return line, 0
    changed: dict[int, str] = {}
    wrong = 0
    start = 0
    while start < len(odd):  # a run of doubtful words, between sure ones
        end = start
        while end + 1 < len(odd) and odd[end + 1] == odd[end] + 1:
            end += 1
        lo, hi, run = max(0, odd[start] - 1), min(len(words), odd[end] + 2), set(odd[start : end + 1])
        path = viterbi([model.candidates(w) if j in run else [(w, 0.0, 0)] for j, w in enumerate(words[lo:hi], lo)], model.word_score)
        for i in run:
            word, _, k = path[i - lo]
            if k:
                changed[i] = word
                wrong += k
        start = end + 1
    for i in sorted(changed, reverse=True):
        line = line[: spans[i][0]] + changed[i] + line[spans[i][1] :]
    return line, wrong


def _suspicious(line: str, span: tuple[int, int], word: str, model: Model) -> bool:
    a, b = span
    if a and line[a - 1].isalpha() and not "一" <= line[a - 1] <= "鿿" or b < len(line) and (line[b].isalpha() and not "一" <= line[b] <= "鿿" or line[b] in "­̧̀́̂̃̈̊̋"):
        return False  # part of a word with letters of another script
    return sum(c.isalpha() for c in word) * 2 > len(word) and not (word.isupper() and any(c.isdigit() for c in word)) and len(model.candidates(word)) > 1


def correct_han(text: str, model: Model) -> tuple[str, int]:
    """The text with misread Han characters replaced, and how many were wrong."""
    if model.suspects is None or not model.suspects.search(text):
        return text, 0
    stream, place = [], []
    for i, ch in enumerate(text):
        if ch in "0123456789,.":
            if not stream or stream[-1] != "0":
                stream.append("0")
                place.append(i)
        elif not ch.isspace():
            stream.append(ch)
            place.append(i)
    s = "".join(stream)
    if len(s) < 3:
        return text, 0
    out, wrong = list(text), 0
    spots = [m.start() for m in model.suspects.finditer(s)]
    start = 0
    while start < len(spots):  # spots within reach of each other are decoded together
        end = start
        while end + 1 < len(spots) and spots[end + 1] - spots[end] <= 2:
            end += 1
        lo = max(0, spots[start] - 2)
        key = s[lo : spots[end] + 3], tuple(i - lo for i in spots[start : end + 1])
        changes = model.decoded.get(key)
        if changes is None:
            if len(model.decoded) > KEPT:
                model.decoded.clear()
            before, changes = len(model.missing), _decode_han(*key, model)
            if len(model.missing) == before:
                model.decoded[key] = changes
        for i, y in changes:
            out[place[lo + i]] = y
            wrong += 1
        start = end + 1
    return "".join(out), wrong


def _decode_han(s: str, spots: tuple[int, ...], model: Model) -> list[tuple[int, str]]:
    """Viterbi over the Han candidates at the spots and the characters around them; the replacements of the best path."""
    n3 = model.trigram
    lo, hi = max(0, spots[0] - 2), min(len(s), spots[-1] + 3)
    options = {i: [(s[i], 0.0), *model.han[s[i]].items()] for i in spots}
    score = lambda a, b, c: math.log(n3(a + b + c) + 0.05) if "一" <= b <= "鿿" else 0.0
    paths: dict[tuple[str, str], tuple[float, str]] = {}
    for k in range(lo, hi):
        step: dict[tuple[str, str], tuple[float, str]] = {}
        for c, p in options.get(k, [(s[k], 0.0)]):
            if k < lo + 2:
                before = paths.items() if k > lo else [(("", ""), (0.0, ""))]
                for (_, b), (q, path) in before:
                    step[(b, c)] = max(step.get((b, c), (-math.inf, "")), (q + p, path + c))
            else:
                for (a, b), (q, path) in paths.items():
                    step[(b, c)] = max(step.get((b, c), (-math.inf, "")), (q + p + score(a, b, c), path + c))
        paths = step
    gain, best = max(paths.values())
    known = lambda a, b, c: math.log(max(n3(a + b + c), model.floors[1]) + 0.05) if "一" <= b <= "鿿" else 0.0
    own = sum(known(*s[k : k + 3]) for k in range(lo, hi - 2))
    if best == s[lo:hi] or gain - own <= GAIN:
        return []
    return [(k, y) for k, y in zip(range(lo, hi), best) if y != s[k]]


def _width(line: str) -> int:
    """The width of a line in print, where Han characters are twice as wide."""
    return len(line) + sum(c >= "⺀" for c in line)


def read_page(text: str, title: str, model: Model) -> tuple[set[str], str]:
    """The kinds of noise of one text, and the text repaired."""
    noise: set[str] = set()
    lines = []
    for line in _BREAK.split(text) if "\n" in text or "\r" in text else [text]:
        if is_page_mark(line) and len(text.strip()) > len(line.strip()):
            noise.add("pageno")
        elif is_running_line(line, title) and len(text.strip()) > len(line.strip()):
            noise.add("header")
        else:
            lines.append(line)
    body = _INVISIBLE.sub("", "\n".join(lines))

    def join(m: re.Match) -> str:
        left = _LETTERS.findall(body[max(0, m.start() - 40) : m.start()])[-1]
        right = _LETTERS.match(body, m.end()).group()
        if not right[0].islower() and not (left.isupper() and right.isupper()):
            return m.group()
        noise.add("hyphen")
        whole = model.count(left + right)
        return "-" if model.count(left) and model.count(right) and whole < min(model.count(left), model.count(right)) and whole < LEAST else ""

    body = _HYPHEN.sub(join, body)
    parts = body.split("\n")
    paragraph, paragraphs, full, width = "", [], True, max(map(_width, parts))
    for part in parts:
        before, full = full, _width(part) >= WRAPPED * width
        if not part.strip():
            paragraphs.append(paragraph)
            paragraph = ""
        elif paragraph and not before:
            paragraph = f"{paragraph}\n{part.rstrip()}"
        elif _KEEP.match(part) or _KEEP.match(paragraph.rsplit("\n", 1)[-1] if paragraph else ""):
            paragraph = f"{paragraph}\n{part.rstrip()}" if paragraph else part.rstrip()
        elif paragraph:
            tight = "⺀" <= paragraph[-1] <= "￯" or "⺀" <= part.lstrip()[0] <= "￯"
            paragraph = paragraph.rstrip() + ("" if tight else " ") + part.strip()
        else:
            paragraph = part.strip()
    paragraphs.append(paragraph)
    whole = "\n\n".join(p for p in paragraphs if p)
    fixed, wrong = correct_latin(whole, model)
    fixed, more = correct_han(fixed, model)
    if wrong + more >= 2:
        noise.add("misread")
    return noise, (fixed if text.strip() else text)


def sketch_places(key: str, size: int) -> tuple[int, int]:
    """The two bits of a key in a sketch of ``size`` bits, a power of two."""
    h = zlib.crc32(key.encode("utf-8", "surrogatepass"))
    return h & size - 1, (h * 0x9E3779B1 >> 5) & size - 1


def rest_sketch(rest: DataFrame) -> bytes:
    """The bits of all keys, of which a set without the key holds both by chance only."""
    size = min(SKETCH, 1 << max(10, (16 * rest.count()).bit_length()))
    part = min(size, 1 << 18)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([x for key in batch.column(0).to_pylist() for x in sketch_places(key, size)], np.int64)
            yield pa.RecordBatch.from_pydict({"part": pa.array(at // part), "at": pa.array(at % part)})

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(part, np.uint8)
        bits[rows["at"].to_numpy()] = 1
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    packed = rest.select("key").mapInArrow(places, "part long, at long").groupBy("part").applyInPandas(pack, "part long, bits binary")
    bits = {r.part: bytes(r.bits) for r in packed.collect()}  # of bounded size: SKETCH bits
    return b"".join(bits.get(k, bytes(part // 8)) for k in range(size // part))


def fit_model(texts: DataFrame) -> tuple[Model, DataFrame | None]:
    """The model of a corpus, and ``(key, n)`` of its forms beyond those that are broadcast, if any."""
    grams = cut(gram_counts(texts))
    sure = lambda kind: grams.where((F.col("kind") == kind) & (F.col("n") >= LEAST))
    misread = cut(misread_words(grams.where("kind = 'w'")))
    latin = {(r.read, r.true): r.n for r in misread.groupBy("read", "true").agg(F.sum("n").alias("n")).collect()}  # bounded by SHAPES
    wrong = misread.where(F.col("n") >= LEAST).select("gram")
    pairs = sure("p").withColumn("a", F.substring_index("gram", " ", 1)).withColumn("b", F.substring_index("gram", " ", -1))
    for side in "ab":
        pairs = pairs.join(wrong.withColumnRenamed("gram", side), side, "left_anti")
    forms = cut(sure("w").join(wrong, "gram", "left_anti").unionByName(pairs.drop("a", "b")).unionByName(sure("h")))
    kept, rest = {}, None
    for kind, most in (("w", WORDS), ("p", PAIRS), ("h", TRIGRAMS)):
        own = forms.where(F.col("kind") == kind)
        kept[kind] = {r.gram: r.n for r in own.orderBy(F.desc("n"), "gram").limit(most).collect()}
        if len(kept[kind]) == most:
            last, least = next(reversed(kept[kind].items()))
            left = own.where((F.col("n") < least) | (F.col("n") == least) & (F.col("gram") > last))
            rest = left if rest is None else rest.unionByName(left)
    if rest is not None:
        rest = cut(rest.select(F.concat("kind", "gram").alias("key"), "n"))
        rest = None if rest.isEmpty() else rest
    total = forms.where("kind = 'w'").agg(F.sum("n")).first()[0] or 0
    letters = Counter({r.c: r.n for r in forms.where("kind = 'w'").select(F.explode(F.split("gram", "")).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n")).collect()})  # bounded by the script
    middles = forms.where("kind = 'h'").groupBy(F.substring("gram", 2, 1).alias("read")).agg(F.sum("n").alias("m"))
    channel = {s: math.log(max(latin.get(s, 0), 0.01) / (letters[s[1][0]] + 100)) for s in SHAPES}
    table: dict[str, dict[str, float]] = defaultdict(dict)
    for pair in HAN_SHAPES:
        table[pair[0]][pair[1]] = math.log(1e-3)
    of = Counter({r.read: r.m for r in middles.collect()})
    han = han_confusions(grams).join(middles, "read", "left").where((F.col("n") >= 0.5 * F.coalesce("m", F.lit(0))) | F.concat("read", "true").isin(HAN_SHAPES))
    for r in han.collect():  # bounded by the script
        table[r.read][r.true] = max(math.log(r.n / (of[r.true] + 100)), table[r.read].get(r.true, -99))
    return Model(kept["w"], kept["p"], kept["h"], channel, dict(table), (0, 0), total, None if rest is None else rest_sketch(rest)), rest


def _read(records: DataFrame, model: Model, rest: DataFrame | None, repaired: bool) -> DataFrame:
    """``(record_kind, record_id, value)`` of each text: its kinds of noise, or itself repaired."""
    shared = records.sparkSession.sparkContext.broadcast((model.words, model.pairs, model.trigrams, model.latin, model.han, model.floors, model.total - 1, model.sketch))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        titles: dict[str, str] = {}
        for batch in batches:
            kinds, ids, out, again = [], [], [], []
            for kind, rid, title, text, known in zip(*(c.to_pylist() for c in batch.columns)):
                t = titles.get(title)
                if t is None:
                    if len(titles) > 100_000:
                        titles.clear()
                    t = titles[title] = plain_title(title or "")
                own.known, own.missing = {k["key"]: k["n"] for k in known or []}, []
                noise, fixed = read_page(text, t, own)
                if own.missing:
                    again.append((kind, rid, title, text, known or [], list(dict.fromkeys(own.missing))))
                    continue
                for value in [fixed] if repaired else sorted(noise):
                    kinds.append(kind)
                    ids.append(rid)
                    out.append(value)
            done, nothing = len(out), [None] * len(out)
            columns = [[*x, *y] for x, y in zip((kinds, ids, nothing, nothing, nothing, nothing), zip(*again))] if again else [kinds, ids, nothing, nothing, nothing, nothing]
            kind_of = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("key", pa.string()), ("n", pa.int64())])), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(columns, kind_of)), pa.array([*out, *[None] * (len(columns[0]) - done)], pa.string())], names=["record_kind", "record_id", "title", "text", "known", "missing", "value"])

    known = "array<struct<key:string,n:bigint>>"
    texts = records.where(F.col("record_id").isNotNull() & F.col("text").isNotNull()).select("record_kind", "record_id", "title", "text", F.lit(None).cast(known).alias("known"))
    look = lambda df: df.mapInArrow(read, f"record_kind string, record_id string, title string, text string, known {known}, missing array<string>, value string")
    seen = look(texts)
    if rest is None:
        return seen.select("record_kind", "record_id", "value")
    parts = []
    while True:  # every round a text knows more of what it asks for
        seen = cut(seen)
        parts.append(seen.where("missing IS NULL").select("record_kind", "record_id", "value"))
        left = seen.where("missing IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
        if left.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        asked = left.select("row", F.explode("missing").alias("key")).join(rest, "key", "left").groupBy("row").agg(F.collect_list(F.struct("key", F.coalesce("n", F.lit(0)).cast("long").alias("n"))).alias("more"))
        seen = look(left.join(asked, "row").select("record_kind", "record_id", "title", "text", F.concat("known", "more").alias("known")))


def page_noise(records: DataFrame) -> DataFrame:
    """``(record_kind, record_id, noise)`` of ``records (record_kind, record_id, title, text)``."""
    model, rest = fit_model(records.where(F.col("text").isNotNull()).select("text"))
    return _read(records, model, rest, False).withColumnRenamed("value", "noise").distinct()


def repaired_texts(records: DataFrame) -> DataFrame:
    """``(record_kind, record_id, text)``: each text as continuous paragraphs without its noise."""
    model, rest = fit_model(records.where(F.col("text").isNotNull()).select("text"))
    return _read(records, model, rest, True).withColumnRenamed("value", "text").distinct()

"""Evaluation passages that leaked into a corpus, whole or in part and not always letter by letter.

Latent semantic retrieval. Texts are folded (width, case) and cut into tokens: a Han character, or a word of other
letters and digits; punctuation and white space fall away. Features are pairs of neighbouring tokens. The evaluation set
is taken in blocks of at most ``ITEM_CHARS`` characters (an item at least), each of which is sought in the whole corpus;
the vocabulary of a block are the features of its passages, which bounds all that is broadcast. One pass over the corpus
finds the features, packed and kept for the passes that follow: their document frequencies are counted by Spark over the
whole corpus, and the basis is a randomised SVD of all TF-IDF passages of the corpus and of the evaluation set, with the
products ``A^T (A B)`` summed over partitions by Spark. Every window of every document is
projected on the basis, block by block, and compared with the segments of every passage: halves, or for long passages
stretches of about a window's length, so that the cosine does not fall with the length. A cosine of ``LATENT`` in the
latent space makes a candidate, if besides either window and segment reach ``FULL`` in the whole vocabulary, as every
stretch copied with single changes does, or the document holds ``ANSWER`` of the item's answer: the rarer half of the
passage's features that its query does not give away, by weight.

A candidate is checked token by token. It leaked if its longest common subsequences with the passage, as local
alignments that pay for every token left out or changed, cover half of the passage, in one stretch or in two that
together make it up. A stretch is the longest part of an alignment in which ``DENSE`` of the passage's tokens match, so
that what an alignment runs on into, past a rewritten clause, takes nothing from a stretch before it. It is a paraphrase
if no stretch does, but ``COMMON`` of the passage's tokens stand near the candidate windows in the passage's order, and
``TOLD`` of its answer does.

Defined results
* null and empty texts and passages, and passages without two tokens, give no rows;
* a document and an item meet once, however often the passage stands in the document; repeated ids meet once;
* texts and passages of any length are compared whole; an empty evaluation table or corpus gives no rows; extra columns
  are ignored; a null query gives nothing of the answer away.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.spans import mix, pieces, powers
from quire.tables import cut, near

#: Units of a block and of a window: a Han character is one unit, a word is WORD.
BLOCK, PER_WINDOW, WORD = 20, 3, 3
#: Dimensions of the latent space and power iterations.
DIMENSIONS, ITERATIONS = 64, 1
#: Characters of passages and queries that are sought together, and units of a passage's segment at most, two windows.
ITEM_CHARS, SEGMENT = 200_000, 2 * BLOCK * PER_WINDOW
#: Least cosines of a candidate, in the latent space and in the whole vocabulary, and the least part of the answer that stands for the latter.
LATENT, FULL, ANSWER = 0.75, 0.36, 0.5
#: The part of a passage a stretch has to carry, the part two stretches have to, how much of a stretch has to match, tokens aligned at a time, and cells of an alignment that are kept.
PART, BOTH, DENSE, ALIGNED, CELLS = 0.48, 0.90, 0.86, 4000, 4_000_000
#: The part of a passage's tokens that a paraphrase has in order, and of its answer.
COMMON, TOLD = 0.6, 0.5
#: Rows that are summed one by one, cosines that are looked at together, and windows whose features are.
RUN, COSINES, LOOKED = 32, 1 << 19, 5000
_MASK = (1 << 22) - 1


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the first plane its folded form, and its kind: 0 separator, 1 word, 2 Han, 3 nothing."""
    fold, kind = np.arange(0x10000, dtype=np.uint32), np.zeros(0x10000, np.uint8)
    for code in range(0x10000):
        ch = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        plain = unicodedata.normalize("NFKC", ch).lower()
        if len(plain) == 1 and ord(plain) < 0x10000:
            fold[code] = ord(plain)
        group = unicodedata.category(ch)
        if 0x3400 <= code < 0xA000 or 0xF900 <= code < 0xFB00 or 0x2E80 <= code < 0x2FE0:
            kind[code] = 2
        elif group[0] in "LN":
            kind[code] = 1
        elif group in ("Cf", "Mn"):
            kind[code] = 3
    return fold, kind


class Tokens:
    """The tokens of many texts: their hashes, the text each is of, and its place in units."""

    def __init__(self, texts: list[str | None]):
        fold, kind = _tables()
        joined = "\n".join(t or "" for t in texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)[: len(points)]
        low = np.minimum(points, 0xFFFF).astype(np.uint16)
        kinds = np.where(points > 0xFFFF, 1, kind[low])
        points = np.where(points > 0xFFFF, points, fold[low])
        if (kinds == 3).any():
            keep = kinds != 3
            points, kinds, owner = points[keep], kinds[keep], owner[keep]
        word = kinds == 1
        begins = word & np.concatenate([[True], ~word[:-1]]) if len(word) else word
        ends = np.flatnonzero(word & np.concatenate([~word[1:], [True]])) + 1 if len(word) else np.zeros(0, np.int64)
        starts = np.flatnonzero(begins)
        n = len(points)
        spread = mix(points.astype(np.uint64) + np.uint64(1))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(np.where(word, spread * powers(0, n), np.uint64(0)), out=sums[1:])
        self_hash = spread
        self_hash[starts] = mix((sums[ends] - sums[starts]) * powers(0, n + 1, True)[starts])
        at = np.flatnonzero(begins | (kinds == 2))
        self.hash, self.owner, self.han = self_hash[at], owner[at], kinds[at] == 2
        units = np.where(self.han, 1, WORD)
        total = np.cumsum(units) - units
        first = np.flatnonzero(np.concatenate([[True], self.owner[1:] != self.owner[:-1]])) if len(at) else np.zeros(0, np.int64)
        self.unit = total - np.repeat(total[first], np.diff([*first, len(at)])) if len(at) else total
        self.pair = mix(self.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.hash[1:]) if len(at) else np.zeros(0, np.uint64)
        self.inside = self.owner[:-1] == self.owner[1:]


class Vocabulary:
    """Features by their hash, found through a table of their lower bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.size = len(self.hashes)
        self.tables = []
        left = np.arange(self.size, dtype=np.int32)
        for shift in (0, 22, 42):
            table = np.full(_MASK + 1, -1, np.int32)
            slot = (self.hashes[left] >> np.uint64(shift)) & np.uint64(_MASK)
            table[slot] = left
            self.tables.append((np.uint64(shift), table))
            left = left[table[slot] != left]
            if not len(left):
                break

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        for shift, table in self.tables:
            at = table[(hashes >> shift) & np.uint64(_MASK)]
            hit = (at >= 0) & (self.hashes[at] == hashes)
            out[hit] = at[hit]
        return out


def features(tokens: Tokens, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the features in the vocabulary: the feature, its text and its block in the text."""
    found = vocabulary.find(tokens.pair)
    on = np.flatnonzero((found >= 0) & tokens.inside)
    return found[on], tokens.owner[on], tokens.unit[on] // BLOCK


def _sums(rows: np.ndarray, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sums, from start to start, of the rows that the index names: a sum's k-th row is added to all sums at once, long sums are made of parts."""
    n = np.diff(np.append(starts, len(index)))
    if n.max() > RUN:
        parts = -(-n // RUN)
        first = np.cumsum(parts) - parts
        begin = np.repeat(starts - RUN * first, parts) + RUN * np.arange(parts.sum())
        return _sums(_sums(rows, index, begin), np.arange(len(begin)), first)
    out = np.empty((len(starts), rows.shape[1]), rows.dtype)
    for s in range(0, len(starts), 4096):
        order = np.argsort(-n[s : s + 4096], kind="stable")
        first, left = starts[s : s + 4096][order], -n[s : s + 4096][order]
        sums = np.take(rows, index[first], axis=0)
        for k, more in enumerate(np.searchsorted(left, -np.arange(1, -left[0])).tolist(), 1):
            sums[:more] += np.take(rows, index[first[:more] + k], axis=0)
        out[s + order] = sums
    return out


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where each of the distinct ones of sorted keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def segments(feature: np.ndarray, unit: np.ndarray) -> list[np.ndarray]:
    """The first, middle and last half of a passage's features; of a long passage stretches of ``SEGMENT`` units that overlap by half."""
    end = int(unit[-1]) + 1 if len(unit) else 0
    size = min(end / 2, SEGMENT)
    steps = max(2, -(-end // SEGMENT)) * 2 - 1 if end > 2 * SEGMENT else 3
    starts = [s * end / 4 for s in range(3)] if steps == 3 else [k * (end - size) / (steps - 1) for k in range(steps)]
    return [feature[(unit >= s) & (unit < s + size)] for s in starts]


def _fill(block: np.ndarray, passage: np.ndarray, text: np.ndarray, used: dict[int, np.ndarray], first: int) -> None:
    """The rows of scores of the passage's tokens from ``first`` on; the block's first row is that before them."""
    n, m = len(block) - 1, len(text)
    step = np.where(passage[first : first + n, None] == text[None, :], 3, 1).astype(block.dtype)
    for i in used:
        if first <= i < first + n:
            step[i - first, used[i]] = 1
    ramp = np.arange(n + m + 1, dtype=block.dtype)  # scores are taken with their row and column added, so that tokens left out cost nothing
    block[0] += ramp[: m + 1]
    for i in range(n):
        row, before = block[i + 1], block[i]
        np.maximum(before, ramp[i + 1 : i + m + 2], out=row)
        np.add(step[i], before[:-1], out=step[i])
        np.maximum(row[1:], step[i], out=row[1:])
        np.maximum.accumulate(row, out=row)
    block -= ramp[: m + 1]
    block -= ramp[: n + 1, None]


def _alignment(passage: np.ndarray, text: np.ndarray, used: dict[int, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """The best local alignment: its score, and the passage's and the text's places that match. A token changed or left out costs one.

    Matches in ``used`` don't count. Only every so many rows of scores are kept, and those between made again on the way back.
    """
    n, m = len(passage), len(text)
    kind = np.int16 if 2 * n + m < 32_000 else np.int32
    every = max(1, min(n, CELLS // (m + 1)))
    kept = {0: np.zeros(m + 1, kind)}
    score, i, j, whole = 0, 0, 0, None
    row = kept[0]
    for start in range(0, n, every):
        block = np.empty((min(every, n - start) + 1, m + 1), kind)
        block[0] = row
        _fill(block, passage, text, used, start)
        row = kept[start + every] = block[-1].copy()
        at = int(np.argmax(block))
        if block.flat[at] > score:
            score, i, j = int(block.flat[at]), start + at // (m + 1), at % (m + 1)
            whole = start, block
    on = []
    while i > 0 and j > 0:
        if whole is None or not whole[0] < i <= whole[0] + len(whole[1]) - 1:
            start = (i - 1) // every * every
            whole = start, np.empty((i - start + 1, m + 1), kind)
            whole[1][0] = kept[start]
            _fill(whole[1], passage, text, used, start)
        start, best = whole
        here = best[i - start, j]
        if here <= 0:
            break
        if passage[i - 1] == text[j - 1] and here == best[i - start - 1, j - 1] + 1 and not (i - 1 in used and j - 1 in used[i - 1]):
            i, j = i - 1, j - 1
            on.append((i, j))
        elif here == best[i - start - 1, j] - 1:
            i -= 1
        elif here == best[i - start, j - 1] - 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
    at = np.array(on[::-1], np.int64).reshape(-1, 2)
    return score, at[:, 0], at[:, 1]


def dense_part(at: np.ndarray) -> tuple[int, int, int]:
    """Of matching places of a passage the longest part of which ``DENSE`` match: how many match, and what it spans."""
    if not len(at):
        return 0, 0, 0
    k = np.arange(len(at))
    before = np.maximum.accumulate(DENSE * at - k)  # a part from i to j is dense where this, at i, is not below that of its end
    first = np.searchsorted(before, DENSE * (at + 1) - (k + 1) - 1e-9)
    last = int(np.argmax(k - first))
    return last - int(first[last]) + 1, int(at[first[last]]), int(at[last]) + 1


def best_stretch(passage: np.ndarray, text: np.ndarray, least: float = 0, enough: float = np.inf) -> tuple[int, int, int]:
    """The longest dense stretch: matched tokens, and the part of the passage it spans.

    Every alignment is followed that could hold a longer stretch than ``least`` and those found, not only the best:
    text that merely resembles the passage must not hide a stretch that carries it. Ends with a stretch of ``enough``.
    """
    n, m = len(passage), len(text)
    found = (0, 0, 0)
    if not n or not m:
        return found
    size = max(ALIGNED, 4 * n)
    if m <= size:
        used: dict[int, np.ndarray] = {}
        while True:
            score, at, on = _alignment(passage, text, used)
            found = max(found, dense_part(at), key=lambda x: x[0])
            if found[0] >= enough or score <= max(0, (2 - 1 / DENSE) * max(least, found[0]) - 1):  # what a dense stretch scores at least
                return found
            for i, j in zip(at.tolist(), on.tolist()):
                used[i] = np.append(used.get(i, np.zeros(0, np.int64)), j)
    for s in range(0, m - 2 * n, size - 2 * n):  # long texts in pieces that overlap by more than an alignment can reach
        found = max(found, best_stretch(passage, text[s : s + size], max(least, found[0]), enough), key=lambda x: x[0])
        if found[0] >= enough:
            break
    return found


def leaked(passage: np.ndarray, text: np.ndarray) -> bool:
    """Whether the tokens of a text carry the passage: half of it in one stretch, or all in two."""
    n = len(passage)
    matched, start, end = best_stretch(passage, text, BOTH / 2 * n, PART * n)  # of two the longer has half of what both need
    if matched >= PART * n:
        return True
    rest = BOTH * n - matched
    return matched >= BOTH / 2 * n and any(best_stretch(side, text, rest, rest)[0] >= rest for side in (passage[:start], passage[end:]))


def common_tokens(passage: np.ndarray, text: np.ndarray, least: float = 0) -> int:
    """The length of the longest common subsequence, by rows of bits. Where fewer than ``least`` of the passage's tokens are in the text, their number, which it can't exceed."""
    tokens, others = passage.tolist(), text.tolist()
    held = set(others).intersection(tokens)
    tokens = [t for t in tokens if t in held]
    if len(tokens) < least:
        return len(tokens)
    places: dict[int, int] = {}
    for j, t in enumerate(tokens):
        places[t] = places.get(t, 0) | 1 << j
    row = full = (1 << len(tokens)) - 1
    for t in others:
        if t in held:
            hit = row & places[t]
            row = ((row + hit) | (row - hit)) & full
    return len(tokens) - row.bit_count()


class Index:
    """What every task needs of a block of the evaluation set; its size is bounded by the block.

    Passages, queries, document frequencies and basis travel; the tables that follow from them are made in each task.
    """

    def __init__(self, ids: list[int], passages: list[str], queries: list[str | None], idf: np.ndarray | None = None, basis: np.ndarray | None = None):
        tokens, asked = Tokens(passages), Tokens(queries)
        self.ids = np.array(ids)
        self.vocabulary = Vocabulary(tokens.pair[tokens.inside])
        place, place_q = (np.searchsorted(t.owner, np.arange(len(ids) + 1)) for t in (tokens, asked))
        self.tokens = [tokens.hash[a:b] for a, b in zip(place[:-1], place[1:])]
        self.units = [int(tokens.unit[b - 1]) + WORD if b > a else 0 for a, b in zip(place[:-1], place[1:])]
        found, known = self.vocabulary.find(tokens.pair), self.vocabulary.find(asked.pair)
        self.queries, self.item, self.untold = [], [], []
        for k, (a, b) in enumerate(zip(place[:-1], place[1:])):
            own = found[a : b - 1] if b - a >= 2 else found[:0]
            self.untold.append(np.setdiff1d(own, known[place_q[k] : max(place_q[k], place_q[k + 1] - 1)]))
            for s in segments(own, tokens.unit[a : b - 1]) if len(own) else []:
                if len(s):
                    self.queries.append(s)
                    self.item.append(k)
        self.item = np.array(self.item, np.int32)
        if basis is not None:
            self.weigh(idf, basis)

    def weigh(self, idf: np.ndarray, basis: np.ndarray) -> None:
        self.idf, self.basis = idf.astype(np.float32), (basis * idf[:, None]).astype(np.float32)
        latent = np.stack([self.basis[q].sum(axis=0) for q in self.queries])
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1), 1e-9)[:, None]).astype(np.float32)
        cells = [np.unique(q, return_counts=True) for q in self.queries]  # segments by their features only
        weights = [self.idf[f] * n for f, n in cells]
        self.cells = np.concatenate([f + k * self.vocabulary.size for k, (f, _) in enumerate(cells)])
        self.weights = np.concatenate([w / max(float(np.linalg.norm(w)), 1e-9) for w in weights]).astype(np.float32)
        self.mask = min(_MASK, (1 << (16 * len(self.cells)).bit_length()) - 1)
        self.slots = np.zeros(self.mask + 1, np.int32)
        self.slots[self.cells & self.mask] = np.arange(len(self.cells))
        self.taken = np.zeros(self.mask + 1, bool)
        self.taken[self.cells & self.mask] = True
        rare, answers = np.minimum(self.idf, self.idf.max() - np.float32(np.log(3))), []  # features of very few documents weigh alike
        for f in self.untold:  # the rarer half of what the query leaves open
            f = f[rare[f] >= np.median(rare[f])] if len(f) else f
            answers.append((f, (rare[f] / max(float(rare[f].sum()), 1e-9)).astype(np.float32)))
        self.answer_at = np.cumsum([0, *(len(f) for f, _ in answers)])
        self.answer, self.answer_weight = (np.concatenate(x) for x in zip(*answers))

    def dots(self, query: np.ndarray, n: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Products of segments and windows by weight in the whole vocabulary; the first ``n[0]`` features are those of the first window, and so on."""
        key = np.repeat(query.astype(np.int64) * self.vocabulary.size, n)
        key += feature
        on = np.flatnonzero(self.taken[key & self.mask])  # most features are not in the segment
        key, feature = key[on], feature[on]
        at = self.slots[key & self.mask]
        other = np.flatnonzero(self.cells[at] != key)
        at[other] = np.minimum(np.searchsorted(self.cells, key[other]), len(self.cells) - 1)
        weight = np.where(self.cells[at] == key, self.weights[at], np.float32(0))
        return np.bincount(np.searchsorted(np.cumsum(n), on, side="right"), self.idf[feature] * weight, len(n))

    def told(self, item: int, features: np.ndarray) -> float:
        """The part of an item's answer among some features."""
        on = slice(self.answer_at[item], self.answer_at[item + 1])
        return float(self.answer_weight[on][np.isin(self.answer[on], features)].sum())


def _windows(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums over the blocks of the window that begins at each block."""
    out = rows.copy()
    for ahead in range(1, PER_WINDOW):
        at = np.searchsorted(keys, keys + ahead)
        at[at == len(keys)] = 0
        ok = keys[at] == keys + ahead
        out[ok] += rows[at[ok]]
    return out


def _pack(values: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, of which most are zero."""
    return pa.compress(np.ascontiguousarray(values.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes(), codec="lz4", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=4 * n, codec="lz4", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(np.int32).ravel()


PACKED = "ids array<long>, keys array<long>, n int, features binary, counts binary, steps binary"


def _featured(index):
    """For every piece of the texts their ids and keys, the features, how many each text has, and the steps between their blocks."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Tokens(index.value[1])
        vocabulary = Vocabulary(passages.pair[passages.inside])
        for batch in batches:
            for part in pieces(batch, 1, 1_500_000):
                feature, owner, block = features(Tokens(part.column(1).to_pylist()), vocabulary)
                if len(feature):
                    packed = (_pack(x) for x in (feature, np.bincount(owner, minlength=part.num_rows), np.diff(block, prepend=0)))
                    lists = (pa.array([part.column(c).to_pylist()], pa.list_(pa.int64())) for c in (0, 2))
                    yield pa.RecordBatch.from_arrays([*lists, pa.array([len(feature)], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=["ids", "keys", "n", "features", "counts", "steps"])

    return find


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Ids and keys of the texts of a piece, and of their features: the feature, its text and its block."""
    for batch in batches:
        for r in range(batch.num_rows):
            ids, keys, n, feature, counts, steps = (c[r].as_py() for c in batch.columns)
            owner = np.repeat(np.arange(len(ids)), _unpack(counts, len(ids)))
            yield ids, keys, _unpack(feature, n).astype(np.int64), owner, np.cumsum(_unpack(steps, n), dtype=np.int64)


def _document_frequencies(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for ids, _, feature, owner, _ in _pieces(batches):
            if len(ids) * size < 60_000_000:
                seen = np.zeros((len(ids), size), bool)
                seen[owner, feature] = True
                total += seen.sum(axis=0)
            else:
                total += np.bincount(np.unique(owner * size + feature) % size, minlength=size)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(on.astype(np.int32)), "n": pa.array(total[on])})

    return count


def _products(idf: np.ndarray, basis: np.ndarray):
    """Partial sums of ``A^T (A B)`` over the passages of a partition, in blocks of rows. A ``B`` of one cell a row takes one sum."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (basis * idf[:, None]).astype(np.float32)
        total = np.zeros(rows.shape)
        single = np.abs(basis).argmax(axis=1) if np.count_nonzero(basis) == len(basis) else None
        for _, _, feature, owner, block in _pieces(batches):
            starts = _starts(owner << 32 | block // PER_WINDOW)
            at = np.repeat(np.arange(len(starts)), np.diff([*starts, len(feature)]))
            if single is None:
                product = _sums(rows, feature, starts)
            else:
                column = single[feature]
                product = np.bincount(at * rows.shape[1] + column, rows[feature, column], len(starts) * rows.shape[1]).reshape(len(starts), -1).astype(np.float32)
            product /= np.maximum(np.add.reduceat(idf[feature] ** 2, starts), 1e-18).astype(np.float32)[:, None]
            order = np.argsort(feature.astype(np.uint16) if len(idf) <= 1 << 16 else feature, kind="stable")
            starts = _starts(feature[order])
            total[feature[order[starts]]] += _sums(product, at[order], starts)
        whole = (total * idf[:, None]).astype(np.float32)
        for s in range(0, len(whole), 512):
            yield pa.RecordBatch.from_pydict({"rows": pa.array([s], pa.int32()), "part": [whole[s : s + 512].tobytes()]})

    return multiply


def _add(part: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(p, np.float32) for p in part["part"]], axis=0, dtype=np.float64)
    return pd.DataFrame({"rows": [part["rows"].iloc[0]], "total": [total.tobytes()]})


def latent_basis(featured: DataFrame, index: Index, idf: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the leading directions of all TF-IDF passages."""
    size = len(idf)
    rng, basis = np.random.default_rng(7), np.zeros((size, min(DIMENSIONS, size)))
    basis[np.arange(size), rng.permutation(size) % basis.shape[1]] = rng.choice([-1.0, 1.0], size)  # each feature in one random direction
    for _ in range(ITERATIONS + 1):
        parts = featured.mapInArrow(_products(idf, basis.astype(np.float32)), "rows int, part binary").groupBy("rows").applyInPandas(_add, "rows int, total binary").collect()  # bounded by the vocabulary
        total = np.zeros(basis.shape)
        for p in parts:
            block = np.frombuffer(p.total, np.float64).reshape(-1, basis.shape[1])
            total[p.rows : p.rows + len(block)] = block
        for q in index.queries:  # the evaluation passages are passages too
            w = idf[q]
            total[q] += np.outer(w, (w[:, None] * basis[q]).sum(axis=0) / max(float((w**2).sum()), 1e-9))
        basis, _ = np.linalg.qr(total)
    return basis


def _columns(latent: np.ndarray) -> np.ndarray:
    """The segments' vectors as columns, filled up with zeros to a multiple of eight."""
    out = np.zeros((latent.shape[1], -(-len(latent) // 8) * 8), np.float32)
    out[:, : len(latent)] = latent.T
    return out


def _close(windows: np.ndarray, latent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows and segments of a cosine above ``LATENT``; few cosines are made at a time, and read in eights."""
    width = latent.shape[1]
    step = max(64, COSINES // width)
    cosines, found = np.empty((min(step, len(windows)), width), np.float32), [np.zeros(0, np.int64)]
    for s in range(0, len(windows), step):
        some = windows[s : s + step]
        above = (np.matmul(some, latent, out=cosines[: len(some)]) > LATENT).reshape(-1, 8)
        eights = np.flatnonzero(above.view(np.uint64))
        at, one = np.nonzero(above[eights])
        found.append(s * width + eights[at] * 8 + one)
    return np.divmod(np.concatenate(found), width)


def _search(index):
    """``(doc_id, key, item, blocks)``: the windows of a text that are candidates for an item, both by their places."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = Index(*index.value)
        latent = _columns(x.latent)
        for ids, hashes, feature, owner, block in _pieces(batches):
            places = owner << 32 | block
            starts = _starts(places)
            keys = places[starts]
            windows = _windows(keys, _sums(x.basis, feature, starts))
            windows /= np.maximum(np.linalg.norm(windows, axis=1), 1e-9)[:, None]
            place = np.stack([starts, np.append(starts, len(places))[np.searchsorted(keys, keys + PER_WINDOW)]])
            squares = np.append(0, np.cumsum(x.idf[feature] ** 2, dtype=np.float64))
            norms = np.maximum(np.sqrt(squares[place[1]] - squares[place[0]]), 1e-9)
            holds = _held(len(ids), x.vocabulary.size, owner, feature)
            candidates: dict[tuple[int, int], list[int]] = {}
            for s in range(0, len(keys), 8192):  # every window with every segment, whatever their scripts
                row, query = _close(windows[s : s + 8192], latent)
                for doc, item, b in _confirmed(x, feature, place, row + s, query, keys, norms, holds):
                    candidates.setdefault((doc, item), []).append(b)
            of = sorted(candidates)
            columns = [pa.array([ids[d] for d, _ in of], pa.int64()), pa.array([hashes[d] for d, _ in of], pa.int64()), pa.array([i for _, i in of], pa.int32()), pa.array([sorted(set(candidates[c])) for c in of], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "item", "blocks"])

    return search


def _check(index):
    """``(doc_id, item_id, kind)`` of the candidates ``(doc_id, text, found)`` that are one."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = Index(*index.value)
        for batch in batches:
            for part in pieces(batch, 1, 1_500_000):
                tokens = Tokens(part.column(1).to_pylist())
                first = np.searchsorted(tokens.owner, np.arange(part.num_rows + 1))
                ids, items, kinds = [], [], []
                for doc, (id_, found) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                    for item, at in ((f["item"], f["blocks"]) for f in found):
                        around = _around(tokens.unit[first[doc] : first[doc + 1]], at, x.units[item])
                        text = tokens.hash[first[doc] : first[doc + 1]][around]
                        common = common_tokens(x.tokens[item], text, min(PART, COMMON) * len(x.tokens[item]))  # no stretch can match in more
                        kind = "leaked" if common >= PART * len(x.tokens[item]) and leaked(x.tokens[item], text) else None
                        if kind is None and common >= COMMON * len(x.tokens[item]) and x.told(item, x.vocabulary.find(tokens.pair[first[doc] + around[:-1]])) >= TOLD:
                            kind = "paraphrased"
                        if kind:
                            ids.append(id_)
                            items.append(int(x.ids[item]))
                            kinds.append(kind)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "item_id": pa.array(items, pa.int64()), "kind": pa.array(kinds, pa.string())})

    return check


def _around(unit: np.ndarray, blocks: list[int], reach: int) -> np.ndarray:
    """The tokens within a passage's length of some candidate window of a text."""
    at = np.array(sorted(set(blocks))) * BLOCK
    begin, end = np.searchsorted(unit, at - reach), np.searchsorted(unit, at + PER_WINDOW * BLOCK + reach)
    apart = np.flatnonzero(begin[1:] > end[:-1]) + 1
    return np.concatenate([np.arange(b, e) for b, e in zip(begin[[0, *apart]].tolist(), end[[*(apart - 1), -1]].tolist())])


def _held(n: int, size: int, owner: np.ndarray, feature: np.ndarray):
    """Tells which texts hold which features: from a table of bits, or, where that would be large, from sorted keys."""
    if n * size < 60_000_000:
        table = np.zeros((n, size), bool)
        table[owner, feature] = True
        return lambda doc, f: table[doc, f]
    keys = np.unique(owner.astype(np.int64) * size + feature)

    def among(doc: np.ndarray, f: np.ndarray) -> np.ndarray:
        wanted = doc.astype(np.int64) * size + f
        return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted

    return among


def _confirmed(x: Index, feature: np.ndarray, place: np.ndarray, windows: np.ndarray, queries: np.ndarray, keys: np.ndarray, norms: np.ndarray, holds) -> Iterator[tuple[int, int, int]]:
    """``(text, item, block)`` where window and segment reach the cosine in the whole vocabulary as well, or the text holds the answer."""
    doc, item = keys[windows] >> 32, x.item[queries].astype(np.int64)
    if not len(windows):
        return
    pair = doc * len(x.ids) + item
    order = np.argsort(pair, kind="stable")
    fresh = np.concatenate([[True], np.diff(pair[order]) > 0])
    pairs, of = pair[order[fresh]], np.empty(len(pair), np.int64)
    of[order] = np.cumsum(fresh) - 1
    told = np.zeros(len(pairs), np.float32)
    for s in range(0, len(pairs), 50_000):
        d, i = np.divmod(pairs[s : s + 50_000], len(x.ids))
        n = x.answer_at[i + 1] - x.answer_at[i]
        cell = np.repeat(x.answer_at[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        told[s : s + len(d)] = np.bincount(np.repeat(np.arange(len(d)), n), x.answer_weight[cell] * holds(np.repeat(d, n), x.answer[cell]), len(d))
    answered = told[of] >= ANSWER
    for s in range(0, len(windows), LOOKED):
        w, q = windows[s : s + LOOKED], queries[s : s + LOOKED]
        begin, n = place[0, w], place[1, w] - place[0, w]
        f = feature[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ok = (x.dots(q, n, f) >= FULL * norms[w]) | answered[s : s + LOOKED]
        yield from zip((keys[w[ok]] >> 32).tolist(), x.item[q[ok]].tolist(), (keys[w[ok]] & 0xFFFFFFFF).tolist())


def _block_found(texts: DataFrame, n_texts: int, items: DataFrame) -> DataFrame | None:
    """``(doc_id, item_id, kind)`` of one block of items."""
    spark = texts.sparkSession
    known = items.orderBy("item_id", "passage").collect()  # ITEM_CHARS characters, about
    stated = [r.item_id for r in known], [r.passage for r in known], [r.query for r in known]
    index = Index(*stated)  # the driver's own
    if not index.queries:
        return None
    shared = spark.sparkContext.broadcast(stated)
    featured = cut(texts.mapInArrow(_featured(shared), PACKED))
    counts = featured.mapInArrow(_document_frequencies(index.vocabulary.size), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # bounded by the vocabulary
    df = np.zeros(index.vocabulary.size)
    for r in counts:
        df[r.feature] = r.n
    idf = np.log((n_texts + 1) / (df + 1)) + 0.1
    basis = latent_basis(featured, index, idf)
    ready = spark.sparkContext.broadcast((*stated, idf.astype(np.float32), basis.astype(np.float32)))
    candidates = cut(featured.mapInArrow(_search(ready), "doc_id long, key long, item int, blocks array<int>"))
    found = candidates.groupBy("doc_id", "key").agg(F.collect_set(F.struct("item", "blocks")).alias("found"))  # of one text: bounded by the block
    wanted = near(texts, candidates, "doc_id").join(found, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
    return wanted.select("doc_id", "text", "found").repartition(max(1, texts.rdd.getNumPartitions()), "doc_id").mapInArrow(_check(ready), "doc_id long, item_id long, kind string")


def found_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, kind)``: documents that carry at least half of an item's passage, and those that tell it in other words."""
    query = F.col("query").cast("string") if "query" in items.columns else F.lit(None).cast("string")
    known = items.where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).select("item_id", "passage", query.alias("query")).dropDuplicates(["item_id", "passage"])
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    size = known.agg(F.sum(F.length("passage") + F.coalesce(F.length("query"), F.lit(0)))).first()[0] or 0
    n_blocks, n_texts = 1 + size // ITEM_CHARS, texts.count()
    block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    found = [_block_found(texts, n_texts, known.where(block == k)) for k in range(n_blocks)] if size else []
    found = [f for f in found if f is not None]
    if not found:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long, kind string")
    both = reduce(DataFrame.unionByName, found)
    return both.groupBy("doc_id", "item_id").agg(F.min("kind").alias("kind"))


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id)``: documents that carry at least half of an item's passage."""
    return found_items(documents, items).where("kind = 'leaked'").select("doc_id", "item_id")


def paraphrased_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id)``: documents that tell most of an item's passage and its answer in other words."""
    return found_items(documents, items).where("kind = 'paraphrased'").select("doc_id", "item_id")

"""Encoding of whole texts with a byte-level BPE of a public tokenizer, and decoding back.

Spark partitions the texts; a task takes an Arrow batch at a time. The distinct words of a batch lie one after another
in a doubly linked list of symbols (numpy arrays of next and previous). A priority queue of merge ranks gives the
lowest rank that any pair has; all pairs waiting under it are merged at once, entries whose pair has changed since are
skipped as stale, and the pairs that arise wait under their own, always higher, ranks. That is the order in which each
word alone would be merged. Decoding concatenates the vocabulary's byte strings.

Defined results
* a null or empty text has the empty list; a blank text has the ids of its white space;
* strings of special tokens are ordinary text; every row gives one row, repeated rows repeat, a null key stays null;
* texts of any length are encoded whole; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quire.llm.spans import pieces

#: Where the public tokenizers lie unless a caller says otherwise.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a worker remembers between batches; beyond it they are encoded anew.
REMEMBERED = 400_000
#: Bytes of text that are encoded at once.
PIECE = 4_000_000
_NONE = np.int32(2**31 - 1)


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """The vocabulary's parts that encoding and decoding need, from a tokenizers JSON file."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    letters, vocab = _byte_letters(), model["vocab"]
    size = max(vocab.values()) + 1
    strings = [b""] * size
    for token, i in vocab.items():
        strings[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {
        "first": np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32),
        "left": np.array([vocab[a] for a, _ in pairs], np.int64),
        "right": np.array([vocab[b] for _, b in pairs], np.int64),
        "merged": np.array([vocab[a + b] for a, b in pairs], np.int32),
        "strings": strings,
    }


class PairTable:
    """Ranks of symbol pairs in an open hash table that numpy probes for many pairs at once."""

    BITS = 20

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.mask = (1 << self.BITS) - 1
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, _NONE, np.int32)
        keys = (left << 20) | right
        waiting, slot = np.arange(len(keys)), self._slot(keys)
        while len(waiting):
            free = self.keys[slot] == -1
            _, once = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = once[free[once]]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[waiting[put]], waiting[put]
            keep = np.ones(len(waiting), bool)
            keep[put] = False
            waiting, slot = waiting[keep], (slot[keep] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(-7046029254386353131)) >> np.int64(64 - self.BITS)) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 20) | right
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], _NONE)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out


class MergeQueue:
    """A priority queue of ranks; each rank holds the positions of the pairs that wait under it."""

    def __init__(self):
        self.heap: list[int] = []
        self.waiting: dict[int, list[np.ndarray]] = {}

    def push(self, at: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        ends = [*cuts.tolist(), len(at)]
        for r, s, e in zip(ranks[starts].tolist(), starts, ends):
            if (w := self.waiting.get(r)) is None:
                self.waiting[r] = [at[s:e]]
                heapq.heappush(self.heap, r)
            else:
                w.append(at[s:e])

    def pop(self) -> tuple[int, np.ndarray]:
        r = heapq.heappop(self.heap)
        w = self.waiting.pop(r)
        return r, (w[0] if len(w) == 1 else np.concatenate(w))


class Encoder:
    """Encodes lists of words or texts with one vocabulary."""

    def __init__(self, vocabulary: dict):
        self.first, self.merged, self.left, self.right = (vocabulary[k] for k in ("first", "merged", "left", "right"))
        self.table = PairTable(self.left, self.right)
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each word has."""
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        symbol = self.first[data]
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends - lengths] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, _NONE, np.int32)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.table.rank(symbol[inner], symbol[inner + 1])
        queue = MergeQueue()
        ready = inner[rank[inner] != _NONE]
        if len(ready):
            queue.push(ready.astype(np.int32), rank[ready])
        while queue.heap:
            r, at = queue.pop()
            at = at[rank[at] == r]  # the others are stale: merged away, or now part of another pair
            if not len(at):
                continue
            if self.left[r] == self.right[r] and len(at) > 1:  # in a run of one symbol every other pair, from the left
                at = np.unique(at)
                joined = np.empty(len(at), bool)
                joined[0], joined[1:] = False, after[at[:-1]] == at[1:]
                begin = np.flatnonzero(~joined)
                step = np.arange(len(at)) - np.repeat(begin, np.diff([*begin, len(at)]))
                at = at[step % 2 == 0]
            gone = after[at]
            follow = after[gone]
            symbol[at] = self.merged[r]
            alive[gone] = False
            rank[gone] = _NONE
            after[at] = follow
            has = follow >= 0
            before[follow[has]] = at[has]
            rank[at] = _NONE
            lead = before[at]
            lead = lead[lead >= 0]
            changed = np.concatenate([at[has], lead])
            if len(changed):
                fresh = self.table.rank(symbol[changed], symbol[after[changed]])
                rank[changed] = fresh
                if len(ok := np.flatnonzero(fresh != _NONE)):
                    queue.push(changed[ok], fresh[ok])
        total = np.concatenate([[0], np.cumsum(alive)])
        return symbol[alive], total[ends] - total[ends - lengths]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the offsets of each text."""
        if len(self.known) > REMEMBERED:
            self.known, self.ids, self.starts, self.counts = {}, self.ids[:0], self.starts[:0], self.counts[:0]
        known, find = self.known, self.pattern.findall
        seen, words, per_text = len(known), [], []
        for text in texts:
            tokens = find(text) if text else ()
            for w in tokens:
                if w not in known:
                    known[w] = len(known)
            words.append(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)))
            per_text.append(len(tokens))
        if len(known) > seen:
            ids, counts = self.encode_words([w.encode() for w in list(known)[seen:]])
            starts = len(self.ids) + np.cumsum(counts) - counts
            self.ids, self.starts, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.starts, starts]), np.concatenate([self.counts, counts])
        at = np.concatenate(words) if words else np.zeros(0, np.int64)
        counts = self.counts[at]
        upto = np.concatenate([[0], np.cumsum(counts)])
        source = np.repeat(self.starts[at] - upto[:-1], counts) + np.arange(upto[-1])
        ends = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)
        return self.ids[source], upto[ends]


def encode_texts(documents: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_50k.json", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(<key>, ids)``: the token ids of each text. The vocabulary, of fixed size, is read by the driver and broadcast."""
    vocabulary = documents.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    kind = documents.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            for part in pieces(batch, 1, PIECE):
                ids, offsets = encoder.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_50k.json", key: str = "doc_id") -> DataFrame:
    """``(<key>, text)``: the texts that lists of ids stand for."""
    strings = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(path)["strings"])
    kind = encoded.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = strings.value
        for batch in batches:
            texts = [None if ids is None else b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(decode, f"`{key}` {kind}, text string")

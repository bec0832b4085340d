"""Near-duplicate records with small edits, by banded minimum hashes and sequential Bayesian verification.

Equal normalised texts are one class. A task hashes the 5-character substrings of its texts, deals them into ``ROWS``
bins by their hash, and takes for each of ``BANDS`` permutations the least value per bin: a band is one permutation's
bins; the first ``COMPARED`` of all these values are the signature, a byte each. A count-min sketch of the bands
leaves those that repeat. Spark groups bands; texts that share one are candidates, each
set of texts forming its pairs once. The texts of a band of more than ``HOT`` are all compared too, in tiles of ``TILE`` by
``TILE`` texts within tasks, so that only pairs that stay become rows. Candidates are compared signature batch by batch: with a uniform prior on the
similarity, a pair leaves as soon as the posterior probability that it reaches the threshold falls below
``MISS``. The survivors' similarity is computed exactly on their texts.

Defined results
* null, empty, blank and short texts (below ``SHORTEST`` characters normalised) take no part;
* two ids with equal normalised texts are alike with similarity 1; rows of one id count once, and an id with several
  texts is as alike as its most alike one; an id is never paired with itself;
* texts are read whole, whatever their length; empty tables give no rows; extra columns are ignored;
* a text that a third of the records share is hashed once; only the pairs of the result are formed from its class;
* texts are told apart by their kind and 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import group_pairs, repeated_windows
from quire.llm.spans import mix, pieces
from quire.operators.components import connected_components
from quire.tables import cut, near

#: Characters of a substring, least length of a text, and the similarity wanted.
GRAM, SHORTEST, THRESHOLD = 5, 120, 0.70
#: Permutations, values of each, signature values compared at a time, and the chance of losing a pair that is wanted.
BANDS, ROWS, BATCH, MISS = 72, 7, 28, 1e-4
#: Texts of one band beyond which its pairs are compared in tiles, and the texts on a side of a tile.
HOT, TILE = 100, 2000
#: Signature values that are compared first, and in all.
FIRST, COMPARED = 56, 168

_RNG = np.random.default_rng(20240229)
_FLIP = _RNG.integers(0, 1 << 32, BANDS, np.uint64).astype(np.uint32)
_TIMES = (_RNG.integers(0, 1 << 31, BANDS, np.uint64) * 2 + 1).astype(np.uint32)
_MIXERS = _RNG.integers(1, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(texts: list[str]) -> np.ndarray:
    """``BANDS * ROWS`` minimum hashes of each text, band by band."""
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(raw, np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    grams = np.zeros(max(0, len(points) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + points[k : k + len(grams)]
    grams = mix(grams)
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(grams)]
    ends = np.repeat(np.cumsum(lengths), lengths)[: len(grams)]
    inside = np.arange(len(grams)) + GRAM <= ends
    grams, owner = grams[inside], owner[inside]
    slot = owner * ROWS + (grams % np.uint64(ROWS)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    slot, values = slot[order], (grams[order] >> np.uint64(32)).astype(np.uint32)
    starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
    out = np.full((BANDS, len(texts) * ROWS), 0xFFFFFFFF, np.uint32)
    if len(starts):
        for band in range(BANDS):
            out[band, slot[starts]] = np.minimum.reduceat((values ^ _FLIP[band]) * _TIMES[band], starts)
    return out.reshape(BANDS, len(texts), ROWS).transpose(1, 0, 2)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 2, 2_000_000):
            sig = signatures(part.column(2).to_pylist())
            kinds = part.column(1).dictionary_encode()
            named = [int.from_bytes(hashlib.md5(k.encode()).digest()[:8], "little") for k in kinds.dictionary.to_pylist()]
            kind = np.array(named, np.uint64)[kinds.indices.to_numpy()]
            bands = (sig.astype(np.uint64) * _MIXERS).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + kind[:, None]
            n = part.num_rows
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(mix(bands).astype(np.int64).ravel()))
            low = (sig & 0xFF).astype(np.uint8).reshape(n, -1)
            first, rest = (pa.array([row.tobytes() for row in x], pa.binary()) for x in (low[:, :FIRST], low[:, FIRST:COMPARED]))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, first, rest], names=["tid", "bands", "first", "rest"])


def least_matches(threshold: float = THRESHOLD, miss: float = MISS) -> list[tuple[int, int]]:
    """``(n, m)``: after n compared values a pair with less than m matches is pruned.

    Bytes of different minima agree once in 256, so a similarity s shows as an agreement of s + (1 - s) / 256. The
    posterior of the agreement under a uniform prior is a beta distribution, integrated here on a grid.
    """
    grid = (np.arange(4000) + 0.5) / 4000
    wanted = grid >= threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH, COMPARED + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[wanted].sum() >= miss * weight.sum():
                out.append((n, m))
                break
    return out


def _pruner(done: int):
    """Compares the batches of signature values after the first ``done``; a pair's matches so far come with it."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = least_matches()
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (3, 4))
            left, matches, start = np.arange(batch.num_rows), batch.column(2).to_numpy(), 0
            for n, m in bounds:
                if done < n <= done + a.shape[1]:
                    matches = matches + (a[left, start : n - done] == b[left, start : n - done]).sum(axis=1)
                    left, matches, start = left[matches >= m], matches[matches >= m], n - done
            keep = pa.array(left)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(matches)], names=["doc_a", "doc_b", "matches"])

    return prune


def _compare(pairs: DataFrame, signed: DataFrame, part: str, done: int) -> DataFrame:
    """The pairs ``(doc_a, doc_b, matches)`` that one part of the signatures leaves."""
    own = signed.select("tid", part).dropDuplicates(["tid"])
    a, b = (own.select(F.col("tid").alias(f"doc_{x}"), F.col(part).alias(f"part_{x}")) for x in "ab")
    both = pairs.join(a, "doc_a").join(b, "doc_b").select("doc_a", "doc_b", "matches", "part_a", "part_b")
    return both.mapInArrow(_pruner(done), "doc_a binary, doc_b binary, matches long")


def grams_of(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def similarity(a: str, b: str) -> float:
    """The Jaccard similarity of the sets of substrings."""
    x, y = grams_of(a), grams_of(b)
    common = len(x & y)
    return common / (len(x) + len(y) - common) if x or y else 0.0


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[bytes | None, set[str]] = (None, set())
    for batch in batches:
        a, b, ta, tb = (c.to_pylist() for c in batch.columns)
        sims = []
        for key, x, y in zip(a, ta, tb):
            if last[0] != key:  # pairs come sorted by their first text
                last = key, grams_of(x)
            other = grams_of(y)
            common = len(last[1] & other)
            sims.append(common / (len(last[1]) + len(other) - common) if last[1] or other else 0.0)
        keep = pa.array([s >= THRESHOLD for s in sims], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(sims, pa.float64()).filter(keep)], names=["doc_a", "doc_b", "similarity"])


def text_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(record_kind, record_id, tid)`` of every record that takes part, and ``(tid, record_kind, text)`` of their texts, which may repeat."""
    text = F.trim(F.regexp_replace(F.lower("text"), r"(?U)\s+", " "))
    normal = records.where(F.col("record_id").isNotNull()).select("record_kind", "record_id", text.alias("text")).where(F.length("text") >= SHORTEST)
    keyed = normal.withColumn("tid", F.unhex(F.md5(F.concat_ws("\x01", "record_kind", "text"))))
    return keyed.select("record_kind", "record_id", "tid").distinct(), keyed.select("tid", "record_kind", "text")


def _tile(part: pa.Table) -> pa.Table:
    """The pairs that stay of the texts of one tile: all of one side, or each of one with each of the other."""
    part = part.sort_by("tid")
    tids, side = part.column("tid").combine_chunks(), part.column("side").to_numpy()
    values = np.concatenate([np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(part.num_rows, -1) for c in ("first", "rest")], axis=1)
    bounds, out = least_matches(), []
    for i in range(part.num_rows):
        left = np.arange(i + 1, part.num_rows)
        if part.column("i")[0] != part.column("j")[0]:
            left = left[side[left] != side[i]]
        matches, start = np.zeros(len(left), np.int64), 0
        for n, m in bounds:
            matches = matches + (values[left, start:n] == values[i, start:n]).sum(axis=1)
            left, matches, start = left[matches >= m], matches[matches >= m], n
        out.append(np.stack([np.full(len(left), i), left]))
    a, b = np.concatenate(out, axis=1)
    return pa.table({"doc_a": tids.take(pa.array(a)), "doc_b": tids.take(pa.array(b))})


def _hot_pairs(members: DataFrame, sizes: DataFrame, signed: DataFrame) -> DataFrame:
    """Distinct ``(doc_a, doc_b)`` that the signatures leave of all pairs of the texts of hot bands. ``members (key, doc_id)``."""
    hot = members.join(sizes, "key")
    same = hot.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("x"))
    once = same.groupBy("n", "s", "x").agg(F.min("key").alias("key"))  # bands of the same texts are one
    own = signed.select(F.col("tid").alias("doc_id"), "first", "rest").dropDuplicates(["doc_id"])
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    dealt = hot.drop("n").join(once.select("key", tiles.alias("tiles")), "key").withColumn("side", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.col("tiles")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = spread.join(own, "doc_id").select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", F.col("doc_id").alias("tid"), "first", "rest")
    return rows.groupBy("key", "i", "j").applyInArrow(_tile, "doc_a binary, doc_b binary").distinct()


def _likely(members: DataFrame, signed: DataFrame) -> DataFrame:
    """``(doc_a, doc_b)`` of texts that share a band and that the signatures leave. ``members (key, doc_id)``."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    many = cut(sizes.where(F.col("n") > HOT))
    hot = not many.isEmpty()
    cold = members.join(many, "key", "left_anti") if hot else members
    candidates = group_pairs(cold, ["key"]).select("doc_a", "doc_b", F.lit(0).cast("long").alias("matches"))
    likely = _compare(cut(_compare(candidates, signed, "first", 0)), signed, "rest", FIRST).select("doc_a", "doc_b")
    return likely.unionByName(_hot_pairs(members, many, signed)).distinct() if hot else likely


def similar_texts(texts: DataFrame) -> DataFrame:
    """``(doc_a, doc_b, similarity)``: pairs of text classes whose similarity reaches the threshold."""
    signed = cut(texts.mapInArrow(_sign, "tid binary, bands array<long>, first binary, rest binary"))
    repeated = repeated_windows(signed.select(F.col("tid").alias("doc_id"), F.col("bands").alias("keys")), 1, 3)
    likely = cut(_likely(cut(repeated.distinct()), signed))
    needed = likely.select(F.explode(F.array("doc_a", "doc_b")).alias("tid")).distinct()
    own = near(texts, needed, "tid").join(needed, "tid", "left_semi").dropDuplicates(["tid"])
    ta = own.select(F.col("tid").alias("doc_a"), F.col("text").alias("text_a"))
    tb = own.select(F.col("tid").alias("doc_b"), F.col("text").alias("text_b"))
    return likely.join(tb, "doc_b").join(ta, "doc_a").select("doc_a", "doc_b", "text_a", "text_b").mapInArrow(_exact, "doc_a binary, doc_b binary, similarity double")


def near_duplicate_pairs(records: DataFrame) -> DataFrame:
    """``(record_kind, id_a, id_b)`` of ``records (record_kind, record_id, text)``."""
    members, texts = text_classes(records)
    similar = similar_texts(texts)
    a = members.select("record_kind", F.col("tid").alias("doc_a"), F.col("record_id").alias("a"))
    b = members.select(F.col("tid").alias("doc_b"), F.col("record_id").alias("b"))
    across = similar.join(a, "doc_a").join(b, "doc_b").where("a <> b").select("record_kind", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
    copies = members.join(members.groupBy("tid").agg(F.count("*").alias("n")).where("n > 1"), "tid", "left_semi")
    inside = copies.select("record_kind", "tid", F.col("record_id").alias("id_a")).join(copies.select("tid", F.col("record_id").alias("id_b")), "tid").where("id_a < id_b")
    return across.unionByName(inside.select("record_kind", "id_a", "id_b")).distinct()


def near_duplicate_groups(records: DataFrame) -> DataFrame:
    """``(record_kind, record_id, group_id, n_copies, n_links)`` of every record with a near duplicate.

    ``group_id`` is the least record id of the connected group, ``n_copies`` the records of equal normalised text,
    ``n_links`` the number of other texts that are similar to the record's.
    """
    members, texts = text_classes(records)
    similar = cut(similar_texts(texts))
    both = similar.select(F.col("doc_a").alias("tid"), F.col("doc_b").alias("other")).unionByName(similar.select(F.col("doc_b").alias("tid"), F.col("doc_a").alias("other")))
    links = both.groupBy("tid").agg(F.count("*").alias("n_links"))
    sizes = members.groupBy("tid").agg(F.count("*").alias("n_copies"))
    groups = connected_components(similar.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")))
    named = (
        members.join(groups.withColumnRenamed("node", "tid"), "tid", "left")
        .join(links, "tid", "left")
        .join(sizes, "tid")
        .where((F.col("n_copies") > 1) | F.col("n_links").isNotNull())
        .withColumn("component", F.coalesce("component", "tid"))
    )
    names = named.groupBy("record_kind", "component").agg(F.min("record_id").alias("group_id"))
    return named.join(names, ["record_kind", "component"]).select("record_kind", "record_id", "group_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))

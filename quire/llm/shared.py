"""Long exact spans that records share: pairs of records, and how much of each record stands elsewhere.

Exact copies are one class and represented by their least id. In each text windows are laid around anchors, the
positions whose short window has the least hash among ``SPAN - ANCHOR + 1`` neighbours, so that any shared span of
``SPAN`` characters holds one anchor in both texts, and at least one of the ``SHIFTS`` windows laid around it lies in
the span whole. Every partition sketches the counts of its windows in a count-min sketch of saturating counters (0, 1,
2 or more), the sketches are merged by Spark, and a second pass keeps the windows the merged sketch takes for repeated;
estimates only err upwards, so none is lost. Spark groups the windows kept exactly. Windows with the same set of
records are one group; the pairs of small groups are checked on the texts, character for character. Groups of more
than ``HOT`` records are not paired: their records' windows of the full ``SPAN`` around the anchor are grouped by a
rolling hash and the SHA-256 of their characters, so only pairs of the result come out.

A sketch has a bound: ``MAX_CELLS`` cells a row, two bits each, whatever the data; more windows are taken in as many
ranges of their keys, each with a sketch of its own. Partial sketches merge in two steps, so that no task holds more than
about the root of their number.

Defined results
* null texts and texts below ``SPAN`` characters share nothing; their share is 0;
* exact copies share their whole text; a span that only repeats inside one record is not shared;
* characters are code points, white space and line ends count; texts are read whole;
* rows with a null id are left out; repeated rows of one id count once; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.spans import Windows, anchors, pieces
from quire.tables import cut, near

#: Characters of a span worth reporting, of the window an anchor is chosen by, and windows laid around each anchor.
SPAN, ANCHOR, SHIFTS = 300, 60, 4
#: Records of one window beyond which pairs are not formed from it.
HOT = 40
#: Rows of the sketch; its cells a row at least and at most.
SKETCH_ROWS, MIN_CELLS, MAX_CELLS = 3, 1 << 16, 1 << 28
SEGMENT = 1 << 19


def window_keys(text: str) -> np.ndarray:
    """The distinct hashes of the windows laid around the anchors of one text."""
    w = Windows(text)
    if w.n < SPAN:
        return np.zeros(0, np.int64)
    at = anchors(w.all(ANCHOR), SPAN - ANCHOR + 1)
    step = (SPAN - ANCHOR) // SHIFTS
    length = ANCHOR + step * (SHIFTS - 1)
    starts = np.unique((at[:, None] - step * np.arange(SHIFTS)[None, :]).ravel())
    starts = starts[(starts >= 0) & (starts + length <= w.n)]
    return np.unique(w.at(starts, length)).astype(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 1, 8_000_000):
            keys = [window_keys(t) for t in part.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in (0, 2, 3, 4)), lists], names=["doc_id", "h1", "h2", "n", "keys"])


def cells_of(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
    h = keys.astype(np.uint64) * np.uint64((0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)[row])
    return (h >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)


def _sketcher(cells: int, ranges: int, part: int, groups: int):
    """Partition sketches of one range of the keys: bit sets of the cells seen once, and twice or more, in segments."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros((SKETCH_ROWS, cells // 8), np.uint8) for _ in range(2))
        for batch in batches:
            keys = batch.column(0).flatten().to_numpy()
            keys = keys[keys % ranges == part] if ranges > 1 else keys
            if not len(keys):
                continue
            for row in range(SKETCH_ROWS):
                cell, n = np.unique(cells_of(keys, row, cells), return_counts=True)
                byte, bit = cell >> 3, (128 >> (cell & 7)).astype(np.uint16)
                starts = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
                at = byte[starts]
                one, more = (np.add.reduceat(b, starts).astype(np.uint8) for b in (bit, bit * (n > 1)))
                twice[row, at] |= once[row, at] & one | more
                once[row, at] |= one
        group = TaskContext.get().partitionId() % groups
        for row in range(SKETCH_ROWS):
            for s in range(0, cells, SEGMENT):
                a, b = s // 8, min(cells, s + SEGMENT) // 8
                yield pa.RecordBatch.from_pydict({"segment": pa.array([row * (cells // SEGMENT + 1) + s // SEGMENT], pa.int32()), "part": pa.array([group], pa.int32()), "once": [once[row, a:b].tobytes()], "twice": [twice[row, a:b].tobytes()]})

    return sketch


def _merge(part: pd.DataFrame) -> pd.DataFrame:
    once, twice = None, None
    for a, b in zip(part["once"], part["twice"]):
        a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
    return pd.DataFrame({"segment": [part["segment"].iloc[0]], "once": [once.tobytes()], "twice": [twice.tobytes()]})


def repeated_windows(keys: DataFrame, cells_a_key: float = 4, partials: int = 6) -> DataFrame:
    """``(key, doc_id)`` of the windows that the merged sketch takes for repeated. ``keys``: ``(doc_id, keys)``."""
    n = keys.agg(F.sum(F.size("keys"))).first()[0] or 0
    ranges = max(1, math.ceil(cells_a_key * n / MAX_CELLS))
    cells = max(MIN_CELLS, min(MAX_CELLS, 1 << int(cells_a_key * n / ranges).bit_length()))
    return reduce(DataFrame.unionByName, (_repeated(keys, cells, ranges, at, max(1, min(keys.rdd.getNumPartitions(), partials + n // 20_000_000))) for at in range(ranges)))


def _repeated(keys: DataFrame, cells: int, ranges: int, at: int, partials: int) -> DataFrame:
    groups = math.isqrt(partials)
    partial = keys.select("keys").coalesce(partials).mapInArrow(_sketcher(cells, ranges, at, groups), "segment int, part int, once binary, twice binary")
    out = "segment int, once binary, twice binary"
    some = partial if groups == 1 else partial.groupBy("segment", "part").applyInPandas(_merge, out)
    merged = some.groupBy("segment").applyInPandas(_merge, out)
    bits = {r.segment: r.twice for r in merged.select("segment", "twice").collect()}  # of bounded size: SKETCH_ROWS * cells / 8 bytes
    sketch = keys.sparkSession.sparkContext.broadcast([b"".join(bits.get(row * (cells // SEGMENT + 1) + s // SEGMENT, bytes(min(SEGMENT, cells) // 8)) for s in range(0, cells, SEGMENT)) for row in range(SKETCH_ROWS)])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.frombuffer(b, np.uint8) for b in sketch.value]
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy()
            ids = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            on = flat % ranges == at if ranges > 1 else np.ones(len(flat), bool)
            for row in range(SKETCH_ROWS):
                cell = cells_of(flat, row, cells)
                on &= (rows[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids[on])), pa.array(flat[on])], names=["doc_id", "key"])

    kind = keys.schema["doc_id"].dataType.simpleString().replace("bigint", "long")
    return keys.select("doc_id", "keys").mapInArrow(keep, f"doc_id {kind}, key long")


def _runs(on: np.ndarray) -> list[tuple[int, int]]:
    """Spans that the windows at the marked positions cover."""
    at = np.flatnonzero(on)
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) > SPAN)
    return list(zip(at[[0, *(breaks + 1)]].tolist(), (at[[*breaks, -1]] + SPAN).tolist()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans that each pair of texts shares, if they share one of ``SPAN`` characters."""
    for batch in batches:
        out = {"doc_a": [], "doc_b": [], "spans_a": [], "spans_b": []}
        last = (None, None)
        for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
            if last[0] != a:
                last = (a, Windows(ta).all(SPAN))
            ha, hb = last[1], Windows(tb).all(SPAN)
            on = np.isin(ha, hb)
            if on.any():
                s = int(np.flatnonzero(on)[0])
                if any(ta[s : s + SPAN] == tb[t : t + SPAN] for t in np.flatnonzero(hb == ha[s]).tolist()):
                    out["doc_a"].append(a)
                    out["doc_b"].append(b)
                    out["spans_a"].append([{"s": x, "e": y} for x, y in _runs(on)])
                    out["spans_b"].append([{"s": x, "e": y} for x, y in _runs(np.isin(hb, ha))])
        spans = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(out["doc_a"], pa.int64()), pa.array(out["doc_b"], pa.int64()), pa.array(out["spans_a"], spans), pa.array(out["spans_b"], spans)], names=list(out))


def _full_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For texts with hot windows, all windows of ``SPAN`` characters around those anchors, by a rolling hash and SHA-256."""
    step = (SPAN - ANCHOR) // SHIFTS
    length = ANCHOR + step * (SHIFTS - 1)
    for batch in batches:
        for doc, text, hot in zip(*(c.to_pylist() for c in batch.columns)):
            w = Windows(text)
            at = anchors(w.all(ANCHOR), SPAN - ANCHOR + 1)
            near = np.zeros(w.n - SPAN + 1, bool)
            for shift in range(SHIFTS):
                starts = at - step * shift
                starts = starts[(starts >= 0) & (starts + length <= w.n)]
                for p in starts[np.isin(w.at(starts, length).astype(np.int64), hot)].tolist():
                    near[max(0, p + length - SPAN) : p + 1] = True
            pos = np.flatnonzero(near)
            if len(pos):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pos), doc, np.int64)), pa.array(pos.astype(np.int64)), pa.array(w.at(pos, SPAN).astype(np.int64)), pa.array([hashlib.sha256(text[p : p + SPAN].encode("utf-8", "surrogatepass")).digest() for p in pos.tolist()], pa.binary())], names=["doc_id", "pos", "w1", "w2"]
                )


def group_pairs(members: DataFrame, key: list[str]) -> DataFrame:
    """Distinct ``(doc_a, doc_b)`` that share a key. Keys with one set of records count once."""
    sets = members.groupBy(*key).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), "doc_id")).alias("x2")).where("n > 1")
    one = sets.groupBy("n", "x1", "x2").agg(F.min(F.struct(*key)).alias("k")).select("k.*")
    kept = members.join(one, key, "left_semi")
    a, b = kept.withColumnRenamed("doc_id", "doc_a"), kept.withColumnRenamed("doc_id", "doc_b")
    return a.join(b, key).where("doc_a < doc_b").select("doc_a", "doc_b").distinct()


def _shared(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of exact copies ``(rep, doc_id, n)``, pairs of representatives, and the spans ``(doc_id, s, e)`` that those share."""
    texts = documents.where(F.col("doc_id").isNotNull() & (F.length("text") >= SPAN)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = texts.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.length("text").alias("n"))
    keys = cut(hashed.mapInArrow(_keys, "doc_id long, h1 long, h2 long, n int, keys array<long>"))
    classes = keys.select("doc_id", "h1", "h2", "n").distinct()
    reps = classes.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"))
    members = classes.join(reps, ["h1", "h2", "n"]).select("rep", "doc_id", "n")
    own = keys.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "keys")
    kept = cut(repeated_windows(own))
    counts = kept.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    cold = kept.join(counts.where(F.col("n") <= HOT), "key", "left_semi")
    hot = kept.join(counts.where(F.col("n") > HOT), "key", "left_semi")
    candidates = cut(group_pairs(cold, ["key"]))
    needed = candidates.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct()
    own = cut(near(texts, needed, "doc_id").join(needed, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    a = own.select(F.col("doc_id").alias("doc_a"), F.col("text").alias("text_a"))
    b = own.select(F.col("doc_id").alias("doc_b"), F.col("text").alias("text_b"))
    checked = cut(
        candidates.join(b, "doc_b")
        .join(a, "doc_a")
        .select("doc_a", "doc_b", "text_a", "text_b")
        .mapInArrow(_verify, "doc_a long, doc_b long, spans_a array<struct<s:bigint,e:bigint>>, spans_b array<struct<s:bigint,e:bigint>>")
    )
    hot_keys = hot.groupBy("doc_id").agg(F.collect_list("key").alias("hot"))  # of one text: bounded by its length
    full = cut(near(texts, hot_keys, "doc_id").join(hot_keys, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "hot").mapInArrow(_full_windows, "doc_id long, pos long, w1 long, w2 binary"))
    wide = full.select("doc_id", "w1", "w2").distinct()
    pairs = checked.select("doc_a", "doc_b").unionByName(group_pairs(wide, ["w1", "w2"])).distinct()
    several = wide.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    spans = (
        checked.select(F.col("doc_a").alias("doc_id"), F.inline("spans_a"))
        .unionByName(checked.select(F.col("doc_b").alias("doc_id"), F.inline("spans_b")))
        .unionByName(full.join(several, ["w1", "w2"], "left_semi").select("doc_id", F.col("pos").alias("s"), (F.col("pos") + SPAN).alias("e")))
    )
    return members, pairs, spans


def shared_pairs(documents: DataFrame) -> DataFrame:
    """``(doc_a, doc_b)``: pairs of different documents that share a span of ``SPAN`` characters."""
    members, pairs, _ = _shared(documents)
    a = members.select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("a"))
    b = members.select(F.col("rep").alias("doc_b"), F.col("doc_id").alias("b"))
    across = pairs.join(a, "doc_a").join(b, "doc_b").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))
    copies = members.join(members.groupBy("rep").agg(F.count("*").alias("size")).where("size > 1"), "rep", "left_semi")
    inside = copies.select("rep", F.col("doc_id").alias("doc_a")).join(copies.select("rep", F.col("doc_id").alias("doc_b")), "rep").where("doc_a < doc_b")
    return across.unionByName(inside.select("doc_a", "doc_b"))


def covered(spans: DataFrame, start: Column, end: Column) -> DataFrame:
    """``(doc_id, shared_chars)``: the length of the union of each document's spans."""
    w = Window.partitionBy("doc_id").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.select("doc_id", start.alias("s"), end.alias("e")).distinct().withColumn("reach", F.coalesce(reach, F.lit(0)))
    return fresh.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "reach"))).alias("shared_chars"))


def shared_share(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, shared_chars, share)`` of every document."""
    members, _, spans = _shared(documents)
    sizes = members.groupBy("rep").agg(F.count("*").alias("size"))
    parts = covered(spans, F.col("s"), F.col("e")).withColumnRenamed("doc_id", "rep")
    shared = (
        members.join(sizes, "rep")
        .join(parts, "rep", "left")
        .select("doc_id", F.when(F.col("size") > 1, F.col("n").cast("long")).otherwise(F.coalesce("shared_chars", F.lit(0))).alias("shared_chars"))
    )
    lengths = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")).distinct()
    chars = F.coalesce("shared_chars", F.lit(0).cast("long"))
    return lengths.join(shared, "doc_id", "left").select("doc_id", "n_chars", chars.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(chars / F.col("n_chars"), 6)).otherwise(0.0).alias("share"))

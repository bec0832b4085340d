"""Several values packed in one field: the dialect of each field is the one of least description length.

A dialect says which delimiters split, whether quotes protect, and whether brackets surround the list. Every field is
parsed in each dialect its characters admit. A value costs ``log2(N / count)`` bits if a corpus-wide dictionary knows
it, else an escape and its characters; a delimiter or quote left standing outside quotes costs an escape of its own.
The dictionary is counted by Spark over all fields of one clear dialect, the bits of each parse are summed by Spark
over a join of parses with the dictionary, and each field is then parsed in its cheapest dialect.

Defined results
* null, empty and blank fields, and fields that hold only delimiters or marks, give no rows;
* positions count from 1 without gaps, empty values are dropped, repeated values are kept;
* ties between dialects go to the earlier one in :func:`parses` (more delimiters first, quotes first);
* a quote that is never closed, or stands inside a value, is an ordinary character;
* a field of any length is parsed whole; repeated rows of one record give its values once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The delimiters, list marks, quotes and brackets that occur in packed keyword fields.
DELIMITERS = {
    "、": "、", ",": ",", "，": "，", ";": ";", "；": "；", "|": r"\|", "｜": "｜", "\t": r"\t", "\n": r"[\r\n]+",
    "/": r"\s+/\s+", "#": r"(?:^|(?<=\s))#(?=\S)", "•": r"(?:^|(?<=\s))[•●·▪◦‣∙*](?=\s)", "-": r"(?m:^)\s*[-–](?=\s)",
}
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "「": "」", "『": "』"}
BRACKETS = {"[": "]", "【": "】", "(": ")", "（": "）", "{": "}"}

#: Bits of one character, of an unknown value, and of a mark that its dialect does not explain.
CHAR_BITS, NEW_BITS, MARK_BITS = 8.0, 10.0, 24.0

_QUOTED = re.compile(r'\s*(?:"((?:[^"]|"")+)"|\'((?:[^\']|\'\')+)\'|“([^”]+)”|‘([^’]+)’|「([^」]+)」|『([^』]+)』)\s*')
_PRESENT = {d: re.compile(p) for d, p in DELIMITERS.items()}
_MARKS = re.compile("|".join([*DELIMITERS.values(), "[" + re.escape("".join([*QUOTES, *QUOTES.values(), *BRACKETS, *BRACKETS.values()])) + "]"]))
_ANY = re.compile("[" + re.escape("、,，;；|｜\t\r\n/#•●·▪◦‣∙*–-" + "".join([*QUOTES, *QUOTES.values(), *BRACKETS, *BRACKETS.values()])) + "]")
_SPLITTERS: dict[tuple[str, ...], re.Pattern] = {}


def split_field(text: str, delimiters: tuple[str, ...], quotes: bool) -> tuple[tuple[str, bool], ...]:
    """The non-empty values of ``text`` in one dialect, each with whether it stood in quotes."""
    splitter = _SPLITTERS.get(delimiters)
    if splitter is None:
        splitter = _SPLITTERS[delimiters] = re.compile("|".join(DELIMITERS[d] for d in delimiters) or r"(?!)")
    out, at, end = [], 0, len(text)
    while at <= end:
        if quotes and (m := _QUOTED.match(text, at)) and (m.end() == end or (splitter.match(text, m.end()) or splitter.match(text, m.end() - 1) or splitter.match(text, m.end(m.lastindex) + 1))):
            body, mark = m.group(m.lastindex), text[m.start(m.lastindex) - 1]
            if body.strip():
                out.append((body.replace(mark * 2, mark).strip(), True))
            s = splitter.search(text, m.end(m.lastindex) + 1)
        else:
            s = splitter.search(text, at)
            if value := text[at : s.start() if s else end].strip():
                out.append((value, False))
        if s is None:
            break
        at = max(s.end(), at + (s.end() == at))
    return tuple(out)


def parses(text: str) -> list[tuple[tuple[str, bool], ...]]:
    """The different parses of a field, in the order that breaks ties."""
    if not _ANY.search(text):
        return [((value, False),)] if (value := text.strip()) else []
    inner = [text]
    bare = text.strip()
    if len(bare) > 1 and BRACKETS.get(bare[0]) == bare[-1]:
        inner.insert(0, bare[1:-1])
    found: dict[tuple, None] = {}
    for body in inner:
        present = tuple(d for d, p in _PRESENT.items() if p.search(body))
        if not split_field(body, present, False):
            return []
        quoted = any(q in body for q in QUOTES)
        for delimiters in dict.fromkeys([present, *((d,) for d in present), ()]):
            for quotes in (True, False) if quoted else (False,):
                if values := split_field(body, delimiters, quotes):
                    found.setdefault(values)
        for n in range(len(present) - 1, 1, -1):  # some of several delimiters, where the others belong to values
            for delimiters in combinations(present, n):
                if values := split_field(body, delimiters, quoted):
                    found.setdefault(values)
    return list(found)


def literal_bits(value: str, quoted: bool) -> float:
    marks = 0 if quoted else len(_MARKS.findall(value))
    return NEW_BITS + CHAR_BITS * len(value) + (MARK_BITS - CHAR_BITS) * marks


def clear_values(text: str) -> tuple[str, ...]:
    """The values of a field that has at most one kind of delimiter and no quotes or brackets, else nothing."""
    if not _ANY.search(text):
        return (text.strip(),) if text.strip() else ()
    if any(c in text for c in (*QUOTES, *BRACKETS)):
        return ()
    present = tuple(d for d, p in _PRESENT.items() if p.search(text))
    if len(present) > 1 and present not in (("\n", "•"), ("\n", "-")):
        return ()
    return tuple(v for v, _ in split_field(text, present, False))


def _hash(value: str, quoted: bool) -> int:
    return xxhash.xxh64_intdigest(value.encode(), seed=0) - (1 << 63)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[int] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for value in clear_values(text):
                seen[_hash(value, False)] += 1
        if len(seen) > 500_000:
            yield pa.RecordBatch.from_pydict({"vhash": list(seen), "n": list(seen.values())})
            seen = Counter()
    yield pa.RecordBatch.from_pydict({"vhash": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fids, cands, hashes, bits = [], [], [], []
        for fid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            options = parses(text)
            if len(options) > 1:
                for k, values in enumerate(options):
                    for value, quoted in values:
                        fids.append(fid)
                        cands.append(k)
                        hashes.append(_hash(value, quoted))
                        bits.append(literal_bits(value, quoted))
        yield pa.RecordBatch.from_arrays(
            [pa.array(fids, pa.binary()), pa.array(cands, pa.int32()), pa.array(hashes, pa.int64()), pa.array(bits, pa.float64())], names=["fid", "cand", "vhash", "bits"]
        )


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, ids, pos, out = [], [], [], []
        for kind, rid, text, cand in zip(*(c.to_pylist() for c in batch.columns)):
            options = parses(text)
            for i, (value, _) in enumerate(options[cand or 0] if options else (), 1):
                kinds.append(kind)
                ids.append(rid)
                pos.append(i)
                out.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(ids, pa.string()), pa.array(pos, pa.int32()), pa.array(out, pa.string())], names=["record_kind", "record_id", "pos", "keyword"])


def value_dictionary(fields: DataFrame) -> DataFrame:
    """``(vhash, n)``: how often each value occurs in fields of one clear dialect."""
    return fields.select("packed").mapInArrow(_count, "vhash long, n long").groupBy("vhash").agg(F.sum("n").alias("n"))


def cheapest_dialect(fields: DataFrame) -> DataFrame:
    """``(fid, cand)`` of every field string that has more than one parse."""
    words = value_dictionary(fields)
    total = words.agg(F.greatest(F.sum("n"), F.lit(1)).cast("double").alias("total"))
    costs = words.crossJoin(F.broadcast(total)).select("vhash", F.log2((F.col("total") + 1) / F.col("n")).alias("known"))  # one row on the right
    distinct = fields.select("fid", "packed").dropDuplicates(["fid"])
    parts = distinct.mapInArrow(_candidates, "fid binary, cand int, vhash long, bits double")
    cost = F.least("bits", F.coalesce("known", "bits"))
    return (
        parts.join(costs, "vhash", "left")
        .groupBy("fid", "cand")
        .agg(F.sum(cost).alias("bits"))
        .groupBy("fid")
        .agg(F.min(F.struct(F.round("bits", 6).alias("bits"), "cand"))["cand"].alias("cand"))
    )


def unpack_values(records: DataFrame) -> DataFrame:
    """``(record_kind, record_id, pos, keyword)`` of ``records (record_kind, record_id, packed)``."""
    fields = (
        records.where(F.col("packed").isNotNull() & F.col("record_id").isNotNull())
        .select("record_kind", "record_id", "packed", F.unhex(F.md5("packed")).alias("fid"))
        .distinct()
    )
    return (
        fields.join(cheapest_dialect(fields), "fid", "left")
        .select("record_kind", "record_id", "packed", "cand")
        .mapInArrow(_values, "record_kind string, record_id string, pos int, keyword string")
        .distinct()
    )


def dialect_cost(text: str, counts: dict[str, int]) -> list[tuple[float, tuple[str, ...]]]:
    """The bits and values of every parse of one field under given value counts; for inspection and tests."""
    total = max(1, sum(counts.values()))
    return [
        (sum(min(literal_bits(v, q), math.log2((total + 1) / counts[v]) if counts.get(v) else math.inf) for v, q in values), tuple(v for v, _ in values))
        for values in parses(text)
    ]

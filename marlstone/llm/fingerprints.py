"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases level by level. On a level, runs of a symbol become one
symbol; deterministic coin tossing (the lowest bit in which a symbol differs from the one
before it, and that bit's value, repeated until few labels are left) gives labels of which
neighbours differ; a phrase begins at each local maximum of the labels. Its name is a hash
of the names in it, so no dictionary is needed. Where a phrase begins depends on a few
symbols around it only: equal substrings have equal phrases inside, whatever their offset.

The fingerprint holds the smallest 32-bit hashes of a text's distinct phrase names (of the
levels in LEVELS, of about 6 and 15 characters); likeness is the Jaccard similarity that
the smallest hashes of two texts together estimate (exact for texts of few phrases).

Defined results: null text is empty; the fingerprint of an empty text is "", which is
like itself (1) and unlike any other (0); a text of any length is parsed whole; rows follow
each other by descending doc_id, of equal ids by text, and those without id come last, by
the md5 of their texts (rows that share an id, or that lack one and share a text, are in one
range); a single row is its own next; columns besides doc_id and text are not read, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import text_or_empty
from marlstone.shipping import ship

LEVELS = (2, 3)
SKETCH = 64
RANGE_ROWS = 4000
MOST_RANGES = 20_000
BATCH_CHARS = 1_500_000
_U = np.uint64
_C = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _coin_table() -> np.ndarray:
    """For labels below 128: the coin of a label after another."""
    before, own = np.arange(128)[:, None], np.arange(128)[None, :]
    differ = before ^ own
    at = np.bitwise_count((differ & -differ) - 1)
    at = np.where(differ == 0, 7, at)
    return (2 * at + ((own >> at) & 1)).astype(np.uint8).ravel()


_COIN = _coin_table()


def parse_level(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of several texts' symbols, and which of them begin a text.

    first[i] says that symbols[i] begins a text; nothing depends on what stands before it.
    """
    new = np.empty(len(symbols), bool)
    new[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new |= first
    at = np.flatnonzero(new)
    if len(at) < len(symbols):
        length = np.diff(np.append(at, len(symbols)))
        symbols, first = symbols[at], first[at]
        runs = np.flatnonzero(length > 1)
        symbols[runs] = _mix(symbols[runs] + length[runs].astype(np.uint64) * _C)
    n = len(symbols)
    differ = symbols.copy()
    differ[1:] ^= symbols[:-1]
    lowest = np.bitwise_count((differ & (~differ + _U(1))) - _U(1))
    label = (lowest << 1) | ((symbols >> np.minimum(lowest, 63).astype(np.uint64)) & _U(1)).astype(np.uint8)
    label &= 127
    starts = np.flatnonzero(first)
    label[starts] = (symbols[starts] & _U(1)).astype(np.uint8)
    pair = np.empty(n, np.uint16)
    for _ in range(3):
        head = label[starts]
        np.multiply(label[:-1], np.uint16(128), out=pair[1:], dtype=np.uint16)
        pair[0] = 0
        label = _COIN[pair + label]
        label[starts] = head & 1
    high = np.ones(n, bool)
    np.greater(label[1:], label[:-1], out=high[1:])
    ahead = np.ones(n, bool)
    np.greater(label[:-1], label[1:], out=ahead[:-1])
    ahead[starts[1:] - 1] = True
    high &= ahead
    high |= first
    phrase = np.flatnonzero(high)
    size = np.diff(np.append(phrase, n))
    place = (np.arange(n) - np.repeat(phrase, size)).astype(np.uint64)
    names = _mix(np.add.reduceat(_mix(symbols + place * _C), phrase) + size.astype(np.uint64))
    return names, first[phrase]


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted smallest hashes of its phrase names, at most SKETCH of them."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    filled = np.flatnonzero(sizes)
    out = [np.zeros(0, np.uint32)] * len(texts)
    if not len(filled):
        return out
    symbols = _mix(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + _U(1))
    ends = np.cumsum(sizes[filled])
    first = np.zeros(ends[-1], bool)
    first[np.append(0, ends[:-1])] = True
    kept = []
    for level in range(1, max(LEVELS) + 1):
        symbols, first = parse_level(symbols, first)
        if level in LEVELS:
            owner = (np.cumsum(first) - 1).astype(np.uint64)
            kept.append((owner << _U(32)) | (_mix(symbols + _U(level)) >> _U(32)))
    every = np.unique(np.concatenate(kept))
    owner = (every >> _U(32)).astype(np.int64)
    begin = np.searchsorted(owner, np.arange(len(filled) + 1))
    low = every.astype(np.uint32)
    for k, i in enumerate(filled):
        out[i] = low[begin[k] : min(begin[k + 1], begin[k] + SKETCH)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    distinct = len(both) - int(twice.sum())
    full = max(len(a), len(b)) == SKETCH
    if not full or distinct <= SKETCH:
        limit = both[-1] if not full else min(x[-1] for x in (a, b) if len(x) == SKETCH)
    else:
        limit = both[np.append(True, ~twice)][SKETCH - 1]
    shared = int((twice & (both[1:] <= limit)).sum())
    of = int((both[np.append(True, ~twice)] <= limit).sum())
    return shared / of


def shown(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _range(bounds: np.ndarray, heads: np.ndarray):
    """bounds: the first (largest) ids of the ranges, descending; heads: the first (smallest) digests of the ranges of rows without id.

    A range's first row also goes, as `ahead`, to the range before it; the very first to the last one.
    """
    rising, n, every = bounds[::-1], len(bounds), len(bounds) + len(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = pc.is_valid(batch["doc_id"]).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(batch["doc_id"], 0).to_numpy()
            place, first = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
            if n:
                place = n - 1 - np.searchsorted(rising, ids, "left")
                first = known & (bounds[np.maximum(place, 0)] == ids)
            if len(heads):
                digests = np.array(pc.fill_null(batch["digest"], "").to_pylist(), "U32")
                own = np.maximum(np.searchsorted(heads, digests, "right") - 1, 0)
                place = np.where(known, place, n + own)
                first |= ~known & (heads[own] == digests)
            lead = np.flatnonzero(first)
            lead = lead[np.sort(np.unique(place[lead], return_index=True)[1])] if n == 0 or not known[lead].all() else lead
            rows = np.append(np.arange(len(ids)), lead)
            where = np.append(place, (place[lead] - 1) % every)
            ahead = np.arange(len(rows)) >= len(ids)
            for k in range(0, len(rows), 2000):
                some = pa.array(rows[k : k + 2000])
                columns = [batch[c].take(some) for c in ("doc_id", "text", "digest")]
                yield pa.RecordBatch.from_arrays([pa.array(where[k : k + 2000]), pa.array(ahead[k : k + 2000]), *columns], ["place", "ahead", "doc_id", "text", "digest"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; each but the ahead ones is compared with the row after it."""
    last: tuple | None = None  # (place, ahead, doc_id, text)

    def results(rows: list[tuple], final: bool) -> pa.RecordBatch:
        if final:
            rows = [*rows, (None, True, None, "")]
        texts = [r[3] for r in rows]
        asked = [i for i in range(len(rows) - 1) if not rows[i][1]]
        changed = [edited(texts[i], texts[i + 1]) for i in asked]
        made = fingerprints(texts + changed)
        plain, new = made[: len(texts)], made[len(texts) :]
        out = [
            (rows[i][2], len(texts[i]), hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest(), shown(plain[i]), shown(f), likeness(plain[i], f), likeness(plain[i], plain[i + 1]))
            for i, t, f in zip(asked, changed, new, strict=True)
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(_OUT), _OUT, strict=True)], schema=_OUT)

    for batch in batches:
        size = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False)) // BATCH_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                rows = list(zip(*(batch.column(c).slice(a, b - a).to_pylist() for c in range(4)), strict=True))
                rows = [last, *rows] if last else rows
                last = rows[-1]
                yield results(rows, False)
    if last:
        yield results([last], True)


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness; its likeness to the next document.

    One pass over the ids, and one over the digests of rows without id, finds where ranges
    of about RANGE_ROWS rows begin; the texts are shuffled once, by range, and read in order.
    """
    ship(docs.sparkSession)
    digest = F.when(F.col("doc_id").isNull(), F.md5(text_or_empty())).alias("digest")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), digest)
    ids = source.select("doc_id").where("doc_id is not null")
    n, most = ids.agg(F.count(F.lit(1)), F.max("doc_id")).first()
    ranges = min(MOST_RANGES, math.ceil(n / RANGE_ROWS))
    shares = F.expr(f"array({', '.join(f'{k / ranges!r}D' for k in range(1, ranges))})")
    cuts = ids.agg(F.percentile_approx("doc_id", shares, F.lit(10 * ranges))).first()[0] if ranges > 1 else []
    bounds = np.array(sorted(set(cuts) | ({int(most)} if n else set()), reverse=True), np.int64)
    others = source.select("doc_id", "digest").where("doc_id is null")
    parts = min(MOST_RANGES, math.ceil(others.count() / RANGE_ROWS))
    part = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * parts / 2**32)
    heads = sorted(r[0] for r in others.groupBy(part.alias("part")).agg(F.min("digest").alias("first")).select("first").collect()) if parts else []  # one for each range
    dealt = source.mapInArrow(_range(bounds, np.array(heads, "U32")), "place long, ahead boolean, doc_id long, text string, digest string")
    ordered = dealt.repartition(max(1, len(bounds) + len(heads)), "place").sortWithinPartitions("place", "ahead", F.col("doc_id").desc_nulls_last(), "digest", "text")
    return ordered.drop("digest").mapInArrow(
        _compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )

"""Near-duplicate documents: DartMinHash signatures, banded joining, exact verification.

A document is the weighted set of its five-word shingles, the weight being how often a
shingle occurs. Every unit of weight is a region into which a hashed Poisson process
throws darts; a document keeps the darts whose rank is under its limit (about
k (ln k + 3) darts in all, however long it is). Each dart falls on one of k coordinates,
and the earliest dart on a coordinate is the signature's value there. Two signatures
agree on a coordinate with the probability of the weighted Jaccard similarity.

Documents of the same words are one class from the start (by a 128-bit hash), so only one
of them is banded. Documents that share a band's coordinates meet in a bucket. A bucket of
more than `block` members is split by one more coordinate and then by a salt; each block
is a maximum spanning forest by agreement of signatures, of which the edges are candidate
links. They are verified on the 64-bit hashes of all shingles, and classes are the
connected components of the links that hold. That leaves the pairs of a bucket which agree
enough but whose forest links didn't hold. They are never listed: a first task per block
finds the members that have such a pair, from signatures alone, and a second one gets those
members' shingles, verifies their pairs and returns only the links that join classes, at
most one less than members. A bucket that wasn't split goes through both as it is, if some
link of it failed. A split one is dealt anew, by class, into blocks of which every two meet
(and each meets itself), except two of one class. A pair is tried in its first common
bucket only. So every pair that shares a band and agrees enough is tried or lies within a
class.

Defined results: words are runs of letters, digits and underscores in lower case; a text
of one to four words has them as its only shingle; texts without words are in a class only
with their exact copies; null text is empty; a text of any length is one set, and so are
rows that repeat an id with another text; rows without doc_id are linked only as exact
copies, and a class of only such rows has a null class_id; columns besides doc_id and text
are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import release, spare, text_digest, text_or_empty, written
from marlstone.llm.components import components
from marlstone.llm.tokenizing import ragged
from marlstone.shipping import ship

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
BLOCK = 1024
#: How far below the similarity the signatures' agreement may lie (over three standard deviations).
MARGIN = 0.1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's words begin (one more at the end)."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string())), r"[^\p{L}\p{N}\p{M}_]+", " ")
    lists = pc.ascii_split_whitespace(pc.utf8_trim_whitespace(plain))
    flat = lists.flatten()
    words = flat.dictionary_encode()
    distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    hashes, offsets = codes[words.indices.to_numpy()], lists.offsets.to_numpy()
    if "" in distinct:  # what an empty text is split into
        filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        hashes, offsets = hashes[filled], np.concatenate([[0], np.cumsum(filled)])[offsets]
    return hashes, offsets


def shingle_elements(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, element) for every unit of weight: the n-th time that a text has a shingle is an element of its own."""
    count = np.diff(offsets)
    n = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
    at, doc = ragged(offsets[:-1], n), np.repeat(np.arange(len(count)), n)
    size = np.minimum(count, SHINGLE)[doc]
    value = size.astype(np.uint64)
    for k in range(SHINGLE):
        value = mix(value * _U(0x9E3779B97F4A7C15) + np.where(k < size, padded[at + k], _U(0)))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])) if len(value) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    nth = np.arange(len(value)) - np.repeat(first, np.diff(np.append(first, len(value))))
    return doc, mix(value + nth.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def dart_signatures(doc: np.ndarray, element: np.ndarray, docs: int, k: int = COORDINATES) -> np.ndarray:
    """docs x k values of 16 bits; rows of texts without elements are 0."""
    best = np.full(docs * k, np.iinfo(np.uint64).max, np.uint64)
    weight = np.bincount(doc, minlength=docs)
    limit = k * (np.log(k) + 3.0) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        keep = todo[doc]
        d, e = doc[keep], element[keep]
        rank, nth = np.zeros(len(e)), 0
        while len(e):
            nth += 1
            dart = mix(e + _U(nth * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(((dart >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53)
            inside = rank <= limit[d]
            d, e, rank, dart = d[inside], e[inside], rank[inside], mix(dart[inside])
            slot = d * k + (dart % _U(k)).astype(np.int64)
            packed = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << _U(32)) | ((dart >> _U(40)) & _U(0xFFFF))
            np.minimum.at(best, slot, packed)
        todo = todo & (best.reshape(docs, k) == np.iinfo(np.uint64).max).any(axis=1)  # a coordinate without a dart: more darts
        limit = np.where(todo, limit * 2, limit)
    return np.where(weight[:, None] > 0, best.reshape(docs, k) & _U(0xFFFF), _U(0)).astype("<u2")


def _groups(batch: pa.RecordBatch, column: int, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(size // limit)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def content_keys(texts: pa.Array, hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """16 bytes that texts of the same words share; of a text without words, its own."""
    return [
        xxhash.xxh3_128_digest(hashes[a:b].tobytes() if b > a else b"\0" + texts[i].as_py().encode())
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
    ]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _groups(whole, 2):
            texts = batch.column(2)
            hashes, offsets = word_hashes(texts)
            doc, element = shingle_elements(hashes, offsets)
            signature = dart_signatures(doc, element, len(texts))
            some = np.diff(offsets) > 0
            signed = [row.tobytes() if s else None for row, s in zip(signature, some, strict=True)]
            keys = content_keys(texts, hashes, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.binary()), pa.array(signed, pa.binary())], ["doc_id", "digest", "key", "sig"])
    release()


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, elements): sorted 64-bit hashes."""
    for whole in batches:
        for batch in _groups(whole, 1):
            doc, element = shingle_elements(*word_hashes(batch.column(1)))
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            rows = [np.sort(element[a:b]).astype("<u8").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["key", "elements"])
    release()


def _elements(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u8") for x in column]


def alike(own: np.ndarray, others: list[np.ndarray], similarity: float, at_once: int = 1_000_000) -> np.ndarray:
    """Of which of the sorted sets the Jaccard similarity to the own one is `similarity` at least."""
    size = np.fromiter(map(len, others), np.int64, len(others))
    holds = np.minimum(size, len(own)) >= similarity * np.maximum(size, len(own))
    fits = np.flatnonzero(holds)
    for some in np.split(fits, np.flatnonzero(np.diff(np.cumsum(size[fits]) // at_once)) + 1):
        if len(some):
            flat = np.concatenate([others[j] for j in some])
            found = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            shared = np.add.reduceat(found.astype(np.int64), np.cumsum(size[some]) - size[some])
            holds[some] = shared >= similarity * (len(own) + size[some] - shared)
    return holds


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool(alike(x, [y], similarity)[0]) for x, y in zip(_elements(batch.column(2)), _elements(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], ["a", "b", "holds"])

    return run


def forest(signatures: np.ndarray, least: float) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges of a maximum spanning forest among rows that agree on a share of `least` at least; a root of each tree."""
    m = len(signatures)
    best, near = np.full(m, -1.0), np.full(m, -1)
    out, edges, roots, at = np.ones(m, bool), [], [], 0
    for step in range(m):
        if step:
            at = int(np.argmax(np.where(out, best, -2.0)))
        if best[at] >= least:
            edges.append((int(near[at]), at))
        else:
            roots.append(at)
        out[at] = False
        share = (signatures == signatures[at]).mean(axis=1)
        closer = out & (share > best)
        best[closer], near[closer] = share[closer], at
    return edges, roots


#: The side of all rows of a block that meets itself.
WITHIN = 2
LINKS = "band long, block long, a binary, b binary"


def _links(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(types)], ["band", "block", "a", "b"])


def _starts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Where the table's blocks begin, and their sizes."""
    band, block = table["band"].to_numpy(), table["block"].to_numpy()
    first = np.flatnonzero(np.append(True, (band[1:] != band[:-1]) | (block[1:] != block[:-1])))
    return first, np.diff(np.append(first, len(band)))


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["sig"].to_pylist()), "<u2").reshape(table.num_rows, -1)


def _by_block(blocks: Callable[[pa.Table], pa.RecordBatch]):
    """blocks on tables of whole blocks, from rows sorted by (band, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            band, block = batch["band"].to_numpy(), batch["block"].to_numpy()
            last = np.flatnonzero((band != band[-1]) | (block != block[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and (held[-1]["band"][-1].as_py(), held[-1]["block"][-1].as_py()) != (band[0], block[0]):
                yield blocks(pa.Table.from_batches(held))
                held = []
            if cut:
                yield blocks(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield blocks(pa.Table.from_batches(held))

    return run


def _link(least: float):
    """The candidate links of each block."""

    def blocks(table: pa.Table) -> pa.RecordBatch:
        band, block, sig = table["band"].to_numpy(), table["block"].to_numpy(), _signatures(table)
        keys = table["key"].to_pylist()
        first, size = _starts(table)
        rows: list[tuple] = []
        two = first[size == 2]
        for i, share in zip(two.tolist(), (sig[two] == sig[two + 1]).mean(axis=1).tolist(), strict=True):
            if share >= least:
                rows.append((band[i], block[i], *sorted((keys[i], keys[i + 1]))))
        for i, m in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            edges, _ = forest(sig[i : i + m], least)
            rows += [(band[i], block[i], *sorted((keys[i + a], keys[i + b]))) for a, b in edges]
        return _links(rows)

    return _by_block(blocks)


def reachable(i: int, signatures: np.ndarray, label: np.ndarray, side: np.ndarray, nth: int, least: float) -> np.ndarray:
    """The later rows of other labels, of another side (or any if all are of side WITHIN), that row i meets here.

    Those are the rows whose signatures agree with its own on a share of `least` at least
    and whose first common band is the nth; the others meet in that one.
    """
    others = np.flatnonzero((label != label[i]) & ((side != side[i]) | (side == WITHIN)))
    others = others[others > i]
    equal = signatures[others] == signatures[i]
    close = np.flatnonzero(equal.mean(axis=1) >= least)
    return others[close[~equal[close, : nth * ROWS].reshape(len(close), nth, ROWS).all(axis=2).any(axis=1)]]


def meeting(signatures: np.ndarray, label: np.ndarray, side: np.ndarray, nth: int, least: float) -> np.ndarray:
    """Which rows meet another one."""
    some = np.zeros(len(label), bool)
    for i in range(len(label)):
        others = reachable(i, signatures, label, side, nth, least)
        some[others] = True
        some[i] |= len(others) > 0
    return some


def joining(signatures: np.ndarray, elements: list[np.ndarray], label: np.ndarray, side: np.ndarray, nth: int, similarity: float, least: float) -> list[tuple[int, int]]:
    """Links that hold and join all labels that links between rows which meet here join."""
    links, label = [], label.copy()
    for i in range(len(label)):
        others = reachable(i, signatures, label, side, nth, least)
        for j in others[alike(elements[i], [elements[j] for j in others], similarity)].tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def _numbered(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Of each block: where it begins, its size, its labels as numbers, its sides and its band's number."""
    for i, m in zip(*(x.tolist() for x in _starts(table)), strict=True):
        label = np.unique(np.array([x.hex() for x in table["label"].slice(i, m).to_pylist()]), return_inverse=True)[1]
        yield i, m, label, table["side"].slice(i, m).to_numpy(), table["nth"][i].as_py()


def _meeting(least: float):
    """The rows of each block that meet another one of it."""

    def blocks(table: pa.Table) -> pa.RecordBatch:
        sig = _signatures(table)
        found = [meeting(sig[i : i + m], label, side, nth, least) for i, m, label, side, nth in _numbered(table)]
        kept = table.filter(pa.array(np.concatenate(found)))
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in kept.columns], kept.schema.names)

    return _by_block(blocks)


def _joining(similarity: float, least: float):
    """joining in each block."""

    def blocks(table: pa.Table) -> pa.RecordBatch:
        band, block, sig, keys = table["band"].to_numpy(), table["block"].to_numpy(), _signatures(table), table["key"].to_pylist()
        rows: list[tuple] = []
        for i, m, label, side, nth in _numbered(table):
            found = joining(sig[i : i + m], _elements(table["elements"].slice(i, m)), label, side, nth, similarity, least)
            rows += [(band[i], block[i], *sorted((keys[i + a], keys[i + b]))) for a, b in found]
        return _links(rows)

    return _by_block(blocks)


def _settled(labels: DataFrame, met: DataFrame, sets: DataFrame, similarity: float, least: float) -> DataFrame:
    """labels (node, label) after the pairs that meet in the blocks of met (band, block, nth, side, key, label, sig) have been verified."""
    columns = "band long, block long, nth int, side int, key binary, label binary, sig binary"
    met = met.select("band", "block", "nth", "side", "key", "label", "sig").repartition("band", "block").sortWithinPartitions("band", "block", "key")
    open_ = written(met.mapInArrow(_meeting(least), columns), "open")
    if open_.isEmpty():
        return labels
    whole = open_.join(sets, "key").repartition("band", "block").sortWithinPartitions("band", "block", "key")
    links = written(whole.mapInArrow(_joining(similarity, least), LINKS), "joined")
    if links.isEmpty():
        return labels
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links.select("a", "b")))


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))


def _met_across(hot: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """Pairs of blocks of each bucket of hot (band, nth, key), as (band, block, nth, side, key, label).

    A class of more than `block` members of a bucket has blocks of its own, smaller ones
    share blocks. Two blocks of one class don't meet.
    """
    rows = written(_labelled(hot, labels).select("band", "nth", "key", "label"), "classed")
    sizes = written(rows.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n")), "sizes")
    buckets = sizes.groupBy("band").agg(F.sum(F.when(F.col("n") <= block, F.col("n"))).alias("rest"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    own = F.col("n") > block
    classes = sizes.join(buckets, "band").select(F.col("band").alias("_band"), F.col("label").alias("_label"), "n", "rest")
    dealt = rows.join(classes, (F.col("band") == F.col("_band")) & (F.col("label") == F.col("_label")))
    at = F.when(own, F.xxhash64("label", F.pmod(F.xxhash64("key", "band"), F.ceil(F.col("n") / block)))).otherwise(F.pmod(F.xxhash64("label", "band"), F.ceil(F.col("rest") / block)))
    dealt = written(dealt.select("band", "nth", "key", "label", at.alias("at"), F.when(own, F.col("label")).alias("pure")), "dealt")
    blocks = written(dealt.select("band", "at", "pure").distinct(), "blocks")
    other = blocks.select(F.col("band").alias("_band"), F.col("at").alias("_at"), F.col("pure").alias("_pure"))
    pairs = blocks.join(other, (F.col("band") == F.col("_band")) & (F.col("at") <= F.col("_at")) & F.coalesce(F.col("pure") != F.col("_pure"), F.lit(True)))
    side = lambda at, n: F.struct(F.col(at).alias("at"), F.lit(n).alias("side"))
    sides = F.when(F.col("at") == F.col("_at"), F.array(side("at", WITHIN))).otherwise(F.array(side("at", 0), side("_at", 1)))
    meet = pairs.select("band", F.xxhash64("at", "_at").alias("block"), F.explode(sides).alias("x")).select(F.col("band").alias("_band"), "block", F.col("x.at").alias("_at"), "x.side")
    met = dealt.join(written(meet, "meet"), (F.col("band") == F.col("_band")) & (F.col("at") == F.col("_at")))
    return met.select("band", "block", "nth", "side", "key", "label")


def _candidate_links(members: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """members (band, block, key): links (band, block, a, b)."""
    rows = members.join(signed, "key").select("band", "block", "key", "sig")
    rows = rows.repartition("band", "block").sortWithinPartitions("band", "block", "key")
    return written(rows.mapInArrow(_link(least), LINKS), "candidates")


def _salted(members: DataFrame, by: list[str], block: int) -> DataFrame:
    """members with the size n of their group of `by` and a salt that cuts it into blocks of about `block` rows; single rows are left out."""
    sizes = members.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnsRenamed({c: f"_{c}" for c in by})
    salt = F.when(F.col("n") > block, F.pmod(F.xxhash64("key", "band"), F.ceil(F.col("n") / block))).otherwise(F.lit(0))
    return members.join(sizes, [F.col(c) == F.col(f"_{c}") for c in by]).select(*members.columns, "n", salt.alias("salt"))


def _classed(docs: DataFrame, similarity: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest, key), and (key, rep_id, rep_digest, label): the least row of each key and the key's class."""
    ship(docs.sparkSession)
    least = similarity - MARGIN
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"), text_or_empty().alias("text"))
    rows = written(source.mapInArrow(_sign, "doc_id long, digest binary, key binary, sig binary"), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("rep")
    one = written(rows.groupBy("key").agg(first, F.first("sig").alias("sig")).select("key", F.col("rep.doc_id").alias("rep_id"), F.col("rep.digest").alias("rep_digest"), "sig"), "distinct")
    signed = one.where("sig is not null and rep_id is not null").select("key", "sig")
    band = lambda b: F.xxhash64(F.lit(b), F.substring("sig", 1 + b * 2 * ROWS, 2 * ROWS))
    more = lambda b: F.xxhash64(F.substring("sig", 1 + (b * 2 * ROWS + 2 * ROWS) % (2 * COORDINATES), 2))
    each = [F.struct(band(b).alias("band"), F.lit(b).alias("nth"), more(b).alias("more")) for b in range(BANDS)]
    banded = signed.select("key", F.explode(F.array(*each)).alias("x")).select("key", "x.band", "x.nth", "x.more")
    bucketed = written(_salted(banded, ["band"], block), "meeting")
    small = bucketed.where(F.col("n") <= block).select("band", F.lit(0).cast("long").alias("block"), "nth", "key")
    hot = bucketed.where(F.col("n") > block).select("band", "nth", "more", "key")
    large = _salted(hot, ["band", "more"], block).select("band", F.xxhash64("more", "salt").alias("block"), "key")
    links = _candidate_links(small.select("band", "block", "key").union(large), signed, least)
    ends = links.select(F.col("a").alias("key")).union(links.select("b")).union(hot.select("key")).distinct().join(one.select("key", "rep_id", "rep_digest"), "key")
    texts = source.join(ends, (F.col("doc_id") == F.col("rep_id")) & (F.col("digest") == F.col("rep_digest"))).select("key", "text")
    sets = written(texts.mapInArrow(_shingles, "key binary, elements binary").dropDuplicates(["key"]), "shingles")
    pairs = links.select("a", "b").distinct().join(sets.select(F.col("key").alias("a"), F.col("elements").alias("ea")), "a").join(sets.select(F.col("key").alias("b"), F.col("elements").alias("eb")), "b")
    tried = written(pairs.select("a", "b", "ea", "eb").mapInArrow(_verify(similarity), "a binary, b binary, holds boolean"), "verified")
    labels = components(tried.where("holds"))
    failed = links.join(tried.where("not holds"), ["a", "b"], "left_semi").select("band", "block").distinct()
    cold = _labelled(small.join(failed, ["band", "block"], "left_semi"), labels).join(signed, "key")
    labels = _settled(labels, cold.withColumn("side", F.lit(WITHIN)), sets, similarity, least)
    if not hot.isEmpty():
        labels = _settled(labels, _met_across(hot.select("band", "nth", "key"), labels, block).join(signed, "key"), sets, similarity, least)
    keys = one.select("key", "rep_id", "rep_digest")
    return rows.select("doc_id", "digest", "key"), written(_labelled(keys, labels), "classes")


def near_duplicate_classes(docs: DataFrame, *, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id): class_id is the smallest doc_id of the document's class."""
    rows, keys = _classed(docs, similarity, block)
    named = keys.join(keys.groupBy("label").agg(F.min("rep_id").alias("class_id")), "label").select("key", "class_id")
    return rows.select("doc_id", "key").join(named, "key").select("doc_id", "class_id")


def keep_one_of_each(docs: DataFrame, *, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """One row of docs for each class of near copies, all columns as they are.

    It is the row of smallest doc_id, and of these the one whose text has the smallest
    digest; a class of rows without doc_id keeps one of them. Of rows that repeat both
    doc_id and text any one stays. Null text counts as empty, so one of all such rows stays.
    """
    rows, keys = _classed(docs, similarity, block)
    first = F.min(F.struct(F.col("rep_id").isNull().alias("none"), "rep_id", "rep_digest")).alias("rep")
    own, text, digest = spare(docs, "id", "text", "digest")
    kept = written(keys.groupBy("label").agg(first).select(F.col("rep.rep_id").alias(own), F.col("rep.rep_digest").alias(text)), "kept")
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.col(digest) == F.col(text))
    repeated = rows.withColumnRenamed("digest", digest).join(kept, match).groupBy(own, text).count().where("count > 1")
    out = docs.withColumn(digest, text_digest()).join(kept, match)
    if not repeated.isEmpty():
        out = out.dropDuplicates([own, text])
    return out.select(*docs.columns)

"""Quality by a document classifier and hierarchical empirical Bayes.

A logistic classifier on measures of a text's surface gives each document a probability
of being good. Hosts and, within them, paths get a posterior mean of that probability,
shrunk toward the host's, and the host's toward the global mean, by as many pseudo-documents
as the spread between groups justifies (method of moments). For each document the
posteriors of its host and path are those of the other documents there: its own probability
is taken out of the sums, so that its evidence counts once. A document's score adds, on the
log-odds scale, its own evidence and its path's departure from the global mean; the rows of
a group meet only in sums, so a host may have any share of them.

For `documents`, the host is `source` and the path is `lang` within it.

Defined results: null text is empty; a text of any length is measured whole; null hosts and
paths are groups of their own; without labelled rows of both classes every document's own
probability is 0.5; a document alone in its host has the global mean as its posterior;
every row is scored on its own, so repeated rows and ties get equal scores, and doc_id
plays no part; columns besides host, path, doc_id and text are passed on, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import release, spare, text_or_empty, written
from marlstone.llm.learning import labelled_sample, logistic, sigmoid

PER_CLASS = 3000
#: A group counts as at least one and at most this many pseudo-documents.
LEAST_PRIOR, MOST_PRIOR = 1.0, 10_000.0
BATCH_CHARS = 3_000_000
MEASURES = ("log_words", "upper", "digits", "symbols", "stops", "bars", "bangs", "lines", "word_length", "distinct_words", "top_word", "marked_words", "short_words")

_CLASS = np.zeros(256, np.uint8)  # 0: anything else
for _n, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\f\v", b"\n", b".,;:", b"|", b"!", b"#$%&*+/<=>@\\^_`{}~"), 1):
    _CLASS[list(_chars)] = _n
_CLASS[128:] = 10


def measures(texts: pa.Array) -> np.ndarray:
    """A row of MEASURES for each text."""
    n = len(texts)
    raw = np.frombuffer("".join(texts.to_pylist()).encode("utf-8", "surrogatepass"), np.uint8)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(n), sizes)
    count = np.bincount(owner * 11 + _CLASS[raw], minlength=11 * n).reshape(n, 11).astype(float)
    lists = pc.ascii_split_whitespace(pc.utf8_trim_whitespace(texts.cast(pa.large_string())))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    coded = flat.dictionary_encode()
    index, word_of = coded.indices.to_numpy(), np.repeat(np.arange(n), np.diff(offsets))
    pairs, times = np.unique(word_of * max(len(coded.dictionary), 1) + index, return_counts=True)
    pair_of = pairs // max(len(coded.dictionary), 1)
    words = np.maximum(np.bincount(word_of, minlength=n), 1)
    distinct = np.bincount(pair_of, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, pair_of, times)
    length = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)
    marked = pc.match_substring_regex(coded.dictionary, r"[#$%&*!|]$").to_numpy(zero_copy_only=False)
    sums = lambda v: np.bincount(word_of, weights=v[index].astype(float), minlength=n) if len(index) else np.zeros(n)
    letters, every = np.maximum(count[:, 1] + count[:, 2] + count[:, 10], 1), np.maximum(sizes, 1)
    return np.column_stack([
        np.log1p(words), count[:, 2] / letters, count[:, 3] / every, (count[:, 9] + count[:, 0]) / every, count[:, 6] / words, count[:, 7] / words, count[:, 8] / words,
        count[:, 5] / words, np.log1p(sums(length) / words), distinct / words, top / words, sums(marked) / words, sums(length <= 3) / words,
    ])


class Classifier:
    """Standardized measures, their coefficients and an intercept. The measures are clipped to what is usual."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.known = len(y) > 0 and 0 < y.sum() < len(y)
        if self.known:
            self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
            share = y.mean()
            self.beta = logistic(self._scaled(x), y, np.where(y == 1, 0.5 / share, 0.5 / (1 - share)), ridge=2.0)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -4, 4)
        return np.column_stack([z, z * z])

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if not self.known or not len(texts):
            return np.full(len(texts), 0.5)
        z = self._scaled(measures(texts))
        return sigmoid(z @ self.beta[:-1] + self.beta[-1])


def _batches(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.binary_length(pc.fill_null(batch[column], "")).to_numpy(zero_copy_only=False)) // BATCH_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _measure(batches):
    for whole in batches:
        for batch in _batches(whole, "text"):
            got = measures(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["y"], pa.array(list(got), pa.list_(pa.float64()))], ["y", "x"])


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Classifier:
    sample = labelled_sample(docs, labels, "quality", per_class).mapInArrow(_measure, "y double, x array<double>")
    rows = sorted((tuple(r["x"]), r["y"]) for r in sample.collect())  # at most 2 * per_class rows of numbers
    return Classifier(np.array([r[0] for r in rows]).reshape(len(rows), len(MEASURES)), np.array([r[1] for r in rows]))


def _own(classifier: Classifier):
    def run(batches):
        for whole in batches:
            for batch in _batches(whole, "text"):
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(classifier(batch["text"]))], [*names, "own"])
        release()

    return run


def _prior(groups: DataFrame, n: str, total: str, squares: str, center: Column) -> float:
    """Pseudo-documents of a group's prior: the variance within groups over that between their means."""
    mean = F.col(total) / F.col(n)
    row = groups.agg(
        F.sum(n).alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col(squares) - F.col(n) * mean * mean).alias("within"),
        F.sum(F.col(n) * (mean - center) * (mean - center)).alias("between"), F.sum(F.col(n) * F.col(n)).alias("nn"),
    ).first()
    if not row["n"] or row["n"] <= row["k"] or row["k"] < 2:
        return MOST_PRIOR
    within = row["within"] / (row["n"] - row["k"])
    spread = (row["between"] - (row["k"] - 1) * within) / max(row["n"] - row["nn"] / row["n"], 1e-9)
    return float(np.clip(within / spread if spread > 1e-12 else MOST_PRIOR, LEAST_PRIOR, MOST_PRIOR))


#: Documents and their probabilities added up, of the path and of the host.
SUMS = ("n", "s", "hn", "hs")


class Groups:
    """Sums of hosts and paths, a row for each path, and what they are shrunk to and by how much."""

    def __init__(self, scored: DataFrame):
        """scored: (host, path, own)."""
        paths = written(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("s"), F.sum(F.col("own") * F.col("own")).alias("q")), "paths")
        hosts = written(paths.groupBy(F.col("host").alias("_host")).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq")), "hosts")
        total = hosts.agg(F.sum("hs"), F.sum("hn")).first()
        self.overall = float(np.clip(total[0] / total[1], 1e-3, 1 - 1e-3)) if total[1] else 0.5
        self.host_prior = _prior(hosts, "hn", "hs", "hq", F.lit(self.overall))
        joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).select("host", "path", "n", "s", "q", "hn", "hs")
        self.sums = written(joined, "joined")
        self.path_prior = _prior(self.sums, "n", "s", "q", self._host(0, F.lit(0.0)))

    def _host(self, less: int, own: Column, n: str = "hn", s: str = "hs") -> Column:
        return (F.col(s) - own + self.host_prior * F.lit(self.overall)) / (F.col(n) - less + self.host_prior)

    def posteriors(self, less: int, own: Column, sums: Sequence[str] = SUMS) -> tuple[Column, Column]:
        """Of a row's host and path, from its columns named in `sums`, without `less` documents of the probability `own`."""
        n, s, hn, hs = sums
        host = self._host(less, own, hn, hs)
        return host, (F.col(s) - own + self.path_prior * host) / (F.col(n) - less + self.path_prior)

    def score(self, own: Column, sums: Sequence[str] = SUMS) -> Column:
        """A document's log-odds by its own evidence and its path's."""
        logit = lambda p, least: F.log(F.greatest(F.lit(least), F.least(F.lit(1 - least), p)) / (1 - F.greatest(F.lit(least), F.least(F.lit(1 - least), p))))
        return logit(own, 1e-12) + logit(self.posteriors(1, own, sums)[1], 1e-3) - F.lit(float(np.log(self.overall / (1 - self.overall))))


def group_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, host_posterior, path_posterior) of all documents of scored (host, path, own): a row for each path."""
    groups = Groups(scored)
    host, path = groups.posteriors(0, F.lit(0.0))
    return groups.sums.select("host", "path", host.alias("host_posterior"), path.alias("path_posterior"))


def _scored(docs: DataFrame, classifier: Classifier, host: str, path: str, more: Sequence[str]) -> DataFrame:
    source = docs.select(*more, F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), text_or_empty().alias("text"))
    schema = T.StructType([f for f in source.schema.fields if f.name != "text"]).add("own", "double")
    return written(source.mapInArrow(_own(classifier), schema), "scored")


def quality_scores(docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, own, host_posterior, path_posterior, score, keep): keep is 1 where score is at least 0.5."""
    scored = _scored(docs, fitted(docs, labels, per_class), host, path, ["doc_id"])
    groups = Groups(scored)
    sums = groups.sums.withColumnsRenamed({"host": "_host", "path": "_path"})
    both = scored.join(sums, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    (of_host, of_path), score = groups.posteriors(1, F.col("own")), groups.score(F.col("own"))
    return both.select("doc_id", "own", of_host.alias("host_posterior"), of_path.alias("path_posterior"), (1 / (1 + F.exp(-score))).alias("score"), (score >= 0).cast("int").alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", per_class: int = PER_CLASS) -> DataFrame:
    """docs' rows whose score is at least 0.5, as they are. A document's own probability is worked out twice rather than shuffling texts."""
    classifier = fitted(docs, labels, per_class)
    groups = Groups(_scored(docs, classifier, host, path, []))
    of_host, of_path, own, *sums = spare(docs, "host", "path", "own", *SUMS)
    renamed = groups.sums.select(F.col("host").alias(of_host), F.col("path").alias(of_path), *[F.col(c).alias(n) for c, n in zip(SUMS, sums, strict=True)])

    def run(batches):
        for whole in batches:
            for batch in _batches(whole, "text"):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(classifier(pc.fill_null(batch["text"], "")))], [*batch.schema.names, own])
        release()

    known = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(own, T.DoubleType())]))
    same = F.col(host).cast("string").eqNullSafe(F.col(of_host)) & F.col(path).cast("string").eqNullSafe(F.col(of_path))
    return known.join(renamed, same).where(groups.score(F.col(own), sums) >= 0).select(*docs.columns)

"""corpus_pipeline on a test table: run() and each stage held against a plain, slow version."""

import math
import os
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm import catalogue, quality
from marlstone.llm.common import table, written

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def good(docs, spark):
    """Ids that the classifier and the posteriors of host and path let through, worked out one row at a time."""
    classifier = quality.fitted(table(spark, SF, "documents"), table(spark, SF, "labels"))
    rows = [(r.doc_id, r.source, r.lang, float(p)) for r, p in zip(docs, classifier(pa.array([r.text or "" for r in docs])), strict=True)]
    return {i for i, keep in quality_of(rows).items() if keep}


def quality_of(rows):
    """{id: keep} for (id, host, path, own): means of the other rows, shrunk to the host's, shrunk to all others'."""

    def prior(groups, centers):
        n, within, between, nn = sum(map(len, groups)), 0.0, 0.0, sum(len(g) ** 2 for g in groups)
        for g, c in zip(groups, centers, strict=True):
            mean = sum(g) / len(g)
            within += sum((x - mean) ** 2 for x in g)
            between += len(g) * (mean - c) ** 2
        if n <= len(groups) or len(groups) < 2:
            return quality.MOST_PRIOR
        within /= n - len(groups)
        spread = (between - (len(groups) - 1) * within) / max(n - nn / n, 1e-9)
        return min(max(within / spread if spread > 1e-12 else quality.MOST_PRIOR, quality.LEAST_PRIOR), quality.MOST_PRIOR)

    hosts, paths = defaultdict(list), defaultdict(list)
    for _, host, path, own in rows:
        hosts[host].append(own)
        paths[host, path].append(own)
    overall = min(max(sum(r[3] for r in rows) / len(rows), 1e-3), 1 - 1e-3)
    for_host = prior(list(hosts.values()), [overall] * len(hosts))
    posterior = {h: (sum(g) + for_host * overall) / (len(g) + for_host) for h, g in hosts.items()}
    for_path = prior(list(paths.values()), [posterior[h] for h, _ in paths])
    logit = lambda p: math.log(p / (1 - p))
    out = {}
    for i, host, path, own in rows:
        h = (sum(hosts[host]) - own + for_host * overall) / (len(hosts[host]) - 1 + for_host)
        p = (sum(paths[host, path]) - own + for_path * h) / (len(paths[host, path]) - 1 + for_path)
        shift = logit(min(max(p, 1e-3), 1 - 1e-3)) - logit(overall)
        out[i] = logit(min(max(own, 1e-12), 1 - 1e-12)) + shift >= 0
    return out


@needs_tables
def test_run_equals_the_slow_version(spark):
    docs = table(spark, SF, "documents").collect()
    kept = good(docs, spark)
    rows = sorted((r for r in docs if r.doc_id in kept), key=lambda r: r.doc_id)
    label = brute.near_classes([(r.doc_id, r.text) for r in rows])
    rows = [r for k, r in enumerate(rows) if label[k] == k]
    texts = [brute.masked(r.text)[0] for r in rows]
    size, taken = brute.mixed([(r.doc_id, r.source, t) for r, t in zip(rows, texts, strict=True)])
    times = {r.doc_id: n for r, s, turns in zip(rows, size, taken, strict=True) if (n := sum(s > 0 and 2 * t >= s for t in turns))}

    out = corpus_pipeline.run(spark, SF).toPandas()
    library = Tokenizer.from_file(catalogue.tokenizer_path())
    ids = {r.doc_id: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for r, t in zip(rows, texts, strict=True)}
    assert set(out.doc_id) == set(times)
    for doc_id, pieces in out.groupby("doc_id"):
        covered = Counter(k for p in pieces.itertuples() for k in range(p.start, p.start + p.length))
        assert covered == {k: times[doc_id] for k in range(len(ids[doc_id]))}
        assert all(zlib.crc32(ids[doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in pieces.itertuples())
    for _, pieces in out.groupby("sequence_id"):
        pieces = pieces.sort_values("offset")
        assert pieces.offset.tolist() == [0, *pieces.length.cumsum().tolist()[:-1]] and pieces.length.sum() <= 4096


@needs_tables
def test_stages_keep_the_columns(spark):
    docs, kept = table(spark, SF, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        kept[name] = docs.toPandas()
        assert name == "packing" or docs.columns == columns
    first, labels = table(spark, SF, "documents").toPandas(), dict(table(spark, SF, "labels").select("doc_id", "quality").collect())
    known = [i for i in first.doc_id if i in labels]
    assert sum((i in set(kept["quality"].doc_id)) == bool(labels[i]) for i in known) / len(known) > 0.95
    assert list(kept["secrets"].sort_values("doc_id").doc_id) == list(kept["near_duplicates"].sort_values("doc_id").doc_id)

"""Near copies in buckets of more members than a block, most of them unlike, held against every pair."""

import itertools

import numpy as np
import pyarrow as pa

from marlstone.llm import neardup

WORDS = [f"{a}{b}" for a in "the quick brown fox jumps over a lazy dog while seven bright birds sing".split() for b in range(60)]


def prose(n, seed):
    return [WORDS[i] for i in np.random.default_rng(seed).integers(0, len(WORDS), n)]


def changed(words, places, tag):
    w = list(words)
    for n in places:
        w[n] = f"{tag}{n}"
    return w


def bags(texts):
    hashes, offsets = neardup.word_hashes(pa.array(texts))
    doc, element = neardup.shingle_elements(hashes, offsets)
    return [set(element[doc == i].tolist()) for i in range(len(texts))], neardup.dart_signatures(doc, element, len(texts))


def classes_of(texts, also=lambda a, b: True):
    sets, sig = bags(texts)
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        shared = len(sets[a] & sets[b])
        if label[a] != label[b] and shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) and also(sig[a], sig[b]):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
    return dict(enumerate(label))


def classes(spark, texts, **options):
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(made, **options).collect()}


def test_copies_among_many_unlike_texts_that_share_a_band(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BANDS", 2)  # so that no other band makes up for a bucket
    passage, texts = prose(200, 1), []
    for k in range(200):
        w = passage + prose(40, 100 + k)
        texts += [" ".join(w), " ".join(changed(w, [30 + k % 7, 140 + k % 50], f"other{k}x"))]
    band = lambda a, b: any((a[n : n + neardup.ROWS] == b[n : n + neardup.ROWS]).all() for n in (0, neardup.ROWS))
    near = lambda a, b: band(a, b) and (a == b).mean() >= neardup.SIMILARITY - neardup.MARGIN
    assert classes(spark, texts, block=2) == classes_of(texts, near)


def test_copies_in_other_blocks_of_a_family_around_the_limit(spark):
    base, texts, r = prose(250, 7), [], np.random.default_rng(5)
    for k in range(110):  # most of the family's pairs lie between 0.7 and 0.8, where links of a forest fail
        w = changed(base, r.choice(250, 4, replace=False), f"edit{k}x")
        texts += [" ".join(w), " ".join(changed(w, r.choice(250, 4, replace=False), f"more{k}x"))]
    assert classes(spark, texts, block=4) == classes_of(texts)

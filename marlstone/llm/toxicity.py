"""Toxicity by weak supervision.

1. Terms (words and the beginnings of words) that are far more frequent in toxic than in
   other documents are found by counting over a sample of labelled documents.
2. Voters: lexicons, into which the terms are dealt by strength, and patterns. A voter fires on a text
   or doesn't.
3. A generative label model, fitted by EM without labels, estimates how often each voter
   fires on toxic and on other texts (its accuracy) and how the voters' firing goes together
   within either kind (their correlations); from these it has each text's posterior.
4. A linear classifier over the single terms is trained on the posteriors. Its scores are
   calibrated on the sample's labels. All documents are scored by the classifier.

Labels come only from rows whose crc32(doc_id as text) mod 5 is not 0, a bounded sample of
them; lang, source and doc_id are not looked at.

Defined results: null text is empty; an empty text gets the score of a text without terms;
a null doc_id is not held out; without labelled rows of both classes every score is 0; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import text_or_empty
from marlstone.llm.learning import labelled_sample, logistic, sigmoid

PER_CLASS = 3000
FOLDS = 5
STARTS = (4, 5, 6)
LEXICONS = 24
MOST_TERMS = 1200
#: A term's log odds ratio, less two standard errors, must be this high: chance finds many rare terms in toxic texts only.
LEAST_LIFT = 0.7
BATCH_CHARS = 3_000_000
#: Patterns of abuse that hold in any language or in the languages at hand.
PATTERNS = (
    r"(?i)\b(?:you|your|du|dein|tu|ton|vous|eres|te)\s+(?:are|an?|all|bist|es|un|una|une)?\s*(?:so\s+|such\s+an?\s+)?(?:idiot|stupid|moron|dumm|bête|tonto)",
    r"(?i)\b(?:shut up|go away|get lost|kill yourself|i hate|drop dead)\b",
    r"(?i)\b(?:idiot|moron|stupid|loser|scum|trash|worthless|pathetic|disgusting|clown)s?\b",
    r"[!?]{4,}",
)


def _hash(words: list[str], kind: str) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(f"{kind}{w}") for w in words), np.uint64, len(words))


def text_terms(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term) for the distinct terms of each text; terms are 64-bit hashes, or places in wanted (sorted)."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string())), r"[^\p{L}\p{N}\p{M}]+", " ")
    lists = pc.ascii_split_whitespace(pc.utf8_trim_whitespace(plain))
    coded = lists.flatten().dictionary_encode()
    index = coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    length = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)
    docs, terms = [], []
    for start in (0, *STARTS):
        some = np.flatnonzero(length > max(start, 1)) if start else np.flatnonzero(length > 1)
        cut = coded.dictionary.take(pa.array(some))
        if start:
            cut = pc.utf8_slice_codeunits(cut, 0, start)
        heads = cut.dictionary_encode()
        names = _hash(heads.dictionary.to_numpy(zero_copy_only=False).tolist(), str(start))[heads.indices.to_numpy()]
        of_word = np.full(len(length), -1, np.int64)
        if wanted is None:
            distinct, place = np.unique(names, return_inverse=True)
            of_word[some] = place
        else:
            place = np.minimum(np.searchsorted(wanted, names), len(wanted) - 1)
            of_word[some] = np.where(wanted[place] == names, place, -1)
        value = of_word[index]
        hit = value >= 0
        pairs = np.unique((owner[hit].astype(np.int64) << 32) | value[hit])
        docs.append(pairs >> 32)
        low = pairs & 0xFFFFFFFF
        terms.append(distinct[low] if wanted is None else low)
    return np.concatenate(docs), np.concatenate(terms)


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False)) // BATCH_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def _count(batches):
    for batch in _some(batches):
        doc, term = text_terms(batch["text"])
        toxic = batch["y"].to_numpy()[doc]
        names, place = np.unique(term, return_inverse=True)
        all_, bad = np.bincount(place), np.bincount(place, weights=toxic).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(all_), pa.array(bad)], ["term", "n", "bad"])


def _votes(wanted: np.ndarray):
    def run(batches):
        for batch in _some(batches):
            doc, term = text_terms(batch["text"], wanted)
            order = np.argsort(doc, kind="stable")
            ends = np.searchsorted(doc[order], np.arange(1, batch.num_rows))
            fired = np.column_stack([pc.match_substring_regex(batch["text"], p).to_numpy(zero_copy_only=False) for p in PATTERNS])
            yield pa.RecordBatch.from_arrays(
                [batch["y"], pa.array(np.split(term[order], ends), pa.list_(pa.int64())), pa.array(list(fired), pa.list_(pa.bool_()))], ["y", "terms", "fired"]
            )

    return run


def label_model(votes: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Posteriors that the texts are toxic, from votes (texts x voters, 0 or 1), by EM.

    Within either kind the votes are modelled by their rates and one covariance, of which the
    inverse discounts voters that fire together; the first guess trusts earlier voters more.
    """
    n, m = votes.shape
    post = np.clip(1 - np.prod(1 - votes * np.linspace(0.9, 0.3, m), axis=1), 0.02, 0.98)
    for _ in range(rounds):
        weight = post.sum()
        share = np.clip(weight / n, 0.01, 0.99)
        yes = (post @ votes + 0.5) / (weight + 1)
        no = ((1 - post) @ votes + 0.05) / (n - weight + 1)
        a, b = votes - yes, votes - no
        spread = ((a * post[:, None]).T @ a + (b * (1 - post)[:, None]).T @ b) / n + np.eye(m) * 0.01
        direction = np.linalg.solve(spread, yes - no)
        margin = votes @ direction - 0.5 * (yes + no) @ direction + np.log(share / (1 - share))
        new = sigmoid(margin)
        if np.abs(new - post).max() < 1e-5:
            break
        post = new
    return post


class Scorer:
    """Terms in sorted order, a weight for each, and the calibrated line of the score."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, slope: float, base: float):
        self.terms, self.weights, self.slope, self.base = terms, weights, slope, base

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if not len(self.terms):
            return np.full(len(texts), float(sigmoid(np.array([self.base]))[0]))
        doc, term = text_terms(texts, self.terms)
        margin = np.bincount(doc, weights=self.weights[term], minlength=len(texts))
        return sigmoid(self.slope * margin + self.base)


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Scorer:
    learnt = F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0
    known = labels.where("toxic is not null").where(learnt)
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    sample = labelled_sample(docs, labels, "toxic", per_class, learnt)
    sizes = dict(sample.groupBy("y").count().collect())
    bad, good = sizes.get(1.0, 0), sizes.get(0.0, 0)
    if not bad or not good:
        return Scorer(np.zeros(0, np.uint64), np.zeros(0), 0.0, -40.0)
    counts = sample.mapInArrow(_count, "term long, n long, bad long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    b, g = F.col("bad") + 0.5, F.col("n") - F.col("bad") + 0.5
    lift = F.log(b / F.lit(bad + 1.0)) - F.log(g / F.lit(good + 1.0)) - 2 * F.sqrt(1 / b + 1 / g)
    chosen = counts.select("term", lift.alias("lift")).where(F.col("lift") >= LEAST_LIFT).orderBy(F.col("lift").desc(), "term").limit(MOST_TERMS)
    ranked = np.array([r[0] for r in chosen.collect()], np.int64).view(np.uint64)  # at most MOST_TERMS
    terms = np.sort(ranked)
    if not len(terms):
        return Scorer(terms, np.zeros(0), 0.0, float(np.log(share / (1 - share))))
    rows = sample.mapInArrow(_votes(terms), "y double, terms array<long>, fired array<boolean>").toPandas()  # at most 2 * per_class short rows
    rows = rows.sort_values(["y", "terms"], key=lambda c: c.map(tuple) if c.name == "terms" else c)
    x = np.zeros((len(rows), len(terms)))
    for i, own in enumerate(rows["terms"]):
        x[i, np.asarray(own, int)] = 1
    lexicon = np.empty(len(terms), int)
    lexicon[np.searchsorted(terms, ranked)] = np.arange(len(terms)) * LEXICONS // len(terms)  # like with like, the surest terms first
    votes = np.column_stack([*[x[:, lexicon == k].max(axis=1) for k in range(LEXICONS) if (lexicon == k).any()], np.array(rows["fired"].tolist(), float)])
    votes = votes[:, votes.std(0) > 0]
    posterior = label_model(votes)
    beta = logistic(x, posterior, ridge=3.0)
    weights = np.maximum(beta[:-1], 0.0)
    y, margin = rows["y"].to_numpy(), x @ weights
    balance = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    slope, base = logistic(margin[:, None], y, balance, ridge=1e-3)
    return Scorer(terms, weights, float(slope), float(base))


def _score(scorer: Scorer):
    def run(batches):
        for batch in _some(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(scorer(batch["text"]))], ["doc_id", "held_out", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    scorer = fitted(docs, labels, per_class)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text_or_empty().alias("text"))
    scored = source.mapInArrow(_score(scorer), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

"""Personal data: candidate spans, boosted trees over their format and context, redaction.

Generators with high recall propose spans, which may overlap. The strict formats (BASE)
are always redacted. Of the looser proposals (MORE), those are redacted whose score by
gradient-boosted trees reaches the kind's calibrated threshold and that no strict span
overlaps. The trees are fitted on the driver to `fit_rows` invented candidates (a fixed
recipe, no corpus text), whose features come from the same expressions as the corpus's,
and become one SQL expression; scoring runs in the JVM.

Defined results: null text is empty; a text of any length is searched whole; spans that
begin at one place are listed by kind; every row is judged on its own, so null or repeated
doc_ids don't matter; only doc_id and text are read, whatever else there is, by the digest
(scan_pii() keeps all columns, of which none may begin with an underscore and a kind's
name); an empty table gives no rows.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import text_or_empty
from marlstone.llm.spans import listed, no_spans, overlaps, with_spans

KINDS = ("email", "ip", "card", "phone")

#: The strict formats. Possessive runs and the checks before a match leave the matches as they are and keep the search linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser proposals, each with the literal without which it can't match.
MORE = {
    "email": r"(?i)[a-z0-9][a-z0-9._%+-]{0,63}\x20?(?:\(at\)|\[at\]|\{at\})\x20?[a-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[a-z0-9-]{1,63}){1,6}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./])[0-9]{4}(?:[./\x20]{1,2}[0-9]{4}){3}(?![./]?[0-9])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{2,4}\)\x20?|0[0-9]{2,4}[\x20./-]|[0-9]{3}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CONTEXT = 24
FOR = r"(?i)(?:tel|phone|fax|call|mobile|cell|contact|card|visa|amex|master|pay|mail|write|ip|host|addr|server)[a-z]*[.:#]?[\x20a-z]{0,10}$"
AGAINST = r"(?i)(?:isbn|issn|version|ver|order|invoice|date|page|pages|id|no|nr|ref|serial|part|sku|build|fig|table|year|total)\.?[:#]?\x20?$"
FEATURES = ("kind", "digits", "length", "separators", "parens", "luhn", "distinct_digits", "for", "against", "word_before", "word_after", "zero_start", "same_separator")
FIT_ROWS, TREES, DEPTH, RATE, PRECISION = 3000, 24, 3, 0.3, 0.98


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits is right."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, double).otherwise(d)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def _valid(kind: str):
    def check(s: Column) -> Column:
        found = s["found"]
        if kind == "ip":
            return found.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
        if kind == "card":
            return luhn(digits_of(found))
        return F.length(digits_of(found)).between(10, 15)

    return check


def base_spans(docs: DataFrame) -> DataFrame:
    """docs (with _text) and a column of spans for each kind: _email, _ip, _card, _phone."""
    text = F.col("_text")
    needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": None, "card": None}
    out = with_spans(docs, {f"_{k}": (BASE[k], needs[k]) for k in KINDS}, "_text")
    return out.withColumns({f"_{k}": F.filter(f"_{k}", _valid(k)) for k in KINDS if k != "email"})


def features(s: Column, text: Column, kind: Column) -> dict[str, Column]:
    found, digits = s["found"], digits_of(s["found"])
    begin = F.greatest(F.lit(1), s["start"] - (CONTEXT - 1)).cast("int")
    before = F.substring(text, begin, (s["start"] - begin + 1).cast("int"))
    after = F.substring(text, (s["finish"] + 1).cast("int"), F.lit(2))
    separators = F.regexp_replace(found, "[A-Za-z0-9]", "")
    number = lambda c: c.cast("double")
    values = (
        kind, F.length(digits), F.length(found), F.length(separators), F.contains(found, F.lit("(")), luhn(digits),
        F.size(F.array_distinct(F.split(digits, ""))), before.rlike(FOR), before.rlike(AGAINST), before.rlike("[A-Za-z]$"),
        after.rlike("^[A-Za-z]"), F.startswith(digits, F.lit("0")), F.length(F.regexp_replace(separators, r"(.)(?=\1)", "")) <= 1,
    )
    return {n: F.coalesce(number(v), F.lit(0.0)) for n, v in zip(FEATURES, values, strict=True)}


def invented(rows: int, seed: int = 7) -> list[tuple[str, str, int]]:
    """(kind, text, is personal): candidates of a fixed recipe, true and false ones in equal parts."""
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choice("aeioustrnlmd") for _ in range(r.randint(2, 8)))
    run = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def check_digit(body: str) -> str:
        return next(d for d in "0123456789" if sum((lambda v: v - 9 if v > 9 else v)(int(c) * (2 if i % 2 else 1)) for i, c in enumerate(reversed(body + d))) % 10 == 0)

    for _ in range(rows):
        kind, true = r.choice(KINDS), r.random() < 0.5
        good, bad = r.choice(["call ", "tel: ", "phone ", "card ", "mail ", "host ", "contact "]), r.choice(["order ", "isbn ", "ref ", "no. ", "part ", "version "])
        plain = word() + " "
        before = (good if r.random() < 0.6 else plain) if true else (bad if r.random() < 0.6 else plain)
        sep = r.choice(" .-")
        if kind == "email":
            at, dot = r.choice(["(at)", "[at]", "{at}"]), r.choice([".", "(dot)", "[dot]"])
            found = f"{word()}{r.choice(['', '.' + word()])} {at} {word()} {dot} com" if true else f"f{at}x.{run(1)}"
        elif kind == "ip":
            hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
            found = ":".join(hexa(4) for _ in range(8)) if true else ":".join(run(2) for _ in range(8))
        elif kind == "card":
            body = r.choice("3456") + run(14)
            digits = body + check_digit(body) if true else run(16)
            found = r.choice([".", " ", "/"]).join(digits[i : i + 4] for i in range(0, 16, 4))
        elif true:
            found = r.choice([f"({run(3)}) {run(3)}{sep}{run(4)}", f"{run(3)}{sep}{run(3)}{sep}{run(4)}", f"0{run(3)}{sep}{run(3)}{sep}{run(4)}"])
        else:
            found = r.choice([f"{run(3)} {run(3)} {run(3)}", f"({run(4)}) {run(3)}.{run(3)}", f"{run(3)}.{run(3)}.{run(3)}", f"{run(3)}-{run(4)}-{run(3)}"])
            before = bad if r.random() < 0.5 else plain
        out.append((kind, f"{word()} {before}{found}{r.choice([' ', '. ', ', '])}{word()}", int(true)))
    return out


class Trees:
    """Gradient-boosted regression trees on the logistic loss: few rows, few features, on the driver."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        share = float(np.clip(y.mean(), 0.01, 0.99))
        self.start, self.trees = float(np.log(share / (1 - share))), []
        score = np.full(len(y), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), depth, rate)
            self.trees.append(tree)
            score += self._apply(tree, x)

    def _grow(self, x, g, h, depth, rate):
        leaf = float(rate * g.sum() / (h.sum() + 1.0))
        if depth == 0 or len(g) < 20:
            return leaf
        best, at = 1e-6, None
        for j in range(x.shape[1]):
            for cut in np.unique(x[:, j])[:-1]:
                left = x[:, j] <= cut
                a, b = g[left].sum(), g[~left].sum()
                gain = a * a / (h[left].sum() + 1) + b * b / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
                if gain > best:
                    best, at = gain, (j, float(cut))
        if at is None:
            return leaf
        left = x[:, at[0]] <= at[1]
        return (*at, self._grow(x[left], g[left], h[left], depth - 1, rate), self._grow(x[~left], g[~left], h[~left], depth - 1, rate))

    def _apply(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, left, right = tree
        return np.where(x[:, j] <= cut, self._apply(left, x), self._apply(right, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(self._apply(t, x) for t in self.trees)

    def column(self, value: dict[str, Column]) -> Column:
        """The score as one expression of the features."""

        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            j, cut, left, right = tree
            return F.when(value[FEATURES[j]] <= F.lit(cut), of(left)).otherwise(of(right))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + of(tree)
        return total


def fitted(spark: SparkSession, rows: int = FIT_ROWS) -> tuple[Trees, dict[str, float]]:
    """Trees, and for each kind the lowest score at which PRECISION of the held-out candidates above are true."""
    made = json.dumps([{"k": k, "t": t, "y": y} for k, t, y in invented(rows)])
    source = spark.range(1).select(F.explode(F.from_json(F.lit(made), "array<struct<k:string,t:string,y:int>>")).alias("r")).select("r.*")
    found = with_spans(source, {f"_{k}": (MORE[k], F.col("k") == k) for k in KINDS}, "t")
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("k")) - 1
    one = found.select("k", "t", "y", number.alias("n"), F.explode(F.concat(*[F.col(f"_{k}") for k in KINDS])).alias("s"))
    got = one.select("k", "y", *[v.alias(n) for n, v in features(F.col("s"), F.col("t"), F.col("n")).items()]).collect()  # at most fit_rows rows and few spans in each
    x = np.array([[r[n] for n in FEATURES] for r in got])
    y, kinds = np.array([r["y"] for r in got], float), np.array([r["k"] for r in got])
    held = np.arange(len(y)) % 3 == 0
    trees = Trees(x[~held], y[~held])
    score, cuts = trees.score(x), {}
    for kind in KINDS:
        own = held & (kinds == kind)
        order = np.argsort(-score[own])
        s, right = score[own][order], np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        fit = np.flatnonzero(right >= PRECISION)
        cuts[kind] = float(max(s[fit[-1]], 0.0)) if len(fit) else float("inf")
    return trees, cuts


def scan_pii(docs: DataFrame) -> DataFrame:
    """docs with _text, the strict spans (_email ...) and the accepted looser ones (_more_email ...)."""
    trees, cuts = fitted(docs.sparkSession)
    text = F.col("_text")
    strict = base_spans(docs.withColumn("_text", text_or_empty()))
    needs = {
        "email": F.contains(text, F.lit("(")) | F.contains(text, F.lit("[")) | F.contains(text, F.lit("{")),
        "ip": F.contains(text, F.lit(":")), "card": None, "phone": None,
    }
    loose = with_spans(strict, {f"_more_{k}": (MORE[k], needs[k]) for k in KINDS}, "_text")
    every = F.concat(*[F.col(f"_{k}") for k in KINDS])

    def chosen(n: int, kind: str) -> Column:
        free = F.filter(f"_more_{kind}", lambda s: ~F.exists(every, lambda b: overlaps(s, b)))
        named = F.transform(free, lambda s: F.struct(s.alias("s"), F.struct(*[v.alias(f) for f, v in features(s, text, F.lit(n)).items()]).alias("f")))
        kept = F.filter(named, lambda c: trees.column({f: c["f"][f] for f in FEATURES}) >= F.lit(cuts[kind]))
        return F.when(F.size(f"_more_{kind}") > 0, F.transform(kept, lambda c: c["s"])).otherwise(no_spans())

    return loose.withColumns({f"_more_{k}": chosen(n, k) for n, k in enumerate(KINDS)})


def pii_digest(docs: DataFrame) -> DataFrame:
    found = scan_pii(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = {k: F.col(f"_{k}") for k in KINDS}
    both = {k: F.concat(F.col(f"_{k}"), F.col(f"_more_{k}")) for k in KINDS}
    return found.select(
        "doc_id",
        *[F.size(base[k]).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(KINDS, base), 256).alias("base_sha256"),
        listed(KINDS, both).alias("spans"),
    )

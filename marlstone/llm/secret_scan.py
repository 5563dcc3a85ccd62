"""Secret scans through an inverted index of trigrams.

From each rule's regular expression a Boolean query over trigrams is derived that every
matching text satisfies: literal runs give conjunctions, alternatives disjunctions, and
whatever may be anything gives nothing. The index has a posting (trigram, document) for
every trigram that some rule asks for. A rule's candidates are the documents whose
postings satisfy its query; only those are searched by its expression. A rule whose
expression has no mandatory trigram searches all documents.

Trigrams are of texts in lower case, so that one index serves rules of either case.

Defined results: null text is empty; a text of any length is searched whole; rows that
repeat a doc_id or have none share their postings and are each verified on their own text;
spans that begin at one place are listed by kind; columns of any name are passed on by
redact_secrets() and not read by secret_digest(); an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import text_or_empty, written
from marlstone.llm.spans import listed, overlaps, with_spans

try:  # the parser of Python's own expressions
    from re import _constants as rc
    from re import _parser as rp
except ImportError:  # before Python 3.11
    import sre_constants as rc
    import sre_parse as rp

#: Alternatives that are written out before the query gives up on a run of literals.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """pattern finds matches; of those, the ones that `keep` matches as a whole count."""

    kind: str
    pattern: str
    keep: str | None = None
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", True),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16,}"),
    # Only whole runs of hexadecimal digits can match, so the length may as well be asked for at once.
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
)
#: Formats of published kinds of credentials.
MORE_RULES = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9]{10,}(?:-[A-Za-z0-9]{6,}){1,5}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[A-Za-z0-9+/=\x0A\x0D]{64,}"),
)
KINDS = tuple(r.kind for r in (*BASE_RULES, *MORE_RULES))

# A query is True, a trigram, ("and", queries) or ("or", queries).


def _all(queries: list):
    some = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not some else some[0] if len(some) == 1 else ("and", tuple(some))


def _any(queries: list):
    some = list(dict.fromkeys(queries))
    return True if not some or True in some else some[0] if len(some) == 1 else ("or", tuple(some))


def _cover(string: str) -> list[str]:
    """The fewest trigrams that hold all of the string's characters: one after the other, and the last. The ones between ask for nothing more of a text but their places."""
    last = len(string) - 3
    return [string[i : i + 3] for i in sorted({*range(0, last, 3), last})] if last >= 0 else []


def _strings(found: set[str]):
    """The query that a text satisfies if it holds one of the strings."""
    least = [s for s in found if not any(t != s and t in s for t in found)]
    return _any(sorted((_all(_cover(s)) for s in least), key=str))


def trigram_query(pattern: str):
    def members(items) -> set[str] | None:
        out: set[str] = set()
        for op, value in items:
            if op is rc.LITERAL:
                out.add(chr(value).lower())
            elif op is rc.RANGE and value[1] - value[0] < 8:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out

    def walk(items) -> tuple[set[str] | None, object]:
        """The exact strings that the items match, if they are few, else None; and a query for what they match."""
        asked, now, exact = [], {""}, True

        def ends() -> None:
            nonlocal now, exact
            asked.append(_strings(now))
            now, exact = {""}, False

        def extend(more: set[str]) -> None:
            nonlocal now
            if len(now) * len(more) > MOST_STRINGS:
                ends()
            now = {a + b for a in now for b in more}

        for op, value in items:
            if op is rc.LITERAL:
                extend({chr(value).lower()})
            elif op is rc.IN and (found := members(value)) is not None and len(found) <= MOST_STRINGS:
                extend(found)
            elif op is rc.SUBPATTERN:
                found, query = walk(value[-1])
                if found is not None:
                    extend(found)
                else:
                    ends()
                    asked.append(query)
            elif op is rc.BRANCH:
                ways = [walk(x) for x in value[1]]
                if all(w[0] is not None for w in ways):
                    extend(set().union(*[w[0] for w in ways]))
                else:
                    ends()
                    asked.append(_any([_strings(w[0]) if w[0] is not None else w[1] for w in ways]))
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
                least, most, inner = value
                found, query = walk(inner)
                if found is not None and most == 1:
                    extend(found | ({""} if least == 0 else set()))
                elif found is not None and least >= 1 and len(found) <= 4:
                    extend(found)
                    ends()
                else:
                    ends()
                    if least >= 1:
                        asked.append(query)
            elif op in (rc.AT, rc.ASSERT, rc.ASSERT_NOT):
                continue
            else:
                ends()
        return (now, _strings(now)) if exact else (None, _all([*asked, _strings(now)]))

    return walk(rp.parse(pattern))[1]


def trigrams_of(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def satisfied(query, present: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(present, query)
    parts = [satisfied(q, present) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def build_index(docs: DataFrame, wanted: set[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the wanted trigrams, as a written table sorted by trigram."""
    asked = F.array(*[F.lit(t) for t in sorted(wanted)])
    lower = docs.select("doc_id", F.lower(text_or_empty()).alias("lower"))
    posted = lower.select(F.explode(F.filter(asked, lambda t: F.contains(F.col("lower"), t))).alias("trigram"), "doc_id")
    return written(posted.sortWithinPartitions("trigram"), "postings")


def candidates(index: DataFrame, rules: dict[str, object]) -> DataFrame:
    """(doc_id, rules): the rules whose queries the document's postings satisfy; no row if none does."""
    present = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("present"))
    hits = F.array_compact(F.array(*[F.when(satisfied(q, F.col("present")), F.lit(k)) for k, q in rules.items()]))
    return present.select(F.col("doc_id").alias("_id"), hits.alias("_rules")).where(F.size("_rules") > 0)


def _whole(pattern: str):
    return lambda s: s["found"].rlike(f"^(?:{pattern})$")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = (*BASE_RULES, *MORE_RULES)) -> DataFrame:
    """docs with a column of spans for each rule, named after its kind with an underscore in front."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {k: q for k, q in queries.items() if q is not True}
    whole = docs.withColumn("_text", text_or_empty())
    if asked:
        index = build_index(docs, set().union(*map(trigrams_of, asked.values())))
        found = candidates(index, asked)
        # Candidates grow with the input: they are not to be broadcast, however few there are now.
        whole = whole.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    patterns = {f"_{r.kind}": (r.java, F.array_contains("_rules", r.kind) if r.kind in asked else None) for r in rules}
    spans = with_spans(whole, patterns, "_text")
    for r in rules:
        if r.keep:
            spans = spans.withColumn(f"_{r.kind}", F.filter(f"_{r.kind}", _whole(r.keep)))
    return spans.drop("_rules")


def _split(rules_found: DataFrame) -> tuple[dict[str, Column], dict[str, Column]]:
    """Spans of the base rules; spans of the others outside of those."""
    base = {r.kind: F.col(f"_{r.kind}") for r in BASE_RULES}
    every = F.concat(*base.values())
    more = {
        r.kind: F.filter(f"_{r.kind}", lambda s: ~F.exists(every, lambda b: overlaps(s, b)))
        for r in MORE_RULES
        if f"_{r.kind}" in rules_found.columns
    }
    return base, more


def secret_digest(docs: DataFrame) -> DataFrame:
    found = scan_secrets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base, more = _split(found)
    return found.select(
        "doc_id",
        *[F.size(base[k]).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(KINDS, base), 256).alias("base_sha256"),
        listed(KINDS, base | more).alias("spans"),
    )


def redact_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every secret's characters replaced by the mask; n_chars, if there, follows the text.

    Overlapping spans are masked as one. Documents without secrets stay as they are.
    """
    found = scan_secrets(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")))
    base, more = _split(found)
    every = F.array_sort(F.concat(*[F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["finish"].alias("finish"))) for c in (base | more).values()]))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        gap = F.substring(F.col("_text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mask)))
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["finish"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("_text"), (acc["at"] + 1).cast("int"), F.length("_text")))
    found = found.withColumn("_every", every)
    some = F.size("_every") > 0
    found = found.withColumn("_masked", F.when(some, F.aggregate("_every", start, step, rest)).otherwise(F.col("text")))
    new = {"text": F.col("_masked"), "n_chars": F.when(some, F.length("_masked")).otherwise(F.col("_row")["n_chars"]) if "n_chars" in docs.columns else None}
    return found.select(*[(new[f.name].cast(f.dataType) if f.name in new else F.col("_row")[f.name]).alias(f.name) for f in docs.schema.fields])


def compiled(rule: Rule) -> re.Pattern:
    """The rule for Python, for tests and small inputs."""
    return re.compile(rule.pattern, re.IGNORECASE | re.ASCII if rule.ignore_case else 0)

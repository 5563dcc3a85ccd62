"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order (by a hash of id and text),
gone through at most `max_passes` times. An entry of the queue is a document in a pass; its
virtual finish time is the number of its source's words up to and with it, divided by the
source's target. The entries of all sources are range-sorted by that time and truncated
where their running total reaches the budget: ranges of virtual time are added up first,
then the entries of the one range where the budget ends. The entry that is being served
there counts with the words served until then.

The running sums don't gather a source in one task: a source's shuffled order is cut
into buckets of about `bucket_rows` documents, sums of buckets are added up first, in
blocks of FAN buckets and then within a block, and running sums within a bucket start from
there. A range of virtual time holds about as many entries, as every source serves its
target's words in a unit of it. Rows that repeat id and text are one row with a count
until their finish times are known, so they can't fill a bucket. Only (id, source, size,
hash) are shuffled, never texts. The windows over sources hold one row for each source.

Defined results: null text has size 0; texts of any length are one document; null sources
form one source, ranked last; documents and sources of no words are taken with 0 words and
take no part in the queue; equal finish times are ordered by the hash, id and size; rows
that repeat a document are queued one after the other; rows without doc_id are shuffled by
their texts; only doc_id, source and text are read, whatever else there is; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import spare, text_or_empty, written

WEIGHTS = (3, 1, 2)
BUDGET_SHARE = 1.5
MAX_PASSES = 2
BUCKET_ROWS = 2_000
FAN = 1024
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def shuffle_key(seed: str) -> Column:
    """60 bits of an md5 of id and text: an order that any engine can repeat."""
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), F.md5(text_or_empty()))
    return F.conv(F.substring(F.md5(own), 1, 15), 16, 10).cast("long")


def with_bases(sums: DataFrame, group: str) -> DataFrame:
    """sums (group, bucket, words) with base, the words of the group's earlier buckets."""
    blocks = sums.withColumn("block", F.floor(F.col("bucket") / FAN))
    tops = blocks.groupBy(group, "block").agg(F.sum("words").alias("top"))
    earlier = F.sum("top").over(Window.partitionBy(group).orderBy("block")) - F.col("top")
    tops = tops.select(F.col(group).alias("_group"), F.col("block").alias("_block"), earlier.alias("before"))
    joined = blocks.join(tops, F.col(group).eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block")))
    inside = F.sum("words").over(Window.partitionBy(group, "block").orderBy("bucket")) - F.col("words")
    return joined.select(group, "bucket", "words", (F.col("before") + inside).alias("base"))


def source_targets(sizes: DataFrame, weights: Sequence[float], budget_share: float, max_passes: int) -> DataFrame:
    """(source, rows, source_size, target): the budget shared out by weight, capped, the excess shared again.

    Sources sorted by cap over weight fill up in that order. With the first k of them full,
    the rest stand at (budget - their caps) / (remaining weight), which rises as long as the
    next source does fill up and falls afterwards, so the final level is the maximum.
    """
    by_source = sizes.groupBy("source").agg(F.sum("copies").alias("rows"), F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    by_source = by_source.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_passes).cast("double"))
    every = Window.partitionBy()
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(every) * F.lit(float(budget_share))
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    by_source = by_source.withColumn("level", level).withColumn("top", F.max("level").over(every))
    return by_source.select("source", "rows", "source_size", F.least("cap", F.col("top") * F.col("weight")).alias("target"))


def _queued(docs: DataFrame, weights: Sequence[float], budget_share: float, max_passes: int, bucket_rows: int, seed: str) -> tuple[DataFrame, int, int]:
    """Every row with its source's size and target and finish, the source's words up to and with it; the budget; how many rows there are."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), shuffle_key(seed).alias("key"))
    sizes = written(sized.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    sources = written(source_targets(sizes, weights, budget_share, max_passes), "sources")
    whole = sources.agg(F.sum("source_size").alias("words"), F.sum("rows").alias("rows")).first()
    own = sources.select(F.col("source").alias("own"), "source_size", "target", F.ceil(F.col("rows") / bucket_rows).cast("long").alias("buckets"))
    keyed = sizes.join(own, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    keyed = keyed.withColumn("bucket", F.shiftright(F.shiftright("key", 20) * F.col("buckets"), 40)).withColumn("words", F.col("size") * F.col("copies"))
    sums = written(keyed.groupBy("source", "bucket").agg(F.sum("words").alias("words")), "sums")
    bases = with_bases(sums, "source").select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base")
    keyed = keyed.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.col("base") + F.sum("words").over(inside) - F.col("words")
    copies = keyed.withColumn("begin", begin).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    queued = copies.select("doc_id", "source", "size", "key", "source_size", "target", (F.col("begin") + F.col("nth") * F.col("size")).alias("finish"))
    return written(queued, "queued"), int((whole["words"] or 0) * budget_share), whole["rows"] or 0


def _entry(turn: int | Column) -> Column:
    """Where a document's entry of a pass stands in the global order."""
    time = (F.col("finish") + turn * F.col("source_size")).cast("double") / F.col("target")
    return F.struct(time.alias("time"), "key", "doc_id", "size", "source")


def _cut(queued: DataFrame, budget: int, ranges: int, max_passes: int) -> tuple[Column, int] | None:
    """The entry at which the running total in the global order reaches the budget, and how many of its words are served; None if it doesn't."""
    turns = F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1))).alias("turn")
    entries = queued.where("size > 0 and target > 0").select("*", turns).select("size", _entry(F.col("turn")).alias("entry"))
    entries = entries.withColumn("bucket", F.floor(F.col("entry.time") * ranges))
    sums = entries.groupBy("bucket").agg(F.sum("size").alias("words")).withColumn("all", F.lit(0))
    at = with_bases(written(sums, "ranges"), "all").where((F.col("base") < budget) & (F.col("base") + F.col("words") >= budget)).first()
    if at is None:
        return None
    running = at["base"] + F.sum("size").over(Window.partitionBy("bucket").orderBy("entry").rowsBetween(Window.unboundedPreceding, 0))
    last = entries.where(F.col("bucket") == at["bucket"]).withColumn("total", running).where(F.col("total") >= budget).orderBy("entry").first()
    kinds = {f.name: f.dataType for f in entries.schema["entry"].dataType.fields}
    return F.struct(*[F.lit(last["entry"][n]).cast(t).alias(n) for n, t in kinds.items()]), budget - (last["total"] - last["size"])


def mixing_plan(
    docs: DataFrame,
    *,
    weights: Sequence[float] = WEIGHTS,
    budget_share: float = BUDGET_SHARE,
    max_passes: int = MAX_PASSES,
    bucket_rows: int = BUCKET_ROWS,
    seed: str = SEED,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, key, virtual_finish, passes), range-sorted by virtual_finish.

    passes holds the words taken in each pass through the source; virtual_finish is that of
    the first pass, null where the target is 0.
    """
    queued, budget, rows = _queued(docs, weights, budget_share, max_passes, bucket_rows, seed)
    cut = _cut(queued, budget, max(1, rows // bucket_rows), max_passes)

    def served(turn: int) -> Column:
        if cut is None:
            return F.when(F.col("target") > 0, F.col("size")).otherwise(0)
        here = F.when(_entry(turn) < cut[0], F.col("size")).when(_entry(turn) <= cut[0], F.lit(cut[1])).otherwise(0)
        return F.when((F.col("target") > 0) & (F.col("size") > 0), here).otherwise(0)

    finish = F.try_divide(F.col("finish").cast("double"), F.col("target")).alias("virtual_finish")
    passes = F.array(*[served(turn).cast("long") for turn in range(max_passes)]).alias("passes")
    return queued.select("doc_id", "source", "size", "source_size", "target", "key", finish, passes).orderBy("virtual_finish", "key", "doc_id")


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, virtual_finish), in the mix's order."""
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x)
    return mixing_plan(docs, **options).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "virtual_finish")


def mix(docs: DataFrame, *, seed: str = SEED, max_passes: int = MAX_PASSES, **options) -> DataFrame:
    """The rows of the mix, with docs' columns; a document taken in several passes comes as often.

    Whole documents: the one at the cut is in if at least half of its words are, and so are
    rows that repeat its id and text. What the cut leaves of a source is a first part of its
    shuffled order, so the texts are only filtered by where that part ends.
    """
    plan = mixing_plan(docs, seed=seed, max_passes=max_passes, **options)
    own, times, key, filled, *ends = spare(docs, "source", "pass", "key", "filled", *[f"end{p}" for p in range(max_passes)])
    last = [F.max(F.when(2 * F.col("passes")[p] >= F.greatest("size", F.lit(1)), F.struct("key", "doc_id"))).alias(ends[p]) for p in range(max_passes)]
    cuts = written(plan.groupBy(F.col("source").alias(own)).agg(*last), "cuts")
    at = F.struct(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("doc_id"))
    passes = sum((F.when(at <= F.col(c), 1).otherwise(0) for c in ends), F.lit(0))
    known = docs.withColumns({key: shuffle_key(seed), filled: text_or_empty().rlike(WORD)}).where(F.col(filled))
    chosen = known.join(cuts, F.col("source").eqNullSafe(F.col(own)))
    return chosen.withColumn(times, F.explode(F.array_repeat(F.lit(1), passes))).select(*docs.columns)


SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || doc_id || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key
  FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * 2 AS cap,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM by_source),
targets AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels),
queued AS (
  SELECT d.doc_id, d.source, d.size, d.key, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS finish
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
entries AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY (finish + turn * source_size)::DOUBLE / target, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS total
  FROM queued CROSS JOIN (VALUES (0), (1)) AS turns (turn) WHERE size > 0 AND target > 0),
taken AS (
  SELECT doc_id, sum(least(size, greatest(0, (SELECT floor(sum(size) * 1.5) FROM sized) - (total - size))))::BIGINT AS taken
  FROM entries GROUP BY doc_id)
SELECT q.doc_id, size, source_size, target, coalesce(t.taken, 0)::BIGINT AS taken,
       CASE WHEN target > 0 THEN finish::DOUBLE / target END AS virtual_finish
FROM queued q LEFT JOIN taken t ON q.doc_id = t.doc_id
"""

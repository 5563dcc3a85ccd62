"""Relations: target rows nested into their owners' rows, and the semi-joins that filter by them.

Keys meet in equi-joins, so that Catalyst picks the strategy and AQE splits hot keys. Where
both sides have one key of one type in a row, the columns are compared as they are, which
leaves filters on them to the scan; else keys are texts, and lists are exploded with their
positions. Children are gathered before the left join to the owners, which keeps owners
without children and gives them an empty array. An owner's children are one row of the
result, so they must fit into a task's memory: select fewer columns of the target, or join
the pairs of linked(), where an owner may have very many.

Order of children: position of the key, slug of the through row, position of its key, slug
of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.values import INTEGRAL, SLUG_OF, field_values, leaf
from marlstone.plans.catalog import INVERSE, ONE, Relation


class DanglingKeyError(LookupError):
    pass


class Keys:
    """The keys that a dotted path names in the rows of df."""

    def __init__(self, df: DataFrame, path: str):
        self.df, self.path = df, path
        made_of = df.schema["slug"].metadata.get(SLUG_OF) if path == "slug" and "slug" in df.columns else None
        self.found = leaf(df.schema, made_of if made_of in df.columns else path)

    def plain_like(self, other: Keys) -> bool:
        """Whether both have at most one key in a row, of types whose values are equal if and only if their texts are."""
        if self.found is None or other.found is None:
            return False
        own, others = self.found[1], other.found[1]
        return any(isinstance(own, t) and isinstance(others, t) for t in (INTEGRAL, T.StringType))

    def rows(self, prefix: str, plain: bool, *more: Column) -> DataFrame:
        """(<prefix>slug, <prefix>pos, <prefix>key, more): a row for every key; as text unless plain."""
        slug = F.col("slug").alias(f"{prefix}slug")
        if plain:
            key = self.found[0].alias(f"{prefix}key")
            return self.df.select(slug, F.lit(0).alias(f"{prefix}pos"), key, *more).where(F.col(f"{prefix}key").isNotNull())
        return self.df.select(slug, *more, F.posexplode(field_values(self.df.schema, self.path)).alias(f"{prefix}pos", f"{prefix}key"))


def keyed(df: DataFrame, path: str, prefix: str) -> DataFrame:
    """(<prefix>slug, <prefix>pos, <prefix>key): a row for every value of the path, as text."""
    return Keys(df, path).rows(prefix, False)


def meeting(left: Keys, right: Keys, *more: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides, with l_key and f_key of types that can be compared; more: further columns of the right."""
    plain = left.plain_like(right)
    return left.rows("l_", plain), right.rows("f_", plain, *more)


def _containing(local: DataFrame, foreign: DataFrame) -> DataFrame:
    """Pairs whose foreign key contains the local one, as an equi-join on substrings.

    Only substrings of the lengths that local keys have are made. The lengths are a table
    that meets the foreign keys which are long enough.
    """
    lengths = local.select(F.length("l_key").alias("n")).distinct().where("n > 0")
    of, n = F.col("f_key"), F.col("n")
    places = F.sequence(F.lit(1), F.length(of) - n + 1)
    parts = foreign.join(lengths, n <= F.length(of)).withColumn("part", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(of, i, n))))).drop("n")
    return local.join(parts, F.col("l_key") == F.col("part")).drop("part")


def linked(owners: DataFrame, relation: Relation, target: DataFrame, through: DataFrame | None = None, match: str = "exact") -> DataFrame:
    """(l_slug, order, t_slug): the pairs that a relation holds, order being what children are sorted by."""
    own, aims = Keys(owners, relation.local), Keys(target, relation.foreign)
    if through is None:
        if match == "substring":
            left, right = own.rows("l_", False), aims.rows("f_", False)
            sizes = owners.select(F.col("slug").alias("l_slug"), (F.size(field_values(owners.schema, relation.local)) != 1).alias("loose"))
            marked = left.join(sizes, "l_slug")
            exact = marked.where("not loose").join(right, F.col("l_key") == F.col("f_key"))
            pairs = exact.unionByName(_containing(marked.where("loose"), right), allowMissingColumns=True)
        else:
            left, right = meeting(own, aims)
            pairs = left.join(right, F.col("l_key") == F.col("f_key"))
        order = F.struct(F.col("l_pos").alias("a"), F.col("f_slug").alias("b"), F.lit(0).alias("c"), F.lit("").alias("d"))
        pairs = pairs.select("l_slug", order.alias("order"), F.col("f_slug").alias("t_slug"))
        if relation.kind in INVERSE:  # a row meets another once, whatever keys they share
            pairs = pairs.groupBy("l_slug", "t_slug").agg(F.min("order").alias("order"))
        return pairs.select("l_slug", "order", "t_slug")
    middle, ends = Keys(through, relation.through_foreign), Keys(through, relation.through_local)
    onward = ends.plain_like(aims)
    key = ends.found[0] if onward else field_values(through.schema, relation.through_local)
    left, between = meeting(own, middle, key.alias("ends"))
    met = left.join(between, F.col("l_key") == F.col("f_key")).withColumnRenamed("f_slug", "m_slug").drop("f_pos", "f_key")
    met = met.withColumn("n_pos", F.lit(0)).withColumnRenamed("ends", "n_key") if onward else met.select("l_slug", "l_pos", "m_slug", F.posexplode("ends").alias("n_pos", "n_key"))
    pairs = met.join(aims.rows("f_", onward), F.col("n_key") == F.col("f_key"))
    order = F.struct(F.col("l_pos").alias("a"), F.col("m_slug").alias("b"), F.col("n_pos").alias("c"), F.col("f_slug").alias("d"))
    return pairs.select("l_slug", order.alias("order"), F.col("f_slug").alias("t_slug"))


def attach(owners: DataFrame, name: str, relation: Relation, target: DataFrame, through: DataFrame | None = None, match: str = "exact") -> DataFrame:
    """owners with a column of the relation's name: a struct or null for the One kinds, else an array, empty for none."""
    pairs = linked(owners, relation, target, through, match)
    nested = target.select(F.col("slug").alias("t_slug"), F.struct(*[F.col(f"`{c}`") for c in target.columns]).alias("row"))
    rows = pairs.join(nested, "t_slug").select("l_slug", F.struct("order", "row").alias("child"))
    if relation.kind in ONE:
        children = rows.groupBy("l_slug").agg(F.min_by("child.row", "child.order").alias(name))
        return owners.join(children, F.col("slug") == F.col("l_slug"), "left").drop("l_slug")
    ordered = F.array_sort(F.collect_list("child"), lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0))
    children = rows.groupBy("l_slug").agg(F.transform(ordered, lambda c: c["row"]).alias("kids"))
    joined = owners.join(children, F.col("slug") == F.col("l_slug"), "left")
    return joined.select(*owners.columns, F.coalesce("kids", F.array().cast(children.schema["kids"].dataType)).alias(name))


def dangling(owners: DataFrame, relation: Relation, target: DataFrame) -> DataFrame:
    """(slug, key): keys of owners that no target row has."""
    left, right = meeting(Keys(owners, relation.local), Keys(target, relation.foreign))
    return left.join(right, F.col("l_key") == F.col("f_key"), "left_anti").select(F.col("l_slug").alias("slug"), F.col("l_key").cast("string").alias("key"))


def having(owners: DataFrame, relation: Relation, target: DataFrame, through: DataFrame | None = None) -> DataFrame:
    """The owners that the relation links to some row of target (a semi-join)."""
    aims = Keys(target, relation.foreign)
    if through is not None:
        steps, wanted = meeting(Keys(through, relation.through_local), aims)
        reached = steps.join(wanted, F.col("l_key") == F.col("f_key"), "left_semi").select(F.col("l_slug").alias("slug")).distinct()
        aims = Keys(through.join(reached, "slug", "left_semi"), relation.through_foreign)
    own = Keys(owners, relation.local)
    local, wanted = meeting(own, aims)
    if own.plain_like(aims):  # the owners themselves meet the keys
        return owners.join(wanted.select("f_key"), own.found[0] == F.col("f_key"), "left_semi")
    local = local.join(wanted, F.col("l_key") == F.col("f_key"), "left_semi").select("l_slug").distinct()
    return owners.join(local, F.col("slug") == F.col("l_slug"), "left_semi")

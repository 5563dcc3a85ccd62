"""The engine's queries over the test tables, each with the SQL that gives the same rows.

Slugs are keys as text, orders are binary, nested relations are shown as a row for each child.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import export, paths
from marlstone.functions.values import as_array, field_values, js_string, nested_property, prefix_path, unwrap_single
from marlstone.operators import incremental, postings, relations
from marlstone.plans.catalog import Catalog, Relation, Source
from marlstone.plans.engine import Engine
from marlstone.plans.paging import AFTER, BEFORE, cursor_column, encode_cursor, page_slice
from marlstone.plans.query import BINARY, Query
from marlstone.shared import fresh_path
from marlstone.sources import files, parsers
from marlstone.sources.changes import FolderChanges, extract_diff
from marlstone.sources.storage import SparkStorage
from marlstone.sources.validation import violations
from marlstone.streaming import updates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
DIRECT = lambda to, kind, local, foreign: Relation(to, kind, local, foreign)
SOURCES = {
    "region": Source("region", "table", "region.parquet", key=("r_regionkey",), index={"r_name": 1}, relations={
        "nations": DIRECT("nation", "belongsToMany", "slug", "n_regionkey"),
        "customers": Relation("customer", "hasManyThrough", "slug", "c_nationkey", "nation", "n_regionkey", "slug"),
    }),
    "nation": Source("nation", "table", "nation.parquet", key=("n_nationkey",), index={"n_name": 2, "region.r_name": 1}, relations={"region": DIRECT("region", "hasOne", "n_regionkey", "slug")}),
    "customer": Source("customer", "table", "customer.parquet", key=("c_custkey",), index={"c_mktsegment": 2, "c_name": 1, "nation.n_name": 1, "region.r_name": 1}, custom_index={"balance_band": 1}, relations={
        "nation": DIRECT("nation", "hasOne", "c_nationkey", "slug"),
        "region": Relation("region", "hasOneThrough", "c_nationkey", "slug", "nation", "slug", "n_regionkey"),
        "orders": DIRECT("orders", "belongsToMany", "slug", "o_custkey"),
    }),
    "supplier": Source("supplier", "table", "supplier.parquet", key=("s_suppkey",), relations={"nation": DIRECT("nation", "hasOne", "s_nationkey", "slug")}),
    "part": Source("part", "table", "part.parquet", key=("p_partkey",), index={"p_brand": 1}),
    "lineitem": Source("lineitem", "table", "lineitem.parquet", key=LINE),
    "orders": Source("orders", "table", "orders.parquet", key=("o_orderkey",), index={"o_orderpriority": 1, "o_orderstatus": 1, "o_totalprice": 1}, relations={
        "customer": DIRECT("customer", "hasOne", "o_custkey", "slug"),
        "parts": Relation("part", "hasManyThrough", "slug", "slug", "lineitem", "l_orderkey", "l_partkey"),
    }),
    "events": Source("events", "table", "events.parquet", key=("event_id",), index={"event_type": 1, "user_id": 1}),
    "documents": Source("documents", "table", "documents.parquet", key=("doc_id",), index={"lang": 1, "source": 3}, relations={"label": DIRECT("labels", "hasOne", "slug", "doc_id")}),
    "labels": Source("labels", "table", "labels.parquet", key=("doc_id",), relations={"document": DIRECT("documents", "belongsTo", "doc_id", "slug")}),
    "pages": Source("pages", "table", "pages.parquet", key=("page_id",), index={"url": 9}),
    "threads": Source("threads", "table", "", key=("conv_id",), index={"turns.role": 1, "turns.turn": 1}, relations={}),
    "keyed_events": Source("keyed_events", "table", "", key=("event_id",), index={"props.k": 1}),
}
CATALOG = Catalog(SOURCES)


def engine(spark: SparkSession, sf_dir: str, **frames: DataFrame) -> Engine:
    table = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    turn = F.struct("turn", "role", "text")
    made = {
        "threads": table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns")),
        "keyed_events": table("events").withColumn("props", F.from_json("props", "map<string,string>")),
    }
    band = {"customer.balance_band": lambda df: F.when(df["c_acctbal"] < 0, "debt").when(df["c_acctbal"] < 5000, "low").otherwise("high")}
    return Engine(spark, CATALOG, sf_dir, frames=made | frames, custom_index=band)


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return keep


# Filters


def _slugs(q: Query, *more: str) -> DataFrame:
    return q.to_df().select("slug", *more)


@query("SELECT CAST(event_id AS VARCHAR) AS slug, event_type FROM events WHERE event_type = 'click'")
def filter_eq_scalar(spark, d):
    return _slugs(engine(spark, d).from_("events").where("event_type", "eq", "click"), "event_type")


@query("SELECT CAST(event_id AS VARCHAR) AS slug, user_id FROM events WHERE CAST(user_id AS VARCHAR) = '42'")
def filter_eq_number_as_string(spark, d):
    return _slugs(engine(spark, d).from_("events").where("user_id", "eq", "42"), "user_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS slug, source FROM documents WHERE source LIKE 'src1%'")
def filter_starts_with(spark, d):
    return _slugs(engine(spark, d).from_("documents").where("source", "startsWith", "src1"), "source")


@query("SELECT CAST(c_custkey AS VARCHAR) AS slug, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_in(spark, d):
    return _slugs(engine(spark, d).from_("customer").where("c_mktsegment", "in", ["BUILDING", "MACHINERY"]), "c_mktsegment")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS slug FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'O')")
def filter_and(spark, d):
    return _slugs(engine(spark, d).from_("orders").where("o_orderpriority", "eq", "1-URGENT").where("o_orderstatus", "in", ["F", "O"]))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS slug FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'P'")
def filter_or_mode(spark, d):
    return _slugs(engine(spark, d).from_("orders").where("o_orderpriority", "eq", "1-URGENT").where("o_orderstatus", "eq", "P").either())


@query("SELECT CAST(conv_id AS VARCHAR) AS slug, count(*) AS n_turns FROM conversations GROUP BY conv_id HAVING bool_or(role = 'assistant')")
def filter_eq_multivalue(spark, d):
    q = engine(spark, d).from_("threads").where("turns.role", "eq", "assistant")
    return q.to_df().select("slug", F.size("turns").cast("long").alias("n_turns"))


@query("SELECT CAST(conv_id AS VARCHAR) AS slug, count(*) AS n_turns FROM conversations GROUP BY conv_id HAVING bool_or(turn IN (3, 5))")
def filter_in_multivalue(spark, d):
    q = engine(spark, d).from_("threads").where("turns.turn", "in", ["3", "5"])
    return q.to_df().select("slug", F.size("turns").cast("long").alias("n_turns"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS slug, o_totalprice FROM orders WHERE o_orderkey IN (7, 21, 400)")
def filter_slug_direct(spark, d):
    return _slugs(engine(spark, d).from_("orders").where("slug", "in", ["7", "21", "400", "x"]), "o_totalprice")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS slug, o_totalprice FROM orders WHERE o_orderkey = 21")
def find_by_slug(spark, d):
    e = engine(spark, d)
    return spark.createDataFrame([e.from_("orders").find("21")], e.frame("orders").schema).select("slug", "o_totalprice")


@query("SELECT CAST(c_custkey AS VARCHAR) AS slug, c_name, CASE c_custkey WHEN 9 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS pos FROM customer WHERE c_custkey IN (3, 9, 12)")
def get_many_ordered(spark, d):
    return engine(spark, d).by_slugs("customer", ["9", "3", "12", "3"]).select("slug", "c_name", F.col("_pos").cast("int").alias("pos"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS slug FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name LIKE 'N%'")
def relation_semi_hasone(spark, d):
    return _slugs(engine(spark, d).from_("customer").where("nation.n_name", "startsWith", "N"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS slug FROM customer WHERE EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = c_nationkey AND r_name IN (SELECT max(r_name) FROM region))")
def relation_semi_through(spark, d):
    e = engine(spark, d)
    last = e.frame("region").agg(F.max("r_name")).first()[0]
    return _slugs(e.from_("customer").where("region.r_name", "eq", last))


@query("SELECT CAST(c_custkey AS VARCHAR) AS slug FROM customer WHERE c_acctbal >= 0 AND c_acctbal < 5000")
def custom_index_filter(spark, d):
    return _slugs(engine(spark, d).from_("customer").where("balance_band", "eq", "low"))


@query("SELECT CAST(event_id AS VARCHAR) AS slug, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') LIKE '1%'")
def json_path_filter(spark, d):
    q = engine(spark, d).from_("keyed_events").where("props.k", "startsWith", "1")
    return q.to_df().select("slug", F.col("props")["k"].alias("k"))


@query("SELECT CAST(conv_id AS VARCHAR) AS slug, turn, role FROM conversations")
def nested_path_values(spark, d):
    df = engine(spark, d).frame("threads")
    both = F.arrays_zip(nested_property(df.schema, "turns.turn").alias("turn"), field_values(df.schema, "turns.role").alias("role"))
    return df.select("slug", F.explode(both).alias("x")).select("slug", "x.turn", "x.role")


# Relations


def _children(spark, d, name: str, relation: str, child: str, **options) -> DataFrame:
    e = engine(spark, d)
    df = e.attach(e.frame(name), CATALOG[name], relation, **options)
    kind = CATALOG[name].relations[relation].kind
    if kind in ("hasOne", "hasOneThrough"):
        return df.select("slug", F.col(relation)[child].alias("child"))
    return df.select("slug", F.posexplode_outer(relation).alias("pos", "row")).select("slug", F.coalesce("pos", F.lit(-1)).alias("pos"), F.col("row")[child].alias("child"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS slug, c_name AS child FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_hasone(spark, d):
    return _children(spark, d, "orders", "customer", "c_name")


@query("""
SELECT CAST(c.conv_id AS VARCHAR) AS slug, CAST(row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn, CAST(r_regionkey AS VARCHAR)) - 1 AS INTEGER) AS pos, r_name AS child
FROM conversations c JOIN region ON CAST(c.turn AS VARCHAR) = CAST(r_regionkey AS VARCHAR)
UNION ALL
SELECT CAST(conv_id AS VARCHAR), -1, NULL FROM conversations GROUP BY conv_id HAVING NOT bool_or(turn IN (SELECT r_regionkey FROM region))
""")
def join_hasmany(spark, d):
    e = engine(spark, d)
    df = relations.attach(e.frame("threads"), "regions", Relation("region", "hasMany", "turns.turn", "slug"), e.frame("region"))
    return df.select("slug", F.posexplode_outer("regions").alias("pos", "row")).select("slug", F.coalesce("pos", F.lit(-1)).alias("pos"), F.col("row")["r_name"].alias("child"))


@query("SELECT CAST(l.doc_id AS VARCHAR) AS slug, 0 AS pos, d.lang AS child FROM labels l JOIN documents d USING (doc_id)")
def join_belongsto(spark, d):
    return _children(spark, d, "labels", "document", "lang")


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS slug, CASE WHEN o_orderkey IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS INTEGER) ELSE -1 END AS pos,
       o_totalprice AS child FROM customer LEFT JOIN orders ON c_custkey = o_custkey
""")
def join_belongstomany(spark, d):
    return _children(spark, d, "customer", "orders", "o_totalprice")


@query("SELECT CAST(c_custkey AS VARCHAR) AS slug, r_name AS child FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_hasonethrough(spark, d):
    return _children(spark, d, "customer", "region", "r_name")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS slug, CASE WHEN p_partkey IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY o_orderkey
         ORDER BY concat_ws('--', l_orderkey, l_linenumber, l_partkey, l_suppkey), CAST(p_partkey AS VARCHAR)) - 1 AS INTEGER) ELSE -1 END AS pos, p_name AS child
FROM orders LEFT JOIN (lineitem JOIN part ON l_partkey = p_partkey) ON o_orderkey = l_orderkey
""")
def join_hasmanythrough(spark, d):
    return _children(spark, d, "orders", "parts", "p_name")


@query("SELECT n.n_name AS slug, r.k AS child FROM nation n JOIN (VALUES ('AN'), ('IT'), ('A')) AS r(k) ON contains(n.n_name, r.k)")
def join_substring(spark, d):
    words = spark.range(1).select(F.lit("w").alias("slug"), F.array(F.lit("AN"), F.lit("IT"), F.lit("A")).alias("keys"))
    nations = engine(spark, d).frame("nation")
    pairs = relations.linked(words, Relation("nation", "hasMany", "keys", "n_name"), nations.withColumn("slug", F.col("n_name")), match="substring")
    keys = words.select(F.posexplode("keys").alias("a", "child"))
    return pairs.select(F.col("t_slug").alias("slug"), F.col("order.a").alias("a")).join(keys, "a").select("slug", "child")


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS slug, n_name AS nation, r_name AS region, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING' ORDER BY CAST(c_custkey AS VARCHAR) LIMIT 20
""")
def join_multi(spark, d):
    q = engine(spark, d).from_("customer").where("c_mktsegment", "eq", "BUILDING").join("nation").join("region").join("orders").collate(BINARY)
    return q.exec().data.select("slug", F.col("nation.n_name").alias("nation"), F.col("region.r_name").alias("region"), F.size("orders").cast("long").alias("n_orders"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS slug, CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def join_dangling_report(spark, d):
    e = engine(spark, d)
    return relations.dangling(e.frame("orders"), CATALOG["orders"].relations["customer"], e.frame("customer").where("c_mktsegment = 'BUILDING'"))


# Order and pages

BY_PRICE = "regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '')"


def _orders(spark, d) -> Query:
    return engine(spark, d).from_("orders").collate(BINARY)


@query(f"SELECT {BY_PRICE} AS v, CAST(o_orderkey AS VARCHAR) AS slug FROM orders ORDER BY 1, 2 LIMIT 25")
def order_asc(spark, d):
    return _orders(spark, d).order_by("o_totalprice").page_size(25).peek().data.select("v", "slug")


@query(f"SELECT {BY_PRICE} AS v, CAST(o_orderkey AS VARCHAR) AS slug FROM orders ORDER BY 1 DESC, 2 DESC LIMIT 25")
def order_desc(spark, d):
    return _orders(spark, d).order_by("o_totalprice", "desc").page_size(25).peek().data.select("v", "slug")


@query("SELECT DISTINCT role AS v, CAST(conv_id AS VARCHAR) AS slug FROM conversations ORDER BY 1, 2 LIMIT 30")
def order_fanout_multivalue(spark, d):
    return engine(spark, d).from_("threads").collate(BINARY).order_by("turns.role").page_size(30).peek().data.select("v", "slug")


def _records(q: Query) -> DataFrame:
    return q.exec().data.select("slug", "o_orderpriority", "o_totalprice")


def _info(spark, q: Query) -> DataFrame:
    info = q.peek().page_info
    return spark.range(1).select(F.lit(info.has_next).alias("has_next"), F.lit(info.has_previous).alias("has_previous"), F.lit(info.start_cursor).alias("start_cursor"), F.lit(info.end_cursor).alias("end_cursor"))


RECORD = "SELECT CAST(o_orderkey AS VARCHAR) AS slug, o_orderpriority, o_totalprice FROM orders"


@query(f"{RECORD} WHERE o_orderpriority = '1-URGENT' ORDER BY 1 LIMIT 20")
def page_first(spark, d):
    """The flagship: the first page of a filtered source."""
    return _records(_orders(spark, d).where("o_orderpriority", "eq", "1-URGENT").order_by("slug").page_size(20))


AT = encode_cursor({"o_orderpriority": "2-HIGH"}, "500")


@query(f"{RECORD} WHERE o_orderpriority > '2-HIGH' OR (o_orderpriority = '2-HIGH' AND CAST(o_orderkey AS VARCHAR) > '500') ORDER BY o_orderpriority, 1 LIMIT 10")
def page_after(spark, d):
    return _records(_orders(spark, d).order_by("o_orderpriority").cursor(AT, AFTER).page_size(10))


@query(f"{RECORD} WHERE o_orderpriority < '2-HIGH' OR (o_orderpriority = '2-HIGH' AND CAST(o_orderkey AS VARCHAR) < '500') ORDER BY o_orderpriority DESC, 1 DESC LIMIT 10")
def page_before(spark, d):
    return _records(_orders(spark, d).order_by("o_orderpriority").cursor(AT, BEFORE).page_size(10))


@query(f"{RECORD} ORDER BY o_orderpriority DESC, 1 DESC LIMIT 10")
def page_last(spark, d):
    return _records(_orders(spark, d).order_by("o_orderpriority").last_page().page_size(10))


@query(f"{RECORD} WHERE o_orderstatus = 'P' AND CAST(o_orderkey AS VARCHAR) > '500' ORDER BY 1 LIMIT 10")
def page_filtered_after(spark, d):
    return _records(_orders(spark, d).where("o_orderstatus", "eq", "P").cursor(encode_cursor({"slug": "500"}, "500"), AFTER).page_size(10))


def _info_sql(where: str, direction: str, has_next: str, has_previous: str) -> str:
    token = "replace(to_base64(encode('{{\"order\":{{\"o_orderpriority\":\"' || {0}.v || '\"}},\"slug\":\"' || {0}.slug || '\"}}')), chr(10), '')"
    first, last = ("lo", "hi") if direction == "ASC" else ("hi", "lo")
    return f"""
WITH page AS (SELECT o_orderpriority AS v, CAST(o_orderkey AS VARCHAR) AS slug, row_number() OVER (ORDER BY o_orderpriority {direction}, CAST(o_orderkey AS VARCHAR) {direction}) AS n FROM orders {where}),
lo AS (SELECT * FROM page WHERE n = 1), hi AS (SELECT * FROM page WHERE n = (SELECT max(n) FROM page WHERE n <= 10))
SELECT {has_next} AS has_next, {has_previous} AS has_previous, {token.format(first)} AS start_cursor, {token.format(last)} AS end_cursor FROM lo, hi"""


MORE = "(SELECT count(*) > 10 FROM page)"
ORACLE_SQL["page_info_after"] = _info_sql("WHERE o_orderpriority > '2-HIGH' OR (o_orderpriority = '2-HIGH' AND CAST(o_orderkey AS VARCHAR) > '500')", "ASC", MORE, "true")
ORACLE_SQL["page_info_before"] = _info_sql("WHERE o_orderpriority < '2-HIGH' OR (o_orderpriority = '2-HIGH' AND CAST(o_orderkey AS VARCHAR) < '500')", "DESC", "true", MORE)
ORACLE_SQL["page_info_first"] = _info_sql("", "ASC", MORE, "false")


@query()
def page_info_after(spark, d):
    return _info(spark, _orders(spark, d).order_by("o_orderpriority").cursor(AT, AFTER).page_size(10))


@query()
def page_info_before(spark, d):
    return _info(spark, _orders(spark, d).order_by("o_orderpriority").cursor(AT, BEFORE).page_size(10))


@query()
def page_info_first(spark, d):
    return _info(spark, _orders(spark, d).order_by("o_orderpriority").page_size(10))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS slug, replace(to_base64(encode('{"order":{"o_orderpriority":"' || o_orderpriority || '"},"slug":"' || o_orderkey || '"}')), chr(10), '') AS cursor FROM orders""")
def cursor_encode(spark, d):
    df = engine(spark, d).frame("orders")
    return df.select("slug", cursor_column("o_orderpriority", F.col("o_orderpriority"), F.col("slug")).alias("cursor"))


@query("SELECT source AS v, CAST(doc_id AS VARCHAR) AS vs, CAST(doc_id AS VARCHAR) AS slug FROM documents WHERE source LIKE 'src1%' ORDER BY 1, 2 LIMIT 40")
def peek_index_lines(spark, d):
    q = engine(spark, d).from_("documents").where("source", "startsWith", "src1").order_by("source").collate(BINARY).page_size(40)
    return q.peek().data


# Index

HEX = "(SELECT string_agg(printf('%04x', unicode(substr({v}, i, 1))), '/' ORDER BY i) FROM range(1, 1 + least({n}, length({v}))) t(i))"


def _post(v: str, table: str, field: str, source: str, key: str, depth: int, vs: str | None = None) -> str:
    return f"SELECT '{source}' AS source, '{field}' AS field, {HEX.format(v=v, n=depth)} AS p, {v} AS v, {vs or key} AS vs, {key} AS slug FROM {table}"


_C = "CAST(c_custkey AS VARCHAR)"
_JOINED = "customer JOIN nation ON c_nationkey = n_nationkey"
CUSTOMER_POSTINGS = " UNION ALL ".join([
    _post(_C, "customer", "slug", "customer", _C, 1), _post("CAST(c_nationkey AS VARCHAR)", "customer", "c_nationkey", "customer", _C, 1),
    _post("c_mktsegment", "customer", "c_mktsegment", "customer", _C, 2), _post("c_name", "customer", "c_name", "customer", _C, 1),
    _post("n_name", _JOINED, "nation.n_name", "customer", _C, 1, "CAST(n_nationkey AS VARCHAR)"),
    _post("r_name", f"{_JOINED} JOIN region ON n_regionkey = r_regionkey", "region.r_name", "customer", _C, 1, "CAST(r_regionkey AS VARCHAR)"),
    _post("CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END", "customer", "balance_band", "customer", _C, 1),
])
SHOWN = ("source", "field", "p", "v", "vs", "slug")


@query(CUSTOMER_POSTINGS)
def index_postings(spark, d):
    return postings.postings(engine(spark, d), "customer").select(*SHOWN)


@query(f"SELECT * FROM ({CUSTOMER_POSTINGS}) WHERE field IN ('nation.n_name', 'region.r_name')")
def index_relation_fields(spark, d):
    return postings.postings(engine(spark, d), "customer").where(F.col("field").contains(".")).select(*SHOWN)


@query(f"""
WITH x AS ({CUSTOMER_POSTINGS}), s AS (SELECT source, field, string_split(p, '/') AS parts FROM x WHERE p <> ''),
e AS (SELECT DISTINCT source, field, array_to_string(parts[1:i - 1], '/') AS dir, parts[i] AS child FROM s, range(1, 3) t(i) WHERE i <= len(parts))
SELECT source, field, dir, string_agg(child, ',' ORDER BY child) AS children FROM e GROUP BY ALL
""")
def index_prefix_dict(spark, d):
    rows = postings.prefix_dictionary(postings.postings(engine(spark, d), "customer"))
    return rows.withColumn("children", F.array_join("children", ","))


@query(f"""
WITH x AS (SELECT DISTINCT slug, field, p FROM ({CUSTOMER_POSTINGS})), f AS (SELECT slug, field, string_agg(p, ',' ORDER BY p) AS ps FROM x GROUP BY ALL)
SELECT slug, string_agg(field || '=' || ps, ';' ORDER BY field) AS ref FROM f GROUP BY slug
""")
def index_ref_map(spark, d):
    refs = postings.ref_map(postings.postings(engine(spark, d), "customer"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("ref")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return refs.select("slug", shown.alias("ref"))


@query(f"SELECT * FROM ({CUSTOMER_POSTINGS}) WHERE field = 'c_mktsegment' AND v = 'BUILDING'")
def index_probe_eq(spark, d):
    return postings.probe(postings.postings(engine(spark, d), "customer"), "customer", "c_mktsegment", "eq", "BUILDING", 2).select(*SHOWN)


@query(f"SELECT * FROM ({CUSTOMER_POSTINGS}) WHERE field = 'c_mktsegment' AND v LIKE 'M%'")
def index_probe_prefix(spark, d):
    return postings.probe(postings.postings(engine(spark, d), "customer"), "customer", "c_mktsegment", "startsWith", "M", 2).select(*SHOWN)


@query(f"SELECT source, field, min(p) AS first, max(p) AS last FROM ({CUSTOMER_POSTINGS}) GROUP BY ALL")
def index_first_last_leaf(spark, d):
    return postings.leaves(postings.postings(engine(spark, d), "customer"))


@query(f"SELECT source, slug, v, vs, field FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY v, vs, field) AS n FROM ({CUSTOMER_POSTINGS})) WHERE n = 1")
def index_postings_distinct_slug(spark, d):
    return postings.owners(postings.postings(engine(spark, d), "customer"))


@query("SELECT CAST(doc_id AS VARCHAR) AS slug, " + HEX.format(v="source", n=4) + " AS p FROM documents")
def index_prefix_path(spark, d):
    return engine(spark, d).frame("documents").select("slug", prefix_path(F.col("source"), 4).alias("p"))


# Changes

OLD = "SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN 'OLD' ELSE c_mktsegment END AS c_mktsegment, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0"
NEW = "SELECT * FROM customer WHERE c_custkey % 11 <> 0"
DIFF = f"""
SELECT CASE WHEN o.c_custkey IS NULL THEN 'A' WHEN n.c_custkey IS NULL THEN 'D' ELSE 'M' END AS status, CAST(coalesce(n.c_custkey, o.c_custkey) AS VARCHAR) AS slug,
       coalesce(o.c_mktsegment, n.c_mktsegment) AS segment
FROM ({OLD}) o FULL JOIN ({NEW}) n USING (c_custkey) WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR o.c_mktsegment <> n.c_mktsegment"""


def _states(spark, d) -> tuple[DataFrame, DataFrame]:
    df = engine(spark, d).frame("customer")
    old = df.where("c_custkey % 7 <> 0").withColumns({"c_mktsegment": F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'OLD' ELSE c_mktsegment END"), "c_acctbal": F.expr("CASE WHEN c_custkey % 3 = 0 THEN 0.0D ELSE c_acctbal END")})
    return old.drop("balance_band"), df.where("c_custkey % 11 <> 0").drop("balance_band")


def _diff(spark, d) -> DataFrame:
    return incremental.snapshot_diff(*_states(spark, d), "customer", ["c_mktsegment", "c_name"])


def _diff_of(status: str):
    def run(spark, d):
        return _diff(spark, d).where(F.col("status") == status).select("status", "slug", F.col("fields")["c_mktsegment"][0].alias("segment"))

    return run


for _status, _key in (("A", "diff_added"), ("D", "diff_deleted"), ("M", "diff_modified")):
    QUERIES[_key] = _diff_of(_status)
    ORACLE_SQL[_key] = f"SELECT * FROM ({DIFF}) WHERE status = '{_status}'"


@query(f"SELECT CAST(o.c_custkey AS VARCHAR) AS slug FROM ({OLD}) o JOIN ({NEW}) n USING (c_custkey) WHERE o.c_acctbal <> n.c_acctbal AND o.c_mktsegment = n.c_mktsegment")
def diff_modified_unindexed_suppressed(spark, d):
    old, new = _states(spark, d)
    changed = old.select("slug", F.col("c_acctbal").alias("b")).join(new.select("slug", "c_acctbal"), "slug").where("b <> c_acctbal").select("slug")
    return changed.join(_diff(spark, d).select("slug"), "slug", "left_anti")


@query(f"SELECT * FROM ({CUSTOMER_POSTINGS}) WHERE CAST(slug AS BIGINT) % 11 <> 0")
def incremental_equals_full(spark, d):
    """The postings of the old state brought up to date by a change feed."""
    old, new = _states(spark, d)
    before, after = engine(spark, d, customer=old), engine(spark, d, customer=new)
    rows = postings.with_ref(postings.postings(before, "customer"))
    feed = incremental.snapshot_diff(old, new, "customer", ["c_mktsegment", "c_name", "c_nationkey", "c_acctbal"])
    return incremental.updated(after, rows, feed, "customer").select(*SHOWN)


# Checks, paths, formats

SCHEMA = {
    "type": "object", "required": ["name", "when"],
    "properties": {"name": {"type": "string"}, "when": {"type": "date"}, "size": {"type": "integer"}, "note": {"type": ["string", "null"]}},
}


def _checked(spark, d) -> DataFrame:
    df = engine(spark, d).frame("orders")
    return df.select("slug", F.expr("CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END").alias("name"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'soon' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END").alias("when"), F.col("o_totalprice").alias("size"))


def _problem(path: str, problem: str, where: str) -> str:
    return f"SELECT CAST(o_orderkey AS VARCHAR) AS slug, '{path}' AS path, '{problem}' AS problem FROM orders WHERE {where}"


_REQUIRED, _DATES, _INTEGERS = _problem("name", "missing", "o_orderkey % 4 = 0"), _problem("when", "not a date", "o_orderkey % 3 = 0"), _problem("size", "not an integer", "o_totalprice <> floor(o_totalprice)")


@query(f"{_REQUIRED} UNION ALL {_DATES} UNION ALL {_INTEGERS}")
def validate_violations(spark, d):
    return violations(_checked(spark, d), SCHEMA)


@query(_REQUIRED)
def validate_required(spark, d):
    return violations(_checked(spark, d), SCHEMA).where("problem = 'missing'")


@query(_DATES)
def validate_date(spark, d):
    return violations(_checked(spark, d), SCHEMA).where("problem = 'not a date'")


BELOW = "regexp_replace(url, '^[a-z]+://[^/]*/', '')"


@query(f"SELECT page_id, replace(regexp_replace({BELOW}, '\\.[^./]+$', ''), '/', '--') AS slug FROM pages")
def slug_from_path(spark, d):
    below = F.regexp_replace("url", "^[a-z]+://[^/]*/", "")
    return engine(spark, d).frame("pages").select("page_id", paths.slug_column(below, "**/*").alias("slug"))


@query("SELECT page_id, regexp_matches(url, '^https://[^/]*/[^/]*$') AS one_level, regexp_matches(url, '^https://(.*/)?[^/]*1[^/]*$') AS any_level FROM pages")
def glob_match(spark, d):
    rows = engine(spark, d).frame("pages")
    return rows.select("page_id", F.col("url").rlike(paths.glob_regex("https://*/*")).alias("one_level"), F.col("url").rlike(paths.glob_regex("https://**/*1*")).alias("any_level"))


@query("SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$') AS tail, regexp_replace(regexp_replace(url, '/+$', ''), '/?[^/]*$', '') AS parent FROM pages")
def path_tail(spark, d):
    return engine(spark, d).frame("pages").select("page_id", paths.tail_column(F.col("url")).alias("tail"), paths.parent_column(F.col("url")).alias("parent"))


@query(f"SELECT page_id, regexp_replace('a//b/' || '/' || {BELOW}, '/{{2,}}', '/', 'g') AS joined FROM pages")
def join_path(spark, d):
    return engine(spark, d).frame("pages").select("page_id", paths.join_path_column(F.lit("a//b/"), F.regexp_replace("url", "^[a-z]+://[^/]*/", "")).alias("joined"))


YAML_SQL = "SELECT CAST(c_custkey AS VARCHAR) AS slug, c_name AS name, c_nationkey AS nation, c_mktsegment || '+x' AS tags, c_acctbal > 0 AS credit FROM customer"
YAML_SCHEMA = "name string, nation int, tags array<string>, credit boolean"


def _yaml(spark, d, form: str) -> DataFrame:
    return engine(spark, d).frame("customer").select("slug", F.format_string(form, "c_name", "c_nationkey", "c_mktsegment", (F.col("c_acctbal") > 0).cast("string")).alias("raw"))


def _read(spark, d, kind: str, form: str) -> DataFrame:
    return files.parsed_column(_yaml(spark, d, form), kind, YAML_SCHEMA).withColumn("tags", F.array_join("tags", "+"))


@query(YAML_SQL)
def parse_yaml(spark, d):
    return _read(spark, d, "yaml", "# head\nname: %s\nnation: %s\n\ntags:\n  - %s\n  - x\ncredit: %s\n")


@query(YAML_SQL)
def parse_frontmatter(spark, d):
    return _read(spark, d, "markdown", "---\nname: %s\nnation: %s\ntags: [%s, 'x']\ncredit: %s\n---\nbody: no\n")


@query(YAML_SQL)
def parse_json(spark, d):
    return _read(spark, d, "json", '{"name": "%s", "nation": %s, "tags": ["%s", "x"], "credit": %s}')


def _csv(text: str) -> list[dict]:
    head, *rows = [line.split(",") for line in text.splitlines() if line]
    return [dict(zip(head, row, strict=False)) for row in rows]


@query("SELECT CAST(c_custkey AS VARCHAR) AS slug, c_name AS col1, c_mktsegment AS col2 FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'second', 'row' FROM customer")
def parse_csv_injected(spark, d):
    parsers.register_parser("csv-lines", _csv)
    rows = engine(spark, d).frame("customer").select("slug", F.format_string("col1,col2\n%s,%s\nsecond,row\n", "c_name", "c_mktsegment").alias("raw"))
    return files.parsed_column(rows, "csv-lines", "col1 string, col2 string")


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def udtf_parser(spark, d):
    parsers.register_parser("html-title", lambda text: {"title": (re.search(r"(?s)<title>(.*?)</title>", text) or [None, ""])[1]})
    rows = engine(spark, d).frame("pages").select("slug", F.col("html").alias("raw"))
    return files.parsed_column(rows, "html-title", "title string").select(F.col("slug").cast("long").alias("page_id"), "title")


def _brand_values(record: dict) -> list:
    if record["p_partkey"] % 10 == 0:
        raise ValueError("such records are logged and skipped")
    return [record["p_brand"] and record["p_brand"].upper(), record["p_partkey"] % 3 == 0]


@query("""
SELECT upper(p_brand) AS v, CAST(p_partkey AS VARCHAR) AS slug FROM part WHERE p_brand IS NOT NULL AND p_partkey % 10 <> 0
UNION ALL SELECT CASE WHEN p_partkey % 3 = 0 THEN 'true' ELSE 'false' END, CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 10 <> 0
""")
def udf_custom_indexer(spark, d):
    catalog = Catalog({"part": Source("part", "table", "part.parquet", key=("p_partkey",), custom_index={"brand_values": 1})})
    e = Engine(spark, catalog, d, record_index={"part.brand_values": _brand_values})
    return postings.field_postings(e, "part", "brand_values", 1).select("v", "slug")


@query("SELECT CAST(p_partkey AS VARCHAR) AS slug FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 3 = 0")
def record_index_filter(spark, d):
    catalog = Catalog({"part": Source("part", "table", "part.parquet", key=("p_partkey",), custom_index={"brand_values": 1})})
    return _slugs(Engine(spark, catalog, d, record_index={"part.brand_values": _brand_values}).from_("part").where("brand_values", "eq", "true"))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS slug, {BY_PRICE} AS price, CAST(o_custkey AS VARCHAR) AS customer FROM orders")
def values_as_text(spark, d):
    df = engine(spark, d).frame("orders")
    return df.select("slug", js_string(F.col("o_totalprice"), df.schema["o_totalprice"].dataType).alias("price"), js_string(F.col("o_custkey"), df.schema["o_custkey"].dataType).alias("customer"))


@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS matched FROM customer GROUP BY 1")
def count_matched(spark, d):
    e = engine(spark, d)
    e.views()
    return spark.sql("SELECT c_mktsegment, count(*) AS matched FROM customer GROUP BY 1")


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders")
def distinct_keys(spark, d):
    return relations.keyed(engine(spark, d).frame("orders"), "o_custkey", "k_").select(F.col("k_key").alias("v")).distinct()


@query("SELECT CAST(conv_id AS VARCHAR) AS slug, CASE WHEN count(*) = 1 THEN min(role) END AS only_role, CAST(1 AS INTEGER) AS listed FROM conversations GROUP BY conv_id")
def unwrap_and_as_array(spark, d):
    df = engine(spark, d).frame("threads")
    only = unwrap_single(F.col("turns"), df.schema["turns"].dataType)
    return df.select("slug", only["role"].alias("only_role"), F.size(as_array(F.col("slug"), df.schema["slug"].dataType)).alias("listed"))


@query("""
SELECT n_name AS v, CAST(n_nationkey AS VARCHAR) AS slug FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS n_name FROM nation)
ORDER BY lower(n_name), n_nationkey LIMIT 15
""")
def order_unicode(spark, d):
    """The default order, in which case matters last."""
    mixed = engine(spark, d).frame("nation").withColumn("n_name", F.expr("CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END"))
    return engine(spark, d, nation=mixed).from_("nation").order_by("n_name").page_size(15).peek().data.select("v", "slug")


# Scans and written indexes


@query("SELECT CAST(c_custkey AS VARCHAR) AS slug, c_name AS name, CAST(c_nationkey AS INTEGER) AS nation FROM customer")
def jsonl_scan(spark, d):
    path = fresh_path(spark, "jsonl")
    lines = engine(spark, d).frame("customer").select(F.to_json(F.struct("slug", F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))).alias("value"))
    lines.withColumn("value", F.when(F.hash("value") % 3 == 0, F.concat("value", F.lit("\n\n  "))).otherwise(F.col("value"))).write.text(path)
    return files.json_lines(spark, path, "slug string, name string, nation int")


@query("SELECT c_name AS value FROM customer")
def list_scan(spark, d):
    path = fresh_path(spark, "lines")
    engine(spark, d).frame("customer").select(F.concat("c_name", F.lit("\n \n"))).write.text(path)
    return files.text_lines(spark, path)


def _stored(spark, d, name: str, **frames: DataFrame) -> DataFrame:
    path = fresh_path(spark, "index")
    postings.build_index(engine(spark, d, **frames), path, [name])
    return postings.read_index(spark, path)


@query(CUSTOMER_POSTINGS)
def index_stored(spark, d):
    """The index of a source, written and read again."""
    return _stored(spark, d, "customer").select(*SHOWN)


@query(f"SELECT * FROM ({CUSTOMER_POSTINGS}) WHERE field = 'c_mktsegment' AND v IN ('BUILDING', 'MACHINERY')")
def index_stored_probe(spark, d):
    return postings.probe(_stored(spark, d, "customer"), "customer", "c_mktsegment", "in", ["BUILDING", "MACHINERY", "none"], 2).select(*SHOWN)


@query(f"""
SELECT DISTINCT source, field, p FROM ({_post("CAST(r_regionkey AS VARCHAR)", "region", "slug", "region", "CAST(r_regionkey AS VARCHAR)", 1)}
UNION ALL {_post("r_name", "region", "r_name", "region", "CAST(r_regionkey AS VARCHAR)", 1)})
""")
def manifest(spark, d):
    """The files of an exported index, as its manifest lists them: which source, field and prefix each holds."""
    out, listed = fresh_path(spark, "export"), fresh_path(spark, "manifest")
    postings.export_lines(postings.with_ref(postings.postings(engine(spark, d), "region")), out)
    postings.write_manifest(spark, out, listed)
    part = lambda n: F.regexp_extract("file", f"/{n}=([^/]*)/", 1).alias(n)
    return postings.read_manifest(spark, listed).select(part("source"), part("field"), part("p")).distinct()


@query(CUSTOMER_POSTINGS)
def incremental_closure(spark, d):
    """Customers' postings after a change to regions only, which reaches them through their nations."""
    old = engine(spark, d).frame("region").withColumn("r_name", F.expr("CASE WHEN r_regionkey % 2 = 1 THEN concat('OLD ', r_name) ELSE r_name END"))
    rows = postings.with_ref(postings.postings(engine(spark, d, region=old), "customer"))
    feed = incremental.snapshot_diff(old, engine(spark, d).frame("region"), "region", ["r_name"])
    return incremental.updated(engine(spark, d), rows, feed, "customer").select(*SHOWN)


NESTED = {"type": "object", "properties": {"owner": {"type": ["object", "null"], "required": ["name"], "properties": {"name": {"type": "string"}}}}}


@query("SELECT CAST(o_orderkey AS VARCHAR) AS slug, 'owner.name' AS path, 'missing' AS problem FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0")
def validate_nested_required(spark, d):
    """Objects that lack a value they require; rows without the object pass."""
    owner = "CASE WHEN o_orderkey % 2 = 0 THEN named_struct('name', CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END) END AS owner"
    return violations(engine(spark, d).frame("orders").selectExpr("slug", owner), NESTED)


@query("SELECT CAST(c_custkey AS VARCHAR) AS slug, c_name AS name, c_nationkey AS nation, c_mktsegment || '+x' AS tags FROM customer")
def parse_yaml_nested(spark, d):
    raw = _yaml(spark, d, "owner:\n  name: %s\n  at:\n    # where\n    nation: %s\ntags: [%s,\n  'x',\n]\nmore: %s\n")
    got = files.parsed_column(raw, "yaml", "owner struct<name string, at struct<nation int>>, tags array<string>")
    return got.select("slug", "owner.name", "owner.at.nation", F.array_join("tags", "+").alias("tags"))


@query("""
SELECT 'record' AS kind, r_name AS name, CAST((SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS INTEGER) AS n_nations, CAST(NULL AS VARCHAR) AS has_next
FROM (SELECT * FROM region ORDER BY CAST(r_regionkey AS VARCHAR) LIMIT 3)
UNION ALL SELECT 'pageInfo', NULL, NULL, CASE WHEN count(*) > 3 THEN 'true' ELSE 'false' END FROM region
""")
def ssg_export(spark, d):
    """A page's records and page info as JSON, read again; when it was made is left out."""
    made = export.static_result(engine(spark, d), lambda e: e.from_("region").join("nations").collate(BINARY).page_size(3)).where("kind <> 'generatedAt'")
    field = lambda path: F.get_json_object("value", path)
    nations = F.when(F.col("kind") == "record", F.size(F.from_json(field("$.nations"), "array<struct<slug:string>>")))
    return made.select("kind", field("$.r_name").alias("name"), nations.alias("n_nations"), field("$.hasNextPage").alias("has_next"))


# Content files

NATION_FILES = Catalog.from_json({"sources": {"nations": {
    "type": "markdown", "pattern": "nations/**/*.md", "index": {"name": {}, "region": {}},
    "schema": {"type": "object", "required": ["name", "region"], "properties": {"name": {"type": "string"}, "region": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}}},
}}})


def _nation_files(spark, d, where: str = "true", name: str = "n_name") -> str:
    """A folder of Markdown files, one for each nation, below its region's folder."""
    root = fresh_path(spark, "content")
    storage = SparkStorage(spark, root)
    for r in engine(spark, d).frame("nation").where(where).selectExpr("n_nationkey", "n_regionkey", f"{name} AS name").collect():  # 25 rows at most
        storage.write(f"nations/r{r.n_regionkey}/n{r.n_nationkey}.md", f"---\nname: {r.name}\nregion: {r.n_regionkey}\ntags:\n  - {r.name.lower()}\n  - all\n---\nbody\n")
    return root


NATION_SLUG = "'r' || n_regionkey || '--n' || n_nationkey"


@query(f"SELECT {NATION_SLUG} AS slug, n_name AS name, CAST(n_regionkey AS BIGINT) AS region, lower(n_name) || '+all' AS tags FROM nation")
def content_scan(spark, d):
    """All records of a source of files, parsed and checked, with slugs made of their paths."""
    rows = Engine(spark, NATION_FILES, _nation_files(spark, d)).frame("nations")
    return rows.select("slug", "name", "region", F.array_join("tags", "+").alias("tags"))


@query(f"SELECT {NATION_SLUG} AS slug, n_name AS name, true AS has_raw FROM nation WHERE n_nationkey IN (3, 7)")
def content_by_slug(spark, d):
    e = Engine(spark, NATION_FILES, _nation_files(spark, d))
    wanted = [r.slug for r in e.frame("nations").where("slug LIKE '%--n3' OR slug LIKE '%--n7'").select("slug").collect()]
    return e.get_many("nations", wanted).select("slug", "name", F.startswith("raw", F.lit("---")).alias("has_raw"))


@query(f"SELECT 'nations/' || replace({NATION_SLUG}, '--', '/') || '.md' AS path FROM nation WHERE n_regionkey = 1")
def storage_list(spark, d):
    found = SparkStorage(spark, _nation_files(spark, d)).list("nations/r1/*.md")
    return spark.createDataFrame([(p,) for p in found], "path string")


@query(f"""
SELECT CASE WHEN n_nationkey % 8 = 0 THEN 'D' WHEN n_nationkey % 8 = 1 THEN 'A' ELSE 'M' END AS status, {NATION_SLUG} AS slug, CASE WHEN n_nationkey % 8 = 1 THEN 'NEW ' || n_name ELSE n_name END AS name
FROM nation WHERE n_nationkey % 8 <= 2
""")
def folder_diff(spark, d):
    """The change feed between two folders of files."""
    changed = "CASE WHEN n_nationkey % 8 IN (1, 2) THEN concat('NEW ', n_name) ELSE n_name END"
    old, new = _nation_files(spark, d, "n_nationkey % 8 <> 1"), _nation_files(spark, d, "n_nationkey % 8 <> 0", changed)
    return extract_diff(spark, NATION_FILES, FolderChanges(spark), old, new).select("status", "slug", F.col("fields")["name"][0].alias("name"))


_R = "CAST(r_regionkey AS VARCHAR)"
REGION_POSTINGS = f"{_post(_R, 'region', 'slug', 'region', _R, 1)} UNION ALL {_post('r_name', 'region', 'r_name', 'region', _R, 1)}"


@query(f"SELECT * FROM ({REGION_POSTINGS})")
def stream_updates(spark, d):
    """A stored index that a stream of change feeds has brought up to date."""
    old = engine(spark, d).frame("region").where("r_regionkey <> 2").withColumn("r_name", F.expr("CASE WHEN r_regionkey = 1 THEN 'OLD' ELSE r_name END"))
    path, feeds, state = fresh_path(spark, "index"), fresh_path(spark, "feeds"), fresh_path(spark, "stream")
    postings.build_index(engine(spark, d, region=old), path, ["region"])
    incremental.snapshot_diff(old, engine(spark, d).frame("region"), "region", ["r_name"]).write.json(feeds)
    only = Engine(spark, Catalog({"region": Source("region", "table", "region.parquet", key=("r_regionkey",), index={"r_name": 1})}), d)
    updates.follow(only, feeds, path, f"{state}/checkpoint", f"{state}/staging").awaitTermination()
    return postings.read_index(spark, path).select(*SHOWN)


@query(f"SELECT v, vs, slug FROM ({REGION_POSTINGS})")
def export_lines_read(spark, d):
    """The index as gzipped JSON lines, read again."""
    out = fresh_path(spark, "lines")
    postings.export_lines(postings.with_ref(postings.postings(engine(spark, d), "region")), out)
    lines = spark.read.schema("v string, vs string, ref map<string,map<string,array<string>>>").option("recursiveFileLookup", True).json(out)
    return lines.select("v", "vs", F.explode(F.map_keys("ref")).alias("slug"))


@query("SELECT n_name AS v FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS n FROM nation) WHERE n BETWEEN 6 AND 9")
def page_of_rows(spark, d):
    """A page cut from rows at hand: four after the fifth."""
    rows = [r[0] for r in engine(spark, d).frame("nation").select("n_name").orderBy("n_name").collect()]
    return spark.createDataFrame([(v,) for v in page_slice(rows, 4, 4, AFTER)], "v string")


@query()
def type_schema(spark, d):
    text = export.type_definitions(CATALOG)
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), "\n")).alias("line", "text"))

"""One query for each operator of tables, columns, graphs and sketches."""

from __future__ import annotations

import array
import datetime as dt
import sqlite3
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.core.durable import cut, delete, ensure_checkpoint_dir
from millrace.graph.components import components
from millrace.graph.graph import Graph
from millrace.operators import dataflow
from millrace.operators import group as agg
from millrace.sources import readers
from millrace.streaming.builders import TableBuilder
from millrace.streaming.sketch import CountMin
from millrace.table import Col, Table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf: str, name: str, order=None) -> Table:
    return Table.from_spark(spark.read.parquet(f"{sf}/{name}.parquet"), order)


def _events(spark: SparkSession, sf: str) -> Table:
    return _t(spark, sf, "events", "event_id")


def _rounded(t: Table, *names: str, digits: int = 4) -> DataFrame:
    return t.frame().withColumns({n: F.round(n, digits) for n in names})


# minimum slice -------------------------------------------------------------------
@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       round(avg(l_discount), 6) AS avg_disc, round(stddev_pop(l_quantity), 6) AS std_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def flagship_revenue(spark, sf):
    t = _t(spark, sf, "lineitem")
    t = t[t["l_shipdate"] <= dt.datetime(1998, 9, 2)]
    t["amount"] = t["l_extendedprice"] * (1 - t["l_discount"])
    g = t.groupby(["l_returnflag", "l_linestatus"], {"sum_qty": agg.SUM("l_quantity"), "revenue": agg.SUM("amount"), "avg_disc": agg.AVG("l_discount"), "std_qty": agg.STD("l_quantity"), "n": agg.COUNT()})
    g = g.sort([("l_returnflag", True), ("l_linestatus", True)])
    return g.frame().withColumns({"sum_qty": F.round("sum_qty", 2), "revenue": F.round("revenue", 2), "avg_disc": F.round("avg_disc", 6), "std_qty": F.round("std_qty", 6)})


# projection, columns, scalars ------------------------------------------------------
@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING'")
def filter_compare(spark, sf):
    t = _t(spark, sf, "customer")
    return t[(t["c_acctbal"] > 5000) & (t["c_mktsegment"] != "BUILDING")][["c_custkey", "c_mktsegment"]].frame()


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def project_derive(spark, sf):
    t = _t(spark, sf, "lineitem")
    t["charge"] = t["l_extendedprice"] * (1 - t["l_discount"]) * (1 + t["l_tax"])
    return t[["l_orderkey", "l_linenumber", "charge"]].frame()


@query("SELECT p_type AS kind, p_partkey AS id, 7::BIGINT AS seven FROM part")
def column_edit(spark, sf):
    t = _t(spark, sf, "part").remove_columns(["p_name", "p_brand", "p_size", "p_retailprice"]).rename({"p_partkey": "id", "p_type": "kind"})
    return t.swap_columns("id", "kind").add_column(7, "seven").frame()


@query("SELECT o_orderkey::VARCHAR AS s, trunc(o_totalprice)::BIGINT AS i, o_orderkey::DOUBLE AS f FROM orders")
def cast_types(spark, sf):
    t = _t(spark, sf, "orders")
    return Table(t.rows, {"s": (t["o_orderkey"].astype(str).expr, None), "i": (t["o_totalprice"].astype(int).expr, None), "f": (t["o_orderkey"].astype(float).expr, None)}).frame()


@query("SELECT columns.column_name AS name, 1::BIGINT AS n FROM (SELECT unnest(['l_extendedprice', 'l_discount', 'l_quantity', 'l_tax']) AS column_name) AS columns")
def select_by_type(spark, sf):
    names = _t(spark, sf, "lineitem")[float].column_names()
    return Table.of(spark, {"name": names, "n": [1] * len(names)}).frame()


@query("""
SELECT event_id, CASE WHEN d = 0 AND value > 0 THEN 'inf' WHEN d = 0 AND value < 0 THEN '-inf' WHEN d = 0 THEN 'nan' ELSE round(value / d, 4)::VARCHAR END AS q
FROM (SELECT event_id, value, event_id % 3 AS d FROM events)""")
def arith_div_zero(spark, sf):
    t = _events(spark, sf)
    q = (t["value"] / (t["event_id"] % 3)).expr
    shown = F.when(q == float("inf"), "inf").when(q == float("-inf"), "-inf").when(F.isnan(q), "nan").otherwise(F.round(q, 4).cast("string"))
    return t.rows.df.select("event_id", shown.alias("q"))


@query("""
SELECT event_id, floor((a - m) / NULLIF(b, 0))::BIGINT AS q, m FROM (
    SELECT event_id, a, b, CASE WHEN b <> 0 THEN ((a % b) + b) % b END AS m FROM (SELECT event_id, event_id - 5000 AS a, event_id % 7 - 3 AS b FROM events))""")
def floordiv_mod_sign(spark, sf):
    t = _events(spark, sf)
    a, b = t["event_id"] - 5000, t["event_id"] % 7 - 3
    t["q"], t["m"] = a // b, a % b
    return t[["event_id", "q", "m"]].frame()


@query("""
SELECT event_id, CASE WHEN v IS NULL THEN NULL ELSE (v <> 0 AND event_id % 2 <> 0)::BIGINT END AS both_true, CASE WHEN v IS NULL THEN NULL ELSE (v <> 0 OR event_id % 2 <> 0)::BIGINT END AS either_true
FROM (SELECT event_id, CASE WHEN value > 50 THEN NULL ELSE event_id % 3 END AS v FROM events)""")
def logical_null(spark, sf):
    t = _events(spark, sf)
    v = Col(t.rows, F.when(~(F.col("value") > 50), F.col("event_id") % 3), t["event_id"].kind)
    t["both_true"], t["either_true"] = v & (t["event_id"] % 2), v | (t["event_id"] % 2)
    return t[["event_id", "both_true", "either_true"]].frame()


@query("""
SELECT event_id, (v IS NOT DISTINCT FROM w)::BIGINT AS same, (v IS NULL)::BIGINT AS missing FROM (
    SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 3 END AS v, CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_id % 3 END AS w FROM events)""")
def null_eq(spark, sf):
    t = _events(spark, sf)
    kind = t["event_id"].kind
    v, w = (Col(t.rows, F.when(F.col("event_id") % n != 0, F.col("event_id") % 3), kind) for n in (4, 8))
    t["same"], t["missing"] = v == w, v == None  # noqa: E711
    return t[["event_id", "same", "missing"]].frame()


@query("SELECT event_id, least(greatest(value, 10.0), 60.0) AS held FROM events")
def clip_bounds(spark, sf):
    t = _events(spark, sf)
    t["held"] = t["value"].clip(10.0, 60.0)
    return t[["event_id", "held"]].frame()


@query("SELECT p_partkey, contains(p_type, 'STEEL')::BIGINT AS steel, (p_brand IN ('Brand#11', 'Brand#22'))::BIGINT AS listed FROM part")
def contains_substr(spark, sf):
    t = _t(spark, sf, "part")
    t["steel"], t["listed"] = t["p_type"].contains("STEEL"), t["p_brand"].is_in(["Brand#11", "Brand#22"])
    return t[["p_partkey", "steel", "listed"]].frame()


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE c_mktsegment END AS kind FROM customer")
def where_ternary(spark, sf):
    t = _t(spark, sf, "customer")
    t["kind"] = Col.where(t["c_acctbal"] < 0, "debt", t["c_mktsegment"])
    return t[["c_custkey", "kind"]].frame()


@query("SELECT event_id, user_id::VARCHAR || '-' || event_type AS tag, value ** 2 AS square, -value AS minus, abs(value - 50) AS off FROM events")
def scalar_ops(spark, sf):
    t = _events(spark, sf)
    t["tag"] = t["user_id"].astype(str) + "-" + t["event_type"]
    t["square"], t["minus"], t["off"] = t["value"] ** 2, -t["value"], abs(t["value"] - 50)
    return t[["event_id", "tag", "square", "minus", "off"]].frame()


@query("SELECT event_id, coalesce(v, -1.0) AS v, 'kept' AS side FROM (SELECT event_id, CASE WHEN value > 80 THEN NULL ELSE value END AS v FROM events) WHERE v IS NOT NULL UNION ALL SELECT event_id, -1.0, 'dropped' FROM events WHERE value > 80")
def dropna_fillna(spark, sf):
    t = _events(spark, sf)
    t["v"] = Col(t.rows, F.when(~(F.col("value") > 80), F.col("value")), t["value"].kind)
    kept, dropped = t[["event_id", "v"]].dropna_split("v")
    return kept.add_column("kept", "side").append(dropped.fillna("v", -1.0).add_column("dropped", "side")).frame()


# rows --------------------------------------------------------------------------------
@query("SELECT row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) - 1 AS place, o_orderkey FROM orders")
def sort_multi(spark, sf):
    t = _t(spark, sf, "orders")[["o_orderkey", "o_orderpriority", "o_totalprice"]].sort([("o_orderpriority", True), ("o_totalprice", False), ("o_orderkey", True)])
    return t.add_row_number("place")[["place", "o_orderkey"]].frame()


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def topk_desc(spark, sf):
    return _t(spark, sf, "lineitem", ["l_orderkey", "l_linenumber"]).topk("l_extendedprice", 25)[["l_orderkey", "l_linenumber", "l_extendedprice"]].frame()


@query("SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 10")
def topk_reverse(spark, sf):
    return _events(spark, sf).topk("value", 10, reverse=True)[["event_id", "value"]].frame()


@query("SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 12) THEN 1::BIGINT ELSE 0 END AS top FROM events")
def topk_index(spark, sf):
    t = _events(spark, sf)
    t["top"] = t["value"].topk_index(12)
    return t[["event_id", "top"]].frame()


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def append_union_all(spark, sf):
    a, b = _t(spark, sf, "nation")[["n_name"]].rename({"n_name": "name"}), _t(spark, sf, "region")[["r_name"]].rename({"r_name": "name"})
    return a.append(b).frame()


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def unique_rows(spark, sf):
    return _t(spark, sf, "lineitem")[["l_returnflag", "l_linestatus"]].unique().frame()


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 + 100 AS id, event_id FROM events")
def row_number(spark, sf):
    return _events(spark, sf).add_row_number("id", 100)[["id", "event_id"]].frame()


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i >= 10 AND i < 200 AND (i - 10) % 7 = 0")
def slice_rows(spark, sf):
    return _events(spark, sf)[10:200:7][["event_id"]].frame()


@query("(SELECT 'head' AS side, event_id FROM events ORDER BY event_id LIMIT 9) UNION ALL (SELECT 'tail', event_id FROM events ORDER BY event_id DESC LIMIT 9)")
def head_tail(spark, sf):
    t = _events(spark, sf)[["event_id"]]
    return t.head(9).add_column("head", "side").append(t.tail(9).add_column("tail", "side"))[["side", "event_id"]].frame()


@query("SELECT event_id, a + b AS zipped FROM (SELECT event_id, value AS a, lag(value) OVER (ORDER BY event_id) AS b FROM events) WHERE event_id > (SELECT min(event_id) FROM events)")
def positional_zip(spark, sf):
    t = _events(spark, sf)
    n = t.num_rows()
    later, earlier = t[1:n], t[0 : n - 1]
    later["zipped"] = later["value"] + earlier["value"]
    return later[["event_id", "zipped"]].frame()


@query("SELECT count(*) AS n, count(*) AS together, 1::BIGINT AS near FROM events")
def sample_split(spark, sf):
    t = _events(spark, sf)
    a, b = t.random_split(0.3, seed=5)
    n = t.num_rows()
    return Table.of(spark, {"n": [n], "together": [a.num_rows() + b.num_rows()], "near": [int(abs(t.sample(0.3, 5).num_rows() - 0.3 * n) < 0.05 * n)]}).frame()


@query("SELECT o_orderkey, o_orderstatus AS status, extract(year FROM o_orderdate) AS year, o_totalprice * 2 AS twice FROM orders")
def add_columns(spark, sf):
    """Columns of a table that was sorted elsewhere are added by position, others as expressions."""
    t = _t(spark, sf, "orders", "o_orderkey")
    other = _t(spark, sf, "orders", "o_orderkey")[["o_orderstatus", "o_orderdate"]].rename({"o_orderstatus": "status"})
    other = other.split_datetime("o_orderdate", "", ["year"])
    out = t[["o_orderkey", "o_totalprice"]].add_columns(other)
    return out.add_columns([out["o_totalprice"] * 2], ["twice"]).remove_column("o_totalprice").frame()


@query("SELECT c_custkey AS k, c_mktsegment AS v FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def column_append(spark, sf):
    c, s = _t(spark, sf, "customer", "c_custkey"), _t(spark, sf, "supplier", "s_suppkey")
    t = c["c_custkey"].append(s["s_suppkey"]).to_table("k")
    return t.add_column(c["c_mktsegment"].append(s["s_name"]), "v").frame()


@query("SELECT p_partkey, round(ln(p_retailprice) + sqrt(p_size), 6) AS x, floor(p_retailprice / 7)::BIGINT AS y, atan2(p_size, p_retailprice) > 0 AS z FROM part")
def column_functions(spark, sf):
    """Functions of Spark's over cells, one of them by its registered name."""
    t = _t(spark, sf, "part")
    t["x"] = t["p_retailprice"].call(lambda p, s: F.ln(p) + F.sqrt(s), t["p_size"])
    t["y"] = (t["p_retailprice"] / 7).call(F.floor)
    t["z"] = t["p_size"].call(lambda s, p: F.call_function("atan2", s, p), t["p_retailprice"]) > 0
    return _rounded(t[["p_partkey", "x", "y", "z"]], "x", digits=6).withColumn("z", F.col("z") == 1)


@query("SELECT event_id FROM events WHERE value * 2 > 90")
def column_filter(spark, sf):
    """Cells that a Python function keeps."""
    t = _events(spark, sf)
    keep = t["value"].apply(lambda x: int(x * 2 > 90), int)
    kept = t["value"].filter(lambda x: x * 2 > 90)
    out = t[keep][["event_id"]]
    if len(kept) != len(out):
        raise ValueError("both ways must keep the same cells")
    return out.frame()


@query("SELECT count(*) AS n, 3::BIGINT AS columns, 'o_orderkey,o_custkey,double' AS names, 1::BIGINT AS apart, 1::BIGINT AS done FROM orders")
def shape_copy(spark, sf):
    t = _t(spark, sf, "orders")[["o_orderkey", "o_custkey"]]
    other = t.copy()
    other["double"] = other["o_custkey"] * 2
    other.materialize()
    n, columns = other.shape
    return Table.of(spark, [{"n": n, "columns": columns, "names": ",".join(other.column_names()), "apart": int(t.num_columns() == 2), "done": int(other.is_materialized() and "Scan" in other.query_plan())}]).frame()


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS hashes, 1::BIGINT AS alike, 1::BIGINT AS seeded FROM orders")
def column_hash(spark, sf):
    t = _t(spark, sf, "orders")
    t["a"], t["b"], t["c"] = t["o_orderkey"].hash(), t["o_orderkey"].hash(), t["o_orderkey"].hash(seed=1)
    return t.frame().agg(F.count("a").alias("n"), F.count_distinct("a").alias("hashes"), F.max((F.col("a") == F.col("b")).cast("long")).alias("alike"), F.max((F.col("a") != F.col("c")).cast("long")).alias("seeded"))


@query("SELECT 2000::BIGINT AS n, 1::BIGINT AS same, 1::BIGINT AS spread FROM region WHERE r_regionkey = 0")
def random_columns(spark, sf):
    """Numbers of one seed are the same each time and about evenly spread; the generators take no table."""
    a, b = (Col.random_integers(spark, 2000, seed=7).to_table("x") for _ in range(2))
    t = readers.random_table(spark, 2000, "nuzbsv", seed=3)
    mean = t["X2-u"].mean()
    same = a.frame().exceptAll(b.frame()).isEmpty()
    return Table.of(spark, {"n": [a.num_rows()], "same": [int(same)], "spread": [int(abs(mean - 0.5) < 0.05 and t.shape == (2000, 6))]}).frame()


# joins ---------------------------------------------------------------------------------
@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf):
    o = _t(spark, sf, "orders")[["o_orderkey", "o_custkey"]]
    return o.join(_t(spark, sf, "customer")[["c_custkey", "c_name"]], on={"o_custkey": "c_custkey"}).frame()


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def join_left(spark, sf):
    c = _t(spark, sf, "customer")[["c_custkey"]]
    return c.join(_t(spark, sf, "orders")[["o_orderkey", "o_custkey"]], on={"c_custkey": "o_custkey"}, how="left").frame()


@query("SELECT coalesce(o_custkey, c_custkey) AS o_custkey, o_orderkey, c_name FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right(spark, sf):
    return _t(spark, sf, "orders")[["o_custkey", "o_orderkey"]].join(_t(spark, sf, "customer")[["c_custkey", "c_name"]], on={"o_custkey": "c_custkey"}, how="right").frame()


@query("SELECT coalesce(a.k, b.k) AS k, a.x, b.y FROM (SELECT c_custkey AS k, c_nationkey::BIGINT AS x FROM customer) a FULL JOIN (SELECT s_suppkey * 20 AS k, s_nationkey::BIGINT AS y FROM supplier) b ON a.k = b.k")
def join_outer(spark, sf):
    a, b = _t(spark, sf, "customer")[["c_custkey", "c_nationkey"]].rename({"c_custkey": "k", "c_nationkey": "x"}), _t(spark, sf, "supplier")
    b["k"] = b["s_suppkey"] * 20
    return a.join(b[["k", "s_nationkey"]].rename({"s_nationkey": "y"}), on="k", how="outer").frame()


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_dict_keys(spark, sf):
    return _t(spark, sf, "nation").join(_t(spark, sf, "region"), on={"n_regionkey": "r_regionkey"}).frame()


@query("SELECT a.k, count(*) AS n, sum(a.x)::BIGINT AS x, sum(b.x)::BIGINT AS y FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::BIGINT END AS k, c_custkey AS x FROM customer) a JOIN (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey::BIGINT END AS k, s_suppkey AS x FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k GROUP BY ALL")
def join_null_keys(spark, sf):
    """Half of each table has a null key; the joined rows are counted and added up for each key, from counts and sums of each side."""

    def side(name, key, nation):
        t = _t(spark, sf, name)
        t["k"] = Col(t.rows, F.when(F.col(key) % 2 == 0, F.col(nation)), t[nation].kind)
        return t[["k", key]].rename({key: "x"})

    suppliers = side("supplier", "s_suppkey", "s_nationkey")
    return side("customer", "c_custkey", "c_nationkey").join_groupby(suppliers, "k", {"n": agg.COUNT(), "x": agg.SUM("x"), "y": agg.SUM("x.1")}).frame()


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_by_in(spark, sf):
    return _t(spark, sf, "orders").filter_by(["1-URGENT", "2-HIGH"], "o_orderpriority")[["o_orderkey"]].frame()


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def filter_by_exclude(spark, sf):
    return _t(spark, sf, "customer").filter_by(_t(spark, sf, "orders")["o_custkey"], "c_custkey", exclude=True)[["c_custkey"]].frame()


# grouping ------------------------------------------------------------------------------
@query("SELECT o_orderpriority, sum(o_custkey)::BIGINT AS s, round(avg(o_totalprice), 4) AS m, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders GROUP BY ALL")
def groupby_basic(spark, sf):
    g = _t(spark, sf, "orders").groupby("o_orderpriority", {"s": agg.SUM("o_custkey"), "m": agg.AVG("o_totalprice"), "lo": agg.MIN("o_totalprice"), "hi": agg.MAX("o_totalprice"), "n": agg.COUNT()})
    return _rounded(g, "m")


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, count(*) FILTER (l_discount > 0.05) AS n FROM lineitem GROUP BY ALL")
def groupby_user(spark, sf):
    """Aggregates of the caller's own."""
    g = _t(spark, sf, "lineitem").groupby("l_returnflag", {"c": agg.USER(F.corr, "l_quantity", "l_extendedprice"), "n": agg.USER(lambda d: F.count_if(d > 0.05), "l_discount")})
    return _rounded(g, "c", digits=6)


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def groupby_keys(spark, sf):
    return _t(spark, sf, "orders").groupby(["o_orderstatus", "o_orderpriority"], {}).frame()


@query("SELECT l_suppkey, round(var_pop(l_quantity), 6) AS v, round(stddev_pop(l_quantity), 6) AS s FROM lineitem GROUP BY ALL")
def groupby_var_std(spark, sf):
    return _rounded(_t(spark, sf, "lineitem").groupby("l_suppkey", {"v": agg.VAR("l_quantity"), "s": agg.STD("l_quantity")}), "v", "s", digits=6)


@query("""
SELECT user_id, arg_max(event_id, struct_pack(v := value, i := -event_id)) AS hi, arg_min(event_id, struct_pack(v := value, i := event_id)) AS lo FROM events GROUP BY ALL""")
def groupby_argmax(spark, sf):
    return _events(spark, sf).groupby("user_id", {"hi": agg.ARGMAX("value", "event_id"), "lo": agg.ARGMIN("value", "event_id")}).frame()


@query("SELECT user_id, count(DISTINCT event_type) + max((event_type IS NULL)::BIGINT) AS n FROM (SELECT user_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type FROM events) GROUP BY ALL")
def groupby_count_distinct(spark, sf):
    t = _events(spark, sf)
    t["event_type"] = Col(t.rows, F.when(F.col("event_id") % 5 != 0, F.col("event_type")), t["event_type"].kind)
    return t.groupby("user_id", {"n": agg.COUNT_DISTINCT("event_type")}).frame()


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY ALL")
def groupby_distinct(spark, sf):
    g = _events(spark, sf).groupby("user_id", {"kinds": agg.DISTINCT("event_type")})
    return g.frame().withColumn("kinds", F.array_join(F.sort_array("kinds"), ","))


@query("SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL")
def groupby_freq_count(spark, sf):
    g = _events(spark, sf).groupby("user_id", {"counts": agg.FREQ_COUNT("event_type")})
    return g.frame().withColumn("counts", F.array_join(F.transform("counts", lambda e: F.concat_ws("=", e["key"], e["count"])), ","))


@query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY ALL")
def groupby_concat_list(spark, sf):
    g = _events(spark, sf).groupby("user_id", {"ids": agg.CONCAT("event_id")})
    return g.frame().withColumn("ids", F.array_join("ids", ","))


@query("SELECT user_id, string_agg(event_type || '=' || first, ',' ORDER BY event_type) AS firsts FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY ALL")
def groupby_concat_dict(spark, sf):
    g = _events(spark, sf).groupby("user_id", {"firsts": agg.CONCAT("event_type", "event_id")})
    return g.frame().withColumn("firsts", F.array_join(F.transform(F.sort_array(F.map_entries("firsts")), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query("SELECT l_linestatus, count(*) AS n, 1 AS median_near, 1 AS high_near FROM lineitem GROUP BY ALL")
def groupby_quantile(spark, sf):
    """Whole groups; of each quantile it is compared whether its rank is within 1/10000 of the one asked for."""
    t = _t(spark, sf, "lineitem")
    g = t.groupby("l_linestatus", {"q": agg.QUANTILE("l_extendedprice", 0.5, 0.9)})
    x, ranks = F.col("l_extendedprice"), (("median", 0, 0.5), ("high", 1, 0.9))
    both = t[["l_linestatus", "l_extendedprice"]].join(g, on="l_linestatus").frame()
    shares = [f((c(F.col("q")[i])).cast("double")).alias(f"{name}_{end}") for name, i, _ in ranks for end, f, c in (("below", F.avg, lambda q: x < q), ("upto", F.avg, lambda q: x <= q))]
    near = [((F.col(f"{name}_below") - 1e-4 <= p) & (F.col(f"{name}_upto") + 1e-4 >= p)).cast("int").alias(f"{name}_near") for name, _, p in ranks]
    return both.groupBy("l_linestatus").agg(F.count(x).alias("n"), *shares).select("l_linestatus", "n", *near)


@query("SELECT n_regionkey::BIGINT AS n_regionkey, 1 AS member FROM nation GROUP BY ALL")
def groupby_select_one(spark, sf):
    n = _t(spark, sf, "nation")
    g = n.groupby("n_regionkey", {"one": agg.SELECT_ONE("n_name")})
    return g.rename({"n_regionkey": "k"}).join(n, on={"one": "n_name"}).frame().select("n_regionkey", (F.col("k") == F.col("n_regionkey")).cast("int").alias("member"))


_VECTORS = "SELECT label, i, {f}(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL"


def _vector_agg(spark, sf, f):
    g = _t(spark, sf, "embeddings").groupby("label", {"v": f("embedding")})
    return g.frame().select("label", F.posexplode("v").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("SELECT label::BIGINT AS label, i, round(x, 6) AS x FROM (" + _VECTORS.format(f="sum") + ")")
def groupby_vector_sum(spark, sf):
    return _vector_agg(spark, sf, agg.SUM)


@query("SELECT label::BIGINT AS label, i, round(x, 6) AS x FROM (" + _VECTORS.format(f="avg") + ")")
def groupby_vector_avg(spark, sf):
    return _vector_agg(spark, sf, agg.AVG)


@query("SELECT round(sum(value), 4) AS s, round(avg(value), 6) AS m, min(value) AS lo, max(value) AS hi, round(var_pop(value), 4) AS v, round(stddev_samp(value), 6) AS sd, count(*) AS n, count(*) FILTER (value <> 0) AS nnz, 0::BIGINT AS missing, arg_max(event_id, struct_pack(v := value, i := -event_id)) - min(event_id) AS at FROM events")
def column_reductions(spark, sf):
    t = _events(spark, sf)
    c = t["value"]
    found = {"s": round(c.sum(), 4), "m": round(c.mean(), 6), "lo": c.min(), "hi": c.max(), "v": round(c.var(), 4), "sd": round(c.std(ddof=1), 6), "n": len(c), "nnz": c.nnz(), "missing": c.num_missing(), "at": c.argmax()}
    return Table.of(spark, [found]).frame()


# windows -----------------------------------------------------------------------------------
def _values(spark, sf) -> Table:
    """Only the columns that windows need, as rows are numbered in a checkpoint of all that a table is made from."""
    return Table.from_spark(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value"), "event_id")


def _windowed(spark, sf, **columns) -> DataFrame:
    t = _values(spark, sf)
    for name, f in columns.items():
        t[name] = f(t)
    return _rounded(t[["event_id", *columns]], *(n for n in columns if n != "n"))


@query("SELECT event_id, CASE WHEN count(value) OVER w >= 5 THEN round(avg(value) OVER w, 4) END AS m FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def rolling_mean(spark, sf):
    return _windowed(spark, sf, m=lambda t: t["value"].rolling_mean(-4, 0))


@query("SELECT event_id, round(sum(value) OVER w, 4) AS s FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING)")
def rolling_sum(spark, sf):
    return _windowed(spark, sf, s=lambda t: t["value"].rolling_sum(-2, 3, min_observations=1))


@query("SELECT event_id, CASE WHEN count(value) OVER w >= 7 THEN min(value) OVER w END AS lo, CASE WHEN count(value) OVER w >= 7 THEN max(value) OVER w END AS hi FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def rolling_minmax(spark, sf):
    return _windowed(spark, sf, lo=lambda t: t["value"].rolling_min(-3, 3), hi=lambda t: t["value"].rolling_max(-3, 3))


@query("SELECT event_id, CASE WHEN count(value) OVER w >= 2 THEN round(var_pop(value) OVER w, 4) END AS v, CASE WHEN count(value) OVER w >= 2 THEN round(stddev_pop(value) OVER w, 4) END AS s FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def rolling_var(spark, sf):
    return _windowed(spark, sf, v=lambda t: t["value"].rolling_var(-5, -1, 2), s=lambda t: t["value"].rolling_stdv(-5, -1, 2))


@query("SELECT event_id, count(v) OVER (ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n FROM (SELECT event_id, CASE WHEN value <= 50 THEN value END AS v FROM events)")
def rolling_count(spark, sf):
    return _windowed(spark, sf, n=lambda t: Col(t.rows, F.when(F.col("value") <= 50, F.col("value")), t["value"].kind).rolling_count(-9, 0))


@query("SELECT event_id, round(sum(value) OVER w, 2) AS s, round(sum(value) OVER w, 2) AS m FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def cumulative_sum(spark, sf):
    """The mean is compared as the sum that it stands for, whose digits end."""
    t = _values(spark, sf).add_row_number("n", 1)
    t["s"] = t["value"].cumulative_sum()
    t["m"] = t["value"].cumulative_mean()
    t["m"] = t["m"] * t["n"]
    return _rounded(t[["event_id", "s", "m"]], "s", "m", digits=2)


@query("SELECT event_id, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def cumulative_minmax(spark, sf):
    return _windowed(spark, sf, lo=lambda t: t["value"].cumulative_min(), hi=lambda t: t["value"].cumulative_max())


@query("SELECT event_id, round(var_pop(value) OVER w, 4) AS v, round(stddev_pop(value) OVER w, 4) AS s FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def cumulative_var(spark, sf):
    return _windowed(spark, sf, v=lambda t: t["value"].cumulative_var(), s=lambda t: t["value"].cumulative_std())


# reshape -------------------------------------------------------------------------------------
@query("SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings")
def stack_list(spark, sf):
    return _t(spark, sf, "embeddings")[["vec_id", "embedding"]].stack("embedding", "x").frame()


@query("SELECT user_id, event_type AS k, count(*) AS v FROM events GROUP BY ALL")
def stack_dict(spark, sf):
    t = _events(spark, sf).groupby(["user_id", "event_type"], {"n": agg.COUNT()})
    return t.unstack(["event_type", "n"], "d").stack("d", ["k", "v"]).frame()


@query("SELECT l_orderkey, list_aggregate(list_sort(list(l_partkey)), 'string_agg', ',') AS parts FROM lineitem GROUP BY ALL")
def unstack_list(spark, sf):
    t = _t(spark, sf, "lineitem")[["l_orderkey", "l_partkey"]].unstack("l_partkey", "parts")
    return t.frame().withColumn("parts", F.array_join(F.sort_array("parts"), ","))


@query("SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS d FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL")
def unstack_dict(spark, sf):
    t = _events(spark, sf).groupby(["user_id", "event_type"], {"n": agg.COUNT()}).unstack(["event_type", "n"], "d")
    return t.frame().withColumn("d", F.array_join(F.transform(F.sort_array(F.map_entries("d")), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query("SELECT p_partkey, p_size::DOUBLE + p_retailprice AS total, 2::BIGINT AS n FROM part")
def pack_list(spark, sf):
    t = _t(spark, sf, "part")[["p_partkey", "p_size", "p_retailprice"]].pack_columns(["p_size", "p_retailprice"], dtype=array.array, new_column_name="v")
    return t.frame().select("p_partkey", (F.col("v")[0] + F.col("v")[1]).alias("total"), F.size("v").cast("long").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'priority' ELSE 'priority,status' END AS keys FROM orders")
def pack_dict(spark, sf):
    t = _t(spark, sf, "orders")
    t["o.status"] = Col(t.rows, F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")), t["o_orderstatus"].kind)
    t["o.priority"] = t["o_orderpriority"]
    t = t[["o_orderkey", "o.status", "o.priority"]].pack_columns(column_prefix="o.", dtype=dict, new_column_name="d")
    return t.frame().select("o_orderkey", F.array_join(F.sort_array(F.map_keys("d")), ",").alias("keys"))


_KINDS = ("click", "error", "purchase", "signup", "view")  # the event types of the tables


@query("SELECT user_id, " + ", ".join(f"max(n) FILTER (event_type = '{k}') AS \"e.{k}\"" for k in _KINDS) + " FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def unpack_dict(spark, sf):
    t = _events(spark, sf).groupby(["user_id", "event_type"], {"n": agg.COUNT()}).unstack(["event_type", "n"], "e")
    return t.unpack("e").frame()


@query("SELECT vec_id, embedding[1]::DOUBLE AS \"v.0\", embedding[2]::DOUBLE AS \"v.1\" FROM embeddings")
def unpack_vector(spark, sf):
    return _t(spark, sf, "embeddings")[["vec_id", "embedding"]].unpack("embedding", "v", limit=[0, 1]).frame()


@query("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
def flat_map_rows(spark, sf):
    return _t(spark, sf, "part").flat_map(["p_partkey", "word"], lambda r: [[r["p_partkey"], w] for w in r["p_type"].split(" ")], [int, str]).frame()


# text, dictionaries, dates, vectors ---------------------------------------------------------
@query("SELECT o_orderkey, year(o_orderdate) AS \"d.year\", month(o_orderdate) AS \"d.month\", day(o_orderdate) AS \"d.day\", hour(o_orderdate) AS \"d.hour\", isodow(o_orderdate) AS \"d.isoweekday\", isodow(o_orderdate) - 1 AS \"d.weekday\", dayofweek(o_orderdate) AS \"d.tmweekday\" FROM orders")
def split_datetime(spark, sf):
    t = _t(spark, sf, "orders")[["o_orderkey", "o_orderdate"]]
    return t.split_datetime("o_orderdate", "d", ["year", "month", "day", "hour", "isoweekday", "weekday", "tmweekday"]).frame()


@query("SELECT event_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS micros, epoch_us(ts + INTERVAL 90 SECOND) AS later FROM events")
def datetime_diff(spark, sf):
    t = _events(spark, sf)
    seconds, later = t["ts"] - dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), t["ts"] + 90
    return t.rows.df.select("event_id", F.round(seconds.expr * 1e6).cast("long").alias("micros"), F.unix_micros(later.expr).alias("later"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS day, epoch_us(date_trunc('second', o_orderdate)) AS back FROM orders")
def datetime_format(spark, sf):
    t = _t(spark, sf, "orders")
    t["day"] = t["o_orderdate"].datetime_to_str("%Y/%m/%d %H:%M:%S")
    t["back"] = t["day"].str_to_datetime("%Y/%m/%d %H:%M:%S")
    return t.frame().select("o_orderkey", "day", F.unix_micros("back").alias("back"))


_BAG = "SELECT doc_id, string_agg(w || '=' || n, ' ' ORDER BY w) AS bag FROM ({inner}) GROUP BY ALL"


def _bag(t: Table, name: str) -> DataFrame:
    entries = F.sort_array(F.map_entries(name))
    return t.frame().where(F.col("text").rlike(r"\S")).select("doc_id", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), " ").alias("bag"))


@query(_BAG.format(inner="SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[\\r\\x0B\\n\\f\\t ]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL"))
def word_count(spark, sf):
    t = _t(spark, sf, "documents")[["doc_id", "text"]]
    t["bag"] = t["text"].count_words()
    return _bag(t, "bag")


@query("""
WITH words AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\\s\\x0B!"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]+'), lambda w: w <> '') AS w FROM documents),
grams AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS w FROM words)
SELECT words.doc_id, coalesce(bag, '') AS bag FROM words LEFT JOIN (SELECT doc_id, string_agg(w || '=' || n, ' ' ORDER BY w) AS bag FROM (SELECT doc_id, w, count(*) AS n FROM grams GROUP BY ALL) GROUP BY ALL) USING (doc_id) JOIN documents USING (doc_id) WHERE regexp_matches(text, '\\S')""")
def word_ngrams(spark, sf):
    t = _t(spark, sf, "documents")[["doc_id", "text"]]
    t["bag"] = t["text"].count_ngrams(2)
    return _bag(t, "bag")


@query("""
WITH texts AS (SELECT doc_id, regexp_replace(lower(text), '[\\s\\x0B!"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]', '', 'g') AS s FROM documents WHERE regexp_matches(text, '\\S')),
grams AS (SELECT doc_id, substr(s, i, 3) AS w FROM (SELECT doc_id, s, unnest(range(1, length(s) - 1)) AS i FROM texts))
SELECT texts.doc_id, coalesce(bag, '') AS bag FROM texts LEFT JOIN (SELECT doc_id, string_agg(w || '=' || n, ' ' ORDER BY w) AS bag FROM (SELECT doc_id, w, count(*) AS n FROM grams GROUP BY ALL) GROUP BY ALL) USING (doc_id)""")
def char_ngrams(spark, sf):
    t = _t(spark, sf, "documents")[["doc_id", "text"]]
    t["bag"] = t["text"].count_ngrams(3, method="character")
    return _bag(t, "bag")


def _counts(spark, sf) -> Table:
    return _events(spark, sf).groupby(["user_id", "event_type"], {"n": agg.COUNT()}).unstack(["event_type", "n"], "d")


_DICTS = "SELECT user_id, event_type AS k, count(*) AS n FROM events GROUP BY ALL"


@query(f"SELECT user_id, string_agg(k, ',' ORDER BY k) AS keys, sum(n)::BIGINT AS total, count(*) AS n FROM ({_DICTS}) GROUP BY ALL")
def dict_keys_values(spark, sf):
    t = _counts(spark, sf)
    t["keys"], t["values"], t["n"] = t["d"].dict_keys(), t["d"].dict_values(), t["d"].item_length()
    return t.frame().select("user_id", F.array_join(F.sort_array("keys"), ",").alias("keys"), F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), "n")


@query(f"SELECT user_id, count(*) FILTER (k NOT IN ('click', 'view')) AS by_key, count(*) FILTER (n >= 10 AND n <= 30) AS by_value FROM ({_DICTS}) GROUP BY ALL")
def dict_trim(spark, sf):
    t = _counts(spark, sf)
    t["by_key"], t["by_value"] = t["d"].dict_trim_by_keys(["click", "view"]).item_length(), t["d"].dict_trim_by_values(10, 30).item_length()
    return t[["user_id", "by_key", "by_value"]].frame()


@query(f"SELECT user_id, max((k IN ('click', 'error'))::BIGINT) AS has_any, (count(*) FILTER (k IN ('click', 'view')) = 2)::BIGINT AS has_all FROM ({_DICTS}) GROUP BY ALL")
def dict_has_keys(spark, sf):
    t = _counts(spark, sf)
    t["has_any"], t["has_all"] = t["d"].dict_has_any_keys(["click", "error"]), t["d"].dict_has_all_keys(["click", "view"])
    return t[["user_id", "has_any", "has_all"]].frame()


@query("SELECT c_custkey, c_name[1:8] AS head, c_name[-3:] AS tail, reverse(c_name) AS back FROM customer")
def subslice_text(spark, sf):
    t = _t(spark, sf, "customer")
    t["head"], t["tail"], t["back"] = t["c_name"].subslice(0, 8), t["c_name"].subslice(-3), t["c_name"].subslice(step=-1)
    return t[["c_custkey", "head", "tail", "back"]].frame()


@query("SELECT vec_id, len(embedding) AS n FROM embeddings")
def item_length(spark, sf):
    t = _t(spark, sf, "embeddings")
    t["n"] = t["embedding"].item_length()
    return t[["vec_id", "n"]].frame()


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE * 2 + 1)), 6) AS total FROM embeddings")
def vector_arith(spark, sf):
    t = _t(spark, sf, "embeddings")
    v = t["embedding"] * t["embedding"] * 2 + 1
    return t.rows.df.select("vec_id", F.round(F.aggregate(v.expr, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding[3:6], lambda x: x::DOUBLE)), 6) AS total, embedding[8]::DOUBLE AS one FROM embeddings")
def vector_slice(spark, sf):
    t = _t(spark, sf, "embeddings")
    t["part"], t["one"] = t["embedding"].vector_slice(2, 6), t["embedding"].vector_slice(7)
    return t.frame().select("vec_id", F.round(F.aggregate("part", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), "one")


@query("SELECT event_id, value * 2 + 1 AS y, user_id::VARCHAR || ':' || event_type AS tag FROM events")
def apply_udf(spark, sf):
    t = _events(spark, sf)
    t["y"] = t["value"].apply(lambda x: x * 2 + 1, float)
    t["tag"] = t[["user_id", "event_type"]].apply(lambda r: f"{r['user_id']}:{r['event_type']}", str)
    return t[["event_id", "y", "tag"]].frame()


# sources and sinks -------------------------------------------------------------------------------
def _through_files(spark: SparkSession, write: Callable[[str], None], read: Callable[[str], Table]) -> DataFrame:
    """What read gives of what write has put into a shared folder, which then goes."""
    path = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    write(path)
    out = cut(read(path).frame())
    delete(spark, path)
    return out


@query("SELECT range AS i, range % 3 AS m, 'x' AS c FROM range(5, 105)")
def sequence_const(spark, sf):
    i = Col.from_sequence(spark, 5, 105)
    t = i.to_table("i")
    t["m"] = i % 3
    t["c"] = Col.from_const(spark, "x", 100)
    return t.frame()


@query("SELECT epoch_us(t) AS us FROM (SELECT unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02 00:00:01', INTERVAL 3600 SECOND)) AS t)")
def date_range(spark, sf):
    utc = dt.timezone.utc
    return Col.date_range(spark, dt.datetime(2024, 1, 1, tzinfo=utc), dt.datetime(2024, 1, 2, tzinfo=utc), 3600).to_table("t").frame().select(F.unix_micros("t").alias("us"))


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT 0, 'c_name', 0.0, 'c_mktsegment'")
def csv_roundtrip(spark, sf):
    """The line above the header is that of a row too, which isn't skipped where it comes again."""
    t = _t(spark, sf, "customer", "c_custkey")[["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]]
    again = Table.of(spark, [{"c_custkey": 0, "c_name": "c_name", "c_acctbal": 0.0, "c_mktsegment": "c_mktsegment"}])
    t = t.append(again)
    return _through_files(spark, lambda path: t.export_csv(path, file_header='0,"c_name",0.0,"c_mktsegment"'), lambda path: readers.read_csv(spark, path, skiprows=1, column_type_hints={"c_acctbal": float}))


@query("SELECT 'row' AS what, l_orderkey AS k, l_linenumber::BIGINT AS n FROM lineitem WHERE l_returnflag <> 'N' UNION ALL SELECT 'line', l_orderkey, NULL FROM lineitem WHERE l_returnflag = 'N'")
def csv_with_errors(spark, sf):
    """Lines of one kind have a word where a number belongs."""
    t = _t(spark, sf, "lineitem")
    t["n"] = Col(t.rows, F.when(F.col("l_returnflag") == "N", "none").otherwise(F.col("l_linenumber").cast("string")), t["l_returnflag"].kind)
    t = t[["l_orderkey", "n"]].rename({"l_orderkey": "k"})
    path = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    t.export_csv(path, quote_level=3)
    good, bad = readers.read_csv_with_errors(spark, path, column_type_hints={"k": int, "n": int})
    out = good.frame().select(F.lit("row").alias("what"), "k", "n")
    for lines in bad.values():
        out = out.unionByName(lines.frame("line").select(F.lit("line").alias("what"), F.split("line", ",")[0].cast("long").alias("k"), F.lit(None).cast("long").alias("n")))
    out = cut(out)
    delete(spark, path)
    return out


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def json_lines(spark, sf):
    t = _t(spark, sf, "nation", "n_nationkey")[["n_nationkey", "n_name"]]
    return _through_files(spark, lambda path: t.export_json(path, "lines"), lambda path: readers.read_json(spark, path, "lines"))


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place, o_orderkey FROM orders")
def save_load(spark, sf):
    t = _t(spark, sf, "orders").sort([("o_totalprice", False), ("o_orderkey", True)])[["o_orderkey"]]
    return _through_files(spark, t.save, lambda path: readers.load_table(spark, path).add_row_number("place"))


@query("SELECT p_partkey, p_name, p_retailprice * 2 AS twice FROM part")
def sql_roundtrip(spark, sf):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE p (p_partkey INTEGER, p_name TEXT, p_retailprice REAL)")
    _t(spark, sf, "part", "p_partkey")[["p_partkey", "p_name", "p_retailprice"]].to_sql(db, "p")
    return readers.from_sql(spark, db, "SELECT p_partkey, p_name, p_retailprice * ? AS twice FROM p", (2,)).frame()


@query("SELECT s_suppkey, s_acctbal * 2 AS twice FROM supplier")
def save_reference(spark, sf):
    t = _t(spark, sf, "supplier", "s_suppkey")
    t["twice"] = t["s_acctbal"] * 2
    return _through_files(spark, t[["s_suppkey", "twice"]].materialize().save_reference, lambda path: readers.load_table(spark, path))


@query("SELECT p_name AS X1 FROM part")
def text_lines(spark, sf):
    t = _t(spark, sf, "part", "p_partkey")
    return _through_files(spark, lambda path: t["p_name"].save(path, "text"), lambda path: readers.read_text(spark, path).to_table())


@query("SELECT range AS i, range * range AS sq FROM range(20)")
def builder_rows(spark, sf):
    b = TableBuilder(spark, [int, int], ["i", "sq"], num_segments=2)
    for i in range(20):
        b.append((i, i * i), segment=i % 2)
    return b.close().frame()


@query("SELECT o_orderpriority AS p, count(*) AS n, 1::BIGINT AS together FROM orders GROUP BY ALL")
def adjacent_keys(spark, sf):
    df = dataflow.adjacent(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderpriority").alias("p")), "p")
    counts = df.withColumn("at", F.spark_partition_id()).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("at").alias("together"))
    return counts


@query("SELECT event_id, value, event_type FROM events")
def json_cells(spark, sf):
    t = _events(spark, sf)
    t["value"] = t["value"].to_json().from_json(float)
    t["event_type"] = t["event_type"].to_json().from_json(str)
    return t[["event_id", "value", "event_type"]].frame()


@query("SELECT vec_id, 60 AS n, list_sum(list_transform(range(0, 60), lambda i: vec_id % 50 + i))::DOUBLE AS total FROM embeddings")
def image_vectors(spark, sf):
    t = _t(spark, sf, "embeddings")
    pixels = Col(t.rows, F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: (F.col("vec_id") % 50 + i).cast("double")), t["embedding"].kind)
    back = pixels.pixel_array_to_image(5, 4, 3).image_to_vector()
    return t.rows.df.select("vec_id", F.size(back.expr).alias("n"), F.aggregate(back.expr, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events) GROUP BY ALL")
def group_tables(spark, sf):
    groups = _events(spark, sf).group("event_type")
    return Table.of(spark, [{"event_type": k, "n": g.num_rows(), "users": len(g["user_id"].unique())} for (k,), g in groups]).frame()


# graphs ---------------------------------------------------------------------------------------------
def _orders_graph(spark, sf) -> Graph:
    """Customers and nations: an edge from each customer to its nation, and from nation to region plus 1000."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("__src_id"), (F.col("c_nationkey") + 1_000_000).cast("long").alias("__dst_id"), F.col("c_acctbal").alias("w"))
    n = spark.read.parquet(f"{sf}/nation.parquet").select((F.col("n_nationkey") + 1_000_000).cast("long").alias("__src_id"), (F.col("n_regionkey") + 2_000_000).cast("long").alias("__dst_id"), F.lit(1.0).alias("w"))
    return Graph(spark, edges=c.union(n))


_EDGES = "edges AS (SELECT c_custkey AS s, c_nationkey + 1000000 AS d, c_acctbal AS w FROM customer UNION ALL SELECT n_nationkey + 1000000, n_regionkey + 2000000, 1.0 FROM nation), ids AS (SELECT s AS id FROM edges UNION SELECT d FROM edges)"


@query(f"WITH {_EDGES} SELECT id, (SELECT count(*) FROM edges WHERE d = id) AS in_degree, (SELECT count(*) FROM edges WHERE s = id) AS out_degree FROM ids")
def graph_degrees(spark, sf):
    return _orders_graph(spark, sf).degrees().withColumnRenamed("__id", "id")


@query(f"WITH {_EDGES}, one AS (SELECT 1000003 AS id UNION SELECT s FROM edges WHERE d = 1000003 UNION SELECT d FROM edges WHERE s = 1000003), two AS (SELECT id FROM one UNION SELECT s FROM edges JOIN one ON d = id UNION SELECT d FROM edges JOIN one ON s = id) SELECT s AS src, d::BIGINT AS dst FROM edges WHERE s IN (SELECT id FROM two) AND d IN (SELECT id FROM two)")
def graph_neighborhood(spark, sf):
    return _orders_graph(spark, sf).get_neighborhood([1_000_003], radius=2).edges.select(F.col("__src_id").alias("src"), F.col("__dst_id").alias("dst"))


@query(f"WITH {_EDGES} SELECT id, round(coalesce(sum(w), 0), 4) AS got, count(s) AS n FROM ids LEFT JOIN edges ON d = id GROUP BY id")
def graph_triple_gather(spark, sf):
    g = _orders_graph(spark, sf).gather({"got": F.sum("edge.w"), "n": F.count("nbr.__id")}, "in", {"got": 0.0, "n": 0})
    return g.vertices.select(F.col("__id").alias("id"), F.round("got", 4).alias("got"), F.col("n").cast("long").alias("n"))


@query("WITH e AS (SELECT n_nationkey AS s, n_regionkey + 100 AS d FROM nation) SELECT id::BIGINT AS id, count(*) AS touched FROM (SELECT s AS id FROM e UNION ALL SELECT d FROM e) GROUP BY id")
def graph_triple_apply(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("__src_id"), (F.col("n_regionkey") + 100).cast("long").alias("__dst_id"))

    def touch(source, edge, target):
        source["touched"] += 1
        target["touched"] += 1
        return source, edge, target

    g = Graph(spark, edges=n).add_vertex_field("touched", 0).triple_apply(touch, ["touched"])
    return g.vertices.select(F.col("__id").alias("id"), "touched")


@query(f"""
WITH {_EDGES}, outs AS (SELECT s, count(*) AS n FROM edges GROUP BY s),
r1 AS (SELECT id, 0.15 + 0.85 * coalesce((SELECT sum(1.0 / n) FROM edges JOIN outs USING (s) WHERE d = id), 0) AS r FROM ids),
r2 AS (SELECT ids.id, 0.15 + 0.85 * coalesce(sum(r1.r / n), 0) AS r FROM ids LEFT JOIN edges ON d = ids.id LEFT JOIN outs USING (s) LEFT JOIN r1 ON r1.id = s GROUP BY ids.id)
SELECT id, round(r, 6) AS rank FROM r2""")
def graph_pagerank(spark, sf):
    return _orders_graph(spark, sf).pagerank(2).select(F.col("__id").alias("id"), F.round("rank", 6).alias("rank"))


@query(f"WITH {_EDGES} SELECT 'v' AS what, id AS a, NULL::BIGINT AS b FROM ids WHERE id > 1000000 UNION ALL SELECT 'e', s, d FROM edges WHERE d = 1000003 OR (s = 1000005 AND d = (SELECT n_regionkey + 2000000 FROM nation WHERE n_nationkey = 5))")
def graph_select(spark, sf):
    """Vertices by a field, edges by one or both ends."""
    g = _orders_graph(spark, sf).add_vertex_field("place", (F.col("__id") > 1_000_000).cast("int"))
    region = spark.read.parquet(f"{sf}/nation.parquet").where("n_nationkey = 5").first().n_regionkey + 2_000_000
    e = g.get_edges(src_ids=[None, 1_000_005], dst_ids=[1_000_003, region])
    v = g.get_vertices(fields={"place": 1})
    return v.select(F.lit("v").alias("what"), F.col("__id").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(e.select(F.lit("e").alias("what"), F.col("__src_id").alias("a"), F.col("__dst_id").alias("b")))


@query(f"WITH {_EDGES} SELECT s AS src, d::BIGINT AS dst, w * 2 AS weight, 'edge' AS kind FROM edges")
def graph_fields(spark, sf):
    g = _orders_graph(spark, sf).edge_apply("w", F.col("w") * 2).add_edge_field("kind", "edge").rename_edge_fields({"w": "weight"}).add_edge_field("gone", 1).remove_edge_field("gone").swap_edge_fields("weight", "kind")
    g = g.vertex_apply("x", F.col("__id") + 1).rename_vertex_fields({"x": "y"}).select_fields(["weight", "kind"])
    if g.get_fields() != ["__id", "__src_id", "__dst_id", "kind", "weight"] or g.get_vertex_fields() != ["__id"] or len(g.get_edge_fields()) != 4:
        raise ValueError("fields differ")
    return g.edges.select(F.col("__src_id").alias("src"), F.col("__dst_id").alias("dst"), "weight", "kind")


@query(f"WITH {_EDGES} SELECT id, (SELECT count(*) FROM edges WHERE d = id OR s = id) AS deg, (SELECT count(*) FROM ids) AS vertices, (SELECT count(*) FROM edges) AS edges FROM ids")
def graph_send(spark, sf):
    """A triple-wise update that adds up at both ends."""
    g = _orders_graph(spark, sf)
    summary = g.summary()
    out = g.add_vertex_field("deg", F.lit(0).cast("long")).send({"deg": F.lit(1)}, {"deg": F.lit(1)}).vertices
    return out.select(F.col("__id").alias("id"), "deg", F.lit(summary["num_vertices"]).cast("long").alias("vertices"), F.lit(summary["num_edges"]).cast("long").alias("edges"))


@query(f"WITH {_EDGES} SELECT s AS src, d::BIGINT AS dst, (s + d)::BIGINT AS both_ends, w + 1 AS w FROM edges")
def graph_map_edges(spark, sf):
    g = _orders_graph(spark, sf).map_edges({"both_ends": F.col("source.__id") + F.col("target.__id"), "w": F.col("edge.w") + 1})
    return g.edges.select(F.col("__src_id").alias("src"), F.col("__dst_id").alias("dst"), "both_ends", "w")


@query("SELECT id, min(id) OVER (PARTITION BY r) AS component FROM (SELECT c_custkey AS id, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT n_nationkey + 1000000, n_regionkey FROM nation UNION SELECT n_regionkey + 2000000, n_regionkey FROM nation)")
def graph_components(spark, sf):
    """A region's nations and their customers hang together."""
    return components(cut(_orders_graph(spark, sf).edges.select("__src_id", "__dst_id"))).select(F.col("node").alias("id"), F.col("root").alias("component"))


@query("SELECT f.format, e.s AS src, e.d AS dst, e.w FROM (SELECT unnest(['binary', 'csv', 'json']) AS format) f, (SELECT c_name AS s, 'nation ' || c_nationkey AS d, c_acctbal AS w FROM customer) e")
def graph_save_load(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_name").alias("__src_id"), F.concat(F.lit("nation "), F.col("c_nationkey")).alias("__dst_id"), F.col("c_acctbal").alias("w"))
    g, out = Graph(spark, edges=c), None
    for format in ("binary", "csv", "json"):
        path = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
        g.save(path, format)
        back = Graph.load(spark, path, format)
        if back.get_vertices().count() != g.get_vertices().count():
            raise ValueError("vertices differ")
        part = cut(back.edges.select(F.lit(format).alias("format"), F.col("__src_id").alias("src"), F.col("__dst_id").alias("dst"), "w"))
        out = part if out is None else out.unionByName(part)
        delete(spark, path)
    return out


# sketches ------------------------------------------------------------------------------------------
@query("SELECT count(*) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS m, round(stddev_pop(value), 6) AS sd, 1::BIGINT AS median_near FROM events")
def sketch_numeric(spark, sf):
    t = _events(spark, sf)
    s = t["value"].sketch_summary()
    below = t[t["value"] <= s.quantile(0.5)].num_rows() / s.size()
    return Table.of(spark, {"n": [s.size()], "lo": [s.min()], "hi": [s.max()], "m": [round(s.mean(), 6)], "sd": [round(s.std(), 6)], "median_near": [int(abs(below - 0.5) < 0.005)]}).frame()


@query("SELECT 1::BIGINT AS near FROM (SELECT count(DISTINCT l_partkey) AS n FROM lineitem)")
def sketch_unique(spark, sf):
    t = _t(spark, sf, "lineitem")
    exact = len(t["l_partkey"].unique())
    return Table.of(spark, {"near": [int(abs(t["l_partkey"].sketch_summary().num_unique() - exact) <= 0.02 * exact)]}).frame()


@query("SELECT event_type AS item, count(*) AS n FROM events GROUP BY ALL")
def sketch_frequent(spark, sf):
    found = _events(spark, sf)["event_type"].sketch_summary().frequent_items()
    return Table.of(spark, {"item": list(found), "n": list(found.values())}).frame()


@query("""
WITH c AS (SELECT user_id, event_type AS k, count(*) AS n FROM events GROUP BY ALL), d AS (SELECT user_id, count(*) AS keys FROM c GROUP BY ALL)
SELECT (SELECT max(keys) FROM d) AS longest, (SELECT count(*) FROM c) AS entries, (SELECT sum(n) FROM c)::BIGINT AS total, (SELECT count(*) FROM c WHERE k = 'view') AS views, (SELECT max(n) FROM c WHERE k = 'click') AS most_clicks""")
def sketch_dicts(spark, sf):
    s = _counts(spark, sf)["d"].sketch_summary(sub_sketch_keys=["click"])
    keys, values = s.dict_key_summary(), s.dict_value_summary()
    return Table.of(spark, [{"longest": s.element_length_summary().max(), "entries": keys.size(), "total": values.sum(), "views": keys.frequency_count("view"), "most_clicks": s.element_sub_sketch()["click"].max()}]).frame()


@query("SELECT count(*) * len(any_value(embedding)) AS n, round(min(list_min(embedding))::DOUBLE, 6) AS lo, round(max(embedding[3])::DOUBLE, 6) AS third FROM embeddings")
def sketch_vectors(spark, sf):
    s = _t(spark, sf, "embeddings")["embedding"].sketch_summary(background=True)
    elements = s.element_summary()
    if s.num_undefined() or not s.sketch_ready() or s.num_elements_processed() != s.size():
        raise ValueError("the sketch is done once it answers")
    return Table.of(spark, [{"n": elements.size(), "lo": round(elements.min(), 6), "third": round(s.element_sub_sketch([2])[2].max(), 6)}]).frame()


@query("SELECT event_type AS item, count(*) AS n, 1::BIGINT AS near FROM events GROUP BY ALL")
def sketch_count_min(spark, sf):
    """Estimates are never below the counts, and above by a small share of all rows at most."""
    t = _events(spark, sf)
    sketch, n = CountMin(t["event_type"]), t.num_rows()
    exact = t["event_type"].sketch_summary().frequent_items()
    return Table.of(spark, [{"item": k, "n": c, "near": int(c <= sketch.estimate(k) <= c + 0.01 * n)} for k, c in exact.items()]).frame()

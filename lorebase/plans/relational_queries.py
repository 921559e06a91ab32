"""Relational breadth on the generic tables: joins, groupings, windows, sets, sketches, event-time windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import activity as A
from .base import query, table


@query("rel_semi", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 100000)")
def rel_semi(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 100000")
    c = table(spark, d, "customer")
    return c.join(big, c.c_custkey == big.o_custkey, "left_semi").select("c_custkey")


@query("rel_anti", "select item_id from items where item_id is not null and item_id not in (select item_id from sale_lines where item_id is not null and flag <> 'kept')")
def rel_anti(spark, d):
    """Items of which no line was sent back or changed."""
    i, lines = table(spark, d, "items").where("item_id is not null"), table(spark, d, "sale_lines").where("flag <> 'kept'")
    return i.select("item_id").join(lines.select("item_id"), "item_id", "left_anti")


@query("rel_full_outer", "select coalesce(a.k, b.k) k, a.n customers, b.n suppliers from (select c_nationkey k, count(*) n from customer where c_nationkey < 15 group by 1) a full join (select s_nationkey k, count(*) n from supplier where s_nationkey > 5 group by 1) b on a.k = b.k")
def rel_full_outer(spark, d):
    a = table(spark, d, "customer").where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, d, "supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full")


@query("rel_revenue_by_nation", "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where o_orderdate >= timestamp '1995-01-01' group by n_name")
def rel_revenue_by_nation(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.join(table(spark, d, "region").select("r_regionkey"), F.col("n_regionkey") == F.col("r_regionkey"))
    return lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@query("rel_pricing_summary", "select l_returnflag, l_linestatus, sum(l_quantity) sum_qty, round(sum(l_extendedprice), 2) sum_price, round(avg(l_discount), 6) avg_disc, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def rel_pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


_BANDS = "(values (0.0, 50000.0, 'low'), (50000.0, 150000.0, 'mid'), (150000.0, 1e12, 'high'))"


@query("rel_range_join", f"select band, count(*) n from orders join {_BANDS} b(lo, hi, band) on o_totalprice >= lo and o_totalprice < hi group by band")
def rel_range_join(spark, d):
    bands = spark.createDataFrame([(0.0, 50000.0, "low"), (50000.0, 150000.0, "mid"), (150000.0, 1e12, "high")], "lo double, hi double, band string")
    return table(spark, d, "orders").join(F.broadcast(bands), (F.col("o_totalprice") >= F.col("lo")) & (F.col("o_totalprice") < F.col("hi"))).groupBy("band").agg(F.count("*").alias("n"))


@query(
    "rel_as_of",
    "select e.event_id, p.value last_purchase from (select * from events where event_type = 'click') e asof left join (select user_id, ts, max(value) as value from events where event_type = 'purchase' group by all) p on e.user_id = p.user_id and e.ts >= p.ts",
)
def rel_as_of(spark, d):
    e = table(spark, d, "events")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    return A.as_of_join(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


@query("rel_rollup", "select l_returnflag, l_linestatus, count(*) n from lineitem group by rollup (l_returnflag, l_linestatus)")
def rel_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("rel_cube", "select l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) g, count(*) n from lineitem group by cube (l_returnflag, l_linestatus)")
def rel_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))


@query("rel_grouping_sets", "select o_orderstatus, o_orderpriority, count(*) n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ()) having count(*) > 10")
def rel_grouping_sets(spark, d):
    o = table(spark, d, "orders")
    out = o.groupingSets([[o.o_orderstatus], [o.o_orderpriority], []], o.o_orderstatus, o.o_orderpriority).agg(F.count("*").alias("n"))
    return out.where("n > 10")


@query("rel_rank_family", "select c_custkey, rank() over w::int rk, dense_rank() over w::int dr, ntile(4) over w::int nt, round(percent_rank() over w, 9) pr, round(cume_dist() over w, 9) cd from customer window w as (partition by c_nationkey order by round(c_acctbal, -2) desc, c_custkey)")
def rel_rank_family(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.round("c_acctbal", -2).desc(), "c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(w).alias("nt"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"))


@query("rel_running", "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) s from orders")
def rel_running(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("s"))


@query("rel_intersect", "select c_nationkey k from customer intersect select s_nationkey from supplier")
def rel_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("rel_except", "select p_partkey k from part except select l_partkey from lineitem where l_quantity > 45")
def rel_except(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("rel_distinct_agg", "select l_returnflag, count(distinct l_suppkey) suppliers, count(distinct l_partkey) parts from lineitem group by all")
def rel_distinct_agg(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))


@query("rel_approx")
def rel_approx(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_suppkey").alias("suppliers"), F.percentile_approx("l_quantity", 0.5).alias("median"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("parts"))


@query("rel_tumbling", "select time_bucket(interval 1 hour, ts) start, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def rel_tumbling(spark, d):
    out = table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query(
    "rel_sessions",
    """with e as (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 2 hour, true) new from events),
s as (select *, sum(new::int) over (partition by user_id order by ts rows unbounded preceding) k from e)
select user_id, min(ts) start, count(*) n from s group by user_id, k""",
)
def rel_sessions(spark, d):
    out = table(spark, d, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")

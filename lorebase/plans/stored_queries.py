"""Queries on stored tables: change logs, rebuilds, bulk changes and cascades, each published at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised
from ..sources.snapshots import Store
from .base import query, table

_STATE = ["client_id", "source", "segment", "city", "balance"]


def changed_clients(spark, d: str) -> Store:
    """The clients that a log of inserts, updates and deletes leaves, applied month by month to a stored table."""
    log = materialised(table(spark, d, "client_changes").where("client_id is not null and valid_at is not null").withColumn("month", F.month("valid_at")))
    last = Window.partitionBy("client_id").orderBy(F.desc("valid_at"), F.desc("seq"), F.desc("change_id"))
    store = Store.fresh(spark, "clients")
    for month in range(1, 13):
        batch = log.where(F.col("month") == month).withColumn("_k", F.row_number().over(last)).where("_k = 1")
        change = store.begin()
        if "clients" in change.base.tables:
            change.delete("clients", batch.select("client_id"))
        change.append("clients", batch.where("op is null or op <> 'D'").select(*_STATE)).commit(batch=("months", month))
    return store


_LATEST = """select client_id, source, segment, city, balance from (select *, row_number() over (partition by client_id order by valid_at desc, seq desc, change_id desc) k
from client_changes where client_id is not null and valid_at is not null) where k = 1 and (op is null or op <> 'D')"""


@query("stored_changes", _LATEST)
def stored_changes(spark, d):
    """Read with a year's deletions merged in."""
    return changed_clients(spark, d).read("clients")


@query("stored_compacted", _LATEST)
def stored_compacted(spark, d):
    """The same rows from one folder."""
    store = changed_clients(spark, d)
    store.compact("clients")
    return store.read("clients")


@query(
    "stored_rebuild",
    """with bad as (select distinct source from documents join labels using (doc_id) where toxic = 1), low as (select doc_id from documents join labels using (doc_id) join bad using (source) where quality = 0),
d as (select * from documents where doc_id not in (select doc_id from low)), v as (select * from embeddings where vec_id not in (select doc_id from low))
select 'chunks' as part, source as book, count(*) as n from d group by source union all select 'vectors', source, count(*) from v join documents on doc_id = vec_id group by source""",
)
def stored_rebuild(spark, d):
    """Books with a toxic chunk are built anew without chunks of low quality; chunks and vectors change in one commit."""
    docs, labels = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels")
    vectors = table(spark, d, "embeddings").join(docs.withColumnRenamed("doc_id", "vec_id"), "vec_id").select("vec_id", "source")
    store = Store.fresh(spark, "books")
    store.begin().append("chunks", docs).append("vectors", vectors).commit()
    change = store.begin()
    chunks = change.base.read("chunks")
    bad = materialised(chunks.join(labels.where("toxic = 1"), "doc_id").select("source").distinct())
    low = labels.where("quality = 0").select("doc_id").distinct()
    again = chunks.join(bad, "source", "left_semi").join(low, "doc_id", "left_anti")
    change.reads("chunks", "vectors").replace_parts("chunks", again, "source", rebuilt=bad)
    gone = chunks.join(bad, "source", "left_semi").join(low, "doc_id", "left_semi")
    change.delete("vectors", gone.select(F.col("doc_id").alias("vec_id"))).commit()
    now = store.snapshot()
    count = lambda name: now.read(name).groupBy(F.lit(name).alias("part"), F.col("source").alias("book")).agg(F.count("*").alias("n"))
    return count("chunks").union(count("vectors"))


@query("stored_status", "select sale_id, status, total, case when status = 'open' and total < 50 then 'stale' else status end as now from (select distinct sale_id, status, total from sales where sale_id is not null)")
def stored_status(spark, d):
    """A bulk change of status by the rows' own values, beside the status before."""
    rows = table(spark, d, "sales").where("sale_id is not null").select("sale_id", "status", "total").distinct()
    store = Store.fresh(spark, "sales")
    before = store.begin().append("sales", rows.withColumn("now", F.col("status"))).commit()
    change = store.begin().reads("sales")
    stale = change.base.read("sales").where("status = 'open' and total < 50")
    change.delete("sales", stale.select("sale_id", "status", "total")).append("sales", stale.withColumn("now", F.lit("stale"))).commit()
    assert store.snapshot().version == before + 1
    return store.read("sales")


_GONE = "with gone as (select distinct client_id from clients where balance < 0 and client_id is not null), s as (select * from sales where client_id is null or client_id not in (select client_id from gone)), gs as (select distinct sale_id from sales where client_id in (select client_id from gone) and sale_id is not null)"


@query(
    "stored_cascade",
    f"""{_GONE} select 'clients' as part, count(*) as n, round(sum(balance), 2) as amount from clients where client_id is null or client_id not in (select client_id from gone)
union all select 'sales', count(*), round(sum(total), 2) from s union all select 'sale_lines', count(*), round(sum(amount), 2) from sale_lines where sale_id is null or sale_id not in (select sale_id from gs)""",
)
def stored_cascade(spark, d):
    """Clients in debt go, with their sales and the lines of these, in one commit."""
    store, change = Store.fresh(spark, "shop"), None
    kept = {"clients": ("client_id", "balance"), "sales": ("sale_id", "client_id", "total"), "sale_lines": ("sale_id", "amount")}
    change = store.begin()
    for name, columns in kept.items():
        change.append(name, table(spark, d, name).select(*columns))
    change.commit()
    change = store.begin().reads(*kept)
    gone = materialised(change.base.read("clients").where("balance < 0").select("client_id").distinct())
    sales = change.base.read("sales").join(gone, "client_id", "left_semi").select("sale_id")
    change.cascade(gone, {"clients": "client_id", "sales": "client_id"}).cascade(sales, {"sale_lines": "sale_id"}).commit()
    now = store.snapshot()

    def part(name: str, amount: str) -> DataFrame:
        return now.read(name).agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.round(F.sum(amount), 2).alias("amount"))

    return part("clients", "balance").union(part("sales", "total")).union(part("sale_lines", "amount"))

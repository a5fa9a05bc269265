"""Queries of sources and of SQL passed through."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import sql
from .registry import query, table


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 4) as quantity, round(avg(l_discount), 6) as discount from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def sql_passthrough(spark, sf_dir):
    return sql(
        spark,
        sf_dir,
        "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS quantity, round(avg(l_discount), 6) AS discount FROM {lineitem} WHERE l_shipdate <= :until GROUP BY ALL",
        until="1998-09-02",
    )


@query("select n_name, r_name, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def sql_join(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY ALL")


@query("select doc_id, text from documents where doc_id = (select min(doc_id) from documents where lang = 'es')")
def sql_fetch_one(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT doc_id, text FROM {documents} WHERE lang = :lang ORDER BY doc_id LIMIT 1", lang="es")


@query("select lang, count(*) as n from documents where n_chars >= 1000 group by lang")
def count_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("n_chars >= 1000").groupBy("lang").agg(F.count("*").alias("n"))

"""Feature-set joins."""

from pyspark.sql import functions as F

from ..operators.featuresets import join_featuresets, transform_featureset
from ..plans.skew import SkewPolicy
from ..sources import load_featuresets
from .base import query


def _band(balance):
    return F.floor(F.col(balance) / 10).cast("bigint")


def _customer_cells(t):
    return t("customer").groupBy(F.col("c_nationkey").alias("nation"), _band("c_acctbal").alias("band")).agg(
        F.struct(F.count("*").alias("n.rows"), F.round(F.sum("c_acctbal"), 2).alias("balance.sum")).alias("stats"))


def _supplier_cells(t):
    return t("supplier").groupBy(F.col("s_nationkey").alias("nation"), _band("s_acctbal").alias("band")).agg(
        F.struct(F.struct(F.count("*").alias("rows"), F.round(F.max("s_acctbal"), 2).alias("best")).alias("all"))
        .alias("stats"))


def _nations(t):
    return t("nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"), "n_name")


@query("featureset_outer", """
WITH c AS (SELECT c_nationkey AS nation, CAST(floor(c_acctbal / 10) AS BIGINT) AS band, count(*) AS n,
             round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1, 2),
     s AS (SELECT s_nationkey AS nation, CAST(floor(s_acctbal / 10) AS BIGINT) AS band, count(*) AS n,
             round(max(s_acctbal), 2) AS best FROM supplier GROUP BY 1, 2),
     x AS (SELECT nation, band, c.n AS cn, c.total, s.n AS sn, s.best FROM c FULL JOIN s USING (nation, band))
SELECT nation, band, coalesce(cn, 0) AS "feature.customer@stats.n.rows",
  coalesce(total, 0.0) AS "feature.customer@stats.balance.sum",
  coalesce(sn, 0) AS "feature.supplier@stats.all.rows", best AS "feature.supplier@stats.all.best",
  n_regionkey AS "feature.nation@region", n_name AS "feature.nation@n_name"
FROM x FULL JOIN (SELECT n_nationkey AS nation, n_regionkey, n_name FROM nation) USING (nation)""")
def featureset_outer(t):
    return join_featuresets(
        {"customer": _customer_cells(t), "supplier": _supplier_cells(t), "nation": _nations(t)},
        {"customer": {"stats": ["n.rows", "balance.sum"]}, "supplier": {"stats": {"all": ["rows", "best"]}},
         "nation": ["region", "n_name"]},
        ["nation", "band"],
        fill_values={"feature.customer@stats.n.rows": 0, "feature.customer@stats.balance.sum": 0.0,
                     "feature.supplier@stats.all.rows": 0})


#: Splits whatever can be split, at any size.
_EVERYTHING_HOT = SkewPolicy(hot_rows=2, sample=1.0)


_BY_STATUS = {"finished": "F", "open": "O", "pending": "P"}
_SAMEKEY_SPEC = {name: ["orders", "total"] for name in _BY_STATUS}
_SAMEKEY_SQL = """
WITH f AS (SELECT o_custkey AS cust, count(*) AS n, round(sum(o_totalprice), 2) AS total
           FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
     o AS (SELECT o_custkey AS cust, count(*) AS n, round(sum(o_totalprice), 2) AS total
           FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
     p AS (SELECT o_custkey AS cust, count(*) AS n, round(sum(o_totalprice), 2) AS total
           FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT cust, f.n AS "feature.finished@orders", f.total AS "feature.finished@total",
  o.n AS "feature.open@orders", o.total AS "feature.open@total",
  p.n AS "feature.pending@orders", p.total AS "feature.pending@total"
FROM f FULL JOIN o USING (cust) FULL JOIN p USING (cust)"""


def _orders_by_status(t):
    return {name: t("orders").where(F.col("o_orderstatus") == status)
            .groupBy(F.col("o_custkey").alias("cust"))
            .agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
            for name, status in _BY_STATUS.items()}


@query("featureset_samekey", _SAMEKEY_SQL)
def featureset_samekey(t):
    return join_featuresets(_orders_by_status(t), _SAMEKEY_SPEC, ["cust"])


@query("featureset_samekey_unique", _SAMEKEY_SQL)
def featureset_samekey_unique(t):
    return join_featuresets(_orders_by_status(t), _SAMEKEY_SPEC, ["cust"], unique_keys=True)


@query("featureset_samekey_spine", _SAMEKEY_SQL)
def featureset_samekey_spine(t):
    """The same by left joins onto the distinct customers of all sets."""
    return join_featuresets(_orders_by_status(t), _SAMEKEY_SPEC, ["cust"], spine=True)


_REPEATED_SQL = """
WITH o AS (SELECT o_custkey AS cust, o_orderkey FROM orders),
     e AS (SELECT user_id AS cust, event_id FROM events)
SELECT cust, o_orderkey AS "feature.orders@o_orderkey", event_id AS "feature.events@event_id"
FROM o FULL JOIN e USING (cust)"""


def _repeated_keys(t, **options):
    return join_featuresets(
        {"orders": t("orders").withColumnRenamed("o_custkey", "cust"),
         "events": t("events").withColumnRenamed("user_id", "cust")},
        {"orders": ["o_orderkey"], "events": ["event_id"]}, ["cust"], **options)


@query("featureset_repeated_keys", _REPEATED_SQL)
def featureset_repeated_keys(t):
    """Keys repeat on both sides: rows multiply, as in any join."""
    return _repeated_keys(t)


@query("featureset_repeated_keys_spine", _REPEATED_SQL)
def featureset_repeated_keys_spine(t):
    """The same by left joins onto the distinct customers, hot ones dealt out to parts."""
    return _repeated_keys(t, spine=True, skew=_EVERYTHING_HOT)


_CHAIN_SQL = """
WITH e AS (SELECT user_id AS cust, count(*) AS n FROM events GROUP BY 1),
     o AS (SELECT o_custkey AS cust, o_orderstatus AS kind, count(*) AS n FROM orders GROUP BY 1, 2),
     l AS (SELECT l_linestatus AS kind, count(*) AS n FROM lineitem GROUP BY 1)
SELECT cust, kind, e.n AS "feature.events@n", o.n AS "feature.orders@n", l.n AS "feature.lines@n"
FROM e FULL JOIN o USING (cust) FULL JOIN l USING (kind)"""


def _key_chain(t, **options):
    return join_featuresets(
        {"events": t("events").groupBy(F.col("user_id").alias("cust")).agg(F.count("*").alias("n")),
         "orders": t("orders").groupBy(F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("kind"))
         .agg(F.count("*").alias("n")),
         "lines": t("lineitem").groupBy(F.col("l_linestatus").alias("kind")).agg(F.count("*").alias("n"))},
        {"events": ["n"], "orders": ["n"], "lines": ["n"]}, ["cust", "kind"], **options)


@query("featureset_key_chain", _CHAIN_SQL)
def featureset_key_chain(t):
    """Groups {cust}, {cust, kind} and {kind}: each step joins on what both sides have."""
    return _key_chain(t)


@query("featureset_key_chain_spine", _CHAIN_SQL)
def featureset_key_chain_spine(t):
    """The same, each step by left joins onto the keys of both sides."""
    return _key_chain(t, spine=True)


# sets with the same keys meet first, by a full outer join; the result goes onto the customers
_INITIAL_CTE = """
WITH e AS (SELECT user_id AS cust, count(*) AS n, round(max(value), 2) AS top FROM events GROUP BY 1),
     o AS (SELECT o_custkey AS cust, count(*) AS n FROM orders GROUP BY 1),
     c AS (SELECT c_custkey AS cust, c_mktsegment AS segment FROM customer),
     g AS (SELECT cust, e.n AS "feature.events@n", e.top AS "feature.events@top", o.n AS "feature.orders@n"
           FROM e FULL JOIN o USING (cust))
"""
_INITIAL_COLUMNS = """SELECT cust, segment, "feature.events@n", "feature.events@top", "feature.orders@n" """


def _onto_customers(t, how):
    return join_featuresets(
        {"events": t("events").groupBy(F.col("user_id").alias("cust"))
         .agg(F.count("*").alias("n"), F.round(F.max("value"), 2).alias("top")),
         "orders": t("orders").groupBy(F.col("o_custkey").alias("cust")).agg(F.count("*").alias("n"))},
        {"events": ["n", "top"], "orders": ["n"]}, ["cust"], join=how,
        initial_df=t("customer").select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("segment")))


@query("featureset_initial_left", _INITIAL_CTE + _INITIAL_COLUMNS + "FROM c LEFT JOIN g USING (cust)")
def featureset_initial_left(t):
    return _onto_customers(t, "left")


@query("featureset_initial_inner", _INITIAL_CTE + _INITIAL_COLUMNS + "FROM c JOIN g USING (cust)")
def featureset_initial_inner(t):
    return _onto_customers(t, "inner")


@query("featureset_initial_right", _INITIAL_CTE + _INITIAL_COLUMNS + "FROM c RIGHT JOIN g USING (cust)")
def featureset_initial_right(t):
    return _onto_customers(t, "right")


@query("featureset_initial_outer", _INITIAL_CTE + _INITIAL_COLUMNS + "FROM c FULL JOIN g USING (cust)")
def featureset_initial_outer(t):
    return _onto_customers(t, "outer")


@query("featureset_initial_semi", _INITIAL_CTE + "SELECT cust, segment FROM c SEMI JOIN g USING (cust)")
def featureset_initial_semi(t):
    return _onto_customers(t, "left_semi")


@query("featureset_initial_anti", _INITIAL_CTE + "SELECT cust, segment FROM c ANTI JOIN g USING (cust)")
def featureset_initial_anti(t):
    return _onto_customers(t, "left_anti")


@query("featureset_initial_anti_some", """
WITH e AS (SELECT user_id AS cust, count(*) AS n FROM events WHERE event_type = 'error' AND value > 60 GROUP BY 1)
SELECT c_custkey AS cust, c_mktsegment AS segment FROM customer ANTI JOIN e ON c_custkey = cust""")
def featureset_initial_anti_some(t):
    """Customers without a costly error: some stay and some go."""
    costly = t("events").where("event_type = 'error' AND value > 60").groupBy(F.col("user_id").alias("cust")).agg(F.count("*").alias("n"))
    return join_featuresets({"events": costly}, {"events": ["n"]}, ["cust"], join="left_anti",
                            initial_df=t("customer").select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("segment")))


_BROADCAST_SQL = """
WITH s AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1),
     c AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1, 2),
     v AS (SELECT DISTINCT c_mktsegment AS segment FROM customer),
     sv AS (SELECT nation, segment, n FROM s, v)
SELECT nation, segment, sv.n AS "feature.supplier@n", c.n AS "feature.customer@n"
FROM sv FULL JOIN c USING (nation, segment)"""


def _over_segments(t, broadcast_columns):
    return join_featuresets(
        {"supplier": t("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n")),
         "customer": t("customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
         .agg(F.count("*").alias("n"))},
        {"supplier": ["n"], "customer": ["n"]}, ["nation", "segment"], broadcast_columns=broadcast_columns)


@query("featureset_broadcast", _BROADCAST_SQL)
def featureset_broadcast(t):
    return _over_segments(t, {"segment": t("customer").select(F.col("c_mktsegment").alias("segment")).distinct()})


@query("featureset_broadcast_infer", _BROADCAST_SQL)
def featureset_broadcast_infer(t):
    return _over_segments(t, "infer")


@query("featureset_fill_nan", """
WITH a AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'NaN'::DOUBLE ELSE value END AS v FROM events),
     b AS (SELECT l_orderkey AS event_id, max(l_tax) AS w FROM lineitem GROUP BY 1)
SELECT event_id, CASE WHEN v IS NULL OR isnan(v) THEN -1.0 ELSE v END AS "feature.seen@value",
  CASE WHEN w IS NULL OR isnan(w) THEN -2.0 ELSE w END AS "feature.lines@value"
FROM a FULL JOIN b USING (event_id)""")
def featureset_fill_nan(t):
    seen = t("events").withColumn("value", F.when(F.col("event_type") == "error", F.lit(float("nan")))
                                  .otherwise(F.col("value")))
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.max("l_tax").alias("value"))
    return join_featuresets({"seen": seen, "lines": lines}, {"seen": ["value"], "lines": ["value"]}, ["event_id"],
                            fill_values={"feature.seen@value": -1.0, "feature.lines@value": -2.0})


def _written(timestamp):
    return F.date_format(timestamp, "yyyy-MM-dd HH:mm:ss")


@query("featureset_outer_hot", """
WITH e AS (SELECT date_trunc('day', ts) AS day, event_id FROM events),
     o AS (SELECT date_trunc('day', o_orderdate) AS day, o_orderkey FROM orders)
SELECT strftime(day::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS day, event_id AS "feature.events@event_id", o_orderkey AS "feature.orders@o_orderkey"
FROM e FULL JOIN o USING (day)""")
def featureset_outer_hot(t):
    """A full outer join on a timestamp, its repeated keys dealt out to parts."""
    return join_featuresets(
        {"events": t("events").withColumn("day", F.date_trunc("day", "ts")),
         "orders": t("orders").withColumn("day", F.date_trunc("day", "o_orderdate"))},
        {"events": ["event_id"], "orders": ["o_orderkey"]}, ["day"], skew=_EVERYTHING_HOT).withColumn("day", _written("day"))


@query("featureset_key_chain_hot", """
WITH e AS (SELECT user_id AS cust, event_id FROM events),
     o AS (SELECT o_custkey AS cust, o_orderstatus AS kind, o_orderkey FROM orders),
     l AS (SELECT l_linestatus AS kind, count(*) AS n FROM lineitem GROUP BY 1)
SELECT cust, kind, e.event_id AS "feature.events@event_id", o.o_orderkey AS "feature.orders@o_orderkey", l.n AS "feature.lines@n"
FROM e FULL JOIN o USING (cust) FULL JOIN l USING (kind)""")
def featureset_key_chain_hot(t):
    """Key sets that differ, with hot keys in every step."""
    return join_featuresets(
        {"events": t("events").withColumnRenamed("user_id", "cust"),
         "orders": t("orders").withColumnsRenamed({"o_custkey": "cust", "o_orderstatus": "kind"}),
         "lines": t("lineitem").groupBy(F.col("l_linestatus").alias("kind")).agg(F.count("*").alias("n"))},
        {"events": ["event_id"], "orders": ["o_orderkey"], "lines": ["n"]}, ["cust", "kind"], skew=_EVERYTHING_HOT)


@query("featureset_broadcast_many", """
WITH s AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1),
     v AS (SELECT DISTINCT o_orderdate AS day FROM orders),
     o AS (SELECT c_nationkey AS nation, o_orderdate AS day, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
     sv AS (SELECT nation, day, n FROM s, v)
SELECT nation, strftime(day, '%Y-%m-%d %H:%M:%S') AS day, sv.n AS "feature.supplier@n", o.n AS "feature.orders@n" FROM sv FULL JOIN o USING (nation, day)""")
def featureset_broadcast_many(t):
    """Supplier counts repeated over more days than are gathered in one row."""
    per_day = (t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
               .groupBy(F.col("c_nationkey").alias("nation"), F.col("o_orderdate").alias("day")).agg(F.count("*").alias("n")))
    return join_featuresets(
        {"supplier": t("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n")), "orders": per_day},
        {"supplier": ["n"], "orders": ["n"]}, ["nation", "day"],
        broadcast_columns={"day": t("orders").select(F.col("o_orderdate").alias("day")).distinct()}).withColumn("day", _written("day"))


@query("featureset_missing_index", """
SELECT doc_id, lang AS "feature.documents@lang", quality AS "feature.labels@quality"
FROM documents FULL JOIN labels USING (doc_id)""")
def featureset_missing_index(t):
    return join_featuresets({"documents": t("documents"), "labels": t("labels")},
                            {"documents": ["lang"], "labels": ["quality"]}, ["doc_id", "version"])


@query("load_featuresets", """
SELECT doc_id, n_chars AS "feature.documents@n_chars", source AS "feature.documents@source",
  coalesce(quality, -1) AS "feature.labels@quality", coalesce(toxic, -1) AS "feature.labels@toxic"
FROM documents FULL JOIN labels USING (doc_id)""")
def load_from_parquet(t):
    return load_featuresets(
        t.spark, {"documents": t.path("documents"), "labels": t.path("labels")},
        {"documents": ["n_chars", "source"], "labels": ["quality", "toxic"]}, ["doc_id"],
        fill_values={"feature.labels@quality": -1, "feature.labels@toxic": -1})


@query("transform_featureset", """
SELECT l_orderkey, l_linenumber, l_quantity AS "feature.line@pack.amount.qty",
  l_extendedprice AS "feature.line@pack.amount.price.total", l_tax AS "feature.line@pack.tax"
FROM lineitem""")
def transform_lineitem(t):
    packed = t("lineitem").select(
        "l_orderkey", "l_linenumber",
        F.struct(F.struct(F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price.total"),
                          F.col("l_discount").alias("discount")).alias("amount"),
                 F.col("l_tax").alias("tax")).alias("pack"))
    return transform_featureset(packed, "line", {"pack": [{"amount": ["qty", "price.total"]}, "tax"]},
                                ["l_orderkey", "l_linenumber", "absent"])

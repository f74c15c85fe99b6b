"""Scans, projections, predicates, ordering, grouping, set operations and subqueries."""

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import dialect as D
from ..operators import aggregates as A
from ..operators.associations import has_one
from ..operators.request import Request, all_that, any_that, asc_nulls_last, desc, desc_nulls_first
from ..operators.schema import Catalog
from ..sources.sql import SQL, dumped, dumped_tables, name, positional, script
from .catalog import query


@query("SELECT * FROM orders")
def scan_all(db):
    return Request(db, "orders").all().to_df()


@query("SELECT * FROM customer WHERE false")
def scan_none(db):
    return Request(db, "customer").none().all().to_df()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def raw_sql_arguments(db):
    text = SQL("SELECT o_orderkey, o_totalprice FROM {t} WHERE o_orderstatus = :s", {"s": "F"}) + SQL(" AND o_totalprice > :p", {"p": 200000})
    return text.run(db.spark, t=db.df("orders"))


@query("SELECT c_name AS name, c_custkey * 10 + c_nationkey AS code FROM customer")
def project_expressions(db):
    return Request(db, "customer").select(F.col("c_name").alias("name"), (F.col("c_custkey") * 10 + F.col("c_nationkey")).alias("code")).to_df()


@query("SELECT o_orderkey + 1 AS next, o_totalprice * 2 AS twice, upper(o_orderstatus) || '!' AS state FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_totalprice % 1000, o_orderkey LIMIT 60")
def raw_sql_parts(db):
    """Raw SQL, with and without bound values, in the selection, the filter and the order."""
    r = Request(db, "orders").select("o_orderkey + 1 AS next", SQL("o_totalprice * :k AS twice", {"k": 2})).annotated(SQL("upper(o_orderstatus) || :end AS state", {"end": "!"}))
    return r.filter(name("o_orderpriority") + SQL(" IN :wanted", {"wanted": ["1-URGENT", "2-HIGH"]})).order(SQL("o_totalprice % :m", {"m": 1000}), "o_orderkey").limit(60).to_df()


@query("SELECT year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 10")
def group_raw_sql(db):
    return Request(db, "orders").group("year(o_orderdate)").select("first(year(o_orderdate)) AS y", "count(*) AS n").having(SQL("count(*) > :n", {"n": 10})).to_df()


@query("SELECT conv_id, turn, count(*) AS n, max(length(text)) AS longest FROM conversations GROUP BY conv_id, turn")
def group_by_key(db):
    return Request(db, "conversations").group_by_key().select("conv_id", "turn", F.count("*").alias("n"), F.max(F.length("text")).alias("longest")).to_df()


@query("SELECT c_custkey FROM customer")
def project_key(db):
    return Request(db, "customer").select_key().to_df()


@query("SELECT *, s_acctbal * 2 AS twice FROM supplier")
def project_annotated(db):
    return Request(db, "supplier").annotated((F.col("s_acctbal") * 2).alias("twice")).to_df()


@query("SELECT * EXCLUDE (p_name, p_type) FROM part")
def project_excluding(db):
    r = Request(db, "part")
    return r.select(*r.all_columns(excluding=("P_NAME", "p_type"))).to_df()


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def project_distinct(db):
    return Request(db, "lineitem").select("l_returnflag", "l_linestatus").distinct().to_df()


@query("SELECT * FROM orders WHERE o_totalprice > 100000 AND o_orderpriority = '1-URGENT'")
def filters_accumulate(db):
    return Request(db, "orders").filter(F.col("o_totalprice") > 100000).filter("o_orderpriority = '1-URGENT'").to_df()


@query("SELECT * FROM customer WHERE c_custkey IN (1, 5, 42, 1000000)")
def filter_keys(db):
    return Request(db, "customer").filter_key(1, 5, 42, 1000000, None).to_df()


@query("SELECT * FROM conversations WHERE (conv_id = 1 AND turn = 0) OR (conv_id = 2 AND turn = 1)")
def filter_compound_keys(db):
    return Request(db, "conversations").filter_key((1, 0), (2, 1)).to_df()


@query("SELECT * FROM customer WHERE c_name IN (SELECT c_name FROM customer WHERE c_custkey IN (7, 11)) OR c_custkey = 5")
def filter_unique_keys(db):
    names = [r.c_name for r in Request(db, "customer").filter_key(7, 11).fetch_all()]
    return Request(db, "customer").filter_unique(*[{"c_name": n} for n in names], {"c_custkey": 5}).to_df()


@query("SELECT event_id, n IS NULL AS no_value, n IS NOT DISTINCT FROM NULL AS same, n = 'view' AS is_view FROM (SELECT event_id, nullif(event_type, 'click') AS n FROM events)")
def null_comparisons(db):
    n = F.nullif(F.col("event_type"), F.lit("click"))
    return Request(db, "events").select("event_id", n.isNull().alias("no_value"), n.eqNullSafe(F.lit(None)).alias("same"), (n == "view").alias("is_view")).to_df()


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 10 AND p_retailprice >= 920 AND p_retailprice < 980 AND p_size <> 7")
def filter_ranges(db):
    c = F.col
    return Request(db, "part").select("p_partkey").filter(c("p_size").between(5, 10)).filter((c("p_retailprice") >= 920) & (c("p_retailprice") < 980)).filter(c("p_size") != 7).to_df()


@query("SELECT p_partkey, p_type FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_size > 49)")
def filter_in_subquery(db):
    big = Request(db, "part").filter(F.col("p_size") > 49).select("p_type")
    return Request(db, "part").select("p_partkey", "p_type").filter_in("p_type", big).to_df()


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def filter_not_in(db):
    rich = Request(db, "orders").filter("o_totalprice > 150000").select("o_custkey")
    return Request(db, "customer").select("c_custkey").filter_not_in("c_custkey", rich).to_df()


@query("SELECT event_id FROM events WHERE nullif(event_type, 'view') NOT IN (SELECT nullif(event_type, 'error') FROM events WHERE value > 1e12) UNION ALL SELECT event_id + 10000000 FROM events WHERE event_type NOT IN (SELECT nullif(event_type, 'error') FROM events)")
def filter_not_in_nulls(db):
    """Nulls on either side: an empty list passes all rows, a list with a null none."""
    e = Request(db, "events")
    empty = e.filter("value > 1e12").select(F.nullif(F.col("event_type"), F.lit("error")).alias("t"))
    holed = e.select(F.nullif(F.col("event_type"), F.lit("error")).alias("t"))
    one = e.select("event_id").filter_not_in(F.nullif(F.col("event_type"), F.lit("view")), empty)
    return one.union(e.select("event_id + 10000000 AS event_id").filter_not_in("event_type", holed), every=True).to_df()


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
def filter_exists(db):
    big = Request(db, "orders").filter(F.col("o_totalprice") > 250000)
    return Request(db, "customer").select("c_custkey", "c_name").filter_exists(big, lambda c, o: c["c_custkey"] == o["o_custkey"]).to_df()


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) IS FALSE")
def filter_exists_not(db):
    orders = Request(db, "orders")
    r = Request(db, "customer").select("c_custkey").filter_exists(orders, lambda c, o: c["c_custkey"] == o["o_custkey"], negated=True)
    return r.filter_exists(orders.filter("o_totalprice < 0"), negated=True).to_df()


@query("SELECT s_suppkey, l_n FROM supplier JOIN (SELECT l_suppkey, l_linenumber, count(*) AS l_n FROM lineitem GROUP BY ALL) ON l_suppkey = s_suppkey WHERE (s_suppkey, l_linenumber) IN (SELECT l_suppkey, min(l_linenumber) FROM lineitem GROUP BY l_suppkey)")
def filter_in_rows(db):
    """Pairs of values in the rows of a request."""
    lines = Request(db, "lineitem")
    counts = lines.group("l_suppkey", "l_linenumber").select("l_suppkey", "l_linenumber", F.count("*").alias("l_n"))
    least = lines.group("l_suppkey").select("l_suppkey", F.min("l_linenumber").alias("l"))
    return Request(db, "counts", counts.to_df()).filter_in(("l_suppkey", "l_linenumber"), least).select(F.col("l_suppkey").alias("s_suppkey"), "l_n").to_df()


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_suppkey, l_linenumber) IN ((1, 1), (2, 3), (3, 2))")
def filter_row_values(db):
    pair = F.struct(F.col("l_suppkey").cast("long"), F.col("l_linenumber").cast("long"))
    wanted = [F.struct(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in ((1, 1), (2, 3), (3, 2))]
    return Request(db, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").filter(pair.isin(wanted)).to_df()


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%a_1%' OR lower(p_brand) LIKE 'brand#1%'")
def filter_like(db):
    return Request(db, "part").select("p_partkey", "p_name").filter(D.like(F.col("p_name"), "%A_1%") | D.like(F.col("p_brand"), "bRAND#1%")).to_df()


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building' OR lower(c_mktsegment) = 'machinery'")
def filter_collated(db):
    segment = F.collate(F.col("c_mktsegment"), "UTF8_LCASE")
    return Request(db, "customer").select("c_custkey").filter((segment == F.lit("Building")) | (segment == F.lit("machinery"))).to_df()


@query("SELECT event_id FROM events WHERE event_type <> 'view' AND value > 20 AND user_id < 100 OR event_type = 'error' OR user_id = 3")
def filter_many_conditions(db):
    """Any number of conditions, none included."""
    c = F.col
    every = all_that(c("event_type") != "view", c("value") > 20, c("user_id") < 100, all_that())
    return Request(db, "events").select("event_id").filter(any_that(every, c("event_type") == "error", c("user_id") == 3, any_that())).to_df()


@query("SELECT event_id FROM events WHERE (value > 50) = true AND ((event_type = 'view') = false)")
def filter_booleans(db):
    c = F.col
    return Request(db, "events").select("event_id").filter((c("value") > 50) == F.lit(True)).filter((c("event_type") == "view") == F.lit(False)).to_df()


@query("SELECT event_id FROM events WHERE NOT (event_type = 'view' OR (event_type = 'click' AND value > 10))")
def filter_logic(db):
    c = F.col
    return Request(db, "events").select("event_id").filter(~((c("event_type") == "view") | ((c("event_type") == "click") & (c("value") > 10)))).to_df()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def order_limit(db):
    return Request(db, "orders").select("o_orderkey", "o_totalprice").order("o_orderkey").order(desc("o_totalprice"), "o_orderkey").limit(5).limit(25).to_df()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 20")
def limit_holds_after_filters(db):
    return Request(db, "orders").select("o_orderkey").order("o_totalprice", "o_orderkey").limit(10, 20).filter("o_orderstatus = 'O'").to_df()


@query("SELECT doc_id, t FROM (SELECT d.doc_id, l.toxic AS t FROM documents d LEFT JOIN labels l USING (doc_id)) ORDER BY t ASC NULLS LAST, doc_id DESC LIMIT 50")
def order_nulls_last(db):
    df = db.df("documents").join(db.df("labels"), "doc_id", "left").select("doc_id", F.col("toxic").alias("t"))
    return Request(db, "documents", df).order(asc_nulls_last("t"), desc("doc_id")).limit(50).to_df()


@query("SELECT doc_id, t FROM (SELECT d.doc_id, l.toxic AS t FROM documents d LEFT JOIN labels l USING (doc_id)) ORDER BY t DESC NULLS FIRST, doc_id LIMIT 50")
def order_nulls_first(db):
    df = db.df("documents").join(db.df("labels"), "doc_id", "left").select("doc_id", F.col("toxic").alias("t"))
    return Request(db, "documents", df).order(desc_nulls_first("t"), "doc_id").limit(50).to_df()


@query("SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 7")
def order_reversed(db):
    return Request(db, "customer").select("c_custkey").order_by_key().reversed().limit(7).to_df()


@query("SELECT c_nationkey, c_custkey FROM customer ORDER BY c_nationkey, c_custkey LIMIT 30")
def order_stable(db):
    return Request(db, "customer").select("c_nationkey", "c_custkey").order("c_nationkey").stable_order().limit(30).to_df()


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def group_pricing_summary(db):
    c = F.col
    return (
        Request(db, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'").group("l_returnflag", "l_linestatus")
        .select(F.first("l_returnflag").alias("l_returnflag"), F.first("l_linestatus").alias("l_linestatus"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
        .to_df()
    )


@query("SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND max(o_totalprice) > 100000")
def group_having(db):
    return (
        Request(db, "orders").group("o_custkey").select(F.first("o_custkey").alias("o_custkey"), F.count("*").alias("n"), F.max("o_totalprice").alias("most"))
        .having(F.count("*") >= 12).having("max(o_totalprice) > 100000").to_df()
    )


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS s, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def group_aggregates(db):
    return db.df("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT coalesce(sum(value), 0)::DOUBLE AS total, sum(value) AS s, count(*) AS n FROM events WHERE event_type = 'no such type'")
def aggregate_of_nothing(db):
    return db.df("events").filter("event_type = 'no such type'").agg(D.total(F.col("value")).alias("total"), F.sum("value").alias("s"), F.count("*").alias("n"))


@query("SELECT user_id, round(avg(value) FILTER (event_type = 'purchase'), 6) AS bought, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id")
def aggregate_filter(db):
    c = F.col
    return db.df("events").groupBy("user_id").agg(F.round(D.where(F.avg, c("value"), c("event_type") == "purchase"), 6).alias("bought"), D.where(F.count, F.lit(1), c("event_type") == "error").alias("errors"))


@query("SELECT o_custkey, string_agg(o_orderpriority, ';' ORDER BY o_orderkey) AS priorities, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) FILTER (o_totalprice > 100000) AS dear FROM orders GROUP BY o_custkey")
def aggregate_concat(db):
    c = F.col
    text = [A.concatenated(c("o_orderpriority"), c("o_orderkey"), ";").alias("priorities"), A.concatenated(c("o_orderpriority"), where=c("o_totalprice") > 100000).alias("dear")]
    return Request(db, "orders").group("o_custkey").select("o_custkey", *text).to_df()


@query("SELECT user_id, md5(array_to_string(list(event_type ORDER BY ts DESC, event_id DESC), ',')) AS kinds FROM events GROUP BY user_id")
def aggregate_ordered(db):
    kinds = A.ordered_array(F.col("event_type"), F.struct("ts", "event_id"), descending=True)
    return Request(db, "events").group("user_id").select("user_id", F.md5(F.array_join(kinds, ",")).alias("kinds")).to_df()


@query("SELECT true AS distinct_close, true AS median_close")
def aggregate_sketches(db):
    """Sketches against the exact values of the same table, within their errors."""
    rows = db.df("lineitem").select(F.col("l_extendedprice").alias("v"))
    sketch = rows.agg(A.about_distinct(F.col("v"), 0.02).alias("d"), A.about_quantile(F.col("v"), 0.5).alias("m"))
    exact = rows.distinct().agg(F.count("v").alias("e"))
    return A.rank_of(rows, "v", sketch, "m").crossJoin(F.broadcast(exact)).select((F.abs(F.col("d") - F.col("e")) <= 0.1 * F.col("e")).alias("distinct_close"), A.within_shares(0.49, 0.51).alias("median_close"))


@query("SELECT o_custkey, max(o_totalprice) AS most, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS at FROM orders GROUP BY o_custkey")
def aggregate_bare_column(db):
    c = F.col
    return Request(db, "orders").group("o_custkey").select("o_custkey", F.max("o_totalprice").alias("most"), A.of_greatest(c("o_orderkey"), c("o_totalprice"), c("o_orderkey")).alias("at")).to_df()


@query("SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def count_of_distinct(db):
    return Request(db, "lineitem").select("l_partkey", "l_suppkey").distinct().to_df().agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(db):
    return Request(db, "customer").select(F.col("c_nationkey").alias("k")).union(Request(db, "supplier").select("s_nationkey")).to_df()


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def set_union_all(db):
    return Request(db, "customer").select(F.col("c_nationkey").alias("k")).union(Request(db, "supplier").filter("s_acctbal > 0").select("s_nationkey"), every=True).to_df()


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def set_intersect_all(db):
    return Request(db, "customer").select(F.col("c_nationkey").alias("k")).intersect(Request(db, "supplier").select("s_nationkey"), every=True).to_df()


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT o_custkey FROM orders WHERE o_totalprice > 150000")
def set_except_all(db):
    keys = Request(db, "orders").select(F.col("o_custkey").alias("k"))
    return keys.subtract(Request(db, "orders").filter("o_totalprice > 150000").select("o_custkey"), every=True).to_df()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersect(db):
    return Request(db, "customer").select(F.col("c_nationkey").alias("k")).intersect(Request(db, "supplier").filter("s_acctbal > 5000").select("s_nationkey")).to_df()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 150000")
def set_except(db):
    return Request(db, "customer").select(F.col("c_custkey").alias("k")).subtract(Request(db, "orders").filter("o_totalprice > 150000").select("o_custkey")).to_df()


@query("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT c_name, round(t, 2) AS t FROM customer JOIN big ON c_custkey = o_custkey WHERE t > 1000000")
def cte_joined(db):
    totals = Request(db, "orders").group("o_custkey").select("o_custkey", F.sum("o_totalprice").alias("t"))
    customer = Request(db, "customer").with_table("big", totals, ("c_custkey",), ("c_custkey", "t"))
    big = has_one(customer, Request(customer.db, "big"), "c_custkey", key="big").filter("t > 1000000")
    return customer.annotated_with_required(big, "t").select("c_name").to_df().select("c_name", F.round("t", 2).alias("t"))


@query("WITH RECURSIVE days(d) AS (SELECT 0 UNION ALL SELECT d + 1 FROM days WHERE d < 29) SELECT d, count(event_id) AS n FROM days LEFT JOIN events ON date_diff('day', DATE '2024-01-01', ts::DATE) = d GROUP BY d")
def cte_recursive(db):
    text = SQL("WITH RECURSIVE days(d) AS (SELECT 0 UNION ALL SELECT d + 1 FROM days WHERE d < :last) SELECT d, count(event_id) AS n FROM days LEFT JOIN {e} ON datediff(to_date(ts), DATE '2024-01-01') = d GROUP BY d", {"last": 29})
    return text.run(db.spark, e=db.df("events"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def scalar_subquery(db):
    mean = Request(db, "orders").group().select((F.avg("o_totalprice") * 1.5).alias("m"))
    return Request(db, "orders").select("o_orderkey").filter(F.col("o_totalprice") > mean.scalar()).to_df()


@query("SELECT s_suppkey, s_acctbal FROM supplier s WHERE s_acctbal > (SELECT avg(x.s_acctbal) FROM supplier x WHERE x.s_nationkey = s.s_nationkey)")
def correlated_subquery(db):
    others = Request(db, "supplier").aliased("x").filter(F.col("x.s_nationkey") == F.col("s.s_nationkey").outer()).select(F.avg("x.s_acctbal").alias("m"))
    return Request(db, "supplier").aliased("s").select("s_suppkey", "s_acctbal").filter(F.col("s.s_acctbal") > others.scalar()).to_df()


@query("SELECT o_orderkey || ',''' || o_orderstatus || ''',''' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ''',NULL,X''6869''' AS line FROM orders")
def dump_quoted(db):
    r = Request(db, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", F.lit(None).cast("string").alias("nothing"), F.lit(b"hi").alias("blob"))
    return dumped(r.order_by_key().to_df(), "quote")


@query("SELECT 'customer' AS \"table\", c_custkey || '|''' || c_name || '''' AS line FROM customer UNION ALL SELECT 'part', p_partkey || '|''' || p_name || '''' FROM part")
def dump_tables(db):
    small = db.with_tables(customer=db.df("customer").select("c_custkey", "c_name"), part=db.df("part").select("p_partkey", "p_name"))
    return dumped_tables(small, "customer", "part", style="debug")


@query("SELECT '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\",\"c_nationkey\":' || c_nationkey || '}' AS line FROM customer")
def dump_json(db):
    return dumped(Request(db, "customer").select("c_custkey", "c_name", "c_nationkey").to_df(), "json")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 100000 AND 120000")
def raw_sql_positional(db):
    return positional(db.spark, "SELECT o_orderkey FROM {o} WHERE o_orderstatus = ? AND o_totalprice BETWEEN ? AND ?", "F", 100000, 120000, o=db.df("orders"))


@query("SELECT c_custkey, 'a;b' AS s FROM customer WHERE c_acctbal > 5000")
def raw_sql_script(db):
    """The last of several statements, a semicolon in a text included."""
    text = "SELECT count(*) FROM {c}; SELECT c_custkey, 'a;b' AS s FROM {c} WHERE c_acctbal > :least;"
    return script(db.spark, text, {"least": 5000}, c=db.df("customer"))[-1]


@query("SELECT event_id, event_type FROM events WHERE value > 40")
def project_default(db):
    """What the table's own selection says, filtered by a column outside of it."""
    metas = db.metas | {"events": replace(db.meta("events"), selection=("event_id", "event_type"))}
    return Request(Catalog(db.spark, db.folder, db.tables, metas), "events").filter("value > 40").to_df()

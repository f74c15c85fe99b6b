"""Mutations, changed tables and views, user functions, windows over rows and over event time."""

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators.associations import belongs_to, has_one
from ..operators.mutations import Mutable, delete_cascading, to
from ..operators.request import Request, desc
from ..operators.schema import Catalog, TableMeta
from ..streaming import observe as O
from .catalog import query


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'NEW ' || p_name ELSE p_name END AS p_name FROM part")
def insert_ignore(db):
    p = db.df("part").select("p_partkey", "p_name")
    old = Mutable(p.filter("p_partkey % 3 <> 0"), ("p_partkey",))
    return old.insert(p.withColumn("p_name", F.concat(F.lit("NEW "), "p_name")), "ignore")[0].df


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'NEW ' || p_name ELSE p_name END AS p_name FROM part")
def insert_replace(db):
    p = db.df("part").select("p_partkey", "p_name")
    rows = p.filter("p_partkey % 2 = 0").withColumn("p_name", F.concat(F.lit("NEW "), "p_name"))
    return Mutable(p.filter("p_partkey % 3 <> 0 OR p_partkey % 2 = 1"), ("p_partkey",)).insert(rows, "replace")[0].df


@query("SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY o_custkey")
def insert_conflicting_rows(db):
    """New rows that repeat a key: ignore keeps the first in an order, replace the last."""
    o = db.df("orders").select("o_custkey", "o_orderkey")
    none = Mutable(o.limit(0), ("o_custkey",))
    first = none.insert(o, "ignore", order=F.col("o_orderkey"))[0].df.withColumnRenamed("o_orderkey", "first")
    return first.join(none.insert(o, "replace", order=F.col("o_orderkey"))[0].df.withColumnRenamed("o_orderkey", "last"), "o_custkey")


@query("SELECT c_custkey, c_acctbal + coalesce(p, 0) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def upsert_repeated_keys(db):
    """Of the new rows of a key the last in an order counts, once."""
    rows = db.df("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    old = Mutable(db.df("customer").select("c_custkey", "c_acctbal"), ("c_custkey",))
    return old.upsert(rows, {"c_acctbal": F.col("old.c_acctbal") + F.col("new.o_totalprice")}, order=F.col("o_orderkey"))[0].df


@query("SELECT p_partkey, 'none' AS p_brand, 7 AS p_size FROM part WHERE p_partkey % 10 = 0")
def insert_returning(db):
    """Inserted rows with the table's defaults filled in, under its rules."""
    p = db.df("part").select("p_partkey", "p_brand", "p_size")
    meta = TableMeta("part", ("p_partkey",), required=("p_brand",), checks={"size": "p_size > 0"}, defaults={"p_brand": "'none'", "p_size": "7"})
    return Mutable(p.filter("p_partkey % 10 <> 0"), ("p_partkey",), meta=meta).insert(p.filter("p_partkey % 10 = 0").select("p_partkey"))[1]


@query("SELECT p_partkey, (p_size * 3 + 1) // 2 AS p_size, p_retailprice / 2 - 1 AS p_retailprice FROM part")
def update_assigned(db):
    """Assignment operators, one after another."""
    p = Mutable(db.df("part").select("p_partkey", "p_size", "p_retailprice"), ("p_partkey",))
    every = F.lit(True)
    for change in (to("p_size").times(3), to("p_size").plus(1), to("p_size").over(2), to("p_retailprice").over(2.0), to("p_retailprice").minus(1)):
        p = p.update(every, **change)[0]
    return p.df


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal + coalesce(t, 0) AS c_acctbal, c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def upsert_assigned(db):
    best = db.df("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("t"))
    return Mutable(db.df("customer"), ("c_custkey",)).upsert(best, {"c_acctbal": F.col("old.c_acctbal") + F.col("new.t")})[0].df


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, CASE WHEN p_size > 25 THEN p_retailprice * 1.5 ELSE p_retailprice END AS p_retailprice FROM part")
def update_all(db):
    return Mutable(db.df("part"), ("p_partkey",)).update(F.col("p_size") > 25, p_retailprice=F.col("p_retailprice") * 1.5)[0].df


@query("SELECT p_partkey, p_size + 1 AS p_size FROM part WHERE p_size % 5 = 0")
def update_returning(db):
    return Mutable(db.df("part"), ("p_partkey",)).update(F.col("p_size") % 5 == 0, p_size=F.col("p_size") + 1)[1].select("p_partkey", "p_size")


@query("SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_by_request(db):
    poor = db.df("customer").filter("c_acctbal < 0")
    doomed = db.df("orders").join(poor, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return Mutable(db.df("orders"), ("o_orderkey",)).delete_rows(doomed)[0].df


@query("SELECT o_orderkey FROM orders WHERE o_totalprice < 20000")
def delete_returning(db):
    return Mutable(db.df("orders"), ("o_orderkey",)).delete(F.col("o_totalprice") < 20000)[1].select("o_orderkey")


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'delete' WHEN s_suppkey % 10 = 0 THEN 'update' END AS kind FROM supplier WHERE s_acctbal < 0 OR s_suppkey % 10 = 0")
def changed_rows(db):
    old = Mutable(db.df("supplier"), ("s_suppkey",))
    new = old.update(F.col("s_suppkey") % 10 == 0, s_name=F.lit("changed"))[0].delete(F.col("s_acctbal") < 0)[0]
    return old.changes(new.df)


@query("SELECT c_custkey, list_sum(list_transform(string_split(c_custkey::VARCHAR || c_nationkey::VARCHAR, ''), lambda d, i: d::INT * (i % 3 + 1)))::BIGINT % 10 AS digit FROM customer")
def user_function(db):
    """A check digit over two columns, which no built-in function gives."""

    def check(*parts):
        return sum(int(d) * (i % 3 + 1) for i, d in enumerate("".join(map(str, parts)), 1)) % 10

    digit = A.user_function(check, LongType())
    return db.df("customer").select("c_custkey", digit("c_custkey", "c_nationkey").alias("digit"))


@query("SELECT user_id, list_sort(list_distinct(list(value)))[-2] AS second FROM events GROUP BY user_id")
def user_aggregate(db):
    """The second greatest distinct value of a group, from states of two values."""
    top = lambda values: sorted({v for v in values if v is not None})[-2:]
    second = A.Aggregate(list, lambda s, v: top([*s, v]), lambda a, b: top([*a, *b]), lambda s: s[0] if len(s) == 2 else None)
    return A.aggregated(db.df("events"), ("user_id",), ("value",), second, "second", DoubleType())


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def top_of_group(db):
    return Request(db, "orders").first_of_each("o_custkey", order=[desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice").to_df()


@query("SELECT event_id, user_id, row_number() OVER w AS n, lag(event_type) OVER w AS before, round(sum(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS recent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def row_windows(db):
    r = Request(db, "events").select("event_id", "user_id").annotated_over("user_id", ("ts", "event_id"), n=F.row_number(), before=F.lag("event_type"))
    df = r.annotated_over("user_id", ("ts", "event_id"), (-2, 0), recent=F.sum("value")).to_df()
    return df.withColumns({"n": F.col("n").cast("long"), "recent": F.round("recent", 4)})


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_cube(db):
    return Request(db, "lineitem").cube("l_returnflag", "l_linestatus").select(F.count("*").alias("n")).to_df()


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority) HAVING count(*) > 5")
def grouping_rollup(db):
    return Request(db, "orders").rollup("o_orderstatus", "o_orderpriority").select(F.count("*").alias("n")).having("count(*) > 5").to_df()


@query("SELECT c_mktsegment, c_nationkey, round(sum(c_acctbal), 2) AS s FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
def grouping_sets(db):
    return Request(db, "customer").grouping_sets(("c_mktsegment",), ("c_nationkey",), ()).select(F.round(F.sum("c_acctbal"), 2).alias("s")).to_df()


@query("SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 9000) FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 9900) ON s_nationkey = c_nationkey")
def full_join(db):
    s, c = db.df("supplier").filter("s_acctbal > 9000"), db.df("customer").filter("c_acctbal > 9900")
    return s.join(c, F.col("s_nationkey") == F.col("c_nationkey"), "full").select("s_suppkey", "c_custkey")


@query("SELECT a.event_id, b.event_id AS latest FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def join_as_of(db):
    """The user's last click before each purchase."""
    e = db.df("events")
    clicks = e.filter("event_type = 'click'").select("user_id", "ts", "event_id")
    out = J.as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, "ts", "ts", {"user_id": "user_id"})
    return out.select("event_id", F.col("latest.event_id").alias("latest"))


@query("SELECT o_orderkey, p_partkey FROM orders JOIN (SELECT p_partkey, p_retailprice * 100 AS lo, p_retailprice * 100 + p_size AS hi FROM part) ON o_totalprice BETWEEN lo AND hi")
def join_range(db):
    ranges = db.df("part").select("p_partkey", (F.col("p_retailprice") * 100).alias("lo"), (F.col("p_retailprice") * 100 + F.col("p_size")).alias("hi"))
    return J.in_range(db.df("orders").select("o_orderkey", "o_totalprice"), ranges, "o_totalprice", "lo", "hi", 50.0).select("o_orderkey", "p_partkey")


@query("SELECT a.p_partkey AS one, b.s_suppkey AS other FROM part a JOIN supplier b ON a.p_size * 100 <= b.s_acctbal + 30 AND b.s_acctbal <= a.p_size * 100 + 20 WHERE a.p_partkey % 4 = 0")
def join_overlapping(db):
    c = F.col
    parts = db.df("part").filter("p_partkey % 4 = 0").select("p_partkey", (c("p_size") * 100).cast("double").alias("a"), (c("p_size") * 100 + 20).cast("double").alias("b"))
    suppliers = db.df("supplier").select("s_suppkey", c("s_acctbal").alias("x"), (c("s_acctbal") + 30).alias("y"))
    return J.overlapping(parts, suppliers, ("a", "b"), ("x", "y"), 40.0).select(c("p_partkey").alias("one"), c("s_suppkey").alias("other"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(db):
    return O.tumbling(db.df("events"), "ts", "6 hours", "event_type")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS start, count(*) AS n FROM events, range(0, 3) r(k) GROUP BY ALL")
def event_sliding_windows(db):
    return O.sliding(db.df("events"), "ts", "3 hours", "1 hour")


@query("""WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM m)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, s""")
def event_sessions(db):
    return O.sessions(db.df("events"), "ts", "12 hours", "user_id")


def _ruled(db, **rules):
    """The catalog with other rules for deletions, by child table."""
    metas = {n: replace(m, fks=tuple(replace(fk, on_delete=rules.get(n, fk.on_delete)) for fk in m.fks)) for n, m in db.metas.items()}
    return Catalog(db.spark, db.folder, db.tables, metas)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0)")
def delete_cascaded(db):
    ruled = _ruled(db, orders="cascade", lineitem="cascade")
    return delete_cascading(ruled, "customer", db.df("customer").filter("c_acctbal < 0")).df("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey, CASE WHEN n_regionkey <> 3 THEN c_nationkey END AS c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def delete_set_null(db):
    ruled = _ruled(db, nation="cascade", customer="set null", supplier="cascade", lineitem="set null")
    return delete_cascading(ruled, "region", db.df("region").filter("r_regionkey = 3")).df("customer").select("c_custkey", "c_nationkey")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'saved' ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, 'saved', NULL, NULL FROM supplier WHERE s_suppkey % 4 = 0")
def save_rows(db):
    s = db.df("supplier")
    some = s.filter("s_suppkey % 4 = 0").select("s_suppkey", F.lit("saved").alias("s_name"))
    return Mutable(s, ("s_suppkey",)).save(some.union(some.withColumn("s_suppkey", F.col("s_suppkey") + 1000000)))[0].df


@query("SELECT p_partkey, p_size::VARCHAR AS size, CASE WHEN p_brand <> 'Brand#11' THEN p_brand END AS brand FROM part WHERE p_partkey % 3 = 0")
def changed_values(db):
    p = db.df("part")
    edited = p.filter("p_partkey % 3 = 0").select("p_partkey", "p_name", (F.col("p_size") + 1).alias("p_size"), F.lit("Brand#11").alias("p_brand"))
    return Mutable(p, ("p_partkey",)).changed_values(edited).select("p_partkey", F.try_element_at("changed", F.lit("p_size")).alias("size"), F.try_element_at("changed", F.lit("p_brand")).alias("brand"))


@query("SELECT o_orderkey AS id, o_custkey AS buyer, o_totalprice, year(o_orderdate) AS y, 'new' AS state, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def altered_table(db):
    """Renamed key columns still join; y is generated and state a default."""
    now = db.altered("orders", {"o_orderkey": "id", "o_custkey": "buyer"}, {"y": F.year("o_orderdate").cast("long"), "state": F.lit("new")}, ("o_orderstatus", "o_orderdate", "o_orderpriority"))
    o = Request(now, "orders")
    return o.annotated_with_required(belongs_to(o, Request(now, "customer")), "c_name").to_df()


@query("SELECT c_custkey, n, name FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) JOIN (SELECT c_custkey, c_name AS name FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey WHERE n >= 3")
def view_by_key(db):
    busy = db.with_view("busy", db.df("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")), ("c_custkey",))
    rich = busy.with_view("rich", db.df("customer").filter("c_acctbal > 0").select("c_custkey", F.col("c_name").alias("name")), ("c_custkey",))
    of = has_one(Request(rich, "busy"), Request(rich, "rich"), "c_custkey")
    return Request(rich, "busy").filter("n >= 3").annotated_with_required(of, "name").to_df()

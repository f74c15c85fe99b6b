"""Associations: joins, prefetched rows and aggregates."""

from pyspark.sql import functions as F

from ..operators.associations import associated_on, belongs_to, has_many, has_one, through
from ..operators.request import Request, desc
from ..operators.schema import Catalog, ForeignKey, TableMeta
from .catalog import query


def requests(db, *names):
    return [Request(db, n) for n in names]


@query("SELECT n_name, c_name, o_n AS \"orderCount\", round(t, 2) AS \"totalOrderO_totalprice\" FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT o_custkey, count(*) AS o_n, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey WHERE o_n >= 3")
def join_including_required(db):
    customer, nation, orders = requests(db, "customer", "nation", "orders")
    o = has_many(customer, orders)
    r = customer.including_required(belongs_to(customer, nation)).having(o.count >= 3)
    return r.select("nation.n_name", "c_name", o.count, o.total("o_totalprice").map(lambda c: F.round(c, 2))).to_df().drop("nation")


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1")
def join_including_optional(db):
    documents, labels = requests(db, "documents", "labels")
    label = has_one(documents, labels).filter("quality = 1")
    df = documents.including_optional(label).to_df()
    return df.select("doc_id", "lang", "label.quality", "label.toxic")


@query("SELECT c_custkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'")
def join_joining_required(db):
    customer, orders = requests(db, "customer", "orders")
    return customer.joining_required(has_many(customer, orders).filter("o_orderpriority = '1-URGENT'")).select("c_custkey", "c_name").to_df()


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 2")
def join_annotated_optional(db):
    supplier, nation = requests(db, "supplier", "nation")
    return supplier.annotated_with_optional(belongs_to(supplier, nation).filter("n_regionkey = 2"), "n_name").select("s_suppkey").to_df()


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
def join_nested(db):
    customer, nation, region = requests(db, "customer", "nation", "region")
    home = belongs_to(customer, nation).including_required(belongs_to(nation, region).filter("r_name = 'EUROPE'"))
    return customer.including_required(home).to_df().select("c_custkey", "nation.n_name", "nation.region.r_name")


@query("SELECT n_nationkey, c_custkey, c_acctbal FROM nation JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 AND c_mktsegment = 'BUILDING'")
def join_merged_keys(db):
    nation, customer = requests(db, "nation", "customer")
    a = has_many(nation, customer)
    r = nation.including_optional(a.filter("c_acctbal > 9000")).joining_required(a.filter("c_mktsegment = 'BUILDING'"))
    return r.to_df().select("n_nationkey", "customers.c_custkey", "customers.c_acctbal")


@query("SELECT DISTINCT c_custkey, l_partkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 49")
def join_through(db):
    customer, orders, lineitem = requests(db, "customer", "orders", "lineitem")
    items = through(has_many(customer, orders), has_many(orders, lineitem, key="items").filter("l_quantity > 49"), key="items")
    return customer.including_required(items).to_df().select("c_custkey", "items.l_partkey").distinct()


@query("SELECT a.s_suppkey AS one, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
def join_self_on_condition(db):
    (supplier,) = requests(db, "supplier")
    a = associated_on(supplier, supplier, "other", lambda df, o: (df["s_nationkey"] == o["other"]["s_nationkey"]) & (df["s_acctbal"] < o["other"]["s_acctbal"]))
    return supplier.aliased("mine").including_required(a).to_df().select(F.col("s_suppkey").alias("one"), F.col("other.s_suppkey").alias("other"))


@query("SELECT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c ON c.c_nationkey = s.s_nationkey WHERE s.s_acctbal > c.c_acctbal + 9000")
def join_aliased(db):
    """A condition over the request's alias and the association's key."""
    supplier, customer = requests(db, "supplier", "customer")
    rich = (lambda df: df["s_acctbal"], lambda o: o["c"]["c_acctbal"] + 9000)  # without it, the pairs of 25 nations' rows would all be made
    near = associated_on(supplier, customer, "c", lambda df, o: df["s_nationkey"] == o["c"]["c_nationkey"], rich)
    r = supplier.aliased("s").including_required(near).filter("s.s_acctbal > c.c_acctbal + 9000")
    return r.select("s.s_suppkey", "c.c_custkey").to_df().drop("c")


@query("SELECT doc_id, quality IS NOT NULL AS labelled FROM documents LEFT JOIN labels USING (doc_id)")
def join_row_exists(db):
    documents, labels = requests(db, "documents", "labels")
    label = has_one(documents, labels)
    return documents.joining_optional(label).select("doc_id", label.present.alias("labelled")).to_df()


@query("SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0")
def join_one_through(db):
    customer, nation, region = requests(db, "customer", "nation", "region")
    home = through(belongs_to(customer, nation), belongs_to(nation, region))
    return customer.filter("c_acctbal > 0").annotated_with_required(home, "r_name").select("c_custkey").to_df()


@query("SELECT c_custkey, n, most FROM customer JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY o_custkey HAVING count(*) > 12) ON o_custkey = c_custkey")
def join_grouped(db):
    """The association's rows are grouped, and their groups filtered, before the join."""
    customer, orders = requests(db, "customer", "orders")
    busy = has_many(customer, orders, key="busy").group("o_custkey").select("o_custkey", F.count("*").alias("n"), F.max("o_totalprice").alias("most")).having("count(*) > 12")
    return customer.annotated_with_required(busy, "n", "most").select("c_custkey").to_df()


@query("SELECT p_partkey, s FROM part JOIN (SELECT DISTINCT l_partkey, l_suppkey AS s FROM lineitem WHERE l_quantity > 45) ON l_partkey = p_partkey")
def join_distinct(db):
    part, lineitem = requests(db, "part", "lineitem")
    makers = has_many(part, lineitem, key="makers").filter("l_quantity > 45").select("l_partkey", F.col("l_suppkey").alias("s")).distinct()
    return part.annotated_with_required(makers, "s").select("p_partkey").to_df()


@query("SELECT n_nationkey, coalesce(string_agg(s_name, ',' ORDER BY s_acctbal DESC, s_suppkey), '') AS names FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY n_nationkey")
def prefetch_ordered(db):
    nation, supplier = requests(db, "nation", "supplier")
    df = nation.including_all(has_many(nation, supplier).filter("s_acctbal > 0").order(desc("s_acctbal"), "s_suppkey")).to_df()
    return df.select("n_nationkey", F.array_join(F.transform("suppliers", lambda s: s["s_name"]), ",").alias("names"))


@query("SELECT c_custkey, coalesce((SELECT string_agg(o_orderkey, ',' ORDER BY abs(o_totalprice - 100000), o_orderkey) FROM (SELECT * FROM orders WHERE o_custkey = c_custkey ORDER BY abs(o_totalprice - 100000), o_orderkey LIMIT 3)), '') AS nearest FROM customer")
def prefetch_limited(db):
    """At most three rows of each parent, in the order of an expression."""
    customer, orders = requests(db, "customer", "orders")
    some = has_many(customer, orders).order(F.abs(F.col("o_totalprice") - 100000), "o_orderkey").limit(3)
    df = customer.including_all(some).to_df()
    return df.select("c_custkey", F.array_join(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), ",").alias("nearest"))


@query("SELECT conv_id, turn, length(text) AS n, CASE WHEN turn > 0 THEN 1 ELSE 0 END AS before FROM conversations")
def prefetch_composite_key(db):
    """An association over two columns: the turn before each turn."""
    c = db.df("conversations")
    later = c.select("conv_id", "turn", (F.col("turn") - 1).alias("previous"), "text")
    metas = {"later": TableMeta("later", ("conv_id", "turn"), (ForeignKey(("conv_id", "previous"), "conversations", ("conv_id", "turn")),)), "conversations": db.meta("conversations")}
    both = Catalog(db.spark, tables={"later": later, "conversations": c.select("conv_id", "turn")}, metas=metas)
    one = belongs_to(Request(both, "later"), Request(both, "conversations"), key="earlier")
    df = Request(both, "later").including_all(one).to_df()
    return df.select("conv_id", "turn", F.length("text").alias("n"), F.size("earlier").alias("before"))


@query("SELECT r_regionkey, count(c_custkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 8000 GROUP BY r_regionkey")
def prefetch_through(db):
    region, nation, customer = requests(db, "region", "nation", "customer")
    rich = through(has_many(region, nation), has_many(nation, customer).filter("c_acctbal > 8000"))
    return region.including_all(rich).to_df().select("r_regionkey", F.size("customers").cast("long").alias("n"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS \"orderCount\", (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) = 0 AS \"hasNoOrders\" FROM customer")
def aggregate_count(db):
    customer, orders = requests(db, "customer", "orders")
    o = has_many(customer, orders)
    return customer.select("c_custkey", o.count, o.is_empty).to_df()


@query("SELECT n_nationkey, round(a, 4) AS \"averageCustomerC_acctbal\", lo AS \"minCustomerC_acctbal\", hi AS \"maxCustomerC_acctbal\", round(s, 2) AS balance, coalesce(round(t, 2), 0) AS \"totalSupplierS_acctbal\" FROM nation LEFT JOIN (SELECT c_nationkey, avg(c_acctbal) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi, sum(c_acctbal) AS s FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, sum(s_acctbal) AS t FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def aggregate_values(db):
    nation, customer, supplier = requests(db, "nation", "customer", "supplier")
    c, s = has_many(nation, customer), has_many(nation, supplier)
    two = lambda x: F.round(x, 2)
    return nation.select("n_nationkey", c.average("c_acctbal").map(lambda x: F.round(x, 4)), c.min("c_acctbal"), c.max("c_acctbal"), c.sum("c_acctbal").map(two).for_key("balance"), s.total("s_acctbal").map(two)).to_df()


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000) AS dear, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS \"orderCount\" FROM customer")
def aggregate_two_populations(db):
    """Differing rows of one table, each under a key of its own."""
    customer, orders = requests(db, "customer", "orders")
    o = has_many(customer, orders)
    return customer.select("c_custkey", o.filter("o_totalprice > 150000").for_key("dearOrders").count.for_key("dear"), o.count).to_df()


@query("SELECT p_partkey, coalesce(hi, -1) AS most FROM part LEFT JOIN (SELECT l_partkey, max(l_quantity) AS hi FROM lineitem WHERE l_discount > 0.09 GROUP BY l_partkey) ON l_partkey = p_partkey")
def aggregate_if_null(db):
    part, lineitem = requests(db, "part", "lineitem")
    return part.select("p_partkey", has_many(part, lineitem, key="items").filter("l_discount > 0.09").max("l_quantity").if_null(-1).for_key("most")).to_df()


@query("SELECT c_custkey FROM customer JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE n > 8 AND m > 200000")
def aggregate_having(db):
    customer, orders = requests(db, "customer", "orders")
    o = has_many(customer, orders)
    return customer.select("c_custkey").having((o.count > 8) & (o.max("o_totalprice") > 200000)).to_df()


@query("SELECT p_partkey, count(DISTINCT l_suppkey) AS \"supplierCount\" FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def aggregate_count_through(db):
    part, lineitem, supplier = requests(db, "part", "lineitem", "supplier")
    return part.select("p_partkey", through(has_many(part, lineitem), belongs_to(lineitem, supplier), key="suppliers").count).to_df()


@query("SELECT n_nationkey, c + s AS parties FROM nation JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def aggregate_arithmetic(db):
    nation, customer, supplier = requests(db, "nation", "customer", "supplier")
    c, s = has_many(nation, customer).count, has_many(nation, supplier).count
    return nation.select("n_nationkey", (c + s).for_key("parties")).having((c > 0) & (s > 0)).to_df()


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_join(db):
    customer, orders = requests(db, "customer", "orders")
    return customer.select("c_custkey").having_any(has_many(customer, orders).filter("o_orderstatus = 'P'")).to_df()


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def anti_join(db):
    customer, orders = requests(db, "customer", "orders")
    return customer.select("c_custkey").having_no(has_many(customer, orders).filter("o_totalprice > 150000")).to_df()


@query("SELECT l_orderkey, l_partkey, missing FROM (SELECT l_orderkey, l_partkey, 'part' AS missing FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2))")
def foreign_key_violations(db):
    metas = {"lineitem": TableMeta("lineitem", (), (ForeignKey(("l_partkey",), "part", ("p_partkey",)),))}
    small = Catalog(db.spark, tables={"lineitem": db.df("lineitem"), "part": db.df("part").filter("p_size > 2")}, metas=metas)
    return small.violations("lineitem").select("l_orderkey", "l_partkey", "missing")


@query("SELECT o_orderkey, n_name AS supplier_nation, sum(l_quantity) AS quantity FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY o_orderkey, n_name")
def join_star(db):
    lines, orders, customer, supplier, nation = requests(db, "lineitem", "orders", "customer", "supplier", "nation")
    order = belongs_to(lines, orders, key="o").including_required(belongs_to(orders, customer, key="c"))
    maker = belongs_to(lines, supplier, key="s").including_required(belongs_to(supplier, nation, key="n"))
    r = lines.joining_required(order).joining_required(maker).filter("s.s_nationkey = o.c.c_nationkey")
    grouped = r.group("o.o_orderkey", "s.n.n_name").select("o.o_orderkey", "s.n.n_name", F.sum("l_quantity").alias("quantity"))
    return grouped.to_df().withColumnRenamed("n_name", "supplier_nation")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def associated_rows(db):
    customer, orders = Request(db, "customer"), Request(db, "orders")
    return has_many(customer, orders).of(customer.filter("c_mktsegment = 'BUILDING'").to_df()).select("o_orderkey", "o_custkey").to_df()


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 300000)")
def associated_rows_through(db):
    orders, lineitem, part = (Request(db, t) for t in ("orders", "lineitem", "part"))
    parts = through(has_many(orders, lineitem), belongs_to(lineitem, part))
    return parts.of(orders.filter("o_totalprice > 300000").to_df()).select("p_partkey", "p_name").to_df()


@query("SELECT l.doc_id, quality, toxic, d.n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id ORDER BY quality, toxic, d.n_chars DESC, d.doc_id LIMIT 40")
def order_by_joined(db):
    """The association's order comes after the request's own."""
    labels, documents = requests(db, "labels", "documents")
    document = belongs_to(labels, documents).order(desc("n_chars"), "doc_id")
    return labels.order("quality", "toxic").annotated_with_required(document, "n_chars").select("doc_id", "quality", "toxic").limit(40).to_df()

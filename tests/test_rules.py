"""Rules that a result alone does not show: refusals, hooks, constraints, regions, watermarks, plans."""

import sqlite3
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

from weir.functions import json as J
from weir.functions.text_index import TextIndex, Tokenizer
from weir.operators import aggregates as A
from weir.operators import joins
from weir.operators.associations import belongs_to, has_many, through
from weir.operators.migrations import Migrator
from weir.operators.mutations import Conflict, Hooks, Mutable, to
from weir.operators.request import NotFound, NotSupported, Request, asc, desc
from weir.operators.schema import Catalog, ForeignKey, SchemaError, TableMeta
from weir.sources.sql import SQL, dumped, dumped_schema, literal, name
from weir.streaming.observe import Region, observe, region_of, sessions, sliding, tumbling


@pytest.fixture(scope="module")
def db(spark):
    metas = {
        "team": TableMeta("team", ("id",), unique=(("name",),)),
        "player": TableMeta("player", ("id",), (ForeignKey(("teamId",), "team", ("id",)),)),
        "award": TableMeta("award", ("id",), (ForeignKey(("teamId",), "team", ("id",)),)),
    }
    tables = {
        "team": spark.createDataFrame([(1, "Reds"), (2, "Blues"), (3, "Greens"), (4, "Oranges")], "id long, name string"),
        "player": spark.createDataFrame([(1, 1, 100), (2, 1, 1000), (3, 2, 200), (4, 2, 500), (5, 2, 800), (6, 4, 0), (7, None, 9)], "id long, teamId long, score int"),
        "award": spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 2), (5, 3)], "id long, teamId long"),
    }
    return Catalog(spark, tables=tables, metas=metas)


def test_one_key_is_one_population(db):
    team, player = Request(db, "team"), Request(db, "player")
    p = has_many(team, player)
    good = p.filter("score > 150")
    with pytest.raises(SchemaError):
        team.select("id", good.count.for_key("good"), p.count).fetch_all()
    rows = team.select("id", good.for_key("goodPlayers").count.for_key("good"), p.count, has_many(team, Request(db, "player")).max("score")).order("id").fetch_all()
    assert [tuple(r) for r in rows] == [(1, 1, 2, 1000), (2, 3, 3, 800), (3, 0, 0, None), (4, 0, 1, 0)]
    team.select(good.count, p.filter("score > 150").sum("score")).to_df()
    column = lambda: p.filter(F.col("score") > 150)
    with pytest.raises(SchemaError):  # two columns are not known to be the same condition
        team.select(column().count, column().sum("score")).to_df()


def test_expression_orders_limits_and_groups_of_associations(db):
    team, player, award = (Request(db, t) for t in ("team", "player", "award"))
    p = has_many(team, player).order(F.abs(F.col("score") - 450), desc("id"))
    assert [[x.id for x in r.players] for r in team.including_all(p).order("id").fetch_all()] == [[1, 2], [4, 3, 5], [], [6]]
    assert [[x.id for x in r.players] for r in team.including_all(p.limit(1)).order("id").fetch_all()] == [[1], [4], [], [6]]
    narrow = has_many(team, player).select("id").order(desc("score"))  # neither the key nor the order is selected
    assert [[tuple(x) for x in r.players] for r in team.including_all(narrow).order("id").fetch_all()] == [[(2,), (1,)], [(5,), (4,), (3,)], [], [(6,)]]
    over = through(belongs_to(player, team), has_many(team, award).order(desc("id")))
    assert [[x.id for x in r.awards] for r in player.including_all(over).order("id").fetch_all()][:3] == [[3, 2, 1], [3, 2, 1], [4]]
    r = player.including_required(belongs_to(player, team).order(F.length("name"), "name"))
    assert [x.id for x in r.order("teamId IS NULL").stable_order().fetch_all()] == [1, 2, 3, 4, 5, 6] and [x.team.name for x in r.fetch_all()][0] == "Reds"
    best = has_many(team, player, key="best").group("teamId").select("teamId", F.max("score").alias("most")).having("max(score) > 100")
    assert sorted(tuple(x) for x in team.annotated_with_optional(best, "most").select("id").fetch_all()) == [(1, 1000), (2, 800), (3, None), (4, None)]
    assert sorted(x.id for x in team.joining_optional(p.limit(1)).filter(~p.present).fetch_all()) == [3]


def test_required_behind_optional_is_refused(db):
    team, player, award = (Request(db, t) for t in ("team", "player", "award"))
    needs = belongs_to(player, team.including_required(has_many(team, award)))
    with pytest.raises(NotSupported):
        player.including_optional(needs)
    assert player.including_required(needs).fetch_count() == 9


def test_unique_keys_and_counts(db):
    team, player = Request(db, "team"), Request(db, "player")
    assert team.find_unique(name="Blues").id == 2 and team.exists_unique(name="Reds") and not team.exists_unique(name="x")
    with pytest.raises(NotFound):
        team.find_unique(name="x")
    with pytest.raises(SchemaError):
        player.filter_unique({"score": 9})
    many = team.including_all(has_many(team, player)).including_optional(belongs_to(player, team))
    plan = many.counted()
    assert plan.prefetched == {} and plan.joins == {} and many.fetch_count() == 4
    assert player.joining_optional(belongs_to(player, team)).filter("team.name = 'Reds'").fetch_count() == 2


def test_raw_parts_and_values(db, spark):
    player = Request(db, "player")
    rows = player.select("id", "score + 1 AS next", SQL("score * :k AS more", {"k": 2})).filter(SQL("teamId IN :t", {"t": [1, 4]})).order(SQL("score % :m", {"m": 7}), "id").fetch_all()
    assert [tuple(r) for r in rows] == [(6, 1, 0), (1, 101, 200), (2, 1001, 2000)]
    assert player.filter(SQL("teamId IN :t", {"t": []})).is_empty()
    assert player.select(SQL("':a' || :a AS x", {"a": "it's \\ :b"})).fetch_one().x == ":ait's \\ :b"
    assert SQL("x = :a", {"a": 1}).overridden(a=2).values == {"a": 2} and literal(None) == "NULL" and literal(True) == "TRUE"
    odd = spark.createDataFrame([(1,)], "`a b``c` int")
    assert odd.select(name("a b`c").column().alias("v")).first().v == 1
    with pytest.raises(ValueError):
        SQL(":none").column()


def test_subqueries_and_sets(db):
    team, player = Request(db, "team"), Request(db, "player")
    assert sorted(r.id for r in team.filter_in("id", player.filter("score > 400").select("teamId")).fetch_all()) == [1, 2]
    assert team.filter_not_in("id", player.select("teamId")).is_empty()  # the list has a null
    assert [r.id for r in team.filter_not_in("id", player.filter("teamId IS NOT NULL").select("teamId")).fetch_all()] == [3]
    assert sorted(r.id for r in player.filter_not_in("teamId", team.filter("id = 1").select("id")).fetch_all()) == [3, 4, 5, 6]
    assert player.filter_not_in("teamId", team.none().select("id")).fetch_count() == 7
    with_t = player.with_table("top", player.group("teamId").select("teamId", F.max("score").alias("m")), ("k",), ("k", "m"))
    assert Request(with_t.db, "top").filter("m > 500").fetch_count() == 2
    ids = player.select("teamId")
    assert ids.union(team.select("id")).fetch_count() == 5 and ids.intersect(team.select("id"), every=True).fetch_count() == 3 and ids.subtract(team.select("id"), every=True).fetch_count() == 4
    assert sorted(r.id for r in player.first_of_each("teamId", order=[desc("score")]).fetch_all()) == [2, 5, 6, 7]
    assert {(r.teamId, r.n) for r in player.rollup("teamId").select(F.count("*").alias("n")).fetch_all()} == {(1, 2), (2, 3), (4, 1), (None, 1), (None, 7)}


def test_conflicts_within_new_rows_and_rules(spark):
    df = spark.createDataFrame([(1, "a", 1)], "id long, name string, n int")
    meta = TableMeta("t", ("id",), unique=(("name",),), required=("name",), checks={"small": "n < 100"}, defaults={"n": "5"})
    t = Mutable(df, ("id",), meta=meta)
    rows = lambda *r: spark.createDataFrame(list(r), "id long, name string, n int")
    for bad in ([(2, "b", 1), (2, "c", 1)], [(2, "a", 1)], [(2, None, 1)], [(None, "x", 1)], [(2, "b", 100)], [(2, "b", 1), (3, "b", 1)]):
        with pytest.raises(Conflict):
            t.insert(rows(*bad))
    kept = lambda m: sorted(tuple(r) for r in m.df.collect())
    assert kept(t.insert(rows((2, "b", None)))[0]) == [(1, "a", 1), (2, "b", 5)]
    assert kept(t.insert(rows((2, "c", 3), (2, "b", 4), (3, "a", 1), (4, "d", 500)), "ignore")[0]) == [(1, "a", 1), (2, "b", 4)]
    assert kept(t.insert(rows((2, "c", 3), (2, "b", 4), (3, "a", 9)), "replace")[0]) == [(2, "c", 3), (3, "a", 9)]
    assert kept(t.insert(rows((2, "c", 3), (2, "b", 4)), "ignore", order=F.col("n"))[0]) == [(1, "a", 1), (2, "c", 3)]
    up = t.upsert(rows((1, "z", 2), (1, "y", 3), (5, "q", 1)), order=F.col("n"))
    assert kept(up[0]) == [(1, "y", 3), (5, "q", 1)] and up[1].count() == 2
    with pytest.raises(Conflict):
        t.upsert(rows((2, "a", 2)))
    with pytest.raises(Conflict):
        t.update(F.lit(True), n=F.lit(1000))
    assert t.update(F.lit(True)) is None
    assert kept(t.update(F.lit(True), **to("n").plus(6), **to("name").set("w"))[0]) == [(1, "w", 7)]
    assert kept(t.update(F.lit(True), **to("n").bits_or(6))[0]) == [(1, "a", 7)]


def test_hooks_meet_every_kind(spark):
    seen = []

    def will(kind, rows):
        seen.append(kind)
        return rows.filter("id <> 2")

    t = Mutable(spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, n int"), ("id",), Hooks(will))
    assert sorted(tuple(r) for r in t.update(F.lit(True), n=F.lit(0))[0].df.collect()) == [(1, 0), (2, 2), (3, 0)]
    left, gone = t.delete(F.col("n") > 1)
    assert [r.id for r in left.df.orderBy("id").collect()] == [1, 2] and [r.id for r in gone.collect()] == [3]
    assert t.delete_rows(t.df)[0].df.count() == 1 and seen == ["update", "delete", "delete"]

    def veto(kind, rows):
        raise PermissionError(kind)

    for act in (lambda m: m.update(F.lit(True), n=F.lit(0)), lambda m: m.delete(F.lit(True)), lambda m: m.insert(m.df), lambda m: m.upsert(m.df), lambda m: m.delete_rows(m.df)):
        with pytest.raises(PermissionError):
            act(Mutable(t.df, ("id",), Hooks(veto)))


def test_created_and_dropped_tables(db):
    now = db.created("coach", "id long, teamId long", TableMeta("coach", ("id",), (ForeignKey(("teamId",), "team", ("id",)),)))
    assert now.df("coach").count() == 0 and now.columns("coach") == [("id", "bigint"), ("teamId", "bigint")] and now.exists("coach") and not db.exists("coach")
    with pytest.raises(SchemaError):
        now.created("coach", "id long")
    with pytest.raises(SchemaError):
        now.dropped("team")
    assert not now.dropped("coach").exists("coach")
    assert dumped_schema(db, "player") == ["CREATE TABLE player (id bigint NOT NULL, teamId bigint, score int, PRIMARY KEY (id), FOREIGN KEY (teamId) REFERENCES team (id))"]


def test_quoted_lines_read_back(spark):
    row = spark.sql("SELECT 1 AS a, 'it''s' AS b, timestamp_ntz'2024-01-02 03:04:05' AS c, X'00ff' AS d, true AS e, CAST(NULL AS string) AS f, 1.5D AS g")
    got = sqlite3.connect(":memory:").execute(f"SELECT {dumped(row, 'quote').first().line}").fetchone()
    assert got == (1, "it's", "2024-01-02 03:04:05", b"\x00\xff", 1, None, 1.5) and dumped(row, "debug").first().line.count("|") == 6


def test_merged_migrations_and_checks(spark, db):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    m = Migrator()
    m.register("v", lambda t, done: t | {"a": ids(1)} if "one" not in done else t, merging=("one", "two"))
    m.register("three", lambda t: t | {"b": ids(2)})
    assert m.migrate({}, [])[1] == ["v", "three"]
    tables, done = m.migrate({"a": ids(9)}, ["one", "two"])
    assert done == ["v", "three"] and tables["a"].first().id == 9 and not m.superseded(["one"])
    assert m.migrate({"a": ids(9)}, ["one"])[0]["a"].first().id == 9
    assert not m.has_changed(tables, done) and m.has_changed({"a": tables["a"]}, done) and m.has_changed(tables | {"b": tables["b"].withColumn("x", F.lit(1))}, done)
    checked = Migrator(db.metas)
    checked.register("lose", lambda t: t | {"team": t["team"].filter("id <> 2")})
    with pytest.raises(SchemaError):
        checked.migrate({"team": db.df("team"), "player": db.df("player")}, [])


def test_region_algebra():
    a = Region({"t": frozenset({"x", "y"})}, {"t": frozenset({1, 2})})
    b = Region({"t": frozenset({"y", "z"}), "u": None}, {"t": frozenset({2, 3})})
    both = a.intersection(b)
    assert both == Region({"t": frozenset({"y"})}, {"t": frozenset({2})}) and a.meets(b)
    assert not a.meets(Region({"t": frozenset({"x"})}, {"t": frozenset({9})})) and not a.intersection(Region({"t": frozenset({"z"})})).columns
    joined = a.union(b)
    assert joined.columns == {"t": frozenset({"x", "y", "z"}), "u": None} and joined.keys["t"] == frozenset({1, 2, 3}) and a.meets(Region({"t": None}))


def test_only_batches_of_the_region_fetch(spark, tmp_path):
    folder, calls, seen = str(tmp_path / "in"), [], []
    spark.range(3).write.parquet(folder)

    def fetch():
        calls.append(1)
        return spark.read.parquet(folder).filter("id >= 100").count()

    q = observe(spark.readStream.schema("id long").parquet(folder), fetch, seen.append, str(tmp_path / "c"), region=Region({"t": None}, {"t": frozenset(range(100, 110))}), touched=region_of("t", "id"))
    try:
        q.processAllAvailable()
        spark.range(3, 5).write.mode("append").parquet(folder)
        q.processAllAvailable()
        before = len(calls)
        spark.range(100, 102).write.mode("append").parquet(folder)
        for _ in range(50):
            q.processAllAvailable()
            if len(seen) > 1:
                break
            time.sleep(0.1)
    finally:
        q.stop()
    assert before == 1 and seen == [0, 2]


def test_windows_append_under_a_watermark(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(1, "2024-01-01 00:10:00"), (1, "2024-01-01 00:50:00"), (2, "2024-01-01 05:00:00"), (1, "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "u long, s string").selectExpr("u", "CAST(s AS timestamp) t").write.parquet(folder)
    stream = spark.readStream.schema("u long, t timestamp").parquet(folder)
    for i, df in enumerate((tumbling(stream, "t", "1 hour", "u", late="1 hour"), sliding(stream, "t", "2 hours", "1 hour", late="1 hour"), sessions(stream, "t", "2 hours", "u", late="1 hour"))):
        q = df.writeStream.format("memory").queryName(f"w{i}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{i}")).trigger(availableNow=True).start()
        q.awaitTermination()
        out = spark.table(f"w{i}").collect()
        assert out and max(r.n for r in out) == 2 and all(r.start.day == 1 or r.start.year == 2023 for r in out)


def test_user_functions_and_aggregates(spark):
    df = spark.createDataFrame([(i % 3, i, None if i % 5 == 0 else float(i)) for i in range(200)], "g int, i long, v double").repartition(4)
    both = A.user_function(lambda *x: sum(v for v in x if v is not None), DoubleType())
    assert all(r.s == r.i + (r.v or 0) for r in df.select("i", "v", both(F.col("i").cast("double"), "v").alias("s")).collect())
    tick = A.user_function(lambda x: x + 1, LongType(), pure=False)
    assert sorted(r.x for r in df.select(tick("i").alias("x")).collect()) == list(range(1, 201))
    mean = A.Aggregate(lambda: (0.0, 0), lambda s, v: s if v is None else (s[0] + v, s[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s[0] / s[1] if s[1] else None)
    got = {r.g: r.m for r in A.aggregated(df, ("g",), ("v",), mean, "m", DoubleType(), groups=1).collect()}
    assert got == {r.g: pytest.approx(r.m) for r in df.groupBy("g").agg(F.avg("v").alias("m")).collect()}
    assert A.aggregated(df.limit(0), ("g",), ("v",), mean, "m", DoubleType()).count() == 0
    hot = A.aggregated(df.withColumn("g", F.lit(None).cast("string")), ("g",), ("v",), A.Aggregate(str, lambda s, v: s + "x", lambda a, b: a + b, len), "n", LongType()).collect()
    assert [(r.g, r.n) for r in hot] == [(None, 200)] and StringType() is not None


def test_joins_beyond_keys(spark):
    import random

    rng = random.Random(4)
    left = [(i, rng.randint(0, 3), rng.randint(0, 50)) for i in range(80)] + [(80, None, 5), (81, 1, None)]
    right = [(i, rng.randint(0, 3), rng.randint(0, 50)) for i in range(60)] + [(60, None, 1), (61, 2, None)]
    a, b = spark.createDataFrame(left, "i long, k int, t int"), spark.createDataFrame(right, "j long, k int, t int")
    got = {r.i: r.latest and r.latest.j for r in joins.as_of(a, b, "t", "t", {"k": "k"}).collect()}
    before = lambda k, t: [(y, x) for x, m, y in right if m == k and k is not None and y is not None and t is not None and y <= t]
    assert got == {i: max(before(k, t), default=(0, None))[1] for i, k, t in left}
    ranges = spark.createDataFrame([(i, x, x + rng.randint(-2, 9)) for i, x in enumerate(rng.sample(range(50), 30))], "r long, lo int, hi int")
    spans = ranges.collect()
    inside = {(x.i, x.r) for x in joins.in_range(a.select("i", "t"), ranges, "t", "lo", "hi", 4).collect()}
    assert inside == {(i, s.r) for i, _, t in left for s in spans if t is not None and s.lo <= t <= s.hi}
    other = ranges.selectExpr("r AS q", "lo + 3 AS x", "hi + 5 AS y")
    meet = [(x.r, x.q) for x in joins.overlapping(ranges, other, ("lo", "hi"), ("x", "y"), 6).collect()]
    want = {(s.r, o.q) for s in spans for o in other.collect() if s.lo <= s.hi and o.x <= o.y and s.lo <= o.y and o.x <= s.hi}
    assert len(meet) == len(set(meet)) and set(meet) == want


def test_text_index_equals_a_full_text_table(spark):
    texts = [(1, "Moby Dick", "call me Ishmael some years ago never mind"), (2, "dick moby", "Über the SEA, moby"), (3, "", None), (4, "the sea the sea", "the whale and the whale"), (5, "never never mind", "years")]
    rows = spark.createDataFrame(texts, "id long, title string, body string")
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE d USING fts5(title, body)")
    con.executemany("INSERT INTO d(rowid, title, body) VALUES (?, ?, ?)", texts)
    index = TextIndex.build(rows, "id", ("title", "body"))
    ask = lambda q: sorted(x for (x,) in con.execute("SELECT rowid FROM d WHERE d MATCH ?", (q,)))
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(index.any_of(["moby", "whale"])) == ask("moby OR whale") and ids(index.all_of(["the", "sea", "the"])) == ask("the AND sea")
    assert ids(index.phrase(["the", "sea", "the"])) == ask('"the sea the"') and ids(index.phrase(["never", "mind"])) == ask('"never mind"')
    assert ids(index.phrase(["moby"], first=True)) == ask('^"moby"') and ids(index.all_prefixes(["mo", "di"])) == ask("mo* AND di*")
    assert ids(index.within("body").any_of(["moby"])) == ask("body: moby") and ids(index.any_of(["uber"])) == ask("uber")
    assert ids(index.near("call", "years", 3)) == ask("NEAR(call years, 3)") and ids(index.near("call", "ago", 1)) == ask("NEAR(call ago, 1)")
    for nothing in (index.any_of(None), index.all_of([]), index.phrase([]), index.all_prefixes(None), index.ranked([])):
        assert nothing.count() == 0
    want = dict(con.execute("SELECT rowid, rank FROM d WHERE d MATCH 'moby OR whale'").fetchall())
    assert {r.id: pytest.approx(r.rank, rel=1e-6) for r in index.ranked(["moby", "whale"]).collect()} == want
    now = index.updated(spark.createDataFrame([(3, "moby", "new"), (9, "a whale", "")], "id long, title string, body string"), spark.createDataFrame([(1,)], "id long"))
    con.execute("DELETE FROM d WHERE rowid IN (1, 3)")
    con.executemany("INSERT INTO d(rowid, title, body) VALUES (?, ?, ?)", [(3, "moby", "new"), (9, "a whale", "")])
    assert ids(now.any_of(["moby", "whale"])) == ask("moby OR whale")
    words = lambda t, s: t.tokens(F.lit(s))
    got = spark.range(1).select(words(Tokenizer(separators="x"), "axb Ÿ").alias("a"), words(Tokenizer(token_characters="-"), "a-b c").alias("b"), words(Tokenizer(diacritics="keep"), "É").alias("c"), words(Tokenizer("ascii"), "Éa B").alias("d")).first()
    assert tuple(got) == (["a", "b", "y"], ["a-b", "c"], ["é"], ["Éa", "b"])
    same = TextIndex.build(rows, "id", ("body",), Tokenizer(synonyms={"whale": ("beast",)}))
    assert ids(same.any_of(["beast"])) == [4] and ids(same.phrase(["the", "beast", "and"])) == [4]


def test_ordered_aggregates(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (1, None, 1)], "g int, s string, n int")
    r = df.groupBy("g").agg(A.concatenated(F.col("s"), F.col("n"), "-").alias("c"), A.ordered_array(F.col("s"), F.col("n"), descending=True).alias("o"), J.group_array(F.col("s"), where=F.col("n") > 1).alias("j"), A.of_least(F.col("s"), F.col("n")).alias("l"), A.concatenated(F.col("s"), where=F.col("n") > 9).alias("none")).first()
    assert (r.c, r.o, r.j, r.l, r.none) == ("b-a", ["a", "b", None], '["a","b"]', None, None)
    assert asc("x").reversed().descending

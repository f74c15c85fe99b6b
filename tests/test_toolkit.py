"""Requests, associations, functions, mutations, migrations and observation on small tables, held against sqlite3 where it has the same."""

import json
import sqlite3
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from weir.functions import dialect as D
from weir.functions import json as J
from weir.functions import search as S
from weir.operators.associations import belongs_to, has_many, has_one, through
from weir.operators.migrations import Migrator
from weir.operators.mutations import Conflict, Hooks, Mutable, delete_cascading
from weir.operators.request import NotFound, NotSupported, Request, desc
from weir.operators.schema import AmbiguousForeignKey, Catalog, ForeignKey, NoForeignKey, SchemaError, TableMeta, plural, singular
from weir.sources.sql import SQL, dumped, joined
from weir.streaming.observe import Region, Shared, observe, on_arrival


@pytest.fixture(scope="module")
def db(spark):
    metas = {
        "team": TableMeta("team", ("id",)),
        "player": TableMeta("player", ("id",), (ForeignKey(("teamId",), "team", ("id",)),)),
        "award": TableMeta("award", ("id",), (ForeignKey(("teamId",), "team", ("id",)),)),
        "match": TableMeta("match", ("id",), (ForeignKey(("home",), "team", ("id",)), ForeignKey(("away",), "team", ("id",)))),
    }
    tables = {
        "team": spark.createDataFrame([(1, "Reds"), (2, "Blues"), (3, "Greens"), (4, "Oranges")], "id long, name string"),
        "player": spark.createDataFrame([(1, 1, 100), (2, 1, 1000), (3, 2, 200), (4, 2, 500), (5, 2, 800), (6, 4, 0), (7, None, 9)], "id long, teamId long, score int"),
        "award": spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 2), (5, 3)], "id long, teamId long"),
        "match": spark.createDataFrame([(1, 1, 2)], "id long, home long, away long"),
    }
    return Catalog(spark, tables=tables, metas=metas)


def test_two_aggregates_do_not_multiply(db):
    team, player, award = (Request(db, t) for t in ("team", "player", "award"))
    p, a = has_many(team, player), has_many(team, award)
    rows = team.select("id", p.count, a.count, p.sum("score"), p.total("score"), p.is_empty).order("id").fetch_all()
    assert [tuple(r) for r in rows] == [(1, 2, 3, 1100, 1100.0, False), (2, 3, 1, 1500, 1500.0, False), (3, 0, 1, None, 0.0, True), (4, 1, 0, 0, 0.0, False)]
    assert rows[0].asDict().keys() == {"id", "playerCount", "awardCount", "sumPlayerScore", "totalPlayerScore", "hasNoPlayers"}


def test_prefetch_keeps_order_and_empty_lists(db):
    team, player = Request(db, "team"), Request(db, "player")
    rows = team.including_all(has_many(team, player).order(desc("score"))).order("id").fetch_all()
    assert [[p.id for p in r.players] for r in rows] == [[2, 1], [5, 4, 3], [], [6]]


def test_joins_and_merging(db):
    team, player = Request(db, "team"), Request(db, "player")
    t = belongs_to(player, team)
    assert [r.team and r.team.name for r in player.including_optional(t).order("id").fetch_all()] == ["Reds", "Reds", "Blues", "Blues", "Blues", "Oranges", None]
    assert player.including_optional(t).joining_required(t.filter("name = 'Reds'")).fetch_count() == 2
    assert player.including_required(t).filter(F.col("team.name") == "Blues").fetch_count() == 3
    with pytest.raises(NotSupported):
        player.including_required(t).including_required(through(t, has_many(team, Request(db, "award")), key="team"))


def test_through(db):
    team, player, award = (Request(db, t) for t in ("team", "player", "award"))
    awards = through(belongs_to(player, team), has_many(team, award))
    rows = player.including_all(awards).select("id", awards.count).order("id").fetch_all()
    assert [(r.id, r.awardCount, len(r.awards)) for r in rows] == [(1, 3, 3), (2, 3, 3), (3, 1, 1), (4, 1, 1), (5, 1, 1), (6, 0, 0), (7, 0, 0)]


def test_foreign_keys(db):
    team, match = Request(db, "team"), Request(db, "match")
    with pytest.raises(AmbiguousForeignKey):
        belongs_to(match, team)
    assert belongs_to(match, team, "away").left == ("away",)
    with pytest.raises(NoForeignKey):
        has_one(match, Request(db, "player"))
    assert db.violations("player").count() == 0


def test_request_rules(db):
    player = Request(db, "player")
    assert player.limit(2).filter("score > 400").order("id").fetch_count() == 2
    assert [r.id for r in player.order("score").order(desc("id")).limit(2).fetch_all()] == [7, 6]
    assert player.find(3).score == 200 and player.exists(3) and not player.exists(99)
    with pytest.raises(NotFound):
        player.find(99)
    assert player.filter_key(None).is_empty() and player.none().all().is_empty()
    assert player.group("teamId").select(F.first("teamId").alias("t"), F.count("*").alias("n")).having("count(*) > 1").fetch_count() == 2
    assert player.select("teamId").distinct().order("teamId").fetch_all()[0].teamId is None


def test_names():
    assert [plural(x) for x in ("book", "country", "box", "person", "orders")] == ["books", "countries", "boxes", "people", "orders"]
    assert [singular(x) for x in ("books", "countries", "boxes", "people", "news", "class")] == ["book", "country", "box", "person", "news", "class"]


VALUES = [7, -7, 0, 3, None]


def test_arithmetic_equals_sqlite(spark):
    con = sqlite3.connect(":memory:")
    pairs = [(a, b) for a in VALUES for b in VALUES]
    df = spark.createDataFrame(pairs, "a long, b long")
    a, b = F.col("a"), F.col("b")
    got = df.select("a", "b", D.divide_int(a, b).alias("d"), D.greatest(a, b).alias("g"), D.least(a, b).alias("l"), D.shift_left(a, b).alias("s"), D.shift_right(a, b).alias("r")).collect()
    for r in got:
        assert tuple(r)[2:] == con.execute("SELECT ?1 / ?2, max(?1, ?2), min(?1, ?2), ?1 << ?2, ?1 >> ?2", (r.a, r.b)).fetchone()


def test_text_equals_sqlite(spark):
    con = sqlite3.connect(":memory:")
    texts = ["12abc", " -3.5e2x", "abc", "", "ABC", "æ", "Æ", "a_c", "+4", ".5", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.cast_integer(F.col("t")).alias("i"), D.cast_real(F.col("t")).alias("r"), D.like(F.col("t"), "A_C").alias("k"), D.like(F.col("t"), "æ").alias("m"), D.like(F.col("t"), "a\\_c").alias("e")).collect()
    for r in got:
        want = con.execute("SELECT CAST(?1 AS INTEGER), CAST(?1 AS REAL), ?1 LIKE 'A_C', ?1 LIKE 'æ', ?1 LIKE 'a\\_c' ESCAPE '\\'", (r.t,)).fetchone()
        assert (r.i, r.r, *(None if x is None else int(x) for x in (r.k, r.m, r.e))) == want


def test_dates_equal_sqlite(spark):
    con = sqlite3.connect(":memory:")
    days = ["2020-01-31 10:20:30", "2021-12-31 00:00:00", "2024-02-29 23:59:59", "2000-01-01 12:00:00"]
    t = F.col("t").cast("timestamp")
    got = spark.createDataFrame([(d,) for d in days], "t string").select("t", D.date_time(D.add_months(t, 1)).alias("m"), D.julian_day(t).alias("j"), F.date_format(D.weekday(t, 2), "yyyy-MM-dd").alias("w"), D.date_time(D.start_of(t, "year")).alias("y")).collect()
    for r in got:
        want = con.execute("SELECT datetime(?1, '+1 month'), julianday(?1), date(?1, 'weekday 2'), datetime(?1, 'start of year')", (r.t,)).fetchone()
        assert (r.m, round(r.j, 8), r.w, r.y) == (want[0], round(want[1], 8), *want[2:])


def test_json_equals_sqlite(spark):
    con = sqlite3.connect(":memory:")
    texts = ['{"a":1,"b":"x"}', '{"b":null}', "{}"]
    c = F.col("t")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", J.set_(c, "a", F.lit(5)).alias("s"), J.insert(c, "a", F.lit("q")).alias("i"), J.replace(c, "a", F.lit(7)).alias("r"), J.remove(c, "b").alias("d"), J.patch(c, F.lit('{"a":null,"z":2}')).alias("p"), J.type_name(c, "$.a").alias("k"), J.represent(c, "$.b").alias("e")
    ).collect()
    for r in got:
        want = con.execute("SELECT json_set(?1,'$.a',5), json_insert(?1,'$.a','q'), json_replace(?1,'$.a',7), json_remove(?1,'$.b'), json_patch(?1,'{\"a\":null,\"z\":2}'), json_type(?1,'$.a'), ?1 -> '$.b'", (r.t,)).fetchone()
        assert tuple(r)[1:] == want
    assert spark.createDataFrame([("{bad",), ("[1,2]",)], "t string").select(J.is_valid(c).alias("v"), J.array_length(c).alias("n")).collect() == [(False, 0), (True, 2)]


def test_search(spark):
    docs = spark.createDataFrame([(1, "The Moby Dick of old"), (2, "dick moby"), (3, "Über-Über café"), (4, "")], "id long, text string")
    tokens = S.unicode_tokens(F.col("text"))
    ids = lambda c: [r.id for r in docs.filter(c).orderBy("id").collect()]
    assert ids(S.phrase(tokens, ["moby", "dick"])) == [1] and ids(S.all_of(tokens, ["moby", "dick"])) == [1, 2]
    assert ids(S.any_of(tokens, ["cafe", "old"])) == [1, 3] and ids(S.any_of(tokens, [])) == []
    assert ids(S.near(tokens, "the", "dick", 1)) == [1] and ids(S.near(tokens, "the", "old", 1)) == []
    assert ids(S.first_phrase(tokens, ["dick"])) == [2] and ids(S.all_prefixes(tokens, ["mo", "di"])) == [1, 2] and ids(S.any_of(tokens, ["uber"])) == [3]
    assert ids(S.any_of(S.ascii_tokens(F.col("text")), ["moby"])) == [1, 2]
    assert [r.id for r in S.bm25(docs, "id", tokens, ["moby"]).orderBy("rank").collect()] == [2, 1]


def test_mutations(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, name string, n int")
    t = Mutable(df, ("id",))
    with pytest.raises(Conflict):
        t.insert(spark.createDataFrame([(2, "x")], "id long, name string"))
    now, new = t.insert(spark.createDataFrame([(3, None)], "id long, name string"), defaults={"name": F.lit("new"), "n": F.lit(1000)})
    assert [tuple(r) for r in new.collect()] == [(3, "new", 1000)] and now.df.count() == 3
    up, touched = now.upsert(spark.createDataFrame([(1, "z", 9), (4, "d", 4)], "id long, name string, n int"), {"n": F.col("old.n") + F.col("new.n")})
    assert sorted(tuple(r) for r in up.df.collect()) == [(1, "a", 10), (2, "b", 2), (3, "new", 1000), (4, "d", 4)] and touched.count() == 2
    assert {(r.id, r.kind) for r in t.changes(up.delete(F.col("id") == 2)[0].df).collect()} == {(1, "update"), (2, "delete"), (3, "insert"), (4, "insert")}
    with pytest.raises(Conflict):
        up.check(conditions={"small": F.col("n") < 100})
    up.check(unique=("name",))
    assert spark.read.parquet(up.publish(str(tmp_path), 1)).count() == 4


def test_migrations(spark):
    m = Migrator()
    m.register("one", lambda t: t | {"a": spark.range(3).toDF("id")})
    m.register("two", lambda t: t | {"a": t["a"].withColumn("x", F.lit(1))})
    tables, done = m.migrate({}, [], up_to="one")
    assert done == ["one"] and tables["a"].columns == ["id"]
    tables, done = m.migrate(tables, done)
    assert done == ["one", "two"] and tables["a"].columns == ["id", "x"]
    with pytest.raises(ValueError):
        m.migrate(tables, ["three"])


def test_observation(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(3).write.parquet(folder)
    seen = []
    q = observe(spark.readStream.schema("id long").parquet(folder), lambda: spark.read.parquet(folder).count(), seen.append, str(tmp_path / "c"))
    try:
        q.processAllAvailable()
        spark.range(3, 5).write.mode("append").parquet(folder)
        for _ in range(50):
            q.processAllAvailable()
            if seen == [3, 5]:
                break
            time.sleep(0.1)
    finally:
        q.stop()
    assert seen == [3, 5]


def test_regions():
    a, b = Region({"t": frozenset({"x"})}), Region({"t": frozenset({"y"}), "u": None})
    assert not a.meets(b) and a.union(b).meets(b) and b.meets(Region({"u": frozenset({"q"})}))


def test_raw_sql(spark):
    q = joined([SQL("id = :a", {"a": 1}), SQL("id = :b", {"b": 2})], " OR ")
    df = (SQL("SELECT * FROM {t} WHERE ") + q).run(spark, t=spark.range(5))
    assert sorted(r.id for r in df.collect()) == [1, 2]
    with pytest.raises(ValueError):
        SQL(":a", {"a": 1}) + SQL(":a", {"a": 2})
    rows = spark.createDataFrame([(1, "it's", None)], "a int, b string, c string")
    assert dumped(rows, "quote").first().line == "1,'it''s',NULL" and dumped(rows, "list").first().line == "1|it's|"
    assert dumped(rows, "json").first().line == '{"a":1,"b":"it\'s","c":null}'


def test_globs_and_substrings_equal_sqlite(spark):
    con = sqlite3.connect(":memory:")
    texts = ["abc", "a*c", "Abc", "a]c", "a-c", "", "héllo wörld", "it's", "a\nc", "[x]", None]
    patterns = ["a*", "a?c", "[a-b]*", "[^a]*", "*[]]*", "a[*]c", "*c", "A*", "a[-]c", "[x", "*"]
    parts = [(1, 2), (-2, None), (2, None), (-2, 1), (0, 2), (3, -2), (-1, -2), (-9, 8), (0, None), (2, 0), (0, -1)]
    c = F.col("t")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", *[D.glob(c, p).cast("int").alias(f"g{i}") for i, p in enumerate(patterns)], *[D.substr(c, *s).alias(f"s{i}") for i, s in enumerate(parts)],
        D.unicode(c).alias("u"), D.quote(c, "string").alias("q"), D.type_of(c, "string").alias("k"), D.instr(c, F.lit("c")).alias("n"),
    ).collect()
    globs = ", ".join(f"?1 GLOB '{p}'" for p in patterns)
    cuts = ", ".join(f"substr(?1, {a}{'' if n is None else f', {n}'})" for a, n in parts)
    for r in got:
        assert tuple(r)[1:] == con.execute(f"SELECT {globs}, {cuts}, unicode(?1), quote(?1), typeof(?1), instr(?1, 'c')", (r.t,)).fetchone(), r.t


def test_deep_json_equals_sqlite(spark):
    con = sqlite3.connect(":memory:")
    texts = ['{"a":{"b":[1,2,{"c":"x"}]},"z":null}', "{}", "[1,[2,3]]", "5", '{"a":[]}', '{"a":{"b":{}}}', '{"a":1.5}', None]
    paths = ["$.a.b", "$.a.b[0]", "$.a.b[2].c", "$.a.b[3]", "$.a[#]", "$[1][0]", "$[2]", "$.a.n.m", '$."a"', "$.z", "$.a.b[#]"]
    c, v = F.col("t"), F.lit("v")
    cells = [x for p in paths for x in (J.insert_at(c, p, v), J.replace_at(c, p, v), J.set_at(c, p, v), J.remove_at(c, p))]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[x.alias(f"c{i}") for i, x in enumerate(cells)]).collect():
        for i, p in enumerate(paths):
            want = con.execute(f"SELECT json_insert(?1, '{p}', 'v'), json_replace(?1, '{p}', 'v'), json_set(?1, '{p}', 'v'), json_remove(?1, '{p}')", (r.t,)).fetchone()
            read = lambda x: x and json.loads(x)  # noqa: E731  inner objects may come out in another order of keys
            assert list(map(read, r[1 + 4 * i : 5 + 4 * i])) == list(map(read, want)), (r.t, p)
    changes = ['{"a":null}', '{"a":{"b":{"q":1},"k":null}}', "7", '{"z":[1]}']
    for r in spark.createDataFrame([(t, p) for t in texts for p in changes], "t string, p string").select("t", "p", J.merge_patch("t", "p").alias("m")).collect():
        assert r.m == con.execute("SELECT json_patch(?, ?)", (r.t, r.p)).fetchone()[0]
    with pytest.raises(ValueError):
        J.set_at(c, "a.b", v)
    got = spark.createDataFrame([('{"a":}',), ("[1]",), (None,)], "t string").select(J.error_position("t").alias("e"), J.text(J.binary(c)).alias("b")).collect()
    assert [tuple(r) for r in got] == [(6, None), (0, "[1]"), (None, None)]


def ruled(db, **rules):
    return Catalog(db.spark, tables=db.tables, metas={n: replace(m, fks=tuple(replace(fk, on_delete=rules.get(n, "restrict")) for fk in m.fks)) for n, m in db.metas.items()})


def test_cascades(db):
    doomed = db.df("team").filter("id IN (1, 2)")
    for rules in ({}, {"player": "cascade"}):
        with pytest.raises(Conflict):
            delete_cascading(ruled(db, **rules), "team", doomed)
    now = delete_cascading(ruled(db, player="set null", award="cascade", match="set default"), "team", doomed, {"home": F.lit(4)})
    assert sorted((r.id, r.teamId) for r in now.df("player").collect()) == [(1, None), (2, None), (3, None), (4, None), (5, None), (6, 4), (7, None)]
    assert [r.id for r in now.df("award").collect()] == [5] and sorted(r.id for r in now.df("team").collect()) == [3, 4]
    assert [(r.home, r.away) for r in now.df("match").collect()] == [(4, None)] and db.df("team").count() == 4
    loop = Catalog(db.spark, tables=db.tables, metas={"team": TableMeta("team", ("id",), (ForeignKey(("id",), "team", ("id",), "cascade"),))})
    with pytest.raises(SchemaError):
        delete_cascading(loop, "team", doomed)


def test_hooks_and_changed_values(spark):
    seen = []
    hooks = Hooks(lambda kind, rows: rows.filter("n > 0"), lambda kind, rows: seen.append((kind, rows.count())))
    t = Mutable(spark.createDataFrame([(1, 1), (2, None)], "id long, n int"), ("id",), hooks)
    now, _ = t.insert(spark.createDataFrame([(3, 3), (4, 0)], "id long, n int"))
    now, _ = now.save(spark.createDataFrame([(1, 5), (2, -1)], "id long, n int"))
    assert sorted(tuple(r) for r in now.df.collect()) == [(1, 5), (2, None), (3, 3)]
    now.delete(F.col("id") == 3)
    assert seen == [("insert", 1), ("update", 1), ("delete", 1)]
    assert [(r.id, r.changed) for r in t.changed_values(spark.createDataFrame([(1, 1), (2, 7)], "id long, n int")).collect()] == [(2, {"n": None})]


def test_altered_and_renamed_tables(db):
    now = db.altered("team", {"id": "team_id"}, {"size": F.length("name")}, ("name",)).renamed("player", "person")
    assert now.df("team").columns == ["team_id", "size"] and now.meta("person").fks[0].to == ("team_id",) and not now.exists("player")
    assert has_many(Request(now, "team"), Request(now, "person")).key == "people" and db.meta("player").fks[0].to == ("id",)
    with pytest.raises(SchemaError):
        db.altered("player", drop=("teamId",))


def test_associated_rows_and_joined_orders(db):
    team, player, award = (Request(db, t) for t in ("team", "player", "award"))
    assert sorted(r.id for r in has_many(team, player).of(team.filter("name = 'Blues'").to_df()).fetch_all()) == [3, 4, 5]
    members = through(belongs_to(award, team), has_many(team, player))
    assert sorted(r.id for r in members.of(award.filter("id IN (1, 2, 5)").to_df()).fetch_all()) == [1, 2]  # each once
    r = player.order("teamId").including_required(belongs_to(player, team).order(desc("name")))
    assert [x.team.name for x in r.order(F.col("score") < 0).fetch_all()] == ["Reds"] * 2 + ["Oranges"] + ["Blues"] * 3
    assert [x.team.name for x in r.order(F.col("score") < 0).reversed().fetch_all()] == ["Blues"] * 3 + ["Oranges"] + ["Reds"] * 2
    assert r.unordered()._joined_orders() == ()


def test_shared_observation(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(3).write.parquet(folder)
    calls, first, second, batches = [], [], [], []
    arrivals = spark.readStream.schema("id long").parquet(folder)

    def fetch():
        calls.append(1)
        return spark.read.parquet(folder).count()

    shared = Shared(arrivals, fetch, str(tmp_path / "c"))
    told = on_arrival(arrivals, batches.append, str(tmp_path / "d"))
    try:
        shared.subscribe(first.append)
        shared.query.processAllAvailable()
        end = shared.subscribe(second.append)
        spark.range(3, 5).write.mode("append").parquet(folder)
        for _ in range(50):
            shared.query.processAllAvailable()
            told.processAllAvailable()
            if first[-1] == 5 and len(batches) > 1:
                break
            time.sleep(0.1)
        end()
        assert first == second == [3, 5] and list(shared.values(1)) == [5] and len(calls) == 3 and len(batches) == 2
    finally:
        shared.stop()
        told.stop()

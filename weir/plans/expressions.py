"""Arithmetic, scalar, date, JSON and search functions."""

from pyspark.sql import functions as F

from ..functions import dialect as D
from ..functions import json as J
from ..functions import search as S
from ..functions.text_index import TextIndex, Tokenizer
from ..operators.request import Request, desc
from .catalog import query


@query("SELECT o_orderkey, (o_orderkey // 7) AS q, CASE WHEN o_custkey % 3 <> 0 THEN o_orderkey // (o_custkey % 3) END AS z, o_totalprice / nullif(o_custkey % 2, 0) AS f FROM orders")
def divide(db):
    c = F.col
    return db.df("orders").select("o_orderkey", D.divide_int(c("o_orderkey"), F.lit(7)).alias("q"), D.divide_int(c("o_orderkey"), c("o_custkey") % 3).alias("z"), D.divide(c("o_totalprice"), c("o_custkey") % 2).alias("f"))


@query("SELECT event_id, (event_id & 12) | 3 AS m, ~event_id AS inv, -event_id AS neg, event_id + user_id - 2 * user_id AS a, event_id * 4 AS l, event_id >> 3 AS r, 0::BIGINT AS far FROM events")
def bits_and_signs(db):
    c = F.col
    return db.df("events").select("event_id", c("event_id").bitwiseAND(F.lit(12)).bitwiseOR(F.lit(3)).alias("m"), F.bitwise_not(c("event_id")).alias("inv"), (-c("event_id")).alias("neg"), (c("event_id") + c("user_id") - 2 * c("user_id")).alias("a"), D.shift_left(c("event_id"), F.lit(2)).alias("l"), D.shift_left(c("event_id"), F.lit(-3)).alias("r"), D.shift_left(c("event_id"), F.lit(70)).alias("far"))


@query("SELECT event_id, event_type || ':' || user_id AS label, length(event_type) AS n, upper(event_type) AS u, abs(-value) AS v, coalesce(nullif(event_type, 'view'), 'seen') AS e FROM events")
def scalars(db):
    c = F.col
    return db.df("events").select("event_id", D.concat(c("event_type"), F.lit(":"), c("user_id").cast("string")).alias("label"), F.length("event_type").cast("long").alias("n"), F.upper("event_type").alias("u"), F.abs(-c("value")).alias("v"), D.coalesce(F.nullif(c("event_type"), F.lit("view")), F.lit("seen")).alias("e"))


@query("SELECT event_id, CASE WHEN x IS NULL THEN NULL ELSE greatest(x, value) END AS hi, CASE WHEN x IS NULL THEN NULL ELSE least(x, value) END AS lo FROM (SELECT event_id, value, CASE WHEN event_type <> 'click' THEN user_id::DOUBLE END AS x FROM events)")
def scalar_extremes(db):
    x = F.when(F.col("event_type") != "click", F.col("user_id").cast("double"))
    return db.df("events").select("event_id", D.greatest(x, F.col("value")).alias("hi"), D.least(x, F.col("value")).alias("lo"))


@query("SELECT p_partkey, coalesce(try_cast(nullif(regexp_extract(t, '^[0-9]+'), '') AS BIGINT), 0) AS i, p_size <> 0 AND p_size % 2 <> 0 AS odd FROM (SELECT p_partkey, p_size, p_size || p_name AS t FROM part)")
def casts_and_truth(db):
    t = F.concat(F.col("p_size").cast("string"), F.col("p_name"))
    return db.df("part").select("p_partkey", D.cast_integer(t).alias("i"), D.truthy(F.col("p_size") % 2, "int").alias("odd"))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 3 DAY + INTERVAL 90 SECOND, '%Y-%m-%d %H:%M:%S') AS t, epoch_us(o_orderdate) / 86400000000.0 + 2440587.5 AS jd, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M:%S') AS m, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d %H:%M:%S') AS y FROM orders")
def date_functions(db):
    t = F.col("o_orderdate").cast("timestamp")
    return db.df("orders").select("o_orderkey", D.date_time(D.add_seconds(D.add_days(t, 3), 90)).alias("t"), D.julian_day(t).alias("jd"), D.date_time(D.start_of(t, "month")).alias("m"), D.date_time(D.start_of(t, "year")).alias("y"))


@query("SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + (o_orderdate - date_trunc('month', o_orderdate)), '%Y-%m-%d %H:%M:%S') AS next, strftime(o_orderdate::DATE + ((1 - dayofweek(o_orderdate)) % 7 + 7)::INTEGER % 7, '%Y-%m-%d') AS monday FROM orders")
def date_overflow(db):
    t = F.col("o_orderdate").cast("timestamp")
    return db.df("orders").select("o_orderkey", D.date_time(D.add_months(t, 1)).alias("next"), F.date_format(D.weekday(t, 1), "yyyy-MM-dd").alias("monday"))


@query("SELECT event_id, json_valid(props) AS ok, props ->> '$.k' AS k, (props ->> '$.k')::BIGINT + 1 AS k1, props ->> '$.none' AS missing FROM events")
def json_extract(db):
    p = F.col("props")
    return db.df("events").select("event_id", J.is_valid(p).alias("ok"), J.extract(p, "$.k").alias("k"), (J.extract(p, "$.k").cast("long") + 1).alias("k1"), J.extract(p, "$.none").alias("missing"))


@query("""SELECT p_partkey, '[' || p_partkey || ',"' || p_name || '",null]' AS a, '{"id":' || p_partkey || ',"name":"' || p_name || '","none":null}' AS o FROM part""")
def json_build(db):
    c = F.col
    return db.df("part").select("p_partkey", J.array(c("p_partkey"), c("p_name"), F.lit(None)).alias("a"), J.object_(id=c("p_partkey"), name=c("p_name"), none=F.lit(None)).alias("o"))


@query("""SELECT event_id, '[' || (props ->> '$.k') || ',null]' AS many, (props ->> '$.k') AS k, '"' || event_type || '"' AS t, '{"k":' || (props ->> '$.k') || '}' AS small FROM events""")
def json_forms(db):
    p = F.col("props")
    tagged = J.set_(p, "t", F.col("event_type"))
    return db.df("events").select("event_id", J.extract_many(p, "$.k", "$.none").alias("many"), J.represent(p, "$.k").alias("k"), J.represent(tagged, "$.t").alias("t"), J.minified(p).alias("small"))


@query("SELECT event_id, '{\"k\":' || (props ->> '$.k') || ',\"t\":\"' || event_type || '\"}' AS added, '{\"k\":\"' || event_type || '\"}' AS put, '{}' AS gone, '{\"z\":1}' AS patched FROM events")
def json_change(db):
    p = F.col("props")
    return db.df("events").select("event_id", J.insert(p, "t", F.col("event_type")).alias("added"), J.replace(p, "k", F.col("event_type")).alias("put"), J.remove(p, "k").alias("gone"), J.patch(p, F.lit('{"k":null,"z":1}')).alias("patched"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'integer' WHEN 1 THEN 'text' WHEN 2 THEN 'array' WHEN 3 THEN 'object' WHEN 4 THEN 'true' WHEN 5 THEN 'null' END AS v, 'object' AS whole,
CASE WHEN event_id % 6 = 2 THEN 1 + event_id % 4 ELSE 0 END AS n FROM events""")
def json_types(db):
    """Values of every type, by event; arrays of varying length."""
    i, ones = F.col("event_id"), F.array_join(F.array_repeat(F.lit("7"), (1 + F.col("event_id") % 4).cast("int")), ",")
    kinds = [F.col("user_id").cast("string"), J.quote(F.col("event_type")), F.concat(F.lit("["), ones, F.lit("]")), F.col("props"), F.lit("true"), F.lit("null")]
    value = F.element_at(F.array(*kinds), (i % 6 + 1).cast("int"))
    text = F.concat(F.lit('{"v":'), value, F.lit("}"))
    return db.df("events").select("event_id", J.type_name(text, "$.v").alias("v"), J.type_name(text).alias("whole"), J.array_length(text, "$.v").cast("long").alias("n"))


@query("""SELECT user_id, '[' || string_agg('"' || event_type || '"', ',' ORDER BY ts, event_id) || ']' AS kinds, coalesce('[' || string_agg(event_id, ',' ORDER BY event_id::VARCHAR) FILTER (value > 50) || ']', '[]') AS dear,
'{' || string_agg('"' || event_id || '":"' || event_type || '"', ',' ORDER BY '"' || event_id || '":"' || event_type || '"') || '}' AS by_id FROM events GROUP BY user_id""")
def json_group(db):
    c = F.col
    kinds = J.group_array(c("event_type"), order=F.struct("ts", "event_id"))
    return Request(db, "events").group("user_id").select("user_id", kinds.alias("kinds"), J.group_array(c("event_id"), where=c("value") > 50).alias("dear"), J.group_object(c("event_id"), c("event_type")).alias("by_id")).to_df()


TOKENS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{M}\\p{N}]+'), lambda t: t <> '')"


#: Lower-case tokens whose letters keep their marks.
KEPT = Tokenizer(diacritics="keep")


def _index(db):
    return TextIndex.stored(db.df("documents"), "doc_id", ("text",), KEPT)


@query(f"SELECT doc_id, list_has_any({TOKENS}, ['idiot', 'license', 'thation']) AS any_word, list_has_all({TOKENS}, ['the', 'and', 'of']) AS all_words FROM documents")
def search_words(db):
    """Flags for all documents, from the postings of six words."""
    index = _index(db)
    flag = lambda keys, name: keys.withColumn(name, F.lit(True))
    found = flag(index.any_of(["idiot", "license", "thation"]), "any_word").join(flag(index.all_of(["the", "and", "of"]), "all_words"), "doc_id", "full")
    out = db.df("documents").select("doc_id").join(found, "doc_id", "left")
    return out.select("doc_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("any_word", "all_words")])


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' all rights reserved ')")
def search_phrase(db):
    return _index(db).phrase(["all", "rights", "reserved"])


@query(f"SELECT doc_id FROM documents WHERE {TOKENS}[1:2] = ['the', 'and']")
def search_first_phrase(db):
    return _index(db).phrase(["the", "and"], first=True)


@query(f"SELECT doc_id FROM documents WHERE len(list_filter({TOKENS}, lambda t: starts_with(t, 'licens'))) > 0 AND len(list_filter({TOKENS}, lambda t: starts_with(t, 'gen'))) > 0")
def search_prefixes(db):
    return _index(db).all_prefixes(["licens", "gen"])


@query(f"""WITH t AS (SELECT doc_id, {TOKENS} AS k FROM documents), f AS (SELECT doc_id, len(k) AS n, len(list_filter(k, lambda x: x = 'license')) AS f0, len(list_filter(k, lambda x: x = 'stupid')) AS f1 FROM t),
s AS (SELECT count(*) AS d, avg(n) AS a, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM f),
i AS (SELECT *, CASE WHEN ln((d - d0 + 0.5) / (d0 + 0.5)) <= 0 THEN 1e-6 ELSE ln((d - d0 + 0.5) / (d0 + 0.5)) END AS i0, CASE WHEN ln((d - d1 + 0.5) / (d1 + 0.5)) <= 0 THEN 1e-6 ELSE ln((d - d1 + 0.5) / (d1 + 0.5)) END AS i1 FROM s)
SELECT doc_id, round(-(i0 * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * n / a)) + i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / a))), 6) AS rank FROM f, i WHERE f0 > 0 OR f1 > 0""")
def search_ranked(db):
    return _index(db).ranked(["license", "stupid"]).select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {TOKENS} AS k FROM documents) WHERE len(list_filter(range(1, len(k) + 1), lambda i: k[i] = 'licensed' AND list_contains(k[greatest(i - 3, 1):i + 3], 'under'))) > 0")
def search_near(db):
    return _index(db).near("licensed", "under", 2)


@query("SELECT doc_id FROM documents WHERE lang = 'fr' AND false")
def search_nothing(db):
    """No pattern finds nothing."""
    return _index(db).any_of(None)


@query(f"SELECT page_id, list_contains({TOKENS.replace('text', 'url')}, 'example') AS in_url FROM pages WHERE list_has_any(list_concat({TOKENS.replace('text', 'url')}, {TOKENS.replace('text', 'html')}), ['example', 'title'])")
def search_columns(db):
    """An index of two columns, searched in both and in one."""
    index = TextIndex.stored(db.df("pages"), "page_id", ("url", "html"), KEPT)
    found = index.any_of(["example", "title"])
    mine = index.within("url").any_of(["example"]).withColumn("in_url", F.lit(True))
    return found.join(mine, "page_id", "left").select("page_id", F.coalesce("in_url", F.lit(False)).alias("in_url"))


@query("SELECT doc_id, len(k) AS n FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9\\x{80}-\\x{10FFFF}]+'), lambda t: t <> '') AS k FROM documents)")
def search_ascii_tokens(db):
    return db.df("documents").select("doc_id", F.size(Tokenizer("ascii").tokens(F.col("text"))).cast("long").alias("n"))


@query("SELECT doc_id, len(k) AS n FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}.@]+'), lambda t: t <> '') AS k FROM documents)")
def search_token_options(db):
    """Letters, points and at-signs make tokens; digits do not."""
    options = Tokenizer(diacritics="keep", categories=("L",), token_characters=".@")
    return db.df("documents").select("doc_id", F.size(options.tokens(F.col("text"))).cast("long").alias("n"))


@query(f"SELECT doc_id FROM documents WHERE list_has_any({TOKENS}, ['idiot', 'moron', 'fool'])")
def search_synonyms(db):
    """Two words are stored as a third as well."""
    synonyms = Tokenizer(diacritics="keep", synonyms={"idiot": ("fool",), "moron": ("fool",)})
    return TextIndex.stored(db.df("documents"), "doc_id", ("text",), synonyms).any_of(["fool"])


@query(f"SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 AND list_contains({TOKENS}, 'license') OR doc_id % 7 = 1")
def search_updated(db):
    """An index that follows its content: documents deleted and rewritten."""
    d = db.df("documents")
    now = _index(db).updated(d.filter("doc_id % 7 = 1").withColumn("text", F.concat("text", F.lit(" license"))), d.filter("doc_id % 7 = 0"))
    return now.any_of(["license"])


@query(f"SELECT doc_id, len(k) AS n, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, {TOKENS.replace('lower(text)', 'strip_accents(lower(text))')} AS k FROM documents)")
def search_tokens(db):
    tokens = S.unicode_tokens(F.col("text"))
    return db.df("documents").select("doc_id", F.size(tokens).cast("long").alias("n"), F.md5(F.array_join(tokens, " ")).alias("digest"))


@query()
def search_stemmed(db):
    """Documents by the stem of a word; the tests hold it against an embedded database's index."""
    return TextIndex.stored(db.df("documents"), "doc_id", ("text",), Tokenizer(stem=True)).any_of(["licensed"])


@query("SELECT c_custkey, c_mktsegment FROM customer ORDER BY lower(c_mktsegment), c_custkey LIMIT 40")
def order_collated(db):
    return Request(db, "customer").select("c_custkey", "c_mktsegment").order(F.collate(F.col("c_mktsegment"), "UTF8_LCASE"), "c_custkey").limit(40).to_df()


@query("SELECT c_custkey, t FROM (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS t FROM customer) ORDER BY lower(t), c_acctbal DESC, c_custkey LIMIT 50")
def order_unicode(db):
    t = D.iif(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment"), F.col("c_mktsegment"))
    r = Request(db, "customer", db.df("customer").withColumn("t", t))
    return r.select("c_custkey", "t").order(F.collate(F.col("t"), "UNICODE_CI"), desc("c_acctbal"), "c_custkey").limit(50).to_df()


@query("SELECT p_partkey, p_brand GLOB '*[1-3]?' AS brand, p_type GLOB '*[!A-M]*' AS late, p_name GLOB 'P*' AS upper_p FROM part")
def glob_match(db):
    c = F.col
    return db.df("part").select("p_partkey", D.glob(c("p_brand"), "*[1-3]?").alias("brand"), D.glob(c("p_type"), "*[^A-M]*").alias("late"), D.glob(c("p_name"), "P*").alias("upper_p"))


@query("SELECT o_orderkey, right(o_orderpriority, 3) AS ending, o_orderpriority[2:4] AS middle, left(o_orderpriority, length(o_orderpriority) - 1) AS front, instr(o_orderpriority, '-') AS dash, unicode(o_orderpriority)::BIGINT AS code FROM orders")
def substrings(db):
    t = F.col("o_orderpriority")
    front = D.substr(t, -1, -100)
    return db.df("orders").select("o_orderkey", D.substr(t, -3).alias("ending"), D.substr(t, 2, 3).alias("middle"), front.alias("front"), D.instr(t, F.lit("-")).cast("long").alias("dash"), D.unicode(t).alias("code"))


@query("SELECT event_id, '''' || replace(event_type, 'i', '''''') || '''' AS literal, CASE WHEN event_type = 'view' THEN 'null' ELSE 'text' END AS class, to_timestamp(user_id * 86400)::TIMESTAMP AS day FROM events")
def literals(db):
    t = F.col("event_type")
    day = D.from_unix(F.col("user_id") * 86400).cast("timestamp_ntz")
    return db.df("events").select("event_id", D.quote(F.replace(t, F.lit("i"), F.lit("'")), "string").alias("literal"), D.type_of(F.when(t != "view", t), "string").alias("class"), day.alias("day"))


def _nested_events(db):
    e = db.df("events")
    return e.select("event_id", "event_type", J.object_(id=F.col("event_id")).alias("d"), "props").withColumn("d", F.concat(F.expr("left(d, length(d) - 1)"), F.lit(',"p":'), F.regexp_replace("props", " ", ""), F.lit(',"t":[1,[2,3]]}')))


@query("""WITH e AS (SELECT *, '{"id":' || event_id || ',"p":{"k":' || (props ->> '$.k') AS a FROM events)
SELECT event_id, a || ',"z":"' || event_type || '"},"t":[1,[2,3]]}' AS put, a || '},"t":[1,[9,3]]}' AS replaced, a || '},"t":[1,[2,3,4]]}' AS grown, '{"id":' || event_id || ',"p":{},"t":[[2,3]]}' AS gone, a || '},"t":[1,[2,3]],"n":{"m":0}}' AS made FROM e""")
def json_deep_change(db):
    d = F.col("d")
    return _nested_events(db).select(
        "event_id", J.set_at(d, "$.p.z", F.col("event_type")).alias("put"), J.replace_at(d, "$.t[1][0]", F.lit(9)).alias("replaced"), J.insert_at(d, "$.t[1][#]", F.lit(4)).alias("grown"),
        J.remove_at(d, "$.p.k", "$.t[0]").alias("gone"), J.insert_at(d, "$.n.m", F.lit(0)).alias("made"),
    )


@query("""SELECT event_id, '{"id":' || event_id || ',"p":{"k":' || (props ->> '$.k') || ',"n":{"type":"' || event_type || '"}}}' AS merged, CASE WHEN event_type = 'view' THEN 2 ELSE 0 END::BIGINT AS wrong FROM events""")
def json_merge_patch(db):
    change = F.concat(F.lit('{"t":null,"p":{"n":{"type":"'), F.col("event_type"), F.lit('","no":null}}}'))
    broken = F.when(F.col("event_type") == "view", F.lit("{")).otherwise(F.col("props"))
    return _nested_events(db).select("event_id", J.merge_patch("d", change).alias("merged"), J.error_position(broken).alias("wrong"))


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k, event_type AS t FROM events")
def json_binary(db):
    stored = db.df("events").select("event_id", J.binary(J.set_at(F.col("props"), "$.t", F.col("event_type"))).alias("v"))
    return stored.select("event_id", J.binary_extract(F.col("v"), "$.k", "long").alias("k"), J.binary_extract(F.col("v"), "$.t", "string").alias("t"))


@query("SELECT p_partkey, list_aggregate(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS titled, hex(p_brand) AS bytes, round(p_retailprice, 1) AS about, trim(p_name, 'P') AS bare, nullif(p_size, 7) AS size, printf('%05d', p_partkey) AS padded FROM part")
def text_forms(db):
    c = F.col
    return db.df("part").select("p_partkey", D.capitalized(c("p_type")).alias("titled"), F.hex("p_brand").alias("bytes"), F.round("p_retailprice", 1).alias("about"), F.btrim("p_name", F.lit("P")).alias("bare"), F.nullif(c("p_size"), F.lit(7)).alias("size"), F.format_string("%05d", "p_partkey").alias("padded"))


@query("SELECT event_id, ts + INTERVAL 2 HOUR AS east, ts - INTERVAL 2 HOUR AS back FROM events")
def date_zones(db):
    t = F.col("ts").cast("timestamp")
    return db.df("events").select("event_id", D.to_local(t, "+02:00").cast("timestamp_ntz").alias("east"), D.to_utc(t, "+02:00").cast("timestamp_ntz").alias("back"))


@query("SELECT count(DISTINCT x) AS dates, count(*) AS n FROM (SELECT current_date AS x FROM orders)")
def current_moment(db):
    """The moment is one for a whole query."""
    return db.df("orders").select(F.current_timestamp().alias("x")).agg(F.count_distinct("x").alias("dates"), F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE rtrim(c_mktsegment || '  ') = 'BUILDING'")
def filter_trimmed(db):
    """Equality that passes over blanks at the end."""
    return db.df("customer").filter(F.collate(F.concat("c_mktsegment", F.lit("  ")), "UTF8_BINARY_RTRIM") == F.lit("BUILDING")).select("c_custkey")


@query("SELECT c_custkey, upper(replace(c_mktsegment, 'i', 'İ')) AS turkish FROM (SELECT c_custkey, lower(c_mktsegment) AS c_mktsegment FROM customer)")
def text_localized(db):
    """Upper case by Turkish rules, where i becomes a dotted capital."""
    return db.df("customer").select("c_custkey", D.upper_in(F.lower("c_mktsegment"), "tr").alias("turkish"))


@query("SELECT p_partkey, p_name = 'PART_7' AS exact, lower(p_name) = 'part_7' AS folded, rtrim(p_name || ' ') = p_name AS trimmed FROM part")
def text_collations(db):
    c = F.col("p_name")
    return db.df("part").select("p_partkey", (D.collated(c, "binary") == "PART_7").alias("exact"), (D.collated(c, "nocase") == "PART_7").alias("folded"), (D.collated(F.concat(c, F.lit(" ")), "rtrim") == D.collated(c, "rtrim")).alias("trimmed"))

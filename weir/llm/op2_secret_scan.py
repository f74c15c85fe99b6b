"""Secret scans by a trigram inverted index, with DataFrame functions only.

Each rule's regular expression gives a Boolean query: alternatives (OR) of trigrams that a match must hold (AND),
in lower case. The index has one posting (trigram, key of the text) for each trigram that some query asks for. Postings
meet the queries on the trigram and intersect per text by a bitwise OR; a full mask makes the text a
candidate of the rule. Only keys and masks are shuffled: the candidates, if counted to be few enough to broadcast, come to the documents. Candidates
are verified with the expression itself. Rules without mandatory trigrams scan every text.

Positions come from the pieces between matches: split() gives the texts between and regexp_extract_all() the
matches, whose lengths add up to the starts. Sums are taken in blocks of the root of their number, so that texts of very many secrets stay quick.

Defined results: null text is empty. Rows that repeat a doc_id, or have none, each get their own spans. Other
columns pass through unchanged, whatever their names, but a column _spans is replaced by scan(). Adjacent or overlapping spans stay separate; ties on the start
follow the rules' order.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, small, table, whole_text, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret. group and least: that group of a match must have so many characters, or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The first three are the base rules; the others add spans of widely documented token formats.
RULES = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the same as runs of [0-9a-f]+ of which those under 24 are dropped
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
MOST_ALTERNATIVES = 64


def alternatives(tree) -> list[list[str | None]]:
    """What a match looks like: alternative sequences of literal texts and gaps (None)."""
    out: list[list[str | None]] = [[]]
    for op, arg in tree:
        if op is C.LITERAL:
            choice = [[chr(arg).lower()]]
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 8:
            choice = [[chr(a).lower()] for _, a in arg]
        elif op is C.SUBPATTERN:
            choice = alternatives(arg[3])
        elif op is C.BRANCH:
            choice = [x for branch in arg[1] for x in alternatives(branch)]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[:2] == (0, 1):
            choice = [[], *alternatives(arg[2])]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            inner = alternatives(arg[2])
            choice = [x + [None] for x in inner] if len(inner) < 9 else [[None]]
        elif op is C.AT:
            choice = [[]]
        else:
            choice = [[None]]
        out = [a + b for a in out for b in choice] if len(out) * len(choice) <= MOST_ALTERNATIVES else [a + [None] for a in out]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The trigrams of each alternative; an empty list if one alternative has none, as then every text must be scanned."""
    found = set()
    for sequence in alternatives(_parser.parse(re.sub(r"^\(\?i\)", "", pattern))):
        runs = "".join("\0" if x is None else x for x in sequence).split("\0")
        grams = frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2))
        if not grams:
            return []
        found.add(grams)
    return sorted((g for g in found if not any(h < g for h in found)), key=sorted)  # a weaker alternative covers a stronger one


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """key (xxhash64 of the text), kinds (bits of the rules' places): the texts that meet the query of some rule with trigrams."""
    queries = [(rank, n, grams) for rank, r in enumerate(rules) for n, grams in enumerate(trigram_query(r.pattern))]
    terms = [(gram, rank, n, 1 << i, (1 << len(grams)) - 1) for rank, n, grams in queries for i, gram in enumerate(sorted(grams))]
    wanted = sorted({t[0] for t in terms})
    if not wanted:
        return docs.sparkSession.createDataFrame([], "key long, kinds long")
    texts = docs.select(F.xxhash64(whole_text()).alias("key"), F.lower(whole_text()).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in wanted]))
    index = texts.select("key", F.explode(held).alias("gram"))
    rows = ", ".join(f"({sql_text(g)}, {rank}, {n}, {bit}L, {mask}L)" for g, rank, n, bit, mask in terms)
    asked = docs.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(gram, rank, alternative, bit, mask)")
    met = (
        index.join(F.broadcast(asked), "gram")  # a row for each trigram of the rules
        .groupBy("key", "rank", "alternative", "mask")
        .agg(F.bit_or("bit").alias("bits"))
        .filter("bits = mask")
    )
    return met.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, rank)")).alias("kinds"))


def sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: start and end in code points, from and to in bytes.
SPAN = "struct<start:int,rank:int,kind:string,end:int,from:int,to:int>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once."""
    return F.transform(F.array(value), f)[0]


def running(values: Column, fold: Callable[[Column], Column], two: Callable[[Column, Column], Column]) -> Column:
    """Running sums or maxima of a non-empty array of numbers, by blocks of the root of its length: fold of an array, two values folded."""

    def over(a: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(a))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / size).cast("int") - 1), lambda b: F.slice(a, b * size + 1, size))
        inner = lambda x: F.transform(x, lambda v, i: fold(F.slice(x, F.lit(1), i + 1)))

        def joined(parts: Column) -> Column:
            tops = F.transform(parts, fold)
            return let(tops, lambda t: F.flatten(F.transform(parts, lambda x, b: F.when(b == 0, inner(x)).otherwise(let(fold(F.slice(t, F.lit(1), F.greatest(b, F.lit(1)))), lambda base: F.transform(inner(x), lambda v: two(base, v)))))))

        return let(blocks, joined)

    return let(values, over)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def running_sum(values: Column) -> Column:
    return running(values, total, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return running(values, F.array_max, F.greatest)


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """All spans of a rule: leftmost matches that do not overlap, less those that fail its length."""
    pattern = F.lit(rule.pattern)

    def found(hits: Column, gaps: Column) -> Column:
        before = F.slice(gaps, F.lit(1), F.size(hits))
        ends = running_sum(F.zip_with(before, hits, lambda g, h: F.length(g) + F.length(h)))
        tos = running_sum(F.zip_with(before, hits, lambda g, h: F.octet_length(g) + F.octet_length(h)))
        span = lambda e, t, h, i: F.struct(
            (F.element_at(e, i + 1) - F.length(h)).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), F.element_at(e, i + 1).alias("end"),
            (F.element_at(t, i + 1) - F.octet_length(h)).alias("from"), F.element_at(t, i + 1).alias("to"),
        )
        kept = lambda h: F.length(F.regexp_extract(h, rule.pattern, rule.group)) >= rule.least
        every = let(ends, lambda e: let(tos, lambda t: F.transform(hits, lambda h, i: F.when(kept(h), span(e, t, h, i)))))
        return F.array_compact(every)

    none = F.array().cast(f"array<{SPAN}>")
    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda hits: F.when(F.size(hits) == 0, none).otherwise(let(F.split(text, rule.pattern, -1), lambda gaps: found(hits, gaps))))


def scanned(docs: DataFrame, rules: tuple[Rule, ...], name: str) -> DataFrame:
    """docs with a column of all spans by start, then the rules' order."""
    key, kinds = fresh(docs, "key", "kinds")
    found = written(candidates(docs, rules)).select(F.col("key").alias(key), F.col("kinds").alias(kinds))
    marked = docs.withColumn(key, F.xxhash64(whole_text())).join(small(found), key, "left")
    each = []
    for rank, rule in enumerate(rules):
        spans = spans_of(whole_text(), rule, rank)
        if trigram_query(rule.pattern):
            spans = F.when(F.coalesce(F.col(kinds), F.lit(0)).bitwiseAND(F.lit(1 << rank)) != 0, spans).otherwise(F.array().cast(f"array<{SPAN}>"))
        each.append(spans)
    return marked.select(*[F.col(quoted(c)) for c in docs.columns if c.lower() != name.lower()], F.array_sort(F.concat(*each)).alias(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with _spans: array of (start, rank, kind, end), in code points, by start, then the rules' order."""
    return scanned(docs, rules, "_spans").withColumn("_spans", F.transform("_spans", lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"])))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """docs with each span's text replaced by the mask (touching spans by one mask); n_chars follows the text if it is there."""
    (name,) = fresh(docs, "spans")

    def kept(spans: Column, raw: Column, most: Column) -> Column:
        """The text between the spans. most: by place, how far the spans up to there reach."""
        firsts = F.array_compact(F.transform(spans, lambda s, i: F.when((i == 0) | (s["from"] > F.element_at(most, F.greatest(i, F.lit(1)))), F.struct(s["from"].alias("from"), i.alias("at")))))

        def pieces(g: Column) -> Column:
            reach = F.transform(g, lambda x, j: F.element_at(most, F.when(j + 1 < F.size(g), F.element_at(g, F.least(j + 2, F.size(g)))["at"]).otherwise(F.size(most))))
            between = lambda r: F.transform(g, lambda x, j: piece(F.when(j == 0, 0).otherwise(F.element_at(r, F.greatest(j, F.lit(1)))), x["from"]))
            return let(reach, lambda r: F.concat(between(r), F.array(piece(F.element_at(r, -1), F.length(raw)))))

        piece = lambda a, b: F.substring(raw, a + 1, b - a).cast("string")
        return F.array_join(let(firsts, pieces), mask)

    some = F.size(name) > 0
    reach = running_max(F.transform(name, lambda s: s["to"]))
    text = F.when(some, let(F.col("text").cast("binary"), lambda raw: let(reach, lambda most: kept(F.col(name), raw, most)))).otherwise(F.col("text"))
    out = scanned(docs, rules, name).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[quoted(c) for c in docs.columns])


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_spans")
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("_spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def _duck_spans(rank: int, rule: Rule, pattern: str) -> str:
    """Spans of one rule in DuckDB's SQL, from the same pieces and matches."""
    return f"""
      SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, start, start + len(hits[i]) AS "end" FROM (
        SELECT doc_id, hits, tested, i, list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x))), 0) AS start FROM (
          SELECT doc_id, hits, tested, gaps, unnest(generate_series(1, len(hits))) AS i FROM (
            SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {rule.group}) AS tested, string_split_regex(t, '{pattern}') AS gaps
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))))
      WHERE len(tested[i]) >= {rule.least}"""


def _duck() -> str:
    letters = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    assign = f"({'|'.join(letters(w) for w in ('password', 'passwd', 'secret', 'token', 'api_?key'))})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    patterns = [assign, *(r.pattern for r in RULES[1:])]
    everything = " UNION ALL ".join(_duck_spans(i, r, p) for i, (r, p) in enumerate(zip(RULES, patterns, strict=True)))
    text = "kind || ':' || start || ':' || \"end\""
    return f"""
    WITH spans AS ({everything}),
    per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg({text}, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg({text}, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents d LEFT JOIN per ON d.doc_id = per.doc_id"""


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLE_SQL = {"op2_secret_scan": _duck()}

"""Secret scans through a trigram inverted index, with DataFrame expressions only.

Each rule's pattern is parsed into a Boolean query over lower-cased trigrams: an OR of clauses, each an AND of trigrams
that every match must hold. The index posts, for each trigram that some rule asks for, the ids of the documents that
hold it, in blocks of ids. A clause intersects its postings, a rule unites its clauses, and only these candidates are
verified with the pattern itself. A rule without mandatory trigrams scans every text.

Defined cases. Null text: as an empty one, no spans. Null doc_id: can't be posted, so its text is scanned by every rule.
Rows that share a doc_id share candidacy, and each is verified by itself. No rows: no rows. Extra columns are kept by
:func:`redact` and ignored by :func:`scan`.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Clauses = list[frozenset[str]] | None


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a regular expression that Python and Java read alike; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The rules of the contract, in its order. A run of the hex and access classes shorter than asked for can't hide a longer one, so their length stands in the pattern.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES
#: Ids in a posting list's block, and strings that a part of a pattern may expand to.
BLOCK, EXPANSIONS = 512, 64
#: Spans of a text that are put together at a time.
PART = 256
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,ok:boolean>>"


def _trigrams(s: str) -> frozenset[str]:
    s = s.lower()
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _simplest(clauses: Clauses) -> Clauses:
    """Without clauses that another implies; None (anything) if one asks for nothing."""
    if clauses is None or not all(clauses):
        return None
    return [c for c in dict.fromkeys(clauses) if not any(o < c for o in clauses)]


def _both(x: Clauses, y: Clauses) -> Clauses:
    if x is None or y is None:
        return y if x is None else x
    return _simplest([a | b for a in x for b in y])


def _parts(op, arg) -> tuple[set[str] | None, Clauses]:
    """(every string the node matches, if they are few, else None; the node's own query)."""
    if op is sre.LITERAL:
        return {chr(arg)}, None
    if op is sre.IN:
        found: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                found.add(chr(value))
            elif kind is sre.RANGE and value[1] - value[0] < EXPANSIONS:
                found |= {chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return None, None
        return (found, None) if len(found) <= 8 else (None, None)
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        each = [_sequence(x) for x in arg[1]]
        if all(x[0] is not None for x in each) and sum(len(x[0]) for x in each) <= EXPANSIONS:
            return set().union(*(x[0] for x in each)), None
        queries = [_simplest([_trigrams(s) for s in x[0]]) if x[0] is not None else x[1] for x in each]
        return None, None if any(q is None for q in queries) else _simplest([c for q in queries for c in q])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        strings, query = _sequence(body)
        if strings is not None and high != sre.MAXREPEAT and len(strings) ** high <= EXPANSIONS and high <= 4:
            out, runs = set(), {""}
            for k in range(int(high) + 1):
                out |= runs if k >= low else set()
                runs = {a + b for a in runs for b in strings}
            return (out, None) if len(out) <= EXPANSIONS else (None, None)
        if not low:
            return None, None
        return None, _simplest([_trigrams(s) for s in strings]) if strings is not None else query
    if op is sre.AT:
        return {""}, None
    return None, None


def _sequence(nodes) -> tuple[set[str] | None, Clauses]:
    run: set[str] = {""}
    query: Clauses = None
    whole = True
    flush = lambda: _both(query, _simplest([_trigrams(s) for s in run]))
    for op, arg in nodes:
        strings, own = _parts(op, arg)
        if strings is not None and len(run) * len(strings) <= EXPANSIONS:
            run = {a + b for a in run for b in strings}
            continue
        query, whole = flush(), False
        run = strings if strings is not None else {""}
        query = _both(query, own)
    return (run, None) if whole else (None, flush())


def trigram_query(pattern: str) -> Clauses:
    """An OR of ANDs of trigrams that each match of ``pattern`` must hold; None if there are none."""
    strings, query = _sequence(sre_parser.parse(pattern))
    return _simplest([_trigrams(s) for s in strings]) if strings is not None else query


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(block, trigram, ids): the sorted-out postings of ``trigrams``, a row for each block of ids."""
    held = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("low"))
    found = held.select("doc_id", F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams])).alias("held"))
    posted = found.select(F.floor(F.col("doc_id") / BLOCK).alias("block"), "doc_id", F.explode_outer("held").alias("trigram")).filter("trigram IS NOT NULL")
    return posted.groupBy("block", "trigram").agg(F.collect_set("doc_id").alias("ids"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram queries a document meets."""
    postings = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("at"))
    none = F.array().cast("array<bigint>")
    of = lambda t: F.coalesce(F.element_at("at", F.lit(t)), none)
    named = lambda ids, kind: F.transform(ids, lambda x: F.struct(x.alias("doc_id"), F.lit(kind).alias("kind")))
    met = [named(reduce(F.array_union, [reduce(F.array_intersect, [of(t) for t in sorted(c)]) for c in clauses]), kind) for kind, clauses in queries.items()]
    return postings.select(F.explode(F.concat(*met)).alias("c")).groupBy("c.doc_id").agg(F.collect_set("c.kind").alias("kinds"))


def _folded(items: Column, measure: Callable, joined: Callable, fold: Callable) -> Column:
    """Array of fold(part, carry) for parts of ``PART`` neighbouring items; the carry is ``joined`` over the measures of the parts
    before. Arrays grow by copying, so parts keep the work of many items from growing with their square."""
    bound = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  evaluated once
    last = lambda p: F.greatest(F.floor((F.size(p) - 1) / PART), F.lit(0))
    cut = lambda p: F.transform(F.sequence(F.lit(0).cast("long"), last(p)), lambda k: F.slice(p, (k * PART + 1).cast("int"), F.lit(PART)))
    carries = lambda parts: F.aggregate(F.transform(parts, measure), F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(joined(F.element_at(acc, -1), x))))
    each = lambda parts: bound(carries(parts), lambda c: F.transform(parts, lambda part, k: fold(part, F.element_at(c, k + 1))))
    return bound(items, lambda p: bound(cut(p), each))


def _spans(rule: Rule, nth: int, body: Column) -> Column:
    """[(start, order, end, kind)] of the rule's matches in code points, in order."""
    pairs = F.arrays_zip(F.split(body, rule.pattern, -1).alias("gap"), F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(0)).alias("hit"))
    long_ = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        size = F.length(F.regexp_extract(x["hit"], rule.pattern, rule.group) if rule.group else x["hit"])
        ok = x["hit"].isNotNull() & (size >= rule.least)
        one = F.struct(start.alias("start"), F.lit(nth).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"), ok.alias("ok"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    measure = lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + long_(x))
    fold = lambda part, at: F.aggregate(part, F.struct(at.alias("at"), F.array().cast(SPANS).alias("out")), step, lambda acc: acc["out"])
    return F.filter(F.flatten(_folded(pairs, measure, lambda a, b: a + b, fold)), lambda x: x["ok"])


def find_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, into: str = "spans") -> DataFrame:
    """``docs`` with, as ``into``, the (start, rank, end, kind, ok) of every secret, by start and then the rules' order."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    vocabulary = sorted(set().union(*(c for q in queries.values() for c in q)))
    if vocabulary:
        found = candidates(trigram_index(docs, vocabulary), queries).select(F.col("doc_id").alias("_secret_doc"), F.lit(0).alias("_secret_salt"), F.col("kinds").alias("_secret_kinds"))
        # rows without an id have no candidates to meet; a salt of their texts spreads them
        salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(4096)).cast("int") + 1).otherwise(0)
        joined = docs.join(found, (docs["doc_id"].cast("long") == found["_secret_doc"]) & (salt == found["_secret_salt"]), "left").drop("_secret_doc", "_secret_salt")
    else:
        joined = docs.withColumn("_secret_kinds", F.array().cast("array<string>"))
    nothing = F.array().cast(SPANS)
    each = []
    for n, rule in enumerate(rules):
        # a rule's candidates are verified; one without trigrams is tried on every text
        due = F.coalesce(F.array_contains("_secret_kinds", rule.kind), F.lit(False)) | F.col("doc_id").isNull() if rule.kind in queries else F.lit(True)
        each.append(F.when(due & F.col("text").rlike(rule.pattern), _spans(rule, n, F.col("text"))).otherwise(nothing))
    return joined.withColumn(into, F.array_sort(F.concat(*each))).drop("_secret_kinds")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count for each base rule, the digest of the base spans, all spans as text, for every row of ``docs``."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    spans = find_spans(slim, rules).select("doc_id", "spans")
    told = lambda xs: F.concat_ws(",", F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = [r.kind for r in rules if r.base]
    of_kind = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in base]
    return spans.select("doc_id", *counts, F.sha2(told(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret's characters replaced by ``mark`` (overlapping spans by one), and n_chars brought up to date."""
    kept, mine = docs.columns, "_secret_spans"
    found = find_spans(docs, rules, mine)

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        fresh = x["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"]).alias("out"))

    ends = lambda part: F.coalesce(F.array_max(F.transform(part, lambda x: x["end"])), F.lit(0))
    fold = lambda part, at: F.aggregate(part, F.struct(at.alias("at"), F.array().cast("array<string>").alias("out")), step, lambda acc: F.concat_ws("", acc["out"]))
    parts = _folded(F.col(mine), ends, F.greatest, fold)
    text = F.when(F.size(mine) > 0, F.concat(F.concat_ws("", parts), F.substring(F.col("text"), ends(F.col(mine)) + 1, F.length("text")))).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in kept:
        out = out.withColumn("n_chars", F.when(F.size(mine) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*kept)


def op1_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """DuckDB SQL for the same rows: every rule on every text, places from the lengths of matches and of what lies between."""
    found = []
    for rank, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        least = f"length(regexp_extract(hit[i], '{pattern}', {r.group}))"
        places = "coalesce(list_sum(list_transform(gap[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0)"
        texts = f"SELECT doc_id, string_split_regex(text, '{pattern}') AS gap, regexp_extract_all(text, '{pattern}') AS hit FROM documents WHERE regexp_matches(text, '{pattern}')"
        split = f"SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM ({texts})"
        found.append(f"SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, {str(r.base).lower()} AS base, CAST({places} AS BIGINT) AS first, length(hit[i]) AS size FROM ({split}) WHERE {least} >= {r.least}")
    told = "string_agg(kind || ':' || first || ':' || (first + size), ',' ORDER BY first, rank)"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    return f"""WITH s AS ({' UNION ALL '.join(found)}),
a AS (SELECT doc_id, {counts}, {told} FILTER (base) AS base, {told} AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id"""


OP1_SQL = _sql()

"""Operator 7: secrets in texts by a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression. From it a Boolean trigram query is derived. The inverted index has, for each trigram
that the queries ask for, sorted postings: the numbers of the rows that hold it, cut into chunks of a bounded number of
rows. A query intersects postings, shortest first, and unites them; only rows that remain are searched with the
expression. Rules without a mandatory trigram are run on every text.

The trigrams are fixed by the rules and not by the data: of each conjunction the two that prose has least, so building
looks for fewer strings than a scan has rules to run. ``build_index`` may be stored and used for any rules of the same
trigrams. Row numbers are hashes of (id, text). Postings and candidates are narrow tables; texts are exchanged only where
the candidates are too many for a broadcast, whose size Spark checks on the stored table.

Defined cases: a null text is an empty one; a null id is a value of its own; rows that share an id each get the spans of
their own text; rows that are equal share a number and get the same spans; spans are in code points, end exclusive;
of one rule they are leftmost and don't overlap, of different rules they may.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.spans import SPAN, cut_spans, find_spans, join_spans, merge_spans
from tessera.llm.storage import materialize
from tessera.llm.trigrams import Query, thinned, trigram_query, trigrams

CHUNK_ROWS = 65_536


@dataclass(frozen=True)
class Rule:
    """A secret's form; ``keep`` says by a span's text whether it counts, ``pattern`` is valid for Java and Python."""

    kind: str
    pattern: str
    base: bool = False
    least_value: tuple[int, int] | None = None  # (group, code points) that the match must have


#: The base rules' patterns as stated by the contract, with the least lengths folded in where a run is
#: always taken whole.
_ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
RULES = (
    Rule("assign", _ASSIGN, base=True, least_value=(2, 8)),
    Rule("access", "AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", "[0-9a-f]{32,}", base=True),
    Rule("private_key", "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("repo_token", "gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("live_key", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("map_key", "AIza[A-Za-z0-9_-]{35}"),
)


def _queries(rules: tuple[Rule, ...]) -> list[Query]:
    return [thinned(trigram_query(r.pattern)) for r in rules]


def _number(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Postings (chunk, gram, rows): the ascending numbers of a chunk's rows that hold a trigram."""
    grams = sorted(set().union(*map(trigrams, _queries(rules))))
    chunks = max(1, -(-docs.count() // chunk_rows))
    low = docs.select(_number(F.col(id_col), F.col(text_col)).alias("number"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)).cast("array<string>"))
    rows = low.select("number", F.explode(held).alias("gram"))
    return rows.groupBy(F.pmod("number", F.lit(chunks)).alias("chunk"), "gram").agg(F.array_sort(F.collect_set("number")).alias("rows"))


def _rows_of(query: Query, postings: Column) -> Column:
    """The rows that satisfy a query, from a map of postings."""
    none = F.array().cast("array<long>")
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(postings, F.lit(query)), none)
    parts = F.array(*(_rows_of(p, postings) for p in query[1]))
    if query[0] == "or":
        return F.array_distinct(F.flatten(parts))
    shortest_first = F.array_sort(parts, lambda a, b: F.size(a) - F.size(b))
    return F.aggregate(F.slice(shortest_first, 2, len(query[1])), F.element_at(shortest_first, 1), F.array_intersect)


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(number, rule numbers) of the rows that satisfy some rule's query."""
    chunks = index.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("gram", "rows"))).alias("postings"))

    def hits_of(query: Query, rule: int) -> Column:
        return F.transform(_rows_of(query, F.col("postings")), lambda r: F.struct(r.alias("number"), F.lit(rule).alias("rule")))

    found = [hits_of(q, k) for k, q in enumerate(_queries(rules)) if q is not True]
    hits = chunks.select(F.explode(F.concat(*found) if found else F.array().cast("array<struct<number:long,rule:int>>")).alias("hit"))
    return hits.groupBy("hit.number").agg(F.collect_set("hit.rule").alias("rules"))


def _verified(rule: Rule, number: int, needs_index: bool) -> Column:
    spans = find_spans(F.col("text"), rule.pattern, F.array_contains("rules", number) if needs_index else None)
    if rule.least_value is None:
        return spans
    group, least = rule.least_value
    return F.filter(spans, lambda s: F.length(F.regexp_extract(s.txt, rule.pattern, group)) >= least)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """Every row with an array of spans (start, end, txt, before, after) by rule, in columns named as the rules' kinds.

    Columns: doc_id, text (null as empty), row (a struct of all columns of docs), then one for each rule. ``index`` may be
    a stored build_index().
    """
    index = materialize(build_index(docs, rules, id_col, text_col), "postings") if index is None else index
    found = materialize(candidates(index, rules), "candidates")
    rows = docs.select(_number(F.col(id_col), F.col(text_col)).alias("number"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct("*").alias("row"))
    joined = rows.join(found, "number", "left")
    return joined.select("doc_id", "text", "row", *(_verified(r, k, trigram_query(r.pattern) is not True).alias(r.kind) for k, r in enumerate(rules)))


def secret_digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base rules, a digest of their spans and all spans as text."""
    base = [r.kind for r in rules if r.base]
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(join_spans(base, [F.col(k) for k in base]), 256).alias("base_sha256"),
        join_spans([r.kind for r in rules], [F.col(r.kind) for r in rules]).alias("spans"),
    )


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, clean_text): every found span, overlapping ones as one, replaced by ``mark``."""
    return _cleaned(docs, mark, rules, id_col, text_col).select("doc_id", "clean_text")


def _cleaned(docs: DataFrame, mark: str, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    found = find_secrets(docs, rules, id_col, text_col).select("doc_id", "row", "text", F.concat(*(F.col(r.kind) for r in rules)).alias("all"))
    return found.select("doc_id", "row", F.when(F.size("all") > 0, cut_spans(F.col("text"), merge_spans(F.col("all")), mark)).otherwise(F.col("text")).alias("clean_text"))


def without_secrets(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their secrets replaced by ``mark``; an ``n_chars`` column follows."""
    new = {text_col: F.col("clean_text"), "n_chars": F.char_length("clean_text").cast("long")}
    return _cleaned(docs, mark, rules, id_col, text_col).select(*(new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))


__all__ = ["RULES", "SPAN", "Rule", "build_index", "candidates", "find_secrets", "redact_secrets", "secret_digest", "without_secrets"]

"""Operator 1: secret scans over a trigram inverted index, with DataFrame functions only.

Each rule is a regular expression. A Boolean query over trigrams, ANDs of ORs of ANDs, is derived from it
that the text of every match satisfies. The index has one posting list for each trigram and block of
documents; lists are intersected and united by the query, and the candidates that come out are verified with
the expression on the whole text. A rule whose expression has no mandatory trigram scans every text: of
``RULES`` that is ``hex`` alone.

A literal run asks for every third of its trigrams, side by side, not for all of them; the index holds the
trigrams that the queries ask for. Texts are lowered once for each document.

Defined results: null and empty texts have no spans (digest of the empty string); rows that repeat a
doc_id share its postings and are each verified; rows with a null doc_id are in no posting list and
are verified in full; a doc_id may be of any type; equal starts order by kind as the rules are listed; other
columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import small_side, table

BLOCK = 1024
MOST_RUNS = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches; group ``part`` needs ``least`` characters, else the match drops."""

    kind: str
    pattern: str
    part: int = 0
    least: int = 1
    any_case: bool = False


# The three kinds every scan reports, then the kinds this operator adds.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("github_pat", r"github_pat_[A-Za-z0-9_]+", 0, 60),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]+", 0, 26),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    # the whole block; without an end line, the header and the unbroken base-64 lines after it
    Rule("private_key", r"-----BEGIN (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----(?:\s*(?:[A-Za-z-]{1,30}:[^\n]*\n){0,8}[A-Za-z0-9+/=\s]*-----END (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----|[A-Za-z0-9+/=\r\n]*)"),
)
RULES = BASE_RULES + MORE_RULES


# ------------------------------------------------------------------ regex -> Boolean trigram query

#: A query is a trigram (str), ("and", *queries) or ("or", *queries); ALL, an AND of nothing, holds anywhere.
ALL = ("and",)


def _cover(run: str) -> tuple:
    """The AND of every third trigram of a literal run; ALL for shorter runs. A longer run asks for what its
    beginning asks for, so it drops out beside it in an OR."""
    return ("and", *dict.fromkeys(run[i : i + 3] for i in range(0, len(run) - 2, 3)))


def _all_of(queries: list) -> tuple:
    parts = [*dict.fromkeys(p for q in queries for p in (q[1:] if q[0] == "and" else (q,)))]
    return parts[0] if len(parts) == 1 and parts[0][0] == "or" else ("and", *parts)


def _any_of(queries: list) -> tuple:
    """ALL if one of the alternatives asks for nothing; alternatives that ask for more than another go."""
    asked = [frozenset(q[1:]) if q[0] == "and" else frozenset([q]) for q in queries]
    kept = [q for i, q in enumerate(queries) if not any(o < asked[i] or (o == asked[i] and j < i) for j, o in enumerate(asked))]
    return ALL if ALL in kept else kept[0] if len(kept) == 1 else ("or", *kept)


def _strings(op: str, arg) -> list[str] | None:
    """All strings that a node can match, if few."""
    if op == "LITERAL":
        return [chr(arg)]
    if op == "IN" and len(arg) <= 8 and all(str(o) == "LITERAL" for o, _ in arg):
        return [chr(c) for _, c in arg]
    if op == "SUBPATTERN":
        return _sequence_strings(arg[-1])
    if op == "BRANCH":
        options = [_sequence_strings(branch) for branch in arg[1]]
        return None if None in options else [x for o in options for x in o]
    if op in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 3:
        one = _sequence_strings(arg[2])
        out, last = [], [""]
        for n in range(arg[1] + 1 if one is not None else 0):
            out += last if n >= arg[0] else []
            last = [a + b for a in last for b in one][: MOST_RUNS + 1]
        return out or None
    return None


def _sequence_strings(tree) -> list[str] | None:
    out = [""]
    for op, arg in tree:
        one = _strings(str(op), arg)
        if one is None or len(out) * len(one) > MOST_RUNS:
            return None
        out = [a + b for a in out for b in one]
    return out


def _query(tree) -> tuple:
    """The query of a sequence: runs of nodes with few strings give an OR of their trigrams; other nodes give
    what they ask for themselves and end the run."""
    asked, runs = [], [""]

    def end_run() -> None:
        nonlocal runs
        asked.append(_any_of([_cover(r.lower()) for r in runs]))
        runs = [""]

    for op, arg in tree:
        name, strings = str(op), _strings(str(op), arg)
        if strings is not None and len(runs) * len(strings) <= MOST_RUNS:
            runs = [a + b for a in runs for b in strings]
            continue
        end_run()
        if strings is not None and len(strings) <= MOST_RUNS:
            runs = strings
        elif name == "SUBPATTERN":
            asked.append(_query(arg[-1]))
        elif name == "BRANCH":
            asked.append(_any_of([_query(branch) for branch in arg[1]]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            asked.append(_query(arg[2]))
    end_run()
    return _all_of(asked)


def trigram_query(pattern: str) -> tuple | None:
    """The query over lower-case trigrams that each match satisfies; None: scan fully."""
    query = _query(re._parser.parse(pattern))
    return None if query == ALL else query


def trigrams(query: tuple | str) -> set[str]:
    return {query} if isinstance(query, str) else {g for q in query[1:] for g in trigrams(q)}


# ------------------------------------------------------------------ index


def _block_of(docs: DataFrame, key: str) -> Column:
    """Blocks of ``BLOCK`` consecutive ids; ids that are not whole numbers are dealt by hash."""
    if isinstance(docs.schema[key].dataType, T.IntegralType):
        return F.floor(F.col(key) / BLOCK).cast("bigint")
    return F.shiftright(F.xxhash64(key), 40)


def build_index(docs: DataFrame, grams: list[str] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Posting lists (gram, block, ids): the sorted ids of a block's documents that hold the trigram.

    ``grams`` limits the index to the trigrams that queries ask for; None indexes every trigram. The lowered
    text is the variable of a lambda, so it is computed once for a document, not once for a trigram.
    """
    if grams is None:
        held = lambda low: F.array_distinct(F.transform(F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>")), lambda i: low.substr(i, F.lit(3))))
    else:
        held = lambda low: F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains(low, g))
    return (
        docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
        .select(F.col(key).alias("id"), _block_of(docs, key).alias("block"), F.explode(F.flatten(F.transform(F.array(F.lower(F.col(text))), held))).alias("gram"))
        .groupBy("gram", "block")
        .agg(F.array_sort(F.collect_set("id")).alias("ids"))
    )


def query_index(index: DataFrame, queries: dict[str, tuple]) -> DataFrame:
    """(id, rules): the documents that satisfy each rule's query, by work on the posting lists alone."""
    ids = index.schema["ids"].dataType
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("lists"))

    def found(query: tuple | str) -> Column:
        if isinstance(query, str):
            return F.coalesce(F.col("lists")[query], F.array().cast(ids))
        lists = [found(q) for q in query[1:]]
        out = lists[0]
        for other in lists[1:]:
            out = F.array_intersect(out, other) if query[0] == "and" else F.array_union(out, other)
        return out

    hits = [F.struct(F.lit(kind).alias("kind"), found(query).alias("ids")) for kind, query in queries.items()]
    if not hits:
        return index.select(F.explode("ids").alias("id"), F.array(F.lit("")).alias("rules")).where("false")
    return (
        blocks.select(F.explode(F.array(*hits)).alias("hit"))
        .select("hit.kind", F.explode("hit.ids").alias("id"))
        .groupBy("id")
        .agg(F.collect_set("kind").alias("rules"))
    )


# ------------------------------------------------------------------ verification


def _find(rule: Rule, text: Column) -> Column:
    """Spans (start, end) of a rule's matches in code points, leftmost and not overlapping.

    The text between matches (``split``) and the matches themselves give the positions.
    """
    pattern = F.lit(("(?i)" if rule.any_case else "") + rule.pattern)
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.part)) if rule.part else whole
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("hit"), part.alias("part"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    walk = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.when(
                F.length(x["part"]) >= rule.least,
                F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(x["gap"])).alias("start"), (s["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end")))),
            )
            .otherwise(s["spans"])
            .alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return F.when(F.rlike(text, pattern), walk).otherwise(none)


def _tight(rule: Rule) -> Rule:
    """A run of one class alone (with a fixed head) fails whole, so its least length goes in the pattern."""
    m = re.fullmatch(r"(?P<head>[A-Za-z0-9_]*)(?P<set>\[[^\]]*\])\+", rule.pattern)
    if m is None or rule.part or (m["head"] and not re.fullmatch(f"{m['set']}*", m["head"])):
        return rule
    return Rule(rule.kind, f"{m['head']}{m['set']}{{{max(1, rule.least - len(m['head']))},}}", 0, 1, rule.any_case)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id", rest: bool = False) -> DataFrame:
    """doc_id, text and the spans of each rule in a column of its kind, for every row of ``docs``; with
    ``rest`` also a struct ``rest`` of the whole row."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    grams = sorted({g for q in queries.values() for g in trigrams(q)})
    docs = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *([F.struct(*docs.columns).alias("rest")] if rest else []))
    hits = table(query_index(build_index(docs, grams), queries).withColumnRenamed("id", "hit_id"), "candidates")
    rows = docs.join(small_side(hits), F.col("doc_id") == F.col("hit_id"), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    found = []
    for r in rules:
        spans = _find(_tight(r), F.col("text"))
        if r.kind in queries:
            spans = F.when(F.array_contains("rules", r.kind) | F.col("doc_id").isNull(), spans).otherwise(none)
        found.append(spans.alias(r.kind))
    return rows.select("doc_id", "text", *(["rest"] if rest else []), *found)


def _as_text(kind: str, order: int) -> Column:
    return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")).alias("text")))


def _digest_text(kinds: list[str]) -> Column:
    parts = [_as_text(k, i) for i, k in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda x: x["text"]), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count for each base kind, the digest of the base spans, and all spans as text."""
    base = [r.kind for r in BASE_RULES]
    found = find_secrets(docs, rules)
    return found.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in base],
        F.sha2(_digest_text(base).cast("binary"), 256).alias("base_sha256"),
        _digest_text([r.kind for r in rules]).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs``, all columns, with each found span of ``text`` replaced by ``mark``.

    Overlapping spans are replaced as one; a null text stays null.
    """
    kinds = [r.kind for r in rules]
    found = find_secrets(docs, rules, rest=True)
    spans = F.array_sort(F.concat(*[F.col(k) for k in kinds]))
    text = F.col("text")
    walk = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], text.substr(s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).alias("out"),
        ),
        lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))),
    )
    clean = F.when(F.size(spans) > 0, walk).otherwise(F.col("rest.text"))
    return found.select(*[clean.alias("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns])

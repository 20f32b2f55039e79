"""Operator 12: how far the sources of a language are from each other and from their language, in whole numbers.

Plain relational. Terms are counted by (lang, source, term), with the documents that hold them, in one partial
aggregation; the terms that enough documents of a language hold are its vocabulary, a row each with the counts
of the groups that have it. Groups are crossed with the vocabulary, so that terms they lack count zero;
probabilities in parts of a thousand million (with one added to each count) then meet in a self-join on
(lang, term), which is keyed by term, so no language or source is one task, and are summed before they are
shuffled. Ranks are windows over (lang, source); Spark cuts the long lists to their first ranks in each task before
it brings them together.

Defined results: null text, lang and source are empty text; a document without terms still makes its group
occur; a language without vocabulary has pairs of value 0 and no terms; an empty table has no rows; repeated
documents count as often as they occur; other columns are not read. The pairs of sources are the result itself:
there are as many as a language's sources squared, and a term's row holds a language's sources at most.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import keyed_join, small_side, table

# What a term is, and the unit of probabilities.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000


@F.arrow_udf(T.StringType())
def lower_ascii(text: pa.Array) -> pa.Array:
    """A-Z lower-cased and nothing else, which Spark's ``lower`` is not and ``translate`` is slow at."""
    return pc.ascii_lower(text)


def probability(n: str, total: str) -> Column:
    """1 + UNIT * (n + 1) div (total + v); a count may pass what a long holds times the unit, hence the decimal."""
    return F.expr(f"1 + CAST({UNIT} AS DECIMAL(10,0)) * ({n} + 1) div ({total} + v)")


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it). A document gives its matches, and once
    more its distinct ones, which count it."""
    terms = F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))
    both = F.array(F.struct(F.col("terms"), F.lit(1).alias("n")), F.struct(F.array_distinct("terms").alias("terms"), F.lit(0).alias("n")))
    lists = docs.select(_empty("lang"), _empty("source"), terms.alias("terms")).select("lang", "source", F.explode(both).alias("t"))
    rows = lists.select("lang", "source", F.col("t.n").alias("n"), F.explode("t.terms").alias("term"))
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum(1 - F.col("n")).alias("docs"))


def vocabulary(counts: DataFrame, least_docs: int) -> DataFrame:
    """lang, term, n and ``held``, the counts (source, n) of the groups that have the term, of each kept term."""
    by = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))
    return by.where(F.col("docs") >= least_docs).drop("docs")


def group_sizes(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (kept occurrences), and their language's number of kept terms v and kept occurrences."""
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("v"))
    sums = kept.select("lang", F.explode("held").alias("h")).groupBy("lang", "h.source").agg(F.sum("h.n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("total"), zero("v"), zero("lang_total"))


def dense(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, term, source and p of every group and every kept term of its language, zeros included. ``kept`` and
    ``groups`` are written tables."""
    lists = groups.where("v > 0").groupBy("lang").agg(F.collect_list("source").alias("sources"), F.max("v").alias("size"))
    rows = keyed_join(kept.select("lang", "term", "held"), table(lists, "lists"), "lang")
    every = F.expr("concat(held, transform(array_except(sources, held.source), s -> named_struct('source', s, 'n', 0L)))")
    rows = rows.select("lang", "term", F.explode(every).alias("h")).select("lang", "term", "h.source", "h.n")
    return rows.join(small_side(groups), ["lang", "source"]).select("lang", "term", "source", probability("n", "total").alias("p"))


def divergence(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: each other source of the language by its divergence
    from the source, all of them. Part ``term``: the source's terms that are commoner there than in the
    language, by their share of the divergence from it, the first ``most_terms``.

    Vocabulary and group sizes are written when the frame is made.
    """
    kept = table(vocabulary(term_counts(docs), least_docs), "kept")
    groups = table(group_sizes(docs.select(_empty("lang"), _empty("source")).distinct(), kept), "groups")
    share, back = F.expr("(p - q) * (p - q) div q"), F.expr("(p - q) * (p - q) div p")

    rows = dense(kept, groups).repartition("lang", "term")
    other = rows.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    met = rows.join(other.hint("shuffle_hash"), ["lang", "term"]).where("source < item")  # a pair once, both ways
    both = met.groupBy("lang", "source", "item").agg(F.sum(share).alias("to"), F.sum(back).alias("fro"))
    ways = F.array(F.struct("source", "item", F.col("to").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("fro").alias("value")))
    sums = both.select("lang", F.explode(ways).alias("w")).select("lang", "w.*")
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))

    held = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("held").alias("h")).select("lang", "term", "lang_n", "h.source", "h.n")
    held = held.join(small_side(groups), ["lang", "source"])
    terms = held.select("lang", "source", "term", probability("n", "total").alias("p"), probability("lang_n", "lang_total").alias("q")).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), share.alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(by))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= most_terms))

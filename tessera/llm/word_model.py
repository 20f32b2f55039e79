"""An interpolated modified Kneser-Ney model of word trigrams, counted and looked up by Spark joins.

Words are runs of letters, digits and bytes from 128 up (A-Z lower-cased) or runs of other signs, each a
64-bit hash; two starts stand before a text and an end after it. Nothing of the model reaches the driver but
the discounts and three totals, so it grows with the trusted text.

ln p of a word is a sum over the n-grams that end at it or at the word before: with missing terms zero,
    ln p(w | u v) = gain3(u v w) + weight3(u v) + gain2(v w) + weight2(v) + gain1(w) + ln p(unknown)
where weight is the logarithm of a context's back-off weight and gain what an n-gram's own probability is
above that of backing off. So each n-gram of a document is looked up by itself: one join of the documents'
n-grams, counted by text, with the model on the n-gram's key finds all orders; the row of a text's length is
salted. N-grams with over 1 / ``HOT`` of the trusted words, fewer than ``HOT`` an order and role (the end of a
text, the starts, frequent words), are broadcast: a task sums them up by text, and only that sum travels.

Disk: the steps are written one after the other, and what Spark shuffled for one goes when it is written. The model
is joined by the word in the middle in up to ``ROUNDS`` parts, and the documents are read as often, each time for
the n-grams of one residue of the key; so a round's shuffle holds one part of all n-grams. Only sums by text are
kept of it. Tables of few n-grams need fewer rounds; the number has no part in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_view, remove, scratch, slices, word_hashes, word_spans

START, END = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
TAGS = (0x3C6EF372FE94F82B, 0x1F83D9ABFB41BD6B, 0x510E527FADE682D1)
SALTS = 1024
HOT = 1 << 18
PIECE = 1 << 21
ROUNDS = 8
ROUND_ROWS = 1 << 21
#: For the written steps: no shuffle file outlives its step, and a join of small partitions needs no sort.
STEP_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m"}
_CHUNK = 1 << 19

IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
IS_SIGN = ~IS_WORD
IS_SIGN[[9, 10, 11, 12, 13, 32]] = False


def rounds_for(rows: DataFrame) -> int:
    return min(ROUNDS, 1 + rows.count() // ROUND_ROWS)


class Steps:
    """Written tables of one session, dropped by ``drop`` when later steps no longer read them."""

    def __init__(self, df: DataFrame):
        self.spark, self.paths = df.sparkSession, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        was = {k: self.spark.conf.get(k) for k in STEP_CONF}
        try:
            for k, v in STEP_CONF.items():
                self.spark.conf.set(k, v)
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in was.items():
                self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, self.paths.pop(id(t)))


def sequences(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of rows: its first row, the words' hashes between starts and end, the row and the place of
    each. Rows without words have none."""
    offsets, data = byte_view(column)
    for lo, hi in slices(offsets, _CHUNK):
        spans = [word_spans(data, offsets[lo : hi + 1], kind) for kind in (IS_WORD, IS_SIGN)]
        starts = np.concatenate([s for s, _ in spans])
        hashes = np.concatenate([word_hashes(data, s, e) for s, e in spans])
        order = np.argsort(starts, kind="stable")
        row = np.searchsorted(offsets[lo : hi + 1], starts[order], side="right") - 1
        n = np.bincount(row, minlength=hi - lo)
        length = np.where(n > 0, n + 3, 0)
        first = np.cumsum(length) - length
        seq = np.full(int(length.sum()), START)
        seq[first[row] + 2 + np.arange(len(row)) - (np.cumsum(n) - n)[row]] = hashes[order]
        seq[(first + length - 1)[n > 0]] = END
        yield lo, seq, np.repeat(np.arange(hi - lo), length), np.arange(len(seq)) - np.repeat(first, length)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def keys(*words: np.ndarray) -> np.ndarray:
    """The key of n-grams: the words' hashes, turned by their place, and a tag of the order."""
    out = np.full(len(words[0]), np.uint64(TAGS[len(words) - 1]))
    for k, w in enumerate(reversed(words)):
        out = out ^ (_turned(w, 21 * k) if k else w)
    return out


def key_column(*words: str) -> Column:
    """The same key of columns."""
    out = F.lit(TAGS[len(words) - 1])
    for k, w in enumerate(reversed(words)):
        c = F.col(w)
        out = out.bitwiseXOR(F.shiftleft(c, 21 * k).bitwiseOR(F.shiftrightunsigned(c, 64 - 21 * k)) if k else c)
    return out


def count_trigrams(texts: DataFrame) -> DataFrame:
    """u, v, w, c: how often each trigram occurs in the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def give() -> pa.RecordBatch:
            u, v, w = (np.concatenate([x[k] for x in waiting]) for k in range(3))
            _, at, c = np.unique(keys(u, v, w), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([*(pa.array(x[at].view(np.int64)) for x in (u, v, w)), pa.array(c.astype(np.int64))], names=["u", "v", "w", "c"])

        for b in batches:
            for _, seq, _, place in sequences(b.column(0)):
                at = np.flatnonzero(place >= 2)
                waiting.append((seq[at - 2], seq[at - 1], seq[at]))
                size += len(at)
                if size > PIECE:
                    yield give()
                    waiting, size = [], 0
        if size:
            yield give()

    return texts.select("text").mapInArrow(run, "u bigint, v bigint, w bigint, c bigint").groupBy("u", "v", "w").agg(F.sum("c").alias("c"))


def _discount(counts: DataFrame) -> Column:
    """The discount of a row by its count: D1, D2 or D3+ of modified Kneser-Ney."""
    row = counts.agg(*[F.sum((F.col("c") == k).cast("bigint")).alias(f"n{k}") for k in range(1, 5)]).first()
    n1, n2, n3, n4 = (row[k] or 0 for k in range(4))
    d = (0.5, 0.75, 0.9)
    if n1 and n2 and n3:
        y = n1 / (n1 + 2 * n2)
        d = tuple(min(max(x, 0.05), k) for k, x in ((0.95, 1 - 2 * y * n2 / n1), (1.95, 2 - 3 * y * n3 / n2), (2.95, 3 - 4 * y * n4 / n3)))
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


def train(texts: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Two frames key and ln: what each n-gram known from the texts adds to ln p, as in the head of this file (a key may
    have two rows, as n-gram and as context), and the logarithm of an unknown word's probability under the
    salted keys 0 to ``SALTS`` - 1. N-grams with over 1 / ``hot`` of all words are in the second frame alone.

    An n-gram is followed by a word wherever it occurs, unless it ends a text, and then it is never a context; so both
    rows of a key have one number of occurrences and are in one frame.
    """
    steps = Steps(texts)
    c3 = steps.write(count_trigrams(texts), "trigrams")
    c2 = steps.write(c3.groupBy("v", "w").agg(F.count("*").alias("c"), F.sum("c").alias("raw")), "bigrams")
    c1 = steps.write(c2.groupBy("w").agg(F.count("*").alias("c"), F.sum("raw").alias("raw")), "words")
    d3, d2, d1 = (_discount(c) for c in (c3, c2, c1))
    of3 = steps.write(c3.groupBy("u", "v").agg((F.sum(d3) / F.sum("c")).alias("gamma"), F.sum("c").alias("total")), "contexts")
    of2 = steps.write(c2.groupBy("v").agg((F.sum(d2) / F.sum("c")).alias("gamma"), F.sum("c").alias("total"), F.sum("raw").alias("occurs")), "contexts")
    total, kinds, taken, words = c1.agg(F.sum("c"), F.count("*"), F.sum(d1), F.sum("raw")).first()  # four numbers
    unknown = taken / total / (kinds + 1) if kinds else 1.0
    p1 = c1.select("w", ((F.col("c") - d1) / F.lit(float(total or 1)) + unknown).alias("q"), F.col("raw").alias("occurs"))
    p2 = c2.withColumn("own", F.col("c") - d2).join(of2.drop("occurs"), "v").join(p1.drop("occurs"), "w").withColumn("p", F.col("own") / F.col("total") + F.col("gamma") * F.col("q"))
    p2 = steps.write(p2.select("v", "w", "p", (F.ln("p") - F.ln("gamma") - F.ln("q")).alias("ln"), F.col("raw").alias("occurs")), "bigrams")
    steps.drop(c2)
    low = float(np.log(unknown))
    bar = (words or 0) / hot

    def side(df: DataFrame, n: str, few: bool) -> DataFrame:
        return df.where(F.col(n) > bar if few else F.col(n) <= bar)

    def trigrams(few: bool, parts: int = 1, part: int = 0) -> DataFrame:
        """key and ln of the trigrams; of several ``parts`` each has those with some words in the middle."""
        own, of, p = (df if parts == 1 else df.where(F.pmod(F.hash("v"), F.lit(parts)) == part) for df in (side(c3, "c", few), of3, p2))
        p3 = own.withColumn("own", F.col("c") - d3)
        p3 = (F.broadcast(p3) if few else p3).join(of, ["u", "v"])
        p3 = (F.broadcast(p3) if few else p3).join(p.select("v", "w", F.col("p").alias("q")), ["v", "w"])
        p3 = p3.withColumn("p", F.col("own") / F.col("total") + F.col("gamma") * F.col("q"))
        return p3.select(key_column("u", "v", "w").alias("key"), (F.ln("p") - F.ln("gamma") - F.ln("q")).alias("ln"))

    def others(few: bool) -> DataFrame:
        return (
            side(of3, "total", few)
            .select(key_column("u", "v").alias("key"), F.ln("gamma").alias("ln"))
            .unionByName(side(p2, "occurs", few).select(key_column("v", "w").alias("key"), "ln"))
            .unionByName(side(of2, "occurs", few).select(key_column("v").alias("key"), F.ln("gamma").alias("ln")))
            .unionByName(side(p1, "occurs", few).select(key_column("w").alias("key"), (F.ln("q") - low).alias("ln")))
        )

    hot_rows = steps.write(trigrams(True).unionByName(others(True)), "frequent")
    parts = rounds_for(c3)
    light = [steps.write(trigrams(False, parts, part), "model") for part in range(parts)]
    steps.drop(c3)
    light.append(steps.write(others(False), "model"))
    steps.drop(c1, of3, of2, p2)
    salted = texts.sparkSession.range(SALTS).select(F.col("id").alias("key"), F.lit(low).alias("ln"))
    return reduce(DataFrame.unionByName, light, salted), hot_rows


def document_grams(texts: DataFrame, known: tuple[np.ndarray, np.ndarray], rounds: int = 1, turn: int = 0) -> DataFrame:
    """key, id, n, sum: how often each n-gram is in each text of the rows (id, text), and a row of a text with a salted
    key, its number of words to predict and the sum over its n-grams in ``known`` (ascending keys, and what
    each adds), which have no rows of their own. A text has an n-gram once. Of several ``rounds`` each, by its ``turn``
    from 0, has the n-grams of one residue of the key, and only the first the number of words."""
    hot, gain = known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_numpy()
            for lo, seq, row, place in sequences(b.column(1)):
                two, three = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
                if not len(three):
                    continue
                salt = (names[lo + row[three]] & np.int64(SALTS - 1)).view(np.uint64)
                key = np.concatenate([keys(seq[two]), keys(seq[two - 1], seq[two]), keys(seq[three - 2], seq[three - 1], seq[three])])
                who = np.concatenate([row[two], row[two], row[three]])
                if rounds > 1:
                    at = np.flatnonzero(key.view(np.int64) % rounds == turn)
                    key, who = key[at], who[at]
                key, who = np.concatenate([key, salt]), np.concatenate([who, row[three]])
                order = np.lexsort((key, who))
                key, who = key[order], who[order]
                new = np.ones(len(key), dtype=bool)
                new[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(key))).astype(np.int32)
                key, who = key[at].view(np.int64), who[at]
                place = np.minimum(np.searchsorted(hot, key), max(0, len(hot) - 1))
                near = hot[place] == key if len(hot) else np.zeros(len(key), dtype=bool)
                got = np.bincount(who[near], gain[place[near]] * n[near], minlength=int(who[-1]) + 1)
                length = (key >= 0) & (key < SALTS)
                total = np.where(length, got[who], 0.0)
                if turn:
                    n[length] = 0
                out = pa.RecordBatch.from_arrays([pa.array(x[~near]) for x in (key, names[lo + who], n, total)], names=["key", "id", "n", "sum"])
                for k in range(0, out.num_rows, 1 << 16):
                    yield out.slice(k, 1 << 16)

    return texts.select("id", "text").mapInArrow(run, "key bigint, id bigint, n int, sum double")


def perplexity(docs: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The rows of ``docs`` without their text, and perplexity (per word; null for texts without any).

    A text is known by the number of its row in a written table, so no two share one.
    """
    steps = Steps(docs)
    rows = steps.write(docs.withColumn("id", F.monotonically_increasing_id()), "texts")
    light, few = model
    hot = few.groupBy("key").agg(F.sum("ln").alias("ln")).toPandas().sort_values("key")  # under HOT an order and role
    known = hot["key"].to_numpy(np.int64), hot["ln"].to_numpy(np.float64)
    salted = F.col("key").between(0, SALTS - 1)
    sums, rounds = [], rounds_for(light)
    for turn in range(rounds):
        part = light.where(salted | (F.pmod("key", F.lit(rounds)) == turn))
        found = document_grams(rows, known, rounds, turn).join(part, "key")
        sums.append(steps.write(found.groupBy("id").agg(F.sum(F.col("ln") * F.col("n") + F.col("sum")).alias("ln"), F.sum(F.when(salted, F.col("n")).otherwise(0)).alias("n")), "sums"))
    whole = reduce(DataFrame.unionByName, sums).groupBy("id").agg(F.sum("ln").alias("ln"), F.sum("n").alias("n"))
    return rows.drop("text").join(whole, "id", "left").withColumn("perplexity", F.exp(-F.col("ln") / F.col("n"))).drop("id", "ln", "n")

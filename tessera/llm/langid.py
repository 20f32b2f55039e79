"""Operator 6: language identification by multinomial naive Bayes over hashed character n-grams.

Learning counts hashed n-grams (orders 1 to ``ORDERS``) of a bounded sample of labelled rows, about
``bound`` documents a language; every language is learned. The matrix of log-probabilities (buckets x
languages) is broadcast: ``BUCKETS * 4`` bytes (256 KB) a language, whatever the corpus. Scoring reads whole
texts in Arrow batches and adds matrix rows per document in numpy.

An n-gram lies in one text: none crosses to the next row, and a long text is read in parts of ``PIECE``
characters that carry the characters which n-grams across the cut need. Log-probabilities are integers in
units of 1 / ``UNIT``, so a score depends on its text alone, exactly.

Defined results: a null text, or one without any letter, is ``und`` with score 0; repeated rows have equal
scores; without any labelled row every text is ``und``; equal scores go to the language that sorts first;
rows with a null doc_id are scored, never learned from, and count as held out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, remainder

BUCKETS = 1 << 16
ORDERS = 4
SAMPLE_PER_LANGUAGE = 1500
SMOOTHING = 0.5
FOLDS = 5
UNKNOWN = "und"
PIECE = 1 << 18
UNIT = 1 << 20

_TABLES: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each code point: its lower-case code point if a letter, else a blank."""
    if "letters" not in _TABLES:
        t = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _TABLES["letters"] = t
    return _TABLES["letters"]


def _codes(text: str | None) -> np.ndarray:
    if not text:
        return np.zeros(0, dtype=np.uint32)
    return _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def features(codes: list[np.ndarray], carried: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram that ends at each character of the parts, one part after the
    other; BUCKETS where none ends: its first characters are not in the part, or its last was carried over
    from the part before. Learning and scoring both count these."""
    joined = np.concatenate(codes)
    length = np.array([len(c) for c in codes])
    place = np.arange(len(joined)) - np.repeat(np.cumsum(length) - length, length)
    carried = np.repeat(carried, length)
    for order in range(1, ORDERS + 1):
        m = max(len(joined) - order + 1, 0)
        acc = np.full(m, order * 0x51ED270B & 0xFFFFFFFF, dtype=np.uint32)
        for k in range(order):
            acc = (acc ^ joined[k : k + m]) * _MULTIPLIERS[k]
            acc ^= acc >> np.uint32(15)
        out = np.full(len(joined), BUCKETS)
        out[len(joined) - m :] = acc >> np.uint32(32 - BUCKETS.bit_length() + 1)
        out[place < np.maximum(carried, order - 1)] = BUCKETS
        yield out


def _pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """Row numbers, code arrays and carried characters of about PIECE characters at once; a long text comes in
    parts, each with the last characters of the part before."""
    rows, codes, carried, size = [], [], [], 0
    for i, value in enumerate(column):
        c = _codes(value.as_py())
        for at in range(0, len(c), PIECE):
            back = min(at, ORDERS - 1)
            rows.append(i)
            codes.append(c[at - back : at + PIECE])
            carried.append(back)
            size += len(codes[-1])
            if size >= PIECE:
                yield np.array(rows), codes, np.array(carried)
                rows, codes, carried, size = [], [], [], 0
    if rows:
        yield np.array(rows), codes, np.array(carried)


def learn(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", bound: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and the matrix [BUCKETS + 1, languages] of log-probabilities in units of 1 / UNIT.

    Rows whose label, text or key is null are not learned from. Counts reach the driver one language at a
    time; the matrix is ``4 * BUCKETS`` bytes a language.
    """
    rows = bounded_sample(docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("l")).where("k is not null and l is not null and t is not null"), "l", "k", bound)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for rows_, codes, carried in _pieces(b.column(0)):
                names, which = np.unique([langs[i] for i in rows_], return_inverse=True)
                which = np.repeat(which, [len(c) for c in codes]) * (BUCKETS + 1)
                for at in features(codes, carried):
                    n = np.bincount(which + at, minlength=len(names) * (BUCKETS + 1)).reshape(len(names), -1)
                    for k, lang in enumerate(names.tolist()):
                        sums[lang] = sums.get(lang, 0) + n[k, :BUCKETS]
        for lang, acc in sums.items():
            at = np.flatnonzero(acc)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(acc[at], pa.int64())], names=["l", "b", "n"])

    counts = rows.select("t", "l").mapInArrow(count, "l string, b int, n bigint").groupBy("l", "b").agg(F.sum("n").alias("n"))
    columns = {}
    for row in counts.groupBy("l").agg(F.collect_list(F.struct("b", "n")).alias("c")).toLocalIterator():
        n = np.full(BUCKETS, SMOOTHING)
        n[[c[0] for c in row["c"]]] += [c[1] for c in row["c"]]
        columns[row["l"]] = np.rint(np.log(n / n.sum()) * UNIT).astype(np.int32)
    langs = sorted(columns)
    matrix = np.zeros((BUCKETS + 1, len(langs)), dtype=np.int32)
    for k, lang in enumerate(langs):
        matrix[:BUCKETS, k] = columns[lang]
    return langs, matrix


def score_column(column: pa.Array, names: list[str], m: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language of each text and its posterior, priors equal. Sums are of integers, so they do not depend
    on what else is in the batch nor on where a long text is cut."""
    n = len(column)
    sums, letters = np.zeros((n, len(names)), dtype=np.int64), np.zeros(n, dtype=bool)
    for rows, codes, carried in _pieces(column):
        starts = np.cumsum([0] + [len(c) for c in codes])[:-1]
        np.logical_or.at(letters, rows, np.logical_or.reduceat(np.concatenate(codes) != 32, starts))
        part = np.zeros((len(codes), len(names)), dtype=np.int64)
        for at in features(codes, carried):
            for k in range(len(names)):
                part[:, k] += np.add.reduceat(m[at, k], starts, dtype=np.int64)
        np.add.at(sums, rows, part)
    if not names:
        return [UNKNOWN] * n, np.zeros(n)
    best = sums.argmax(axis=1)
    post = 1.0 / np.exp((sums - sums.max(axis=1, keepdims=True)) / UNIT).sum(axis=1)
    return [names[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)], np.where(letters, post, 0.0)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) for every row; score is the posterior of the language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key_type = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, post = score_column(b.column(1), *shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(post, pa.float64())], names=[key, "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(score, f"`{key}` {key_type}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a posterior of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, post = score_column(b.column(at), *shared.value)
            yield b.filter(pa.array([p != UNKNOWN and s >= least for p, s in zip(pred, post, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, bound: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the other folds only."""
    model = learn(docs.where(remainder("doc_id", FOLDS) != 0), bound=bound)
    return identify(docs, model).select("doc_id", F.coalesce(remainder("doc_id", FOLDS) == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")

"""Operator 5: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is the logistic of a bias and the weights of
its distinct hashed features, words and the beginnings of words (``PREFIXES`` bytes: many languages build
words from stems). A document's is the noisy-or of its sentences, 1 - prod(1 - p). Only documents have
labels: weights, none below zero, are fitted to those through the noisy-or (proximal Adam; an L1 term
selects features that ``LEAST_DOCS`` documents or more have, then the selected ones are fitted again
nearly without it), so the sentences that carry the label find themselves. Fitting uses a bounded sample
of labelled rows, about ``bound`` and ``SAMPLE_BYTES`` of text a label, weighted to the labels' own shares;
what reaches the driver is bounded by those. Scoring reads every whole text.

Defined results: null and empty texts (no words) have no sentence and score 0; without any labelled
row every score is the score of the bias alone; rows are scored one by one, so repeated rows and
ties do not matter; a document whose labels contradict counts by the highest label; rows with a null doc_id
are scored, never learned from, and count as held out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, byte_view, mix, remainder, slices, word_hashes, word_spans

BITS = 18
PREFIXES = (4, 5, 6, 7)
SAMPLE_PER_LABEL = 1000
SAMPLE_BYTES = 1 << 25
STEPS = 250
RATE = 0.05
L1 = 5e-4
REFIT_L1 = 1e-5
SELECTED = 0.3
LEAST_DOCS = 4
BIAS = -5.0
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
_CHUNK = 1 << 20

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[:128] = False
for _a, _b in (("0", "9"), ("a", "z"), ("A", "Z")):
    _IS_WORD[ord(_a) : ord(_b) + 1] = True
_IS_END = np.zeros(256, dtype=bool)
_IS_END[[ord(c) for c in ".!?\n"]] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (sentence, feature) pairs of some rows, and of each sentence its row, start and end byte.

    A sentence runs to a full stop, exclamation or question mark or line end, or to the row's end;
    those without a word are left out.
    """
    s, e = word_spans(data, offsets, _IS_WORD)
    lo = offsets[0]
    row = np.searchsorted(offsets, s, side="right") - 1
    ends_before = np.concatenate(([0], np.cumsum(_IS_END[data[lo : offsets[-1]]])))
    part = ends_before[s - lo]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
    sentence = np.cumsum(new) - 1
    pairs = [(sentence << BITS) | (word_hashes(data, s, e) >> np.uint64(64 - BITS)).astype(np.int64)]
    for n in PREFIXES:
        on = e - s > n
        start = mix(word_hashes(data, s[on], s[on] + n) + np.uint64(n))
        pairs.append((sentence[on] << BITS) | (start >> np.uint64(64 - BITS)).astype(np.int64))
    pair = np.unique(np.concatenate(pairs))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1 if len(s) else first
    return pair >> BITS, pair & ((1 << BITS) - 1), row[first], s[first], e[last]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _descend(pairs: tuple[np.ndarray, np.ndarray], row_of: np.ndarray, positive: np.ndarray, weight: np.ndarray, l1: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights from zero by proximal Adam on the noisy-or's log loss."""
    w, bias = np.zeros(1 << BITS), BIAS
    sentence, feature = pairs
    used, feature = np.unique(feature, return_inverse=True)
    v = np.zeros(len(used))
    m1, m2, b1, b2 = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = bias + np.bincount(sentence, v[feature], minlength=len(row_of))
        total = np.bincount(row_of, _softplus(z), minlength=len(positive))
        # d loss / d total: 1 for a clean bag, -1 / (e**total - 1) for a toxic one
        pull = np.where(positive, -1.0 / np.expm1(np.clip(total, 1e-4, 50.0)), 1.0) * weight
        g = pull[row_of] / (1.0 + np.exp(-z))
        gv, gb = np.bincount(feature, g[sentence], minlength=len(used)), g.sum()
        m1, m2 = 0.9 * m1 + 0.1 * gv, 0.999 * m2 + 0.001 * gv * gv
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        rate = RATE / (np.sqrt(m2 / c2) + 1e-6)
        v = np.maximum(v - rate * (m1 / c1 + l1), 0.0)
        bias -= RATE * (b1 / c1) / (np.sqrt(b2 / c2) + 1e-6)
    w[used] = v
    return w, float(bias)


def fit(pairs: tuple[np.ndarray, np.ndarray], row_of: np.ndarray, labels: np.ndarray, shares: tuple[float, float] | None = None, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias from bags: (sentence, feature) pairs, the bag of each sentence, labels of bags, and
    the labels' shares where the bags were sampled (else those of the bags)."""
    if not len(labels) or not len(row_of):
        return np.zeros(1 << BITS, dtype=np.float32), BIAS
    positive = labels.astype(bool)
    own = np.array([(~positive).sum(), positive.sum()])
    shares = np.array(shares if shares is not None else own / own.sum())
    weight = (shares / np.maximum(own, 1))[positive.astype(int)]
    sentence, feature = pairs
    held = np.unique((row_of[sentence].astype(np.int64) << BITS) | feature) & ((1 << BITS) - 1)
    often = (np.bincount(held, minlength=1 << BITS) >= LEAST_DOCS)[feature]
    sentence, feature = sentence[often], feature[often]
    w, _ = _descend((sentence, feature), row_of, positive, weight, L1, steps)
    chosen = (w > SELECTED)[feature]
    w, bias = _descend((sentence[chosen], feature[chosen]), row_of, positive, weight, REFIT_L1, steps)
    return w.astype(np.float32), bias


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_PER_LABEL) -> tuple[np.ndarray, float]:
    """Fit to the documents that ``labels`` (doc_id, toxic) marks; about ``bound`` rows a label."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") == 1).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).join(marked, "doc_id")
    chosen = bounded_sample(sized, "y", "doc_id", bound, "bytes", SAMPLE_BYTES).select("doc_id", "y").distinct()
    bags = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = byte_view(b.column(0))
            y = b.column(1).to_pylist()
            for lo, hi in slices(offsets, _CHUNK):
                sent, feat, row, _, _ = sentences(data, offsets[lo : hi + 1])
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                at = np.searchsorted(sent, cut)
                s = [(sent[at[i] : at[i + 1]] - cut[i]).astype(np.int32).tobytes() for i in range(hi - lo)]
                f = [feat[at[i] : at[i + 1]].astype(np.int32).tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array(y[lo:hi], pa.int32()), pa.array(s, pa.binary()), pa.array(f, pa.binary())], names=["y", "s", "f"])

    rows = bags.mapInArrow(features, "y int, s binary, f binary").collect()
    rows.sort(key=lambda r: (r["y"], bytes(r["f"])))  # the same sums in whatever order rows come
    sents, feats, row_of, y, base = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [], 0
    for i, r in enumerate(rows):
        own = np.frombuffer(r["s"], dtype=np.int32)
        n = int(own.max(initial=-1)) + 1
        sents.append(own + np.int32(base))
        feats.append(np.frombuffer(r["f"], dtype=np.int32))
        row_of.append(np.full(n, i, dtype=np.int32))
        y.append(r["y"])
        base += n
    total = max(1, sum(counts.values()))
    return fit((np.concatenate(sents), np.concatenate(feats)), np.concatenate(row_of), np.array(y), (counts.get(0, 0) / total, counts.get(1, 0) / total))


def score(docs: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """key, score, n_sentences and the offending sentences (p >= ``least``) as byte start, end and p."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key_type = docs.schema[key].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for b in batches:
            offsets, data = byte_view(b.column(1))
            totals, counts, found = np.zeros(b.num_rows), np.zeros(b.num_rows, dtype=np.int64), [[] for _ in range(b.num_rows)]
            for lo, hi in slices(offsets, _CHUNK):
                sent, feat, row, first, last = sentences(data, offsets[lo : hi + 1])
                z = bias + np.bincount(sent, w[feat], minlength=len(row))
                totals[lo:hi] = np.bincount(row, _softplus(z), minlength=hi - lo)
                counts[lo:hi] = np.bincount(row, minlength=hi - lo)
                p = 1.0 / (1.0 + np.exp(-z))
                for k in np.flatnonzero(p >= least):
                    at = offsets[lo + row[k]]
                    found[lo + row[k]].append({"start": first[k] - at, "end": last[k] - at, "p": p[k]})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(-np.expm1(-totals)), pa.array(counts), pa.array(found, spans)], names=[key, "score", "n_sentences", "offending"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {key_type}, score double, n_sentences bigint, offending array<struct<start:bigint,end:bigint,p:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_PER_LABEL) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending of every document; folds 0, 1 and 3 are learned from."""
    model = learn(docs, labels.where(remainder("doc_id", FOLDS) != HELD_OUT), bound)
    return score(docs, model).select(
        "doc_id",
        F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("offending").cast("bigint").alias("n_offending"),
    )

"""Extra columns whose names the operators use themselves change nothing, and operators that return rows keep them."""

import common_rows
import public_tokenizers
import pytest

from tessera.llm import bpe, decontaminate, jaccard, langid, quality, secret_scan, suffix_dedup, toxicity

NAMES = ["nid", "key", "score", "spans", "found", "perplexity", "id", "n", "rest", "needs", "size", "sig", "t", "a", "word", "kept", "items", "label", "lo", "hi", "row", "root", "node"]


@pytest.fixture(scope="module")
def frames(spark):
    plain = common_rows.frame(spark)
    return plain, plain.selectExpr("*", *[f"{i} AS {n}" for i, n in enumerate(NAMES)])


def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")


REPORTS = {
    "op1": lambda s, d: secret_scan.secret_report(d),
    "op2": lambda s, d: suffix_dedup.dedup_report(d),
    "op3": lambda s, d: jaccard.jaccard_report(d),
    "op5": lambda s, d: toxicity.toxicity(d, labels(s)),
    "op6": lambda s, d: langid.language_id(d),
    "op8": lambda s, d: bpe.round_trip(d, bpe.vocabulary(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)),
    "op9": lambda s, d: quality.quality(d, labels(s)),
    "op10": lambda s, d: decontaminate.contamination_report(d, s.createDataFrame([(1, "one other text")], "item_id long, text string")),
}


@pytest.mark.parametrize("name", REPORTS)
def test_reports(spark, frames, name):
    plain, clash = frames
    rows = lambda df: sorted((tuple(f"{x:.9g}" if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)
    one, two = REPORTS[name](spark, plain), REPORTS[name](spark, clash)
    assert one.columns == two.columns and rows(one) == rows(two)


def test_kept_rows(spark, frames):
    plain, clash = frames
    bench = spark.createDataFrame([(1, "one other text")], "item_id long, text string")
    for keep in (jaccard.keep_one, secret_scan.redact, lambda d: decontaminate.drop_contaminated(d, bench), lambda d: langid.keep_identified(d, langid.learn(d))):
        a, b = keep(plain), keep(clash)
        assert b.columns == clash.columns and sorted(b.select(plain.columns).collect(), key=repr) == sorted(a.collect(), key=repr)
        assert {tuple(r[n] for n in NAMES) for r in b.collect()} <= {tuple(range(len(NAMES)))}

"""Flow metrics and reports against plain numpy and Python walks, with their edge cases."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation, filters, flow, reports


def divergence(a, b, least=0.5):
    def hist(x):
        u, v = x[:, 0], x[:, 1]
        m, angle = np.hypot(u, v), np.degrees(np.arctan2(v, u)) % 360
        ok = m >= least
        if ok.sum() < 10:
            return None
        top = max(m[ok].max(), least + 1)
        h = np.zeros((36, 20))
        for k, t in zip(m[ok], angle[ok], strict=True):
            h[min(35, int(t // 10)), min(19, int(np.floor(np.log10(k / least) / np.log10(top / least) * 20)))] += 1
        return (h + 1) / (h + 1).sum()

    p, q = hist(a), hist(b)
    return 0.0 if p is None or q is None else float((p * np.log(p / q)).sum())


def test_flow_divergence(spark):
    rng = np.random.default_rng(1)
    sides, want = [], {}
    for f, (n, scale) in enumerate([(200, 3), (200, 0.6), (12, 5), (9, 5), (50, 0.1), (11, 40)]):
        a, b = rng.normal(size=(n, 2)) * scale, rng.normal(size=(n, 2)) * scale
        want[f] = divergence(a, b)
        sides += [(f, s, float(u), float(v)) for s, x in (("a", a), ("b", b)) for u, v in x]
    got = {r.f: r.kl for r in flow.flow_divergence(spark.createDataFrame(sides, "f int, side string, u double, v double").repartition(5), "f").collect()}
    assert got.keys() == want.keys() and all(got[f] == pytest.approx(want[f], abs=1e-9) for f in want) and want[3] == want[4] == 0


def test_flow_errors(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for f, scale in enumerate([2.0, 0.3, 0.0, 9.0]):
        t, g = rng.normal(size=(6, 7, 2)) * scale, rng.normal(size=(6, 7, 2)) * scale
        m = np.maximum(np.linalg.norm(t, axis=2), np.linalg.norm(g, axis=2))
        ok = (m >= 0.5) & (m <= np.percentile(m, 80))
        e = np.linalg.norm(t - g, axis=2)
        use = ok if ok.any() else np.ones_like(ok)
        cells = []
        for i in range(2):
            for j in range(2):
                c, k = e[i * 3 : i * 3 + 3, j * 3 : j * 3 + 3], ok[i * 3 : i * 3 + 3, j * 3 : j * 3 + 3]
                cells.append(c[k].mean() if k.any() else c.mean())
        far = (e > 3) & (e > 0.05 * np.linalg.norm(t, axis=2))
        want[f] = (ok.sum(), np.linalg.norm(t[use].mean(axis=0) - g[use].mean(axis=0)), e[use].mean(), e[use].max(), np.mean(cells), np.max(cells), far[use].mean())
        rows += [(f, y, x, *map(float, t[y, x]), *map(float, g[y, x])) for y in range(6) for x in range(7)]
    df = spark.createDataFrame(rows, "f int, y int, x int, u double, v double, gu double, gv double").repartition(4)
    got = flow.flow_errors(df, "f", flow.grid_cell(F.col("x"), F.col("y"), 7, 6, 2)).collect()
    for r in got:
        assert (r.n_valid, r.mf_epe, r.pixel_epe_mean, r.pixel_epe_max, r.grid_epe_mean, r.grid_epe_max, r.fl_all) == pytest.approx(want[r.f], abs=1e-9)
    assert {r.f: (r.mf_angle_err, r.mf_cosine) for r in got}[2] == (0.0, 1.0)


def test_batches(spark):
    rows = [("a", "low", i, v) for i, v in enumerate([1.0, 1.0, 1.6, None, float("nan")])] + [("a", "high", i, v) for i, v in enumerate([10.0, 10.0, 4.0])] + [("b", "low", 1, 3.0), ("c", "low", 1, -1.0), ("c", "low", 2, 1.0)]
    got = {(r.batch, r.metric): (r.n, r.verdict, r.worst, r.regression) for r in reports.batch_consistency(spark.createDataFrame(rows, "batch string, metric string, id int, value double"), ["batch", "metric"], "id", F.col("metric") == "low", 0.61).collect()}
    assert got == {("a", "low"): (3, "pass", 2, pytest.approx(0.6)), ("a", "high"): (3, "pass", 2, pytest.approx(0.6)), ("b", "low"): (1, "skipped", None, None), ("c", "low"): (2, "invalid", None, None)}


def test_stress_report(spark):
    s = spark.createDataFrame([("success", True), ("success", None), (None, False)], "status string, progressive boolean")
    c = spark.createDataFrame([(None, 10.2, 500), (100.0, 10.9, 300), (300.0, 12.0, 0), (200.0, None, 900), (400.0, 13.2, 1000)], "gap_ms double, finish double, size_bytes long")
    r = reports.stress_report(s, c, 400.0).collect()[0]
    assert (r.total, r.success, r.other, r.eligible, r.progressive_ratio, r.gaps, r.breaches, r.passed) == (3, 2, 1, 2, 0.5, 4, 1, False)
    assert r.gap_p50 == 250 and r.goodput_mbps == pytest.approx(1800 * 8 / 3.0 / 1e6) and r.buckets == 2 and r.bucket_peak == pytest.approx(0.008)
    assert r.reasons == "1 session(s) did not succeed; 1 chunk gap(s) at the threshold or over"
    none = reports.stress_report(s.where("false"), c.where("false"), 1.0).collect()[0]
    assert none.total == 0 and none.gap_p50 is None and none.goodput_mbps is None and none.reasons == "no chunk gaps"
    assert reports.stress_report(s.where("status = 'success'"), c, 500.0).collect()[0].passed


def test_scores_and_series(spark):
    rows = [("x", [0.1, 0.2, 0.3], [0.5], [0.1], [0.9, 0.7], 0.5, 0.4, 0.9, 0.8), ("x", [0.9], [0.7, 0.6], [0.2, 0.3], [0.8], 0.3, 0.2, 0.7, 0.6)]
    r = reports.corpus_score(spark.createDataFrame(rows, "g string, mse array<double>, st array<double>, pv_mse array<double>, pv_st array<double>, s double, ws double, pv_s double, pv_ws double"), ["g"]).collect()[0]
    mean = statistics.mean
    want = 100 * (((0.6 / 0.8) + (0.4 / 0.8) + (0.3 / 0.7)) / 3 - (mean([0.1, 0.2, 0.3, 0.9]) - 0.2))
    assert r.mse == pytest.approx(0.375) and r.score == pytest.approx(min(100, max(0, want)), abs=0.006)
    series = [("p", i, float(v)) for i, v in enumerate([1, 1, 1, 1, 1, 3, 3, 3, 3])] + [("q", 0, 0.1), ("q", 1, 9.0)]
    got = {r.g: (r.threshold, r.onset) for r in reports.temporal_onset(spark.createDataFrame(series, "g string, i int, v double"), "g", ["i"], "v").collect()}
    assert got == {"p": (2.0, 3), "q": (pytest.approx(9.1), None)}


def test_markdown_correlation_and_classifier(spark):
    lines = reports.markdown_table(spark.createDataFrame([(2, "b"), (1, None)], "k int, v string"), ["k"], {"K": F.col("k").cast("string"), "V": F.coalesce("v", F.lit("n/a"))}, {"K"}, "T").orderBy("pos").collect()
    assert [r.line for r in lines] == ["## T", "", "| K | V |", "|---:|---|", "| 1 | n/a |", "| 2 | b |"]
    e = spark.createDataFrame([(1, [1.0, 1.0, 2.0, 2.0] * 2, [1.0, 1.0, 3.0, 3.0] * 2), (2, [1.0] * 8, [float(i) for i in range(8)])], "k int, a array<double>, b array<double>")
    got = {r.k: r.r for r in evaluation.block_correlation(e, "k", "a", "b", 4, 2, 2).collect()}
    assert got[1] == pytest.approx(1.0) and np.isnan(got[2])
    texts = spark.createDataFrame([("a\nb",), (None,), ("bad",)], "t string").coalesce(1)
    run = lambda f: sorted((r.decision, r.reason or "") for r in filters.classified(texts, "t", f, 0.5).collect())
    assert run(lambda xs: [("unsafe", 0.5 if "bad" in x else 0.4) for x in xs if "\n" not in x]) == [("ALLOW", ""), ("ALLOW", ""), ("BLOCK", "")]
    assert {d for d, _ in run(None)} == {"UNAVAILABLE"} and all("boom" in why for _, why in run(lambda xs: [][0] if not xs else (_ for _ in ()).throw(ValueError("boom"))))
    m = evaluation.Metric("t.len", lambda: F.length("t"), skipped=lambda: F.when(F.col("t").isNull(), "no text"))
    assert sorted((r.score or 0, r.reason or "") for r in evaluation.explained_rows(texts, ["t"], [m]).collect()) == [(0, "no text"), (3.0, ""), (3.0, "")]

import re
from collections import Counter

import common_rows
import pytest

from tessera.llm import divergence as d

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least_docs=3, most_terms=200):
    groups, held, langs = {}, {}, {}
    for r in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r.text or "").translate(LOW))
        lang, source = r.lang or "", r.source or ""
        groups.setdefault((lang, source), Counter()).update(terms)
        langs.setdefault(lang, Counter()).update(terms)
        held.setdefault(lang, Counter()).update(set(terms))
    kept = {lang: [t for t, n in held[lang].items() if n >= least_docs] for lang in langs}

    def p(counts, lang):
        total = sum(counts[t] for t in kept[lang])
        return {t: 1 + 1_000_000_000 * (counts[t] + 1) // (total + len(kept[lang])) for t in kept[lang]}

    probs, out = {g: p(c, g[0]) for g, c in groups.items()}, []
    f = lambda a, b: (a - b) * (a - b) // b
    for (lang, source), own in probs.items():
        q = p(langs[lang], lang)
        parts = {
            "pair": [(sum(f(own[t], o[t]) for t in own), s) for (other, s), o in probs.items() if other == lang and s != source],
            "term": [(f(own[t], q[t]), t) for t in own if groups[lang, source][t] and own[t] > q[t]],
        }
        for part, items in parts.items():
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, v, i) for i, (v, item) in enumerate(items, 1) if part == "pair" or i <= most_terms]
    return sorted(out)


@pytest.mark.parametrize(("least_docs", "most_terms"), [(3, 200), (2, 4)])
def test_against_brute_force(spark, least_docs, most_terms):
    more = [(1000 + i, f"Über alles word{i % 7} {'hot ' * (i % 5)} ΣΑΣ x{i}", "en" if i % 3 else "de", "s" if i % 2 else f"t{i % 5}", 1, None) for i in range(120)]
    more += [(3000 + i, "nur einmal", "fr", f"u{i}", 1, None) for i in range(2)] + [(3100, "§§ 12", "fr", "none", 1, None), (3101, "a b", None, "", 1, None), (3102, "a b", "", None, 1, None), (3103, "a " * 3, "", "s", 1, None)]
    docs = common_rows.frame(spark, more)
    got = sorted(tuple(r) for r in d.divergence(docs, least_docs, most_terms).collect())
    assert got == brute(docs.collect(), least_docs, most_terms)
    assert {r[2] for r in got} == {"pair", "term"}


def test_empty_tables_clashing_columns_and_long_text(spark):
    assert d.divergence(common_rows.empty(spark)).collect() == []
    clash = common_rows.frame(spark).selectExpr("*", "1 AS term", "'x' AS terms", "2 AS n", "3 AS p", "4 AS item", "5 AS size")
    assert sorted(tuple(r) for r in d.divergence(clash).collect()) == brute(clash.collect())
    long_ = spark.createDataFrame([(i, "ab Cd é " * 300_000 if i == 1 else "ab é", "en", f"s{i % 2}", 1, None) for i in range(5)], common_rows.SCHEMA)
    assert sorted(tuple(r) for r in d.divergence(long_).collect()) == brute(long_.collect())


def test_counts_beyond_a_long(spark):
    """10**9 times a count of 4 * 10**12 passes a long; probabilities are exact all the same."""
    n = [4 * 10**12, 7, 0]
    counts = spark.createDataFrame([("en", s, f"t{i}", v if s == "a" else i + 1, 3) for s in "ab" for i, v in enumerate(n)], "lang string, source string, term string, n bigint, docs bigint")
    kept = d.table(d.vocabulary(counts, 3), "kept")
    groups = d.table(d.group_sizes(counts.select("lang", "source").distinct(), kept), "groups")
    got = {(r.source, r.term): r.p for r in d.dense(kept, groups).collect()}
    assert got == {("a", f"t{i}"): 1 + 10**9 * (v + 1) // (sum(n) + 3) for i, v in enumerate(n)} | {("b", f"t{i}"): 1 + 10**9 * (i + 2) // 9 for i in range(3)}
    q = kept.join(groups.where("source = 'a'"), "lang").select("term", d.probability("n", "lang_total").alias("q"))
    assert {r.term: r.q for r in q.collect()} == {f"t{i}": 1 + 10**9 * (v + i + 2) // (sum(n) + 9) for i, v in enumerate(n)}

import re

import common_rows
import numpy as np
import pytest

from tessera.llm import jaccard as j

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sets(rows, n):
    out = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOW))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute(rows, n, percent):
    s, parent = sets(rows, n), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                parent[find(a)] = find(b)
    low = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            low[find(i)] = min(low.get(find(i), r.doc_id), r.doc_id)
    return sorted(((r.doc_id, len(s[i]), low.get(find(i))) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 1024), (2, 40, 3)])
def test_against_brute_force(spark, n, percent, block):
    base = ["w%d" % i for i in range(60)]
    near = [(500 + k, " ".join(base[: 60 - k] + ["v%d" % i for i in range(k)]), "en", "s", 1, None) for k in range(20)]
    docs = common_rows.frame(spark, near)
    got = sorted((tuple(r)[:3] for r in j.jaccard_components(docs, n, (percent, 100), block).collect()), key=repr)
    assert got == brute(docs.collect(), n, percent)


def test_one_stays(spark):
    docs = common_rows.frame(spark)
    kept = j.keep_one(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns
    assert ids.count(100) == 1 and not {101, None} & set(ids) and {103, 104, 106} <= set(ids)
    assert j.keep_one(common_rows.empty(spark)).count() == 0 and j.jaccard_report(common_rows.empty(spark)).count() == 0


def test_overlap_bound():
    for a in range(1, 40):
        for b in range(1, 40):
            least = j.needed(a, b, (90, 100))
            assert all((100 * i >= 90 * (a + b - i)) == (i >= least) for i in range(min(a, b) + 1))


def small_pairs():
    """Texts of 4 to 50 shingles of five, each with its near copy of one word more; most of them of 4."""
    for k in range(4, 51):
        for v in range(1500 if k == 4 else 20):
            w = [f"k{k}v{v}w{i}" for i in range(k + 5)]
            yield " ".join(w[:-1]), " ".join(w)


def shared_and_needed(pairs):
    """Of each pair, compared alone: the signatures in common, and the larger of the numbers asked for."""
    plan = j.Segments((80, 100))
    sets = [j.shingle_set(w, 5) for w in j._word_lists(j.pa.array([t for p in pairs for t in p]))]
    for a, b in zip(sets[::2], sets[1::2], strict=True):
        yield len(np.intersect1d(plan.sign(a), plan.sign(b))), max(plan.needs(a), plan.needs(b))


def test_each_linked_pair_shares_what_it_needs():
    assert all(shared >= needed >= 1 for shared, needed in shared_and_needed(list(small_pairs())))


def test_a_sparse_pair_alone_is_found(spark):
    pairs = list(small_pairs())
    pair = pairs[489]  # 2 signatures in common
    docs = spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")
    assert [r.doc_id for r in j.keep_one(docs).collect()] == [0]


@pytest.mark.parametrize("t", [(90, 100), (80, 100)])
def test_random_linked_pairs_share_what_they_need(t):
    """Linked pairs of 4 to 60 shingles, as far apart as the threshold allows: recall is 1."""
    rng, plan, seen = np.random.default_rng(7), j.Segments(t), 0
    for _ in range(20_000):
        size = int(rng.integers(4, 61))
        both = rng.integers(0, 2**64, size, dtype=np.uint64)
        spare = size * t[1] // t[0] - size  # shingles that one or the other may have beyond the shared ones
        one = int(rng.integers(0, spare + 1))
        more = rng.integers(0, 2**64, spare, dtype=np.uint64)
        a, b = np.unique(np.append(both, more[:one])), np.unique(np.append(both, more[one:]))
        assert t[1] * len(np.intersect1d(a, b)) >= t[0] * len(np.union1d(a, b))
        seen += len(a) != len(b)
        assert len(np.intersect1d(plan.sign(a), plan.sign(b))) >= max(plan.needs(a), plan.needs(b)) >= 1
    assert seen > 1000


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_many_pairs_in_one_table(spark, n, percent):
    """Groups of three texts of 4 to 60 shingles with some words apart, some over and some under the threshold."""
    rng, texts = np.random.default_rng(percent), []
    for g in range(400):
        w = [f"g{g}w{i}" for i in range(int(rng.integers(n + 3, n + 60)))]
        for _ in range(3):
            v = list(w)
            if rng.random() < 0.5:
                v[int(rng.integers(len(v)))] = "new"
            texts.append(" ".join(v[int(rng.integers(0, 3)) :] + ["tail"] * int(rng.integers(0, 2))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((tuple(r)[:3] for r in j.jaccard_components(docs, n, (percent, 100)).collect()), key=repr)
    rows = docs.collect()
    want = [x for g in range(400) for x in brute(rows[3 * g : 3 * g + 3], n, percent)]
    assert got == sorted(want, key=repr)


def test_one_hot_set(spark):
    """A third of all rows hold one text; their key is broadcast and no row is lost."""
    rows = [(i, "one and the same text") for i in range(3000)] + [(10_000 + i, f"text {i} of its own kind") for i in range(6000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.jaccard_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got == {i: (3, 0) if i < 10_000 else (4, i) for i, _ in rows}


def test_sets_without_link_share_no_signature():
    """Small sets of unrelated shingles: what is empty in them must not bring them together, at any size of table."""
    rng = np.random.default_rng(7)
    for t in ((80, 100), (90, 100), (50, 100)):
        plan = j.Segments(t)
        for size in (*range(1, 13), 30):
            sigs = np.concatenate([plan.sign(np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))) for _ in range(3000)])
            assert len(np.unique(sigs)) == len(sigs)


def test_sparse_sets_are_found(monkeypatch):
    """Linked sets share a signature whatever the deal: by brute force with few segments hit, down to the prefix."""
    rng = np.random.default_rng(8)
    for deals in (1, 2, 4):
        monkeypatch.setattr(j, "DEALS", deals)
        for t in ((80, 100), (50, 100)):
            plan = j.Segments(t)
            for size in range(2, 40):
                for _ in range(60):
                    a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
                    own = rng.integers(0, 2**63, int(rng.integers(0, size)) + 1, dtype=np.uint64)
                    b = np.unique(np.concatenate([rng.permutation(a)[: int(rng.integers(1, size + 1))], own[: int(rng.integers(0, len(own) + 1))]]))
                    both = len(np.intersect1d(a, b))
                    if t[1] * both >= t[0] * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
                        assert plan.links(len(a)) and plan.links(len(b))  # unequal ones
                        assert len(np.intersect1d(plan.sign(a), plan.sign(b))) >= max(plan.needs(a), plan.needs(b)) >= 1

from collections import defaultdict

import numpy as np

from deliverylens.llm import ngram_join
from deliverylens.llm.ngram_join import links_in, miss_of, near_groups, one_of_each


def brute(texts, k, share):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= share * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for x in range(len(texts)):
        groups[find(x)].append(texts[x][0])
    return sorted(((texts[x][0], len(sets[x]), min((i for i in groups[find(x)] if i is not None), default=None))
                   for x in range(len(texts))), key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_classes_equal_brute_force(docs, texts):
    assert rows(near_groups(docs)) == brute(texts, 4, 85)


def test_clusters_of_several_blocks(docs, texts, monkeypatch):
    """Blocks of a few nodes: pivots and the second pass of nodes outside the largest group."""
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    assert rows(near_groups(docs)) == brute(texts, 4, 85)


def test_prefix_bound():
    for n in range(1, 500):
        need = min(i for i in range(n + 1) if 100 * i >= 85 * n)
        assert miss_of(n) == n - need


def test_links_in_a_block_join_all_linked_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2 ** 63, 60, dtype=np.uint64)
    sets = []
    for _ in range(40):
        s = base.copy()
        hit = rng.random(60) < rng.random() * 0.12
        s[hit] = rng.integers(0, 50, hit.sum(), dtype=np.uint64)
        sets.append(np.unique(s))
    n = np.array([len(s) for s in sets])
    allowed = [np.sort(s)[:] for s in sets]
    got = links_in(n, sets, [a[:miss_of(len(a)) + 1] for a in allowed], np.arange(40), np.ones(40, bool), np.ones(40, bool), 85)
    label = list(range(40))
    for a, b in got:
        label = [label[a] if x == label[b] else x for x in label]
    for a in range(40):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (n[a] + n[b] - both):
                assert label[a] == label[b]


def test_one_of_each(docs, texts):
    left = one_of_each(docs)
    assert left.columns == docs.columns
    want = {i for i, _, c in brute(texts, 4, 85) if i is None or i == c}
    assert {r.doc_id for r in left.collect()} == want


def test_empty(no_docs):
    assert near_groups(no_docs).count() == 0

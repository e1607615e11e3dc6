"""The n-gram join against all pairs of sets."""

import random

import numpy as np
import pytest

from specband.llm import ngram_join as grams
from tests.llm import brute


def near_copies(seed, groups=12, size=9, words=60):
    """Groups of copies with a few changed words: many pairs lie close to the threshold; a common passage in most."""
    r, rows = random.Random(seed), []
    passage = " ".join(f"common{i}" for i in range(12))
    for g in range(groups):
        base = [f"w{g}_{r.randrange(10**6)}" for _ in range(words)]
        for _ in range(r.randrange(1, size)):
            w = list(base)
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(words)] = f"x{r.randrange(10**6)}"
            rows.append((len(rows) * 3 + 5, " ".join(w) + (" " + passage if r.random() < 0.6 else "")))
    r.shuffle(rows)
    return rows


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("frequent, group", [(16, 4000), (2, 3)])
def test_components(make, odd_texts, frequent, group):
    rows = odd_texts + [(100 + d, t) for d, t in near_copies(3)]
    out = result(grams.ngram_join(make(rows), frequent=frequent, group_sets=group))
    want = sorted(brute.components(rows))
    assert out == want
    assert len({c for _, _, c in want}) < len(rows) - 10


def test_all_links(make):
    rows = near_copies(8)
    got = {(r.a, r.b): (r.overlap, r.together) for r in grams.similar_sets(make(rows), group_sets=7).collect()}
    sets = {}
    for d, t in rows:
        w = t.split(" ")
        s = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        sets[s] = min(sets.get(s, d), d)
    want, items = {}, sorted((d, s) for s, d in sets.items())
    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1 :]:
            if 100 * len(x & y) >= 75 * len(x | y):
                want[a, b] = (len(x & y), len(x | y))
    assert got == want and want


def test_null_ids_and_empty_table(make):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(None, text), (5, text), (4, text + " b"), (None, "other words here"), (None, None)]
    out = sorted((tuple(r) for r in grams.ngram_join(make(rows)).select("doc_id", "component_id").collect()), key=str)
    assert out == sorted([(None, 4), (5, 4), (4, 4), (None, None), (None, None)], key=str)
    assert grams.ngram_join(make([])).count() == 0


def test_tree_overlaps_are_exact():
    r = np.random.default_rng(4)
    tree = grams.PrefixTree(75, 60, True)
    sets = [np.sort(r.choice(60, r.integers(20, 40), replace=False)) for _ in range(60)] + [np.arange(50), np.arange(1, 50), np.arange(50)]
    sets.sort(key=len)
    sizes = np.array([len(s) for s in sets])
    for i, s in enumerate(sets):
        tree.parent.append(i)
        tree.block.append(0)
        found = dict(tree.probe(i, s, len(s), sizes, False))
        for j in range(i):
            both = len(np.intersect1d(s, sets[j]))
            assert found.get(j) == (both if 100 * both >= 75 * (len(s) + len(sets[j]) - both) else None)
        tree.insert(i, s, len(s))


def one_text(seed, size, words=80, edits=9):
    """Variants of one text: some near the threshold, some beyond it, some with passages in common that the text does not have."""
    r, base = random.Random(seed), [f"b{i}" for i in range(words)]
    extra, rows = [f"e{i}" for i in range(12)], []
    for d in range(size):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(words)] = f"x{r.randrange(30)}"
        at = r.randrange(words)
        rows.append((d, " ".join(w[:at] + extra * (r.random() < 0.3) + w[at:])))
    return rows


@pytest.mark.parametrize("group", [4000, 70])
def test_large_groups(make, group):
    rows = one_text(5, 230) + [(1000 + d, t) for d, t in one_text(6, 150, 40, 5)]
    want = sorted(brute.components(rows))
    assert result(grams.ngram_join(make(rows), group_sets=group)) == want
    assert len({c for _, _, c in want}) > 20


@pytest.mark.parametrize("cross", [False, True])
def test_large_groups_rarely_walk_the_tree(monkeypatch, cross):
    """Most sets of a group are linked, or out of reach of all others, without a walk; the classes are those of the walks."""
    rows, walks, probe = one_text(7, 600, 200, 12), [], grams.PrefixTree.probe
    monkeypatch.setattr(grams.PrefixTree, "probe", lambda self, *a: walks.append(a[0]) or probe(self, *a))
    words = [t.split(" ") for _, t in rows]
    sets = [{hash(tuple(w[i : i + 5])) & (2**63 - 1) for i in range(len(w) - 4)} for w in words]
    lists = [np.array(sorted(s), np.uint64) for s in sets]
    n, sig = np.array([len(s) for s in sets]), np.arange(len(sets))
    block = sig % 2

    def classes():
        label = list(range(len(sets)))
        for u, v, overlap, together in grams.tree_join(sig, n, block, lists, 75, False, cross):
            assert overlap == len(sets[u] & sets[v]) and together == len(sets[u] | sets[v]) and 100 * overlap >= 75 * together
            assert not cross or block[u] != block[v]
            label = [label[u] if x == label[v] else x for x in label]
        return {frozenset(i for i, x in enumerate(label) if x == y) for y in label}

    got = classes()
    few = len(walks)
    monkeypatch.setattr(grams, "LARGE", len(sets) + 1)
    assert got == classes()
    assert 0 < few < len(sets) / 3 and len(walks) - few == len(sets)


def test_blobs_of_many_slices_are_one(spark, make):
    """Rows of the first exchange do not grow with slices times partitions."""
    r = random.Random(2)
    rows = [(d, " ".join(f"w{r.randrange(10**6)}" for _ in range(6000))) for d in range(120)]
    slices = sum(len(t) for _, t in rows) / (1 << 20)
    blobs = grams.scan(make(rows).coalesce(1), 5, 200, 16)
    assert slices > 4 and blobs.count() < 200 * slices


def test_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert result(grams.ngram_join(docs)) == sorted(brute.components([(r.doc_id, r.text) for r in docs.collect()]))

"""Random band subsets by unranking, best relabelings by subsets, and images per excitation."""

import math
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from specband.operators import compare as cmp, reshape as rs
from specband.plans import experiments as ex


def test_unranking_lists_every_subset_once():
    columns = [[math.comb(c, j + 1) for c in range(9)] for j in range(4)]
    got = [tuple(ex.unranked(r, 4, columns)) for r in range(math.comb(9, 4))]
    assert sorted(got) == list(combinations(range(9), 4))
    assert got == sorted(got, key=lambda s: s[::-1])


@pytest.mark.parametrize("total", [7, 12, 1001, math.comb(217, 13)])
def test_numbers_are_a_permutation(total):
    factor, shift = ex.rank_key(total, 5)
    n = min(total, 3000)
    assert math.gcd(factor, total) == 1 and len({(factor * i + shift) % total for i in range(n)}) == n


def test_random_subsets(spark):
    bands = spark.createDataFrame([(3 * b + 1,) for b in range(40)] + [(1,)], "band_id INT")
    drawn = [tuple(r.subset) for r in ex.robustness_sample(bands, 6, 4000, seed=9).collect()]
    assert len(set(drawn)) == 4000 and all(list(s) == sorted(set(s)) and len(s) == 6 for s in drawn)
    share = np.bincount([b for s in drawn for b in s], minlength=121)[1::3] / 4000
    assert share.shape == (40,) and np.abs(share - 6 / 40).max() < 0.03  # every band is as frequent as any other
    assert drawn != [tuple(r.subset) for r in ex.robustness_sample(bands, 6, 4000, seed=10).collect()]
    wide = spark.range(900).select(F.col("id").cast("int").alias("band_id"))
    assert len({tuple(r.subset) for r in ex.robustness_sample(wide, 60, 50).collect()}) == 50  # more subsets than any number type holds
    few = sorted(tuple(r.subset) for r in ex.robustness_sample(bands.where("band_id < 14"), 2).collect())
    assert few == list(combinations([1, 4, 7, 10, 13], 2))


def brute(w):
    best = max(permutations(range(len(w))), key=lambda p: (sum(w[c][t] for c, t in enumerate(p)), [-t for t in p]))
    return list(best), sum(w[c][t] for c, t in enumerate(best))


def test_permutations_by_subsets(spark):
    r = np.random.default_rng(2)
    for k in (1, 2, 4, 6):
        w = r.integers(0, 4, (k, k))
        rows = [(int(t), int(c), int(w[c, t])) for c in range(k) for t in range(k) if w[c, t]] + [(k, 0, 9), (0, k + 3, 2)]
        out = cmp.permutation_mapping(spark.createDataFrame(rows, "class INT, cluster INT, n BIGINT"), k).orderBy("cluster").collect()
        perm, hit = brute(w)
        assert [x.mapped for x in out] == perm and out[0].accuracy == pytest.approx(hit / sum(n for *_, n in rows))


def test_twelve_classes(spark):
    r = np.random.default_rng(3)
    w = r.integers(0, 50, (12, 12))
    planted = r.permutation(12)
    w[np.arange(12), planted] += 1000
    rows = [(int(t), int(c), int(w[c, t])) for c in range(12) for t in range(12)]
    out = cmp.permutation_mapping(spark.createDataFrame(rows, "class INT, cluster INT, n BIGINT"), 12).orderBy("cluster").collect()
    assert [x.mapped for x in out] == planted.tolist()
    with pytest.raises(ValueError):
        cmp.permutation_mapping(spark.createDataFrame(rows, "class INT, cluster INT, n BIGINT"), 21)


def test_images_by_excitation_equal_single_ones(spark):
    rows = [("s", float(e), b, y, x, float((y * 7 + x * 3 + b * e) % 11)) for e in (300, 320) for b in range(5) for y in range(4) for x in range(4)]
    cubes = spark.createDataFrame(rows, "scan_id STRING, excitation DOUBLE, em_idx INT, y INT, x INT, value DOUBLE")
    both = lambda df: sorted(tuple(r) for r in df.collect())
    for make, cols in ((lambda c, by: rs.projection(c, "max", by=by), ["y", "x", "value"]), (lambda c, by: rs.false_color(c, 5, by=by), ["y", "x", "r", "g", "b"]),
                       (lambda c, by: rs.false_color(c, 2, by=by), ["y", "x", "r", "g", "b"])):
        for e in (300.0, 320.0):
            assert both(make(cubes, ["excitation"]).where(F.col("excitation") == e).select(*cols)) == both(make(cubes.where(F.col("excitation") == e), []).select(*cols))


def test_emission_targets_of_several_configurations(spark):
    bands = spark.createDataFrame([(float(e), i, 400.0 + 10 * i + e / 10) for e in (300, 320) for i in range(6)], "excitation DOUBLE, em_idx INT, emission DOUBLE")
    targets = spark.createDataFrame([("a", 431.0), ("a", 470.0), ("b", 900.0)], "config STRING, emission DOUBLE")
    both = rs.subset_bands_emission_only(bands, targets, by=["config"])
    for c in "ab":
        one = rs.subset_bands_emission_only(bands, targets.where(F.col("config") == c).select("emission"))
        assert sorted(map(tuple, both.where(F.col("config") == c).drop("config").collect())) == sorted(map(tuple, one.collect()))
    assert rs.subset_bands_emission_only(bands, targets.where("config = 'z'").select("emission")).count() == bands.count()

import brute
import numpy as np
import pytest

from corvid.llm import itq
from corvid.llm.itq import near_vectors, table_positions

SCHEMA = "vec_id long, embedding array<float>, label int, code long, n_links int"


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, y, 0, 0) for i, v, y in rows], SCHEMA)
    return {r.vec_id: tuple(r)[1:] for r in near_vectors(df, **more).collect()}


def planted(n=260, dims=64):
    random = np.random.default_rng(3)
    rows = [(k, [float(x) for x in np.float32(random.standard_normal(dims))], k % 3) for k in range(n)]
    base = np.array(rows[1][1])
    rows += [(1000 + k, [float(x) for x in np.float32(base + 0.1 * random.standard_normal(dims))], 1) for k in range(400)]
    return rows + [(5000 + k, rows[2][1], 2) for k in range(50)] + [(6000, rows[2][1], 0)]


def test_recall_precision_and_components(spark):
    rows = planted()
    got = run(spark, rows, block=64)
    links = brute.vector_links(rows, 0.98)
    counts = dict.fromkeys((r[0] for r in rows), 0)
    for i, j in links:
        counts[rows[i][0]] += 1
        counts[rows[j][0]] += 1
    assert all(got[k][0] <= counts[k] for k in counts)
    assert sum(v[0] for v in got.values()) >= 0.97 * sum(counts.values())
    assert got[2][0] == 50 and got[5003] == (50, 2, False) and got[6000] == (0, 6000, True)
    parts = brute.smallest_reachable(list(counts), [(rows[i][0], rows[j][0]) for i, j in links])
    assert sum(got[k][1] == parts[k] for k in parts) >= 0.99 * len(parts)


def test_edges(spark):
    nan, one = float("nan"), [1.0] * 64
    rows = [(1, None, 1), (2, [], 1), (3, [0.0] * 64, 1), (4, [nan] * 64, 1), (5, [None] + one[1:], 1), (6, one, None), (7, one, 1), (8, [2.0] * 64, 1), (9, one[:5], 1), (10, [1e38] * 64, 1), (11, one, 2)]
    got = run(spark, rows)
    assert {k: v for k, v in got.items() if v[0]} == {7: (2, 7, True), 8: (2, 7, False), 10: (2, 7, False)}
    assert all(v == (0, k, True) for k, v in got.items() if k not in (7, 8, 10))
    assert run(spark, []) == {}


def near_pairs(random, n, near, mean, noise, cosine, dims=64):
    """n unit vectors around a common mean, the last `near` of them at a cosine with the first ones, apart in any direction."""
    centre = random.standard_normal(dims)
    base = mean * centre / np.linalg.norm(centre) + noise * random.standard_normal((n - near, dims)) / np.sqrt(dims)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    across = random.standard_normal((near, dims))
    across -= (across * base[:near]).sum(axis=1, keepdims=True) * base[:near]
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    return np.concatenate([base, cosine * base[:near] + np.sqrt(1 - cosine**2) * across])


def tables_of(rows, sample=4000):
    mean, projection = itq.learn_rotation(rows[:sample], 64, rounds=10)
    left, right = itq.threshold_pairs(rows[:sample], 0.98)
    bits = lambda x: (x - mean) @ projection >= 0
    return bits(rows), table_positions(len(rows), bits(left) == bits(right))


@pytest.mark.parametrize(("mean", "noise"), [(0.05, 1.0), (1.0, 0.5), (1.0, 0.35)])
def test_comparisons_a_row_stay_level_and_recall_holds(mean, noise):
    """Pairs that meet in a bucket, counted from the codes, for 2,500 and 40,000 vectors; recall on planted pairs at the threshold."""
    each = []
    for n in (2500, 40_000):
        rows = near_pairs(np.random.default_rng(n), n, 400, mean, noise, 0.9805)
        bit, tables = tables_of(rows)
        met, cost = np.zeros(400, bool), 0
        for t in tables:
            part = bit[:, t] @ (1 << np.arange(len(t)))
            size = np.unique(part, return_counts=True)[1]
            cost += (size * (size - 1) // 2).sum() + itq.MOVE * n
            met |= part[:400] == part[-400:]
        each.append(cost / n)
        assert met.mean() >= 0.97
    # sixteen times the vectors: far from sixteen times the work of each, even around a mean that nearly hides what tells them apart
    assert each[1] < 5 * each[0]


@pytest.mark.parametrize("noise", [0.2, 0.3])
def test_recall_around_a_common_mean(spark, noise):
    """As real embeddings have it: one large mean, and each component off it by noise; pairs at a cosine of 0.983."""
    random = np.random.default_rng(7)
    centre = random.standard_normal(64)
    base = centre + noise * random.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    across = random.standard_normal((1500, 64))
    across -= (across * base).sum(axis=1, keepdims=True) * base
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    rows = np.float32(np.concatenate([base, 0.983 * base + np.sqrt(1 - 0.983**2) * across]))
    got = run(spark, [(k, [float(x) for x in v], 1) for k, v in enumerate(rows)])
    unit = rows.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert all(got[k][0] <= links[k] for k in got)
    assert sum(got[k][0] for k in got) >= 0.97 * links.sum() > 0


def test_double_vectors_and_few_dimensions(spark):
    random = np.random.default_rng(4)
    rows = [(k, [float(x) for x in random.standard_normal(3)], 1) for k in range(300)]
    df = spark.createDataFrame([(i, v, y) for i, v, y in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in near_vectors(df).collect()}
    links = brute.vector_links(rows, 0.98)
    assert sum(got.values()) >= 0.9 * 2 * len(links) > 0

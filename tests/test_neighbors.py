"""Neighbour search against brute force, with every path forced."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from basketry.operators import block_scores, blocked, hot_features, neighbors, postings

SCHEMA = "cont_id string, prod_name string, weight double"


def grid(x, digits=8):
    return math.floor(x * 10.0**digits + 0.5) / 10.0**digits


def brute(base, queries, metric, k, include_self):
    def vectors(entries):
        out = {}
        for i, f, w in entries:
            out.setdefault(i, {})[f] = w
        return out

    b, q = vectors(base), vectors(queries)
    norm = lambda v: sum(w * w for w in v.values())
    found = set()
    for i, v in q.items():
        ranked = []
        for j, u in b.items():
            dot = sum(w * u.get(f, 0.0) for f, w in v.items())
            if metric == "cosine":
                if dot <= 0:
                    continue
                gap = 1 - dot / math.sqrt(norm(v) * norm(u))
                dist = grid(grid(max(gap, 0), 12))
            else:
                gap = (norm(v) + norm(u)) / 2 - dot
                dist = grid(math.sqrt(2 * grid(max(gap, 0), 12)))
            if include_self or i != j:
                ranked.append((dist, j))
        for rank, (dist, j) in enumerate(sorted(ranked)[:k], 1):
            found.add((i, j, dist, rank))
    return found


def skewed(seed, n=120):
    """Most ids have the one popular feature, many are exact copies, some have rare features only."""
    rng = random.Random(seed)
    entries = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:
            vector = {"top": 1.0}
        elif kind < 0.5:
            vector = {"top": 0.5, "second": 1.0}
        else:
            vector = {
                f"f{int(rng.paretovariate(0.6)) % 60}": rng.choice([0.25, 0.5, 1 / 3, 1.0])
                for _ in range(rng.randint(1, 6))
            }
            if rng.random() < 0.6:
                vector["top"] = rng.choice([0.25, 0.5, 1.0])
        entries += [(f"c{i:03}", f, w) for f, w in vector.items()]
    return entries


def result(df):
    return {(r.cont_id, r.neighbor_id, r.dist, r.neighbor_rank) for r in df.collect()}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize(
    "hot_degree, shard_rows", [(512, 4096), (4, 4096), (4, 7), (1, 3)]
)
def test_matches_brute_force(rows, monkeypatch, metric, hot_degree, shard_rows):
    monkeypatch.setattr(hot_features, "_SHARD_ROWS", shard_rows)
    data = skewed(7)
    find = getattr(neighbors, f"{metric}_neighbors")
    got = find(rows(data, SCHEMA), k=6, hot_degree=hot_degree, by="features")
    assert result(got) == brute(data, data, metric, 6, True)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("hot_degree", [512, 3])
def test_other_queries_without_self(rows, monkeypatch, metric, hot_degree):
    monkeypatch.setattr(hot_features, "_SHARD_ROWS", 5)
    base, asked = skewed(1, 70), skewed(2, 40)
    find = getattr(neighbors, f"{metric}_neighbors")
    got = find(
        rows(base, SCHEMA), k=4, queries=rows(asked, SCHEMA), include_self=False,
        hot_degree=hot_degree, by="features",
    )
    assert result(got) == brute(base, asked, metric, 4, False)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("block_rows", [4096, 11])
def test_blocks_match_brute_force(rows, monkeypatch, metric, block_rows):
    monkeypatch.setattr(blocked, "BLOCK_ROWS", block_rows)
    find = getattr(neighbors, f"{metric}_neighbors")
    data = skewed(8)
    got = find(rows(data, SCHEMA), k=6, by="blocks")
    assert result(got) == brute(data, data, metric, 6, True)
    base, asked = skewed(9, 70), skewed(2, 40)
    got = find(rows(base, SCHEMA), k=4, queries=rows(asked, SCHEMA), include_self=False, by="blocks")
    assert result(got) == brute(base, asked, metric, 4, False)


def test_what_moves_decides():
    # 15,000 ids of 40 features: a join on features that 30 ids share, or 25 features that all have.
    entries = 600_000
    small = blocked.Grid(4, 4, 2 * 4 * entries)
    assert blocked.worth_it(small, 15_000**2 * 25) and blocked.worth_it(small, entries * 30)
    large = blocked.Grid(4000, 4000, 2 * 4000 * 1000 * entries)
    assert not blocked.worth_it(large, 1000 * entries * 30)


@pytest.mark.parametrize("gain", [0, 10**9])
def test_block_scores_either_way(monkeypatch, gain):
    monkeypatch.setattr(hot_features, "_DENSE_GAIN", gain)
    monkeypatch.setattr(hot_features, "_DENSE_FEATURES", 7)
    monkeypatch.setattr(hot_features, "_CELLS", 300)
    features = {}

    def side(seed, first):
        vectors, sums = skewed(seed, 50), {}
        for i, _, w in vectors:
            sums[i] = sums.get(i, 0) + w * w
        return pd.DataFrame(
            [(first + int(i[1:]), features.setdefault(f, len(features)), w, sums[i]) for i, f, w in vectors],
            columns=["idx", "fid", "w", "sq"],
        )

    queries, base = side(3, 0), side(4, 0)
    got = hot_features.best_of_block(queries, base, 4, "euclidean")
    ours = {(r.q, r.n, grid(math.sqrt(2 * grid(max(r.gap, 0), 12)))) for r in got.itertuples()}
    q, b = ({i: g for i, g in s.groupby("idx")} for s in (queries, base))
    expected = set()
    for i, v in q.items():
        ranked = []
        for j, u in b.items():
            both = v.merge(u, on="fid")
            dot = (both.w_x * both.w_y).sum()
            if dot > 0:
                gap = (v.sq.iloc[0] + u.sq.iloc[0]) / 2 - dot
                ranked.append((grid(math.sqrt(2 * grid(max(gap, 0), 12))), j))
        expected |= {(i, j, d) for d, j in sorted(ranked)[:4]}
    assert ours == expected


def test_small_slices_of_a_block(rows, monkeypatch):
    monkeypatch.setattr(hot_features, "_CELLS", 50)
    data = skewed(5, 60)
    got = neighbors.cosine_neighbors(rows(data, SCHEMA), k=5, hot_degree=2, by="features")
    assert result(got) == brute(data, data, "cosine", 5, True)


MICRO = [
    ("c1", "A", 1.0), ("c1", "B", 1.0), ("c1", "C", 0.5), ("c2", "A", 0.5), ("c2", "B", 1.0),
    ("c2", "C", 0.5), ("c2", "D", 0.5), ("c3", "B", 1.0), ("c3", "D", 1.0), ("c4", "C", 1.0),
    ("c4", "E", 1.0), ("c5", "F", 1.0),
]


def test_worked_cosine_example(rows):
    got = neighbors.cosine_neighbors(rows(MICRO, SCHEMA), k=3)
    expected = {
        "c1": [("c1", 0.0), ("c2", 0.1180829), ("c3", 0.52859548)],
        "c2": [("c2", 0.0), ("c1", 0.1180829), ("c3", 0.19821627)],
        "c3": [("c3", 0.0), ("c2", 0.19821627), ("c1", 0.52859548)],
        "c4": [("c4", 0.0), ("c2", 0.73273876), ("c1", 0.76429774)],
        "c5": [("c5", 0.0)],
    }
    assert result(got) == {
        (c, n, d, r) for c, near in expected.items() for r, (n, d) in enumerate(near, 1)
    }


def test_worked_euclidean_example(rows):
    got = neighbors.euclidean_neighbors(rows(MICRO, SCHEMA), k=5)
    dist = {(a, b): d for a, b, d, _ in result(got)}
    assert dist[("c1", "c2")] == 0.70710678
    assert dist[("c1", "c4")] == 1.80277564
    assert dist[("c3", "c4")] == 2.0
    assert dist[("c3", "c5")] == 1.73205081
    assert len(dist) == 25
    assert all(dist[(a, b)] == dist[(b, a)] for a, b in dist)
    assert all(dist[(a, a)] == 0 for a, _ in dist)


def test_worked_item_example(rows):
    counts = [
        ("c1", "A", 2), ("c1", "B", 1), ("c1", "C", 1), ("c2", "A", 1), ("c2", "B", 1),
        ("c2", "C", 1), ("c2", "D", 1), ("c3", "B", 1), ("c3", "D", 2), ("c4", "C", 2),
        ("c4", "E", 1), ("c5", "F", 1),
    ]
    weights = rows([(c, p, float(n * n)) for c, p, n in counts], SCHEMA)
    got = neighbors.cosine_neighbors(weights, id_col="prod_name", feature_col="cont_id")
    dist = {(r.prod_name, r.neighbor_id): r.dist for r in got.collect()}
    expected = {
        "AB": 0.29985996, "AC": 0.71416902, "AD": 0.94117647, "BC": 0.72783447,
        "BD": 0.29985996, "CD": 0.9428338, "CE": 0.05719096,
    }
    assert {k: v for k, v in dist.items() if k[0] < k[1]} == {tuple(k): v for k, v in expected.items()}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_pivots_rule_out_most_shards(rows, monkeypatch, metric):
    """Twenty clusters that all share one feature: a query visits few shards, and the result is exact."""
    monkeypatch.setattr(hot_features, "_SHARD_ROWS", 10)
    rng, data = random.Random(3), []
    for i in range(400):
        vector = {"all": 0.5}
        for f in range(3):
            vector[f"c{i % 20}f{f}"] = 1 + rng.random() / 4
        data += [(f"c{i:03}", f, w) for f, w in vector.items()]
    visits, score = [], hot_features._score

    def counted(problem, query_cells, base_cells, wanted):
        visits.append((wanted.count(), base_cells.select("block").distinct().count()))
        return score(problem, query_cells, base_cells, wanted)

    monkeypatch.setattr(hot_features, "_score", counted)
    got = getattr(neighbors, f"{metric}_neighbors")(rows(data, SCHEMA), k=5, hot_degree=3, by="features")
    assert result(got) == brute(data, data, metric, 5, True)
    made, shards = sum(v for v, _ in visits), visits[0][1]
    assert shards >= 40 and made < 400 * shards / 4


def test_pivots_are_far_apart(spark, rows):
    cells = [(i, f, float(w)) for i in range(60) for f, w in ((i % 6, 5), (9, 1 + i / 100))]
    entries = rows(cells, "idx long, fid long, w double")
    reps = entries.groupBy("idx").count().selectExpr("idx as rep", "count as n_entries")
    old, hot_features._SHARD_ROWS = hot_features._SHARD_ROWS, 20
    try:
        pivots = hot_features._pivots(entries, reps)
    finally:
        hot_features._SHARD_ROWS = old
    table = entries.toPandas()
    ids, away = pivots.distances(table)
    assert len(pivots.square) == 6 and list(ids) == list(range(60))
    # Every id is near one pivot, which stands for its feature, and far from the others.
    assert (away.min(axis=1) < 1).all() and ((away < 3).sum(axis=1) == 1).all()
    dense = np.zeros((60, 10))
    for i, f, w in cells:
        dense[i, f] = w
    where = away.argmin(axis=0)
    assert np.allclose(away, np.linalg.norm(dense[:, None] - dense[where][None], axis=2), atol=1e-6)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("held, per_task", [(10, 60), (4_000_000, 500)])
def test_lists_match_brute_force(rows, monkeypatch, metric, held, per_task):
    """Products that are added up in many steps, in many tasks; a feature of one side alone has many ids."""
    monkeypatch.setattr(postings, "_HELD", held)
    monkeypatch.setattr(postings, "_PAIRS_PER_TASK", per_task)
    find = getattr(neighbors, f"{metric}_neighbors")
    base, asked = skewed(3, 60) + [(f"x{i}", "unasked", 1.0) for i in range(50)], skewed(4, 30)
    got = find(
        rows(base, SCHEMA), k=2, queries=rows(asked, SCHEMA), include_self=False, hot_degree=45, by="features"
    )
    assert result(got) == brute(base, asked, metric, 2, False)


def test_pairs_are_no_rows(spark, rows, monkeypatch):
    """A hundred ids that share ten features: what leaves the tasks is k rows a query, not the pairs."""
    data = [(f"c{i:03}", f"f{f}", 1.0 + (i * f) % 7) for i in range(100) for f in range(10)]
    made, top = [], neighbors.top_candidates

    def counted(candidates, *args):
        made.append(candidates.count())
        return top(candidates, *args)

    monkeypatch.setattr(neighbors, "top_candidates", counted)
    got = neighbors.cosine_neighbors(rows(data, SCHEMA), k=3, by="features")
    assert result(got) == brute(data, data, "cosine", 3, True)
    assert made == [300]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_wide_blocks_match_brute_force(rows, monkeypatch, metric):
    """Blocks of several strips."""
    monkeypatch.setattr(blocked, "BLOCK_ROWS", 11)
    monkeypatch.setattr(blocked, "BLOCKS", 2)
    data = skewed(8)
    got = getattr(neighbors, f"{metric}_neighbors")(rows(data, SCHEMA), k=6, by="blocks")
    assert result(got) == brute(data, data, metric, 6, True)


def test_copies_grow_slowly():
    """600,000 ids are copied a dozen times, not once for every 4,096 ids."""
    assert blocked._blocks(15_000, 300_000) == 4
    assert blocked._blocks(600_000, 9_600_000) <= 12


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("shared", [50, 4])
def test_lists_deal_each_entry_once(rows, monkeypatch, metric, shared):
    """Entries go to their feature once, lists to the queries once. Features of one side alone change no result."""
    plans, find_lists = [], neighbors.posting_candidates

    def kept(*args):
        found = find_lists(*args)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(neighbors, "posting_candidates", kept)
    monkeypatch.setattr(postings, "_PAIRS_PER_TASK", 20)
    base = [(f"c{i % 20}", f"f{i * 7 % 50}", 1.0 + i % 3) for i in range(100)]
    asked = [(f"c{i % 15}", f"f{i * 3 % 50}" if i * 3 % 50 < shared else f"g{i}", 1.0 + i % 4) for i in range(90)]
    got = getattr(neighbors, f"{metric}_neighbors")(
        rows(base, SCHEMA), k=3, queries=rows(asked, SCHEMA), include_self=False, by="features"
    )
    assert result(got) == brute(base, asked, metric, 3, False)
    if shared == 50:
        assert plans[0].count("Exchange hashpartitioning") == plans[0].count("REPARTITION_BY_NUM") == 3


def test_a_query_in_many_lists_is_added_up_once(monkeypatch):
    """Queries of more pairs than a chunk has places for, beside small ones; whatever arrives when."""
    rng = np.random.default_rng(4)
    for bits, held in ((17, 10**6), (4, 10**6), (4, 30)):
        monkeypatch.setattr(postings, "_PLACE_BITS", bits)
        monkeypatch.setattr(postings, "_QUERY_BITS", 2)
        monkeypatch.setattr(postings, "_HELD", held)
        q = rng.integers(0, 12, 60).astype(np.int32)
        lists = [rng.choice(40, rng.integers(0, 9), replace=False).astype(np.int32) for _ in q]
        w, weights = rng.integers(1, 5, 60) / 8, [rng.integers(1, 5, len(n)) / 8 for n in lists]
        batch = postings.pa.record_batch({
            "q": q, "q_w": w, "n": postings.pa.array(lists), "n_w": postings.pa.array(weights),
        })
        taken = postings._Held(5, "cosine")
        for low in range(0, 60, 7):
            taken.add(batch.slice(low, 7))
        got = [tuple(r.values()) for b in taken.nearest() for r in b.to_pylist()]
        dots = np.zeros((12, 40))
        for i, x, n, v in zip(q, w, lists, weights):
            np.add.at(dots[i], n, x * v)
        expected = []
        for i in range(12):
            best = sorted((max(1 - d, 0.0), n) for n, d in enumerate(dots[i]) if d > 0)[:5]
            expected += [(i, n, 1 - dots[i, n]) for _, n in best]
        assert got == expected


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("gain", [0, 10**9])
def test_single_precision_loses_no_neighbour(monkeypatch, metric, gain):
    """Distances closer together than single precision can tell, and many equal ones; some pairs beyond the limit."""
    monkeypatch.setattr(hot_features, "_DENSE_GAIN", gain)
    rng = np.random.default_rng(5)

    def side(n, first):
        dense = 1 + rng.integers(0, 3, (n, 9)) / 3 + rng.integers(0, 4, (n, 1)) * 3e-8
        sq = (dense**2).sum(axis=1)
        if metric == "cosine":
            dense, sq = dense / np.sqrt(sq)[:, None], np.ones(n)
        row, fid = np.nonzero(dense)
        return dense, block_scores.Vectors(first + np.arange(n), sq, row, fid, dense[row, fid])

    (left, queries), (right, base) = side(150, 0), side(1100, 5000)
    gap = (queries.sq[:, None] + base.sq) / 2 - left @ right.T
    dist = block_scores.rounded_distance(gap, metric)
    best = np.stack([np.lexsort((base.ids, mine))[:7] for mine in dist])
    for limit in (None, gap[np.arange(150), best[:, -1]]):
        scorer = block_scores.Scorer(queries, base, 7, metric, limit)
        assert (scorer.dense is None) == (gain == 0)
        for low in range(0, 1100, 300):
            scorer.scan(low, min(low + 300, 1100))
        q, n, found = scorer.nearest()
        assert (n.reshape(150, 7) == base.ids[best]).all() and (q == np.repeat(queries.ids, 7)).all()
        assert np.allclose(found.reshape(150, 7), np.take_along_axis(gap, best, axis=1), atol=1e-14)


def test_a_vector_is_copied_as_one_row(rows):
    entries = rows([(i, 1.0, f, 0.5) for i in range(6) for f in range(4)], "idx long, sq double, fid long, w double")
    packed = blocked.packed(entries).collect()
    assert sorted(r.idx for r in packed) == list(range(6))
    assert all([c.fid for c in r.cells] == [0, 1, 2, 3] for r in packed)


def test_visits_are_of_blocks(rows, monkeypatch):
    """Vectors without clusters: most shards are visited, by a row a block, and a vector is copied once a part."""
    monkeypatch.setattr(hot_features, "_SHARD_ROWS", 20)
    monkeypatch.setattr(blocked, "BLOCKS", 3)
    rng, made, score = random.Random(6), [], hot_features._score_visits
    data = [(f"c{i:03}", f"f{f}", 1 + rng.random()) for i in range(200) for f in range(6)]

    def counted(problem, facing, base_cells, visits, pivots):
        pairs = visits.count()
        blocks, parts = base_cells.select("block").distinct().count(), hot_features._parts(base_cells)
        made.append((visits.columns, pairs, blocks, parts.select("part").distinct().count()))
        return score(problem, facing, base_cells, visits, pivots)

    monkeypatch.setattr(hot_features, "_score_visits", counted)
    got = neighbors.cosine_neighbors(rows(data, SCHEMA), k=5, hot_degree=3, by="features")
    assert result(got) == brute(data, data, "cosine", 5, True)
    (columns, pairs, blocks, parts), = made
    assert columns == ["q_block", "shard"] and pairs <= blocks**2 and parts <= 3 < blocks


@pytest.mark.parametrize("codes", [4, 1 << 16])
def test_packed_lists_are_the_same_lists(rows, monkeypatch, codes):
    """Ids far apart and in any order, empty lists, slices; numbers as codes or, where there are more of them, as they are."""
    monkeypatch.setattr(postings, "_CODES", codes)
    rng, pa = np.random.default_rng(3), postings.pa
    values = rng.random(20)
    lists = [
        [(int(n), float(rng.choice(values)), float(rng.choice(values[:3]))) for n in rng.choice(2**31 - 1, size, False)]
        for size in (0, 5, 1, 0, 512, 40, 0)
    ]
    base = rows([cell for mine in lists for cell in mine], "n int, w double, sq double")
    packing = postings.Packing.of(base, ["w", "sq"])
    assert (packing.codes["w"] is None) == (codes == 4) and len(packing.codes["sq"]) == 3
    kind = pa.list_(pa.struct([("n", pa.int32()), ("w", pa.float64()), ("sq", pa.float64())]))
    given = pa.array([[dict(zip(("n", "w", "sq"), c)) for c in mine] for mine in lists], kind)
    packed = packing.packed(given)
    batch = pa.record_batch({"q": pa.array(range(7)), "packed": packed})
    for low, high in ((0, 7), (3, 6), (6, 7)):
        got = packing.unpacked(batch.slice(low, high - low)).to_pylist()
        assert [r["q"] for r in got] == list(range(low, high))
        assert [list(zip(r["n"], r["n_w"], r["n_sq"])) for r in got] == [sorted(m) for m in lists[low:high]]
    if codes > 4:
        assert len(packed[4].as_py()) == 512 * 8

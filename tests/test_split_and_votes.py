import pytest

from basketry.operators import features, neighbors, positions, split, voting

LOG = """c1 t01 A | c1 t01 B | c1 t02 A | c1 t03 C
c2 t04 A | c2 t05 B | c2 t06 C | c2 t06 D
c3 t07 B | c3 t08 D | c3 t09 D
c4 t10 C | c4 t11 C | c4 t12 E
c5 t13 F"""


@pytest.fixture
def log(rows):
    cells = [tuple(c.split()) for line in LOG.splitlines() for c in line.split("|")]
    return rows(cells, "cont_id string, transaction_id string, prod_name string")


def test_weights(log):
    got = {
        (r.cont_id, r.prod_name): r.weight
        for r in features.min_max_weights(log).collect() if r.weight
    }
    assert got == {
        ("c1", "A"): 1, ("c1", "B"): 1, ("c1", "C"): 0.5, ("c2", "A"): 0.5, ("c2", "B"): 1,
        ("c2", "C"): 0.5, ("c2", "D"): 0.5, ("c3", "B"): 1, ("c3", "D"): 1, ("c4", "C"): 1,
        ("c4", "E"): 1, ("c5", "F"): 1,
    }


def test_a_product_everybody_bought_equally_weighs_nothing(rows):
    df = rows([("a", "p"), ("b", "p"), ("b", "q"), ("b", "q")], "cont_id string, prod_name string")
    got = {(r.cont_id, r.prod_name): r.weight for r in features.min_max_weights(df).collect()}
    assert got == {("a", "p"): 0.0, ("b", "p"): 0.0, ("b", "q"): 1.0}


def test_literal_nan_is_no_product_but_a_nan_prefix_is(rows):
    df = rows([("a", "nan"), ("a", "nan chair"), ("a", None)], "cont_id string, prod_name string")
    assert [r.prod_name for r in features.purchase_counts(df).collect()] == ["nan chair"]


def test_split(log):
    orders = split.split_orders(log)
    for part, expected in (
        ("history", {"c1": "AAB", "c2": "AB", "c3": "BD", "c4": "CC"}),
        ("target", {"c1": "C", "c2": "CD", "c3": "D", "c4": "E", "c5": "F"}),
    ):
        got = {}
        for r in split.split_rows(log, orders, part).collect():
            got[r.cont_id] = got.get(r.cont_id, "") + r.prod_name
        assert {c: "".join(sorted(v)) for c, v in got.items()} == expected


def test_product_lists_are_paged_and_whole(log):
    lists = split.product_lists(log, split.split_orders(log), page_size=2)
    got = {(r.cont_id, r.part, r.page): r.products for r in lists.collect()}
    assert got[("c1", "history", 1)] == ["A", "B"]
    assert got[("c1", "history", 2)] == ["A"]
    assert sum(len(v) for v in got.values()) == log.count()


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_positions_of_a_group_that_fills_the_table(spark, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        data = [("big", f"t{i:05}") for i in range(3000)] + [("small", f"t{i}") for i in range(4)]
        df = rows(data, "cont_id string, transaction_id string").repartition(7)
        got = split.split_orders(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    big = sorted((r.transaction_id, r.order_no, r.part) for r in got if r.cont_id == "big")
    assert [n for _, n, _ in big] == list(range(1, 3001))
    assert [p for _, _, p in big].count("history") == 2000
    assert {r.n_orders for r in got if r.cont_id == "small"} == {4}
    assert sum(r.part == "history" for r in got if r.cont_id == "small") == 2


def test_positions_are_global_and_dense(rows):
    df = rows([(f"k{i:04}",) for i in range(500)], "k string").repartition(9)
    got = {r.k: r.position for r in positions.with_position(df, ["k"]).collect()}
    assert got == {f"k{i:04}": i + 1 for i in range(500)}


@pytest.mark.parametrize(
    "vote, expected",
    [
        ("last", {"c1": "C1 D1", "c2": "C1 D1", "c3": "D1 C1", "c4": "E1 C1 D1", "c5": "F1"}),
        ("sum", {"c1": "C2 D2", "c2": "C2 D2", "c3": "D2 C2", "c4": "C2 E1 D1", "c5": "F1"}),
    ],
)
def test_votes(log, vote, expected):
    nearest = neighbors.cosine_neighbors(features.min_max_weights(log), k=3)
    targets = voting.target_counts(log, split.split_orders(log))
    best = voting.best_products(voting.votes(nearest, targets, vote), 5).collect()
    got = {}
    for r in sorted(best, key=lambda r: (r.cont_id, r["rank"])):
        got.setdefault(r.cont_id, []).append(f"{r.prod_name}{r.score}")
    assert {c: " ".join(v) for c, v in got.items()} == expected


def test_the_last_vote_may_lower_a_score(rows):
    nearest = rows(
        [("c", "n1", 1), ("c", "n2", 2)], "cont_id string, neighbor_id string, neighbor_rank int"
    )
    targets = rows(
        [("n1", "A", 5), ("n2", "A", 1), ("n1", "B", 2)],
        "neighbor_id string, prod_name string, cnt long",
    )
    last = voting.best_products(voting.votes(nearest, targets, "last")).collect()
    assert [(r.prod_name, r.score) for r in last] == [("B", 2), ("A", 1)]
    total = voting.best_products(voting.votes(nearest, targets, "sum")).collect()
    assert [(r.prod_name, r.score) for r in total] == [("A", 6), ("B", 2)]


def test_seed_is_the_most_bought_then_first_by_name(log):
    seeds = features.seed_products(features.quantity_weights(log)).collect()
    assert {r.cont_id: r.prod_name for r in seeds} == {
        "c1": "A", "c2": "A", "c3": "D", "c4": "C", "c5": "F",
    }


def test_unseen_neighbors_leave_out_history(rows):
    seeds = rows([("c", "A")], "cont_id string, prod_name string")
    near = rows(
        [("A", "A", 0.0), ("A", "Z", 0.1), ("A", "B", 0.2), ("A", "H", 0.05)],
        "prod_name string, neighbor_id string, dist double",
    )
    past = rows([("c", "A"), ("c", "H"), ("c", "H")], "cont_id string, prod_name string")
    by_name = voting.unseen_neighbors(seeds, near, past).collect()
    assert [(r.prod_name, r["rank"]) for r in sorted(by_name, key=lambda r: r["rank"])] == [("B", 1), ("Z", 2)]
    by_dist = voting.unseen_neighbors(seeds, near, past, order="distance").collect()
    assert [(r.prod_name, r["rank"]) for r in sorted(by_dist, key=lambda r: r["rank"])] == [("Z", 1), ("B", 2)]


def test_held_out_customers_and_sizes(log):
    assert {r.cont_id for r in split.held_out_customers(log, 3).collect()} == {"c5"}
    assert tuple(split.set_sizes(log, 3).first()) == (5, 4, 1)


def test_random_customer_depends_on_the_seed_only(log):
    draws = {split.random_customer(log.repartition(n), 7).first().cont_id for n in (1, 5)}
    assert len(draws) == 1
    assert len({split.random_customer(log, seed).first().cont_id for seed in range(12)}) > 1


def test_votes_are_shuffled_once_for_the_ranking(spark, rows):
    nearest = rows(
        [("c", "n1", 1), (None, "n2", 2)], "cont_id string, neighbor_id string, neighbor_rank int"
    )
    targets = rows(
        [("n1", "A", 5), ("n2", "A", 1), ("n2", "B", 2)], "neighbor_id string, prod_name string, cnt long"
    )
    best = voting.best_products(voting.votes(nearest, targets, "sum"))
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(cont_id") == 1
    got = sorted(((r.cont_id, r.prod_name, r.score, r["rank"]) for r in best.collect()), key=repr)
    assert got == [("c", "A", 5, 1), (None, "A", 1, 2), (None, "B", 2, 1)]

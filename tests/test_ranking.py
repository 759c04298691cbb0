import pytest

from basketry.operators import evaluation, ranking

SCHEMA = "cont_id string, prod_name string, category1 string, CAT1 string, rank int, model_id long, n_rows long"
LABELS = {"L": "LIVING ROOM", "D": "DINING ROOM", "B": "BEDROOM", "A": "ACCESSORIES", "O": "OTHER"}


@pytest.fixture
def picks(rows):
    def build(*items):
        data = [
            (c, p, code, LABELS[code], rank, i, n)
            for i, (c, p, code, rank, n) in enumerate(items, 1)
        ]
        return rows(data, SCHEMA)

    return build


def test_gate_needs_all_three_core_categories(picks):
    full = [("c", "l", "L", 1, 1), ("c", "d", "D", 2, 1), ("c", "b", "B", 3, 1), ("c", "a", "A", 4, 1)]
    part = [("x", "l", "L", 1, 1), ("x", "a", "A", 2, 1), ("x", "o", "O", 3, 1)]
    got = ranking.category_gate(picks(*full, *part)).collect()
    assert {r.prod_name for r in got if r.cont_id == "c"} == {"l", "d", "b"}
    assert {r.prod_name for r in got if r.cont_id == "x"} == {"l", "a"}


def test_lists_are_sorted_by_category_unless_told_otherwise(picks):
    df = picks(("c", "b", "B", 1, 1), ("c", "l", "L", 2, 1), ("c", "b2", "B", 3, 1))

    def order(**kw):
        first = ranking.first_per_group(df, "CAT1", 1, **kw)
        return [r.prod_name for r in sorted(ranking.listed(first, **kw).collect(), key=lambda r: r.position)]

    assert order() == ["l", "b"]
    assert order(sort_by_category=False) == ["b", "l"]


def test_places_are_shared_out_by_purchase_rows(picks):
    df = picks(("c", "p", "L", 1, 2), ("c", "q", "L", 2, 9), ("c", "r", "L", 3, 9))
    got = {r.prod_name: r.places for r in ranking.first_rows(df, "CAT1", 3).collect()}
    assert got == {"p": 2, "q": 1}


def test_wide_pads_with_a_blank(picks, rows):
    placed = ranking.first_rows(picks(("c", "p", "L", 1, 7), ("c", "q", "D", 2, 7)), "prod_name", 1)
    ranked = ranking.listed(ranking.unrolled(placed))
    wide = ranking.wide_recommendations(ranked, rows([("c",), ("none",)], "cont_id string"))
    got = {r.cont_id: tuple(r)[1:] for r in wide.collect()}
    assert got == {"c": ("p", "q", " ", " ", " "), "none": (" ",) * 5}


def test_wide_with_several_rows_per_product(picks, rows):
    placed = ranking.first_rows(picks(("c", "p", "L", 1, 3), ("c", "q", "D", 2, 7)), "prod_name", 5)
    ranked = ranking.listed(ranking.unrolled(placed))
    wide = ranking.wide_recommendations(ranked, rows([("c",)], "cont_id string"))
    assert tuple(wide.first())[1:] == ("p", "p", "p", "q", "q")


def test_hits_by_product_and_by_row(rows):
    shown = rows([("c", "p", 2), ("c", "q", 1), ("d", "p", 1)], "cont_id string, prod_name string, places long")
    bought = rows([("c", "p"), ("c", "p"), ("c", "z"), ("e", "q")], "cont_id string, prod_name string")
    by_product = evaluation.hit_counts(shown, bought).first()
    assert tuple(by_product) == (1, 4, 3, 1 / 3, 1 / 4)
    by_row = evaluation.hit_counts(shown, bought, "rows", "rows").first()
    assert tuple(by_row) == (2, 4, 4, 0.5, 0.5)


def test_no_recommendations_give_no_ratio(rows):
    shown = rows([], "cont_id string, prod_name string, places long")
    bought = rows([("c", "p")], "cont_id string, prod_name string")
    assert tuple(evaluation.hit_counts(shown, bought).first()) == (0, 0, 1, 0.0, None)

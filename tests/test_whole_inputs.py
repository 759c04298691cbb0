"""Nothing is lost on the way: every request, every row, every column by its name."""

import datetime

import pytest

from basketry import storage
from basketry.operators import features, positions, voting
from basketry.plans import recommend
from basketry.schemas import PURCHASES
from basketry.sources import files, star_schema
from basketry.sources.tables import Dataset
from basketry.streaming.feedback import record_suggestions, request_stream
from tests.test_feedback_and_sources import NOW, bought
from verification.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def test_all_purchase_events_become_requests(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet").filter("event_type = 'purchase'").count()
    requests = star_schema.feedback_requests(spark, SMALL)
    rows = requests.collect()
    assert len(rows) == events > 1500
    forms = {}
    for r in rows:
        forms.setdefault((r.client_id, r.form), []).append(r.pos)
    assert all(sorted(p) == list(range(1, len(p) + 1)) and len(p) <= 3 for p in forms.values())


def test_quantities_keep_every_row(rows):
    data = [("c", "a"), ("c", "a"), ("c", None), ("c", "nan"), (None, "a")]
    got = features.with_quantity(rows(data, "cont_id string, prod_name string")).collect()
    cells = sorted((str(r.cont_id), str(r.prod_name), r.qty) for r in got)
    assert cells == [("None", "a", None), ("c", "None", None), ("c", "a", 2), ("c", "a", 2), ("c", "nan", 1)]


def test_null_groups_have_positions(rows):
    df = rows([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    got = positions.with_group_position(df, ["g"], ["v"], size="n").collect()
    assert sorted((str(r.g), r.v, r.position, r.n) for r in got) == [
        ("None", 1, 1, 2), ("None", 2, 2, 2), ("a", 3, 1, 1),
    ]


def test_other_customers_do_not_bound_history_features(rows, monkeypatch):
    """c3 has one order with the largest count; it takes no part, so it does not set the scale."""
    lines = [("c1", "t1", "A"), ("c1", "t1", "A"), ("c1", "t1", "B"), ("c1", "t2", "A"), ("c1", "t3", "C")]
    lines += [("c2", "t4", "A"), ("c2", "t5", "B"), ("c2", "t6", "C")]
    lines += [("c3", "t7", "A")] * 9
    data = [bought(c, t, p, 1) for c, t, p in lines]
    seen = []
    original = features.min_max_weights
    monkeypatch.setattr(features, "min_max_weights", lambda r: seen.append(original(r)) or seen[-1])
    recommend.by_customers(rows(data, PURCHASES), features_from="history", min_orders=2)
    weights = {(r.cont_id, r.prod_name): r.weight for r in seen[-1].collect()}
    # History is the first two of three orders: c1 A 3, B 1; c2 A 1, B 1. Both bought A, so it starts at 1.
    assert weights == {("c1", "A"): 1.0, ("c1", "B"): 0.0, ("c2", "A"): 0.0, ("c2", "B"): 0.0}


def test_stream_and_appends_share_a_folder(spark, rows, tmp_path):
    data = Dataset(spark, str(tmp_path / "data"))
    menu = spark.createDataFrame([], "CAT1 string, prod_family string, prod_subfamily string, prod_name string")
    data.create(rows([bought("c1", "t1", "sofa", 1), bought("c2", "t2", "bed", 2)], PURCHASES), menu)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("client_id,suggestion1,suggestion2,suggestion3\na,bed,sofa,\n")
    stream = request_stream(spark, str(tmp_path / "in"))
    target, marks = str(tmp_path / "data" / "suggestions"), str(tmp_path / "marks")
    record_suggestions(stream, data.purchases(), target, marks, NOW).awaitTermination(120)
    assert data.purchases().columns == PURCHASES.fieldNames() and data.purchases().count() == 4
    data.append_suggestions(data.purchases(with_suggestions=False).limit(1))
    assert data.purchases().count() == 5
    data.reset_suggestions()
    assert data.purchases().count() == 2


def test_limited_and_whole_item_lists_agree(rows):
    """One customer owns nearly all seeds."""
    seeds = rows([("c1", f"p{i}") for i in range(60)] + [("c2", "p1")], "cont_id string, prod_name string")
    near = [(f"p{i}", f"n{(i * 7 + j) % 40:02d}", (i % 9) / 10) for i in range(60) for j in range(4)]
    near = rows(near, "prod_name string, neighbor_id string, dist double")
    past = rows([("c1", "n03"), ("c2", "n08")], "cont_id string, prod_name string")
    for order in ("name", "distance"):
        whole = voting.unseen_neighbors(seeds, near, past, order).collect()
        few = voting.unseen_neighbors(seeds, near, past, order, num_recs=5).collect()
        assert sorted(r for r in whole if r["rank"] <= 5) == sorted(few)
        assert sum(r.cont_id == "c1" for r in whole) == 39


def test_nothing_is_written_where_one_table_exists(spark, rows, tmp_path):
    menu = spark.createDataFrame([], "CAT1 string, prod_family string, prod_subfamily string, prod_name string")
    menu.write.parquet(str(tmp_path / "menu"))
    with pytest.raises(FileExistsError):
        Dataset(spark, str(tmp_path)).create(rows([bought("c", "t", "p", 1)], PURCHASES), menu)
    assert not (tmp_path / "purchases").exists()


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "client.csv"
    path.write_text(
        "prod_name,extra,cont_id,transaction_id,transaction_date,prod_id,prod_family,prod_subfamily\n"
        '"a\nb",x,1,10,2016-02-03,7,F,S\n'
    )
    (row,) = files.read_purchases_csv(spark, str(path), multi_line=True).collect()
    assert (row.cont_id, row.prod_name, row.transaction_date) == ("1", "a\nb", datetime.datetime(2016, 2, 3))
    path.write_text(path.read_text().replace(",F,S", ""))
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.read_purchases_csv(spark, str(path), multi_line=True).collect()
    path.write_text("cont_id,prod_name\n1,a\n")
    with pytest.raises(ValueError, match="transaction_id"):
        files.read_purchases_csv(spark, str(path))


def test_both_headers_of_all_recommendations(spark, rows, tmp_path):
    columns = "cont_id string, " + ", ".join(f"prod_name{i} string" for i in range(1, 6))
    files.write_csv(rows([("c", "p", "q", " ", " ", " ")], columns), str(tmp_path / "r"))
    (row,) = files.read_recommendations_csv(spark, str(tmp_path / "r"), prefix="prod_name").collect()
    assert tuple(row) == ("c", "p", "q", " ", " ", " ")
    with pytest.raises(ValueError, match="recommendation_1"):
        files.read_recommendations_csv(spark, str(tmp_path / "r"))


def test_a_scope_deletes_its_own_tables_only(spark, rows):
    df = rows([(1,)], "x int")
    outer = storage.save(df, "outer")
    with storage.scope(spark):
        inner = storage.save(df, "inner")
        assert inner.count() == 1
    assert outer.count() == 1
    with pytest.raises(Exception, match="not exist|FileNotFound|PATH_NOT_FOUND"):
        inner.count()


def test_the_log_is_joined_once_for_histories_and_counts(spark, rows, tmp_path, monkeypatch):
    """Both sides of the neighbours come from one written log, not from a join of the tables each."""
    lines = [(o, p) for o in range(1, 13) for p in (o % 4, (o + 1) % 3)]
    rows(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = [(o, o % 3, datetime.datetime(2020, 1, o)) for o in range(1, 13)]
    rows(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(
        str(tmp_path / "orders.parquet")
    )
    parts = [(p, f"n{p}", "b", "ECONOMY") for p in range(4)]
    rows(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(
        str(tmp_path / "part.parquet")
    )
    seen, original = [], features.min_max_weights
    monkeypatch.setattr(features, "min_max_weights", lambda r: seen.append(r) or original(r))
    found = QUERIES["user_knn_history_without_self"](spark, str(tmp_path)).collect()
    assert {r.cont_id for r in found} == {"0", "1", "2"} and all(r.cont_id != r.neighbor_id for r in found)
    assert len(seen) == 2 and not any("lineitem" in f for side in seen for f in side.inputFiles())

import datetime
from unittest.mock import MagicMock

import pytest

from basketry.operators import feedback, menu
from basketry.schemas import PURCHASES
from basketry.sources import files
from basketry.sources.tables import Dataset
from basketry.streaming.feedback import record_suggestions, request_stream
from verification import queries

NOW = "2024-01-01 10:00:00"
OLD = datetime.datetime(2020, 1, 1)


def bought(client, order, name, model, sub="S"):
    return (client, order, OLD, "1", model, "F", sub, name, "L", "L/1", "LIVING ROOM")


@pytest.fixture
def purchases(rows):
    data = [
        bought("c1", "t1", "sofa", 1), bought("c1", "t1", "sofa", 1), bought("c2", "t2", "bed", 2),
        bought("c2", "t3", "sofa", 3, sub="S2"),
    ]
    return rows(data, PURCHASES)


def asked(rows, *requests):
    wide = rows(list(requests), "client_id string, suggestion1 string, suggestion2 string, suggestion3 string")
    return feedback.long_requests(wide)


def test_a_client_gets_at_most_as_many_rows_as_names(rows, purchases):
    requests = asked(rows, ("a", "sofa", None, ""), ("b", "sofa", "bed", "none such"), ("c", "x", "", ""))
    got = feedback.suggestion_rows(requests, purchases, NOW)
    by_client = {}
    for r in got.collect():
        by_client.setdefault(r.cont_id, []).append(r.model_id)
        assert r.transaction_id == "suggestion" and r.prod_id is None
        assert r.transaction_date == datetime.datetime(2024, 1, 1, 10)
    assert {c: sorted(m) for c, m in by_client.items()} == {"a": [1], "b": [1, 2, 3]}
    unknown = feedback.unknown_names(requests, purchases).collect()
    assert {(r.client_id, r.prod_name) for r in unknown} == {("b", "none such"), ("c", "x")}


def test_forms_of_one_client_are_separate(rows, purchases):
    requests = asked(rows, ("a", "sofa", "", ""), ("a", "sofa", "", ""), ("a", "bed", "", ""))
    got = feedback.suggestion_rows(requests, purchases, NOW).collect()
    assert sorted(r.model_id for r in got) == [1, 1, 2]


def test_weighted_rows_have_quantity_one(rows, purchases):
    got = feedback.suggestion_rows(asked(rows, ("a", "bed", "", "")), purchases, NOW, weighted=True)
    assert [r.qty for r in got.collect()] == [1]


def test_reset_undoes_append(spark, rows, purchases, tmp_path):
    data = Dataset(spark, str(tmp_path / "data"))
    empty_menu = spark.createDataFrame([], "CAT1 string, prod_family string, prod_subfamily string, prod_name string")
    data.create(purchases, empty_menu)
    with pytest.raises(Exception, match="already exists"):
        data.create(purchases, empty_menu)
    before = sorted(map(str, data.purchases().collect()))
    data.append_suggestions(feedback.suggestion_rows(asked(rows, ("a", "bed", "", "")), purchases, NOW))
    data.append_suggestions(feedback.suggestion_rows(asked(rows, ("b", "bed", "", "")), purchases, NOW))
    assert data.purchases().count() == len(before) + 2
    assert data.purchases(with_suggestions=False).count() == len(before)
    data.reset_suggestions()
    assert sorted(map(str, data.purchases().collect())) == before
    data.replace(purchases.limit(1), empty_menu)
    assert data.purchases().count() == 1


def test_stream_records_each_request_once(spark, purchases, tmp_path):
    inbox, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    (tmp_path / "in").mkdir()
    header = "client_id,suggestion1,suggestion2,suggestion3\n"

    def run():
        record_suggestions(request_stream(spark, inbox), purchases, target, marks, NOW).awaitTermination(120)
        return spark.read.option("recursiveFileLookup", True).schema(PURCHASES).parquet(target).select("cont_id", "prod_name").collect()

    (tmp_path / "in" / "1.csv").write_text(header + "a,bed,,\n")
    assert len(run()) == 1
    assert len(run()) == 1
    (tmp_path / "in" / "2.csv").write_text(header + "b,sofa,bed,\n")
    assert sorted(tuple(r) for r in run()) == [("a", "bed"), ("b", "bed"), ("b", "sofa")]


def test_two_queries_on_one_data_set_keep_all_rows(spark, purchases, tmp_path):
    target = str(tmp_path / "out")
    orders = ["client_id,suggestion1,suggestion2,suggestion3\na,bed,,\n", "suggestion2,client_id,suggestion1\nsofa,b,bed\n"]
    for i, content in enumerate(orders):
        (tmp_path / f"in{i}").mkdir()
        (tmp_path / f"in{i}" / "1.csv").write_text(content)
        # Each query has a checkpoint of its own, so both begin with batch 0.
        requests = request_stream(spark, str(tmp_path / f"in{i}"))
        at = lambda number: f"2024-01-0{number + 1} 10:00:00"
        record_suggestions(requests, purchases, target, str(tmp_path / f"marks{i}"), at).awaitTermination(120)
    rows = spark.read.option("recursiveFileLookup", True).schema(PURCHASES).parquet(target).collect()
    assert sorted((r.cont_id, r.prod_name) for r in rows) == [("a", "bed"), ("b", "bed"), ("b", "sofa")]
    assert {r.transaction_date for r in rows} == {datetime.datetime(2024, 1, 1, 10)}
    (tmp_path / "in1" / "2.csv").write_text("client_id,other\nx,y\n")
    with pytest.raises(Exception):
        requests = request_stream(spark, str(tmp_path / "in1"))
        record_suggestions(requests, purchases, target, str(tmp_path / "marks1"), NOW).awaitTermination(120)


def test_csv_scan_reads_null_texts_and_quotes(spark, tmp_path):
    path = tmp_path / "client.csv"
    path.write_text(
        "cont_id,transaction_id,transaction_date,prod_id,prod_family,prod_subfamily,prod_name\n"
        '1,10,2016-02-03,7,F,NULL,"a ""big"" sofa, red"\n'
        "2,11,2016-02-04 05:06:07,8,F,.,nan\n"
    )
    one, two = files.read_purchases_csv(spark, str(path)).orderBy("cont_id").collect()
    assert one.prod_subfamily is None and one.prod_name == 'a "big" sofa, red'
    assert one.transaction_date == datetime.datetime(2016, 2, 3)
    assert two.prod_subfamily == "." and two.prod_name is None
    assert two.transaction_date == datetime.datetime(2016, 2, 4, 5, 6, 7)


def test_bad_dates_raise_or_become_null(spark, tmp_path):
    path = tmp_path / "client.csv"
    path.write_text(
        "cont_id|transaction_id|transaction_date|prod_id|prod_family|prod_subfamily|prod_name\n"
        "1|10|03/02/16|7|F|S|p\n2|11|never|7|F|S|p\n"
    )
    lax = files.read_purchases_csv(spark, str(path), "|", "MM/dd/yy", strict_dates=False)
    assert {r.cont_id: r.transaction_date for r in lax.collect()} == {
        "1": datetime.datetime(2016, 3, 2), "2": None,
    }
    with pytest.raises(Exception, match="never"):
        files.read_purchases_csv(spark, str(path), "|", "MM/dd/yy").collect()


def test_recommendations_survive_csv(spark, rows, tmp_path):
    columns = "cont_id string, " + ", ".join(f"recommendation_{i} string" for i in range(1, 6))
    data = [("c", "p", "q,r", " ", " ", " ")]
    path = str(tmp_path / "all")
    files.write_csv(rows(data, columns), path)
    assert [tuple(r) for r in files.read_recommendations_csv(spark, path).collect()] == data
    dated = files.export_dated_csv(rows(data, columns), str(tmp_path), "2024-02-03")
    assert dated.endswith("/20240203 file.csv")


def test_menu_lists_and_head(rows):
    data = [("L", "F", f"S{s}", f"p{s}{i}") for s in range(5) for i in range(5)]
    df = rows(data, "CAT1 string, prod_family string, prod_subfamily string, prod_name string")
    lists = {(r.prod_subfamily, r.page): r.prod_names for r in menu.products_by_subfamily(df, 3).collect()}
    assert lists[("S0", 1)] == ["p00", "p01", "p02"] and lists[("S0", 2)] == ["p03", "p04"]
    assert menu.subfamilies_by_family(df).first().prod_subfamilies == [f"S{s}" for s in range(5)]
    head = menu.menu_head(df).collect()
    assert {r.prod_subfamily for r in head} == {"S0", "S1", "S2"} and len(head) == 9


@pytest.mark.parametrize("name", ["purchases_with_feedback", "reset_feedback"])
def test_both_tables_come_from_one_join_of_the_raw_log(name, monkeypatch):
    made, menus = [], []
    monkeypatch.setattr(queries, "_raw", lambda spark, d: made.append(d) or "raw")
    monkeypatch.setattr(queries, "save", lambda df, label: df)
    monkeypatch.setattr(queries, "new_path", lambda spark, label: label)
    monkeypatch.setattr(queries, "_suggestions", lambda *given: None)
    monkeypatch.setattr(queries, "tables", MagicMock())
    monkeypatch.setattr(queries, "star_schema", MagicMock())
    monkeypatch.setattr(queries, "recommend", MagicMock())
    monkeypatch.setattr(queries, "ingest", MagicMock())
    queries.ingest.menu_table = lambda raw, *given, **limits: menus.append(raw)
    queries.QUERIES[name](None, "folder")
    assert made == ["folder"] and menus == ["raw"]

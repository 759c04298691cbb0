import re
import time

import pytest
from pyspark.sql import functions as F

from basketry.llm import pii

TEXTS = [
    "mail ann.lee7@mail8.example.com or call +1 (269) 555-3296, card 4524132264652876.",
    "ip 42.144.35.254, ssn 123-45-6789, born 2001-02-28 or 28/02/2001 or 3.4.1999, us 03/25/2001",
    "DE89 3704 0044 0532 0130 00 and +44 20 7946 0958",
    "4524132264652877 999.1.1.1 000-12-3456 2001-02-30 version 2.0. DE00 3704 0044 0532 0130 00",
    "again ann.lee7@mail8.example.com 4524132264652876 42.144.35.254",
    "",
    None,
]


@pytest.fixture(scope="module")
def masked(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    df = df.withColumns({"n_chars": F.length("text"), "kind": F.lit("k"), "found": F.lit(1)})
    out = pii.pseudonymise(df, "k")
    assert out.columns == df.columns
    return [r for r in out.sort("doc_id").collect()]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def shape(text):
    return re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", text)))


def test_formats_and_checks_are_kept(masked):
    first, third = masked[0].text, masked[2].text
    assert shape(first) == shape(TEXTS[0]) and first != TEXTS[0]
    card = re.search(r"\d{16}", first)[0]
    assert luhn(card) and card[0] == "4" and card != "4524132264652876"
    assert re.search(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", first)
    iban = re.match(r"DE[\d ]+\d", third)[0].replace(" ", "")
    turned = "".join(str(int(c, 36)) for c in iban[4:] + iban[:4])
    assert int(turned) % 97 == 1 and iban != "DE89370400440532013000"


def test_equal_values_stay_linked(masked):
    mail = re.search(r"\S+@mail8\.example\.com", masked[0].text)[0]
    assert mail in masked[4].text and mail != "ann.lee7@mail8.example.com"
    assert re.search(r"\d{16}", masked[0].text)[0] in masked[4].text


def test_what_fails_its_check_stays(masked):
    assert masked[3].text == TEXTS[3]
    assert masked[5].text == "" and masked[6].text is None and masked[6].n_chars is None


def test_length_column_follows(masked):
    assert all(r.n_chars == len(r.text) for r in masked if r.text is not None)
    assert {(r.kind, r.found) for r in masked} == {("k", 1)}


@pytest.mark.parametrize("label", ["ymd", "dmy", "mdy"])
def test_days_are_permuted(spark, label):
    # Two years of days: no two images are equal, all are dates of the same format.
    days = spark.sql("select explode(sequence(date'2000-01-01', date'2001-12-31')) as day")
    pattern = {"ymd": "yyyy-MM-dd", "dmy": "dd/MM/yyyy", "mdy": "MM/dd/yyyy"}[label]
    texts = days.select(F.date_format("day", pattern).alias("v"))
    rows = texts.select("v", pii.kind(F.col("v")).alias("k"), pii.pseudonym("x", F.col("v")).alias("i"))
    rows = [r for r in rows.collect() if r.k == label]
    assert len(rows) > 400 and len({r.i for r in rows}) == len({r.v for r in rows})
    images = spark.createDataFrame([(r.i,) for r in rows], "v string")
    assert {r[0] for r in images.select(pii.kind(F.col("v"))).collect()} == {label}


def test_small_network_is_a_permutation(spark):
    pairs = spark.sql("select explode(sequence(0, 6)) a").crossJoin(
        spark.sql("select explode(sequence(0, 10)) b")
    )
    image = pii.permute_pair("k", "t", F.col("a"), F.col("b"), 7, 11)
    assert len({tuple(r[0]) for r in pairs.select(image).collect()}) == 77
    codes = spark.sql("select lpad(cast(id as string), 3, '0') v from range(1000)")
    assert codes.select(pii.permute_text("k", "t", F.col("v"))).distinct().count() == 1000


def test_key_matters_and_empty_table(spark):
    df = spark.createDataFrame([(1, TEXTS[1], "e")], "doc_id long, text string, __extra string")
    assert pii.pseudonymise(df, "a").first().text != pii.pseudonymise(df, "b").first().text
    assert pii.pseudonymise(df.limit(0), "k").count() == 0
    kinds = [r.kind for r in pii.findings(df, "k").sort("place").collect()]
    assert kinds == ["ip", "ssn", "ymd", "dmy", "dmy", "mdy"]
    # A find with odd surroundings is none.
    odd = spark.createDataFrame([(1, "x" * 50_000 + "1.2.3.4a 12345-45-67890")], "doc_id long, text string")
    assert pii.pseudonymise(odd, "k").first().text == odd.first().text


def test_numbers_among_other_digits_and_capitals(spark):
    cases = [
        ("card 4111 1111 1111 1111 12/27", {"4111 1111 1111 1111": "card"}),
        ("card 4111 1111 1111 1111 123 ok", {"4111 1111 1111 1111": "card"}),
        ("4111-1111-1111-1111-123", {"4111-1111-1111-1111": "card"}),
        ("4111111111111111 12 27 123", {"4111111111111111": "card"}),
        ("12 27 4111 1111 1111 1111", {"4111 1111 1111 1111": "card"}),
        ("amex 3782 822463 10005 12/27", {"3782 822463 10005": "card"}),
        ("4111 1111 1111 1111 28/02/2001", {"4111 1111 1111 1111": "card", "28/02/2001": "dmy"}),
        ("1235 123-45-6789", {"123-45-6789": "ssn"}),
        ("ES91 2100 0418 4502 0005 1332 USD 12", {"ES91 2100 0418 4502 0005 1332": "iban"}),
        ("to ES9121000418450200051332 CAIX now", {"ES9121000418450200051332": "iban"}),
        ("GB82 WEST 1234 5698 7654 32 GBP.", {"GB82 WEST 1234 5698 7654 32": "iban"}),
        (
            "ES91 2100 0418 4502 0005 1332 4111 1111 1111 1111",
            {"ES91 2100 0418 4502 0005 1332": "iban", "4111 1111 1111 1111": "card"},
        ),
        ("12 34 56 A.LEE@X.ORG 42.144.35.254", {"A.LEE@X.ORG": "email", "42.144.35.254": "ip"}),
        ("DE89 3704 0044 0532 0130 00_x", {"DE89 3704 0044 0532 0130 00": "iban"}),
        ("4111 1111 1111 1112 12/27 0.4111111111111111 123-45-67891", {}),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    found = [{} for _ in cases]
    for r in pii.findings(df, "k").collect():
        found[r.doc_id][r.value] = r.kind
    assert found == [kinds for _, kinds in cases]
    for (text, kinds), r in zip(cases, pii.pseudonymise(df, "k").sort("doc_id").collect()):
        # An ip's image has octets of other lengths.
        assert "ip" in kinds.values() or shape(r.text) == shape(text)
        assert not any(value in r.text for value in kinds)


def test_one_image_however_a_value_is_written(spark):
    groups = [
        ["+1 212-555-0147", "+12125550147", "212-555-0147", "(212) 555-0147", "+1.212.555.0147"],
        ["+49 30 1234567", "+49301234567", "+49-30-123-4567"],
        ["2020-03-04", "04/03/2020", "4.3.2020"],
        ["2020-03-25", "25/03/2020", "03/25/2020"],
        ["A.B@x.com", "a.b@X.com", "a.B@x.com"],
    ]
    texts = [(g, i, v) for g, group in enumerate(groups) for i, v in enumerate(group)]
    df = spark.createDataFrame(texts, "g int, i int, text string")
    images = [[] for _ in groups]
    for r in pii.pseudonymise(df, "k").sort("g", "i").collect():
        images[r.g].append(r.text)
    for old, new in zip(groups[:2], images[:2]):
        assert len({re.sub(r"\D", "", x)[-9:] for x in new}) == 1
        assert [shape(x) for x in new] == [shape(x) for x in old] and not set(new) & set(old)
    assert all(x.startswith("+49") for x in images[1]) and images[0][1].startswith("+1")
    (iso, day_first, short), (late, dmy, mdy) = images[2], images[3]
    y, m, d = iso.split("-")
    assert int(d) <= 12 and day_first == f"{d}/{m}/{y}" and [int(x) for x in short.split(".")] == [int(d), int(m), int(y)]
    y, m, d = late.split("-")
    assert int(d) > 12 and dmy == f"{d}/{m}/{y}" and mdy == f"{m}/{d}/{y}"
    assert len({x.lower() for x in images[4]}) == 1 and images[4][0].split("@")[0].isupper()
    kinds = {r.kind for r in spark.createDataFrame([(x,) for x in images[0]], "v string").select(pii.kind(F.col("v")).alias("kind")).collect()}
    assert kinds == {"nanp"}


def test_long_runs_take_linear_time(spark):
    cards = "4111 1111 1111 1111 5500 0000 0000 0004 "
    seconds = []
    for times in (250, 1000, 4000):
        df = spark.createDataFrame([(1, cards * times)], "doc_id long, text string")
        start = time.time()
        text = pii.pseudonymise(df, "k").first().text
        seconds.append(time.time() - start)
        assert len(text) == len(cards) * times and "4111 1111" not in text
        assert text == text[: len(cards)] * times
    # Sixteen times the text; the fixed part of a run is the same.
    assert seconds[2] < 40

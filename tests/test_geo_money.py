from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo, money

KEEP = [
    "Toronto, Ontario", "Ottawa, Canada", "Remote (Canada)", "Canada Remote", "KOHO (CAN)",
    "Kitchener-Waterloo, ON", "Montréal, QC", "Vancouver, British Columbia", "Remote", None, "", " | ",
    "Pointe Claire", "Laval", "Angus, ON", "TBD", "Grocery Ont-East", "Remote - Hybrid",
    "Remote, North America", "Americas | Remote", "Toronto | San Francisco | New York | Remote",
    "United States | Canada | Remote", "London, ON", "Montreal | Remote",
]
DROP = [
    "San Francisco, CA", "New York, NY", "Remote US", "Remote - USA", "London, England, United Kingdom",
    "Berlin, Germany", "EMEA - Remote", "Amsterdam | Remote", "Tokyo | Remote", "Washington, DC | Remote",
    "Korea | Remote", "Melbourne, Victoria", "Santiago | Latin America", "Cambridge, MA | Massachusetts",
    "Remote in the US | Remote", "USA, Remote", "Remote Saudi Arabia", "Remote, KSA", "Remote - Nairobi",
    "Hamburg | Remote", "Manila | Remote", "Pittsburgh, PA", "Lenexa, KS", "New Castle, CO",
    "新北市, New Taipei City, Taiwan", "Sydney, Australia", "Hybrid Sudbury", "Sudbury | Remote",
]


def test_looks_canadian(values):
    assert [x for x, ok in zip(KEEP, values(KEEP, "string", geo.looks_canadian)) if not ok] == []
    assert [x for x, ok in zip(DROP, values(DROP, "string", geo.looks_canadian)) if ok] == []


@pytest.mark.parametrize(
    "segment, kind",
    [
        ("London, ON", "ca"), ("London", "foreign"), ("Melbourne, Victoria", "foreign"), ("Victoria", "ca"),
        ("Remote", "arrangement"), ("新北市", "arrangement"), ("Hybrid Sudbury", "foreign"), ("Sudbury", "unknown"),
        ("U.S.", "foreign"), ("Angus", "unknown"), ("éus", "unknown"), ("Anywhere", "ca"), ("Québec", "ca"),
        ("Austria", "unknown"), ("Toronto ON", "ca"),
    ],
)
def test_segment_kind(values, segment, kind):
    assert values([segment], "string", geo.segment_kind) == [kind]


def test_cad_annual_estimate(spark):
    rows = [
        (120000.0, 140000.0, "CAD", "year"), (50.0, 50.0, "usd", "hour"), (None, None, "CAD", "year"),
        (1e6, None, "JPY", "year"), (1e5, None, "CAD", "year"), (1.0, 2.0, None, "year"), (1.0, 2.0, "CAD", None),
        (0.01, 0.02, "CAD", "year"), (0.03, 0.04, "CAD", "year"),
    ]
    df = spark.createDataFrame(rows, "a double, b double, c string, p string")
    got = [r[0] for r in df.select(money.cad_annual_estimate(*[F.col(x) for x in "abcp"])).collect()]
    # the last two show half-even rounding: 0.015 and 0.035
    assert got == [
        Decimal("130000.00"), Decimal("142480.00"), None, None, Decimal("100000.00"), None, None,
        Decimal("0.02"), Decimal("0.04"),
    ]


def test_percent_and_prf(spark):
    df = spark.createDataFrame(
        [(1, 3, ["a"], ["a"]), (1, 8, [], []), (0, 0, ["a"], ["b"]), (5, 2000, ["a", "b"], ["a", "c"]), (1, 2, [], ["a"])],
        "x int, y int, p array<string>, g array<string>",
    )
    marks = money.prf1(F.col("p"), F.col("g"))
    got = df.select(money.percent(F.col("x"), F.col("y")).alias("pct"), marks["precision"], marks["recall"], marks["f1"]).collect()
    assert [r[0] for r in got] == [33.3, 12.5, 0.0, 0.2, 50.0]
    assert [tuple(r)[1:] for r in got] == [(1, 1, 1), (1, 1, 1), (0, 0, 0), (0.5, 0.5, 0.5), (0, 0, 0)]


def test_looks_canadian_in_sql(spark):
    from tidemark.functions import sql

    sql.register(spark)
    spark.createDataFrame([(x,) for x in (*KEEP, *DROP)], "v string").createOrReplaceTempView("places_to_grade")
    got = spark.sql("SELECT v, looks_canadian(v) AS said FROM places_to_grade")
    assert got.where(F.col("said") != geo.looks_canadian(F.col("v"))).count() == 0
    assert got.where("said").count() == len(KEEP)

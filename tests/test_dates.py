"""Times as feeds, APIs and pages print them."""

from datetime import datetime

import pytest

from presswarp.functions.dates import published_at
from pyspark.sql import functions as F

UTC10 = datetime(2024, 3, 5, 10)
CASES = [
    ("2024-03-05T10:00:00Z", UTC10), ("2024-03-05T10:00:00.123Z", UTC10), ("2024-03-05T12:00+02:00", UTC10), ("2024-03-05 05:00:00 -0500", UTC10), ("Tue, 05 Mar 2024 10:00:00 GMT", UTC10), ("5 Mar 2024 10:00 UT", UTC10), ("Tue, 05 Mar 2024 05:00:00 EST", UTC10), ("05-Mar-2024 10:00:00 +0000", UTC10), ("March 5, 2024 at 02:00 PST", UTC10),
    ("2024-03-05", datetime(2024, 3, 5)), ("2024/03/05", datetime(2024, 3, 4, 16)), ("2024-03-05 18:00", UTC10), ("2024.3.5 18:00:00", UTC10), ("2024年3月5日 18:00", UTC10), ("2024年3月5日18:00", UTC10), ("2024年3月5日 星期二 18:00", UTC10), ("发布于 2024年3月5日", datetime(2024, 3, 4, 16)),
    ("Mar 5th, 2024", datetime(2024, 3, 4, 16)), ("5 March 2024", datetime(2024, 3, 4, 16)), ("Sept. 5, 2024, 18:00", datetime(2024, 9, 5, 10)), ("2024-02-30", None), ("2024-13-01T00:00:00Z", None), ("31 Feb 2024", None), ("2024-03-05T25:00:00Z", None), ("", None), (None, None), ("yesterday", None), ("12:30", None),
    ("03/04/2024", None), ("07.10.2024 10:00", None), ("03/04/2024-07/10/2024", None), ("from 2023-01-01 to 2024-01-01", None), ("Tue, 05 Mar 2024 10:00:00 +1900", datetime(2024, 3, 4, 15)),
]


def run(spark, values, **options):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").orderBy("k").select(published_at(F.col("v"), **options)).collect()]


def test_texts(spark):
    got = run(spark, [v for v, _ in CASES])
    assert [(v, g) for (v, _), g in zip(CASES, got)] == CASES


@pytest.mark.parametrize(("order", "want"), [("dmy", datetime(2024, 10, 7, 2, 13)), ("mdy", datetime(2024, 7, 10, 2, 13))])
def test_years_last(spark, order, want):
    assert run(spark, ["mer 07/10/2024 - 10:13", "07.10.2024 10:13", "07-10-2024T02:13Z"], date_order=order) == [want] * 3
    assert run(spark, ["31/12/2024", "12/31/2024"], date_order=order) == ([datetime(2024, 12, 30, 16), None] if order == "dmy" else [None, datetime(2024, 12, 30, 16)])


def test_units(spark):
    assert run(spark, ["1709632800000", "x", "", None], unit="epoch_ms") == [UTC10, None, None, None] and run(spark, ["1709632800", "1e9"], unit="epoch_s") == [UTC10, None]
    assert run(spark, ["20240305", "20240230", "2024-03-05"], unit="yyyymmdd") == [datetime(2024, 3, 5), None, None]
    assert run(spark, ["[2024,3,5]", "[2024,3]", "[2024]", "[]", "[1700]", "[2024,2,30]", "[2024,1,1,1]", "no"], unit="date_parts") == [datetime(2024, 3, 5), datetime(2024, 3, 1), datetime(2024, 1, 1), None, None, None, None, None]
    assert run(spark, ["2024-03-05 10:00"], offset_hours=0) == [UTC10]

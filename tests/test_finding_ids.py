"""Ids of findings: those of earlier stores, and unique ones however many a scan has."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import report, store


def test_ids_name_their_scan_and_never_meet(spark):
    numbers = [1, 4, store.ID_SPAN - 1, store.ID_SPAN, store.ID_SPAN + 1, 2 * store.ID_SPAN + 4, (1 << 31) - 1]
    rows = spark.createDataFrame([(s, n) for s in (1, 2, 3, 4_000_000) for n in numbers], "scan long, number int")
    got = rows.withColumn("id", store.id_of(F.col("scan"), F.col("number"))).collect()
    assert len({r.id for r in got}) == len(got) and all(store.scan_of(r.id) == r.scan for r in got)
    assert {r.id for r in got if r.scan == 1 and r.number == 4} == {10_000_004}
    # Within a scan ids follow the numbers.
    assert [r.number for r in sorted((r for r in got if r.scan == 2), key=lambda r: r.id)] == numbers


def test_ids_out_of_range_raise(spark):
    row = spark.createDataFrame([(1 << 40, store.ID_SPAN)], "scan long, number int")
    with pytest.raises(Exception, match="overflow|OVERFLOW"):
        row.select(store.id_of(F.col("scan"), F.col("number"))).collect()


def test_the_latest_scan_decides_whatever_its_ids(spark):
    """A wide id of an earlier scan is larger than a short one of a later scan."""
    old = spark.createDataFrame([(1, 1, "f", "REJECTED", store.WIDE + 5), (2, 1, "f", "ACCEPTED", 20_000_001)], "scan_id long, project_id long, fingerprint string, status string, id long")
    new = spark.createDataFrame([(1, "f", 30_000_001)], "project_id long, fingerprint string, id long")
    assert store.carry_status(new, old, F.struct("scan_id", "id")).first().status == "ACCEPTED"


def test_first_finding_of_each_category(spark):
    rows = spark.createDataFrame([(3, "a", ["z"]), (1, "b", ["x"]), (2, "a", ["y"])], "finding_no int, category string, required_fields array<string>")
    got = report.contract_rows(rows)
    assert got.columns == rows.columns and sorted(tuple(r) for r in got.collect()) == [(1, "b", ["x"]), (2, "a", ["y"])]
    assert report.contract_rows(rows.where("false")).count() == 0

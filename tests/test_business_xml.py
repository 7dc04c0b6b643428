"""Business records as XML files that readers share."""

from placewatch.catalog import business
from placewatch.catalog.registry import Tables


def test_records_are_written_as_small_files(spark, folder, monkeypatch):
    monkeypatch.setattr(business, "XML_RECORDS", 5)
    people = [(k, f"Name {k}", k % 3, 1.0, "BUILDING") for k in range(20)]
    (spark.createDataFrame(people, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
     .coalesce(1).write.parquet(f"{folder}/customer.parquet"))
    read = business.xml_records(Tables(spark, folder))
    assert len(set(read.inputFiles())) == 4 and read.count() == 20

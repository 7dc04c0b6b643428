"""Pages of long documents read in byte ranges."""

import os

from pyspark.sql import functions as F

from placewatch.sources import files as SF


def test_page_numbers_over_many_ranges(spark, folder, rows):
    """A file cut into hundreds of ranges, beside small and empty ones: every page once, with its number."""
    pages = {"long.txt": [f"page {i}\n" + "é" * (i * 7919 % 400) for i in range(3000)], "short.txt": ["one", "", "three"]}
    pages["one.txt"] = ["no form feed at all"]
    for name, texts in pages.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as f:
            f.write("\f".join(texts) + ("\f" if name == "short.txt" else ""))
    open(os.path.join(folder, "empty.txt"), "w").close()
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
        spark.conf.set("spark.sql.files.openCostInBytes", 1024)
        read = SF.read_pages(spark, folder)
        assert spark.read.option("lineSep", "\f").text(folder).rdd.getNumPartitions() > 100
        got = {}
        for r in read.collect():
            got.setdefault(os.path.basename(r.path), {})[r.page] = r.text
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == {name: dict(enumerate(texts, 1)) for name, texts in pages.items()}


def test_document_states(spark, rows):
    pages = spark.createDataFrame([("a", 1, "text"), ("a", 2, ""), ("b", 1, " \n")], "path string, page int, text string")
    broken = spark.createDataFrame([("c", 1, b"\xff\xfe")], "path string, page int, raw binary").select("path", "page", F.expr("CAST(raw AS STRING)").alias("text"))
    files = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "path string")
    got = SF.page_documents(pages.unionByName(broken), files)
    assert rows(got, "path", "n_pages", "error_status") == [("a", 2, None), ("b", 1, "no text"), ("c", 1, "broken text"), ("d", 0, "empty")]
    assert SF.page_documents(pages.where("path = 'z'")).count() == 0

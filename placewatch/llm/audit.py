"""Audit of five text filters in every order, kept up to date by a stream with retractions.

New files arrive as available-now micro-batches. A text's state is the least
``doc_id`` met with it, under the digest of the text. Each row is first counted
as a later copy; the rows at the least id are then moved to the counter of
first copies, and moved back (retracted) when a smaller id arrives in a later
micro-batch. Counters are additive, so that the table of counters holds the
result at any moment without the texts being read again.

Everything a micro-batch writes lies in folders of its number and is replaced
when the micro-batch is repeated; it reads state of earlier numbers only. A
run that breaks off therefore goes on from its checkpoint with exact counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_of, words_of

LETTERS = "ABCDE"
#: The filter that needs other rows: an equal text with a smaller id.
COPY = 1 << LETTERS.index("E")
STATE = "key binary, doc_id long, part string, mask int, good long, toxic long, k long, batch int"
COUNTS = "part string, mask int, n long, good long, toxic long, batch int"


def failed(text: Column) -> Column:
    """Bits of the filters A to D that the text fails: few words, few different words, many capitals, odd symbols."""
    words, n = F.col("_words"), F.size("_words")
    tests = [n < 50, F.size(F.array_distinct(words)) * 100 < n * 65,
             F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 5, text.rlike(r"[#$%&*|]")]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def _facts(batch: DataFrame, labels: DataFrame) -> DataFrame:
    """Short rows: digest of the text, id, part, bits of A to D, labels."""
    one = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic"))
    facts = (batch.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text_of().alias("_text"))
             .withColumn("_words", words_of(F.col("_text")))
             .select(F.unhex(F.sha2("_text", 256)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "part",
                     failed(F.col("_text")).alias("mask")))
    return facts.join(one, "doc_id", "left").select("key", "doc_id", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"),
                                                    F.coalesce("toxic", F.lit(0)).alias("toxic"))


def _moved(rows: DataFrame, sign: int) -> DataFrame:
    """Counter changes that take rows from the later copies to the first ones (1) or back (-1)."""
    change = F.explode(F.array(F.struct(F.col("mask").alias("mask"), (sign * F.col("k")).alias("n")),
                               F.struct(F.col("mask").bitwiseOR(COPY).alias("mask"), (-sign * F.col("k")).alias("n"))))
    return (rows.select("part", "good", "toxic", change.alias("c"))
            .select("part", "c.mask", "c.n", (F.col("c.n") * F.col("good")).alias("good"), (F.col("c.n") * F.col("toxic")).alias("toxic")))


def _count(spark: SparkSession, batch: DataFrame, number: int, labels: DataFrame, root: str) -> None:
    own = f"batch={number}"
    # Texts are read once; from here on rows are short.
    _facts(batch, labels).write.mode("overwrite").parquet(f"{root}/facts/{own}")
    facts = spark.read.parquet(f"{root}/facts/{own}")
    least = facts.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    # By digest and id, so that rows of one very common text go to many tasks; a null id has no smaller one.
    first = facts.join(least, ["key", "doc_id"], "left_semi").unionByName(facts.where("doc_id IS NULL"))
    first = first.groupBy("key", "doc_id", "part", "mask", "good", "toxic").agg(F.count("*").alias("k"))
    before = spark.read.schema(STATE).parquet(f"{root}/state").where(F.col("batch") < number)
    both = first.withColumn("batch", F.lit(number)).unionByName(before)
    # A text has a row here per time its least id went down, not per copy.
    w = Window.partitionBy("key")
    both = both.where("doc_id IS NOT NULL").withColumn("_least", F.min("doc_id").over(w)).withColumn(
        "_before", F.min(F.when(F.col("batch") < number, F.col("doc_id"))).over(w))
    nameless = first.where("doc_id IS NULL")
    both = both.where(F.when(F.col("batch") == number, F.col("doc_id") == F.col("_least"))
                      .otherwise((F.col("doc_id") == F.col("_before")) & (F.col("_before") > F.col("_least"))))
    columns = [f.split()[0] for f in STATE.split(", ")][:-1]
    (both.withColumn("_new", F.col("batch") == number).select(*columns, "_new")
     .unionByName(nameless.withColumn("_new", F.lit(True)).select(*columns, "_new"))
     .write.mode("overwrite").parquet(f"{root}/moves/{own}"))
    moves = spark.read.parquet(f"{root}/moves/{own}")
    moves.where("_new AND doc_id IS NOT NULL").drop("_new").write.mode("overwrite").parquet(f"{root}/state/{own}")
    every = facts.select("part", F.col("mask").bitwiseOR(COPY).alias("mask"), F.lit(1).cast("long").alias("n"), "good", "toxic")
    changes = every.unionByName(_moved(moves.where("_new"), 1)).unionByName(_moved(moves.where("NOT _new"), -1))
    (changes.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
     .coalesce(1).write.mode("overwrite").parquet(f"{root}/counts/{own}"))


def count_masks(stream: DataFrame, labels: DataFrame, root: str) -> DataFrame:
    """Run all new files of ``stream`` (``doc_id``, ``text``, ``source``) and return the counters.

    A row per ``part`` (the source; null: empty) and ``mask`` (bits of the
    filters that fail, A lowest): documents ``n``, of them ``good`` and
    ``toxic`` by ``labels`` (the larger one where an id is labelled twice; null
    or no label: neither). A null text is empty; a null ``doc_id`` is no copy
    and makes none; rows with the same text and the same least id are all
    first; other columns are passed over. Without rows there are no counters.
    ``root`` is a folder that all executors share: it holds checkpoint, state
    and counters, and a later call with it goes on from there.
    """
    spark = stream.sparkSession
    for name, schema in (("state", STATE), ("counts", COUNTS)):
        # So that there is a table to read before the first micro-batch.
        spark.createDataFrame([], schema).drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}/batch=-1")
    query = (stream.writeStream.foreachBatch(lambda batch, n: _count(batch.sparkSession, batch, n, labels, root))
             .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    counts = spark.read.schema(COUNTS).parquet(f"{root}/counts")
    return counts.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]).where("n <> 0")


def interactions(counts: DataFrame) -> DataFrame:
    """Every order of the filters, step by step, per part: from counters alone, a row per part and at most 32 masks."""
    part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    orders = F.array(*[F.lit("".join(o)) for o in permutations(LETTERS)])

    def bits(test) -> Column:
        return sum((F.when(test(x), 1 << i).otherwise(0) for i, x in enumerate(LETTERS)), F.lit(0))

    def steps(order: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(len(LETTERS))), lambda s: F.struct(
            order.alias("filter_order"), s.alias("step"), bits(lambda x: F.instr(order, x) == s).alias("own"),
            bits(lambda x: F.instr(order, x) < s).alias("before")))

    # A constant, so that filters and those before them are not looked up again for each mask.
    part = part.select("part", "m", F.inline(F.flatten(F.transform(orders, steps))))

    def total(of: str, test) -> Column:
        return F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.when(test(x["mask"]), x[of]).otherwise(0))

    own, before = F.col("own"), F.col("before")

    def here(m: Column) -> Column:
        return (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) == 0)

    # A document that fails k filters is removed by each of them in 1/k of all orders.
    n_orders = len(list(permutations(LETTERS)))
    shapley = F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.when(
        x["mask"].bitwiseAND(own) != 0, x["n"] * F.floor(F.lit(n_orders) / F.bit_count(x["mask"]))).otherwise(0))
    return part.select("part", "filter_order", "step", total("n", lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
                       total("n", here).alias("removed"),
                       total("n", lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
                       total("n", lambda m: m == own).alias("unique_fails"), total("good", here).alias("good_lost"),
                       total("toxic", here).alias("toxic_lost"), shapley.cast("long").alias("shapley"))


def document_stream(spark: SparkSession, path: str, batches: int = 4) -> DataFrame:
    """A Parquet folder (or file) as a stream of about ``batches`` micro-batches, however many files it has."""
    now = spark.read.parquet(path)
    files = max(1, -(-len(now.inputFiles()) // batches))
    # As a pattern that matches only this name: a stream takes a plain path for a folder, and the table may be one file.
    path = path.rstrip("/")
    return spark.readStream.schema(now.schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")

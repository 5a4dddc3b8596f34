"""What filters do to each other: every order of a set of filters, step by step, audited by part of the corpus.

Each document becomes a mask with a bit for each filter that it fails; documents are counted by part
(its source), mask and label, so that everything after one pass over the texts works on at most
2**len(LETTERS) cells a part. The cells are laid out in long form, a row for each order and step; a
running bit-or over the earlier steps says what is gone already, conditional sums give the steps'
figures, and a window over a filter's rows its total over all orders.

The duplicate filter fails a document whose text some smaller doc_id has, anywhere in the table.
Texts are compared by their SHA-256, and by text, part and label only counts, least ids and their
numbers are shuffled: thousands of copies are a row or two. Null and empty texts are the same text,
without words. A null id is neither smaller nor larger than any: such a row is never a duplicate,
makes none and has no label. Of rows with the same id and text none is smaller. A document labelled
twice has every label it was given. A null source is the part ''. Extra columns are left out. An
empty table has no parts and gives no rows; labels may be empty.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The filters by letter; a document's mask has bit k for the k-th.
LETTERS = "ABCDE"
SPREAD = 256  # rows without an id, which match no label, are dealt to so many keys


def _conditions(text: Column, words: Column) -> dict[str, Column]:
    """Failure of each filter that a text alone decides."""
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents of each part by the filters they fail."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("words"))
    failed = sum((F.when(c, _bit(k)).otherwise(0) for k, c in _conditions(F.col("text"), F.col("words")).items()), F.lit(0))
    rows = rows.select("doc_id", "part", failed.alias("mask"), F.unhex(F.sha2("text", 256)).alias("h")).groupBy("doc_id", "h", "part", "mask").agg(F.count("*").alias("n"))
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("h"), F.lit(SPREAD))).otherwise(0))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("spread", F.lit(0).cast("long"))
    rows = rows.join(marks, ["doc_id", "spread"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    least = rows.groupBy("h", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_without")
    )
    of_text = F.min("first").over(Window.partitionBy("h"))  # rows of a text: its parts and labels
    passing = F.col("n_without") + F.when(F.col("first") == of_text, F.col("n_first")).otherwise(0)
    both = least.withColumn("passing", passing).select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct(F.col("mask").bitwiseOR(_bit("E")).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))).alias("c"))
    counted = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("c.n"))), F.lit(0))
    return both.where("c.n > 0").groupBy("part", "c.mask").agg(F.sum("c.n").alias("n"), counted("good").alias("n_good"), counted("toxic").alias("n_toxic"))


def interactions(cells: DataFrame) -> DataFrame:
    """Every part, order and step, with what its filter finds, removes and would remove alone."""
    orders = ["".join(p) for p in permutations(LETTERS)]
    long = cells.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    long = long.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    long = long.withColumn("bit", F.element_at(F.array(*[F.lit(_bit(k)) for k in LETTERS]), F.instr(F.lit(LETTERS), F.col("filter"))))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("bit").over(before), F.lit(0)))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    total = lambda value, condition: F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0))
    steps = long.groupBy("part", "filter_order", "step", "filter").agg(
        total("n", ~fails & ~gone).alias("kept"), total("n", fails & ~gone).alias("removed"), total("n", fails & gone).alias("redundant"), total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("n_good", fails & ~gone).alias("good_lost"), total("n_toxic", fails & ~gone).alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step; docs (doc_id, source, text), labels (doc_id, quality, toxic)."""
    return interactions(mask_cells(docs, labels))

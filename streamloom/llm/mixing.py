"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Leading hex digits of the shuffle key that split a source's running sum.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: int = 3, epochs: int = 3) -> DataFrame:
    """Words that each source should give: weights 1..cycle by code point order of the sources (null
    last), sharing all words, at most ``epochs`` times a source's own, the excess reshared by weight.

    The fair queue serves every source at its weight until it runs dry, so the shares are
    ``least(epochs * size, weight * horizon)`` at the virtual time at which the budget is spent. One
    row per source stands in the windows here, never one per document.
    """
    whole = Window.orderBy(F.col("source").isNull(), "source")
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", (F.row_number().over(whole) - 1) % cycle + 1)
    s = s.withColumn("dry", (F.col("source_size") * epochs).cast("double") / F.col("weight"))
    by = Window.orderBy("dry", F.col("source").isNull(), "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        F.sum("source_size").over(Window.partitionBy(F.lit(1))).alias("budget"),
        F.coalesce(F.sum(F.col("source_size") * epochs).over(before), F.lit(0)).alias("spent"),
        F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
    )
    level = (F.col("budget") - F.col("spent")).cast("double") / F.col("open")
    s = s.withColumn("level", F.when(level <= F.col("dry"), level))
    s = s.withColumn("horizon", F.max("level").over(Window.partitionBy(F.lit(1))))
    return s.select("source", "source_size", "weight", F.least((F.col("source_size") * epochs).cast("double"), F.col("weight") * F.col("horizon")).alias("target"))


def _cut(entries: DataFrame, weights: int, budget: int) -> tuple[int, int] | None:
    """The virtual time (as a fraction) at which the queue has given ``budget``, from its running total.

    ``entries`` are the queue (``at``, an integer finish time; ``weight``; ``last``, whether its source
    runs dry with it). They are range-partitioned by finish time and each range keeps its place when
    it is written. At an entry's finish the queue has given ``at`` to each weight, less what dry
    sources did not take: running sums over the entries before, from the sums of whole ranges (a row
    for each) and within a range. The first entry at which the total reaches the budget holds the cut.
    """
    queue = written(entries.repartitionByRange("at").withColumn("part", F.spark_partition_id()))
    dry, dry_at = F.when(F.col("last"), F.col("weight")).otherwise(0), F.when(F.col("last"), F.col("weight") * F.col("at").cast("decimal(38,0)")).otherwise(0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = queue.groupBy("part").agg(F.sum(dry).alias("dry"), F.sum(dry_at).alias("dry_at"))
    ranges = ranges.select("part", F.coalesce(F.sum("dry").over(before), F.lit(0)).alias("dry"), F.coalesce(F.sum("dry_at").over(before), F.lit(0)).alias("dry_at"))
    earlier = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    run = queue.withColumns({"own": F.coalesce(F.sum(dry).over(earlier), F.lit(0)), "own_at": F.coalesce(F.sum(dry_at).over(earlier), F.lit(0))}).join(ranges, "part")
    left = F.lit(weights) - F.col("dry") - F.col("own")
    given = F.col("at") * left.cast("decimal(38,0)") + F.col("dry_at") + F.col("own_at")
    run = run.select("at", left.alias("left"), given.cast("decimal(38,0)").alias("given"))
    found = run.filter(F.col("given") >= F.lit(budget).cast("decimal(38,0)")).agg(F.min(F.struct("at", "left", "given")).alias("cut")).first()["cut"]
    return None if found is None else (int(found["at"] * found["left"] - (found["given"] - budget)), int(found["left"]))


def fair_queue(docs: DataFrame, cycle: int = 3, epochs: int = 3, ordered: bool = True) -> DataFrame:
    """The mix, as a schedule ordered by virtual finish time (or, if not ``ordered``, its rows as they lie).

    Each source's documents are shuffled (by md5 of the id, then of the text's hash, so reruns agree)
    and queued up to ``epochs`` times over. An entry's virtual finish time is its source's running
    word count divided by the source's weight. The entries are range-sorted by it over the whole
    table, and a running total in that order says where the budget, the words of all documents, is
    spent (``_cut``). Entries that finish by then give all their words, later ones none, and the entry
    that a source has in service gives its words up to the cut, so every source ends within one word
    of its target.

    The running sums go by slices of the shuffle key: a source that holds a third of all rows is
    summed by 4096 tasks, and only one row per slice and source enters the windows above. Rows
    without an id are dealt to slices by their text.

    Returns ``doc`` (struct of the input's columns without text), ``size``, ``source_size``,
    ``target``, ``epoch`` (from 0), ``finish`` (virtual time), ``words`` (that this entry gives) and
    ``taken`` (that all entries of the document give). Every document has its entry of epoch 0, with
    words 0 if the mix ends before it. Null or blank texts have size 0. Rows with one id are entries
    of their own. An empty table gives an empty schedule; if all sizes are 0, all targets are 0.
    Columns beside doc_id, text and source only pass through ``doc``.
    """
    key = F.md5(F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("-"), F.md5(docs["text"])), F.lit("")))
    sized = written(docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("doc"), docs["source"].alias("source"), key.alias("key"), F.xxhash64(docs["text"]).alias("tie"), word_count(docs["text"]).alias("size")))
    sized = sized.withColumn("slice", F.substring("key", 1, BUCKET_DIGITS))
    targets = written(source_targets(sized, cycle, epochs))
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("source", "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("base"))
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    slices = slices.join(targets, same(slices, targets, "source")).select(slices["source"], "slice", "base", "source_size", "weight", "target")
    within = Window.partitionBy("source", "slice").orderBy("key", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    queue = sized.withColumn("upto", F.sum("size").over(within))
    queue = queue.join(slices, same(queue, slices, "source", "slice")).select("doc", "size", "source_size", "weight", "target", queue["key"], (F.col("base") + F.col("upto")).alias("upto"))
    queue = written(queue)
    # finish times as integers: a common multiple of the weights makes a unit of virtual time
    unit = math.lcm(*range(1, cycle + 1))
    turns = queue.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    end = F.col("epoch") * F.col("source_size") + F.col("upto")
    turns = turns.select((end * F.floor(F.lit(unit) / F.col("weight"))).alias("at"), "weight", (end == epochs * F.col("source_size")).alias("last"))
    sums = targets.agg(F.sum(F.when(F.col("source_size") > 0, F.col("weight"))).alias("weights"), F.sum("source_size").alias("budget")).first()
    cut = _cut(turns, sums["weights"] or 0, (sums["budget"] or 0) * unit)
    served = [0] * cycle if cut is None else [w * cut[0] // (unit * cut[1]) for w in range(1, cycle + 1)]
    last = F.least(F.element_at(F.array(*[F.lit(x).cast("long") for x in served]), F.col("weight").cast("int")), F.col("source_size") * epochs)

    def place(epoch: Column) -> Column:
        end = epoch * F.col("source_size") + F.col("upto")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), last - end + F.col("size")))
        return F.struct(epoch.alias("epoch"), (end / F.col("weight")).alias("finish"), words.alias("words"))

    queue = queue.withColumn("places", F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), place))
    queue = queue.withColumn("taken", F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + p["words"]))
    entries = queue.withColumn("place", F.explode(F.filter("places", lambda p: (p["words"] > 0) | (p["epoch"] == 0))))
    entries = entries.select("doc", "size", "source_size", "target", "taken", "place.*", "key")
    return (entries.sort("finish", "key") if ordered else entries).drop("key")

"""Line dedup: lines found in several documents stay only in the first of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, doc_key, folded, hash_pair, joined_hot, written


def _key(line: Column) -> Column:
    return folded(F.trim(line, F.lit(SPACE)))


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drop repeated lines of whole texts.

    Lines are exploded, normalised (white space stripped at both ends, A-Z lower-cased) and hashed to
    128 bits, once: hashes and positions are written to the shared folder. Hashes of keys of
    ``min_chars`` code points or more that at least ``min_docs`` documents hold lose all their lines,
    except in the smallest doc_id that holds them. What stays is put together again by position.

    Counting combines in the map tasks, so a hot line costs one row a task; hot lines are decided by
    a broadcast of their hashes, the others meet their hash's first document in a shuffle of hashes
    and positions (``joined_hot``). Each text moves once, without a copy, to meet the positions that
    it loses.

    Returns one row per input row: ``doc`` (struct of the input's columns without text),
    ``kept_text``, ``n_lines`` (before dropping), ``n_dropped``. Null and empty texts are one empty
    line. Rows with one doc_id are one document; those without are one document after all others. An
    empty table gives an empty one. Columns beside doc_id and text only pass through ``doc``.
    """
    t1, t2 = hash_pair(F.col("body"))
    ident, keys = ["did", "t1", "t2"], ["h1", "h2"]
    base = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("doc"), doc_key(docs["doc_id"]).alias("did"), F.coalesce(docs["text"], F.lit("")).alias("body")).withColumns({"t1": t1, "t2": t2})
    h1, h2 = hash_pair(F.col("key"))
    lines = (
        base.select(*ident, F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
        .select(*ident, "pos", _key(F.col("line")).alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select(*ident, "pos", h1.alias("h1"), h2.alias("h2"))
    )
    lines = written(lines)
    if min_docs == 2:  # two different ids: no distinct count is needed
        found = lines.groupBy(*keys).agg(F.min("did").alias("first"), F.max("did").alias("other"), F.count(F.lit(1)).alias("n")).filter("first < other")
    else:
        held = lines.groupBy(*keys, "did").agg(F.count(F.lit(1)).alias("n"))
        found = held.groupBy(*keys).agg(F.min("did").alias("first"), F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")).filter(F.col("docs") >= min_docs)
    found = written(found.select(*keys, "first", "n"))
    gone = joined_hot(lines, found, keys, lines.count()).filter("did > first")
    gone = gone.groupBy(*ident).agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    both = base.join(gone, ident, "left").select("doc", F.split("body", "\n", -1).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    # the runs between dropped positions: each line is copied once, however many are dropped
    edges = F.concat(F.array(F.lit(-1)), F.col("gone"))
    ends = F.concat(F.col("gone"), F.array(F.size("lines")))
    runs = F.zip_with(edges, ends, lambda a, b: F.slice(F.col("lines"), a + 2, b - a - 1))
    kept = F.when(F.size("gone") == 0, F.col("lines")).otherwise(F.flatten(runs))
    return both.select("doc", F.array_join(kept, "\n").alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"))

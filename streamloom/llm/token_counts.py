"""Token counts: an exact histogram of encoded lengths, and what it answers for every context limit."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before this vocabulary's merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths that share a block of the suffix sums.
BLOCK = 1024
#: The tokenizer's own matcher gives up on longer runs of white space; those texts are split here.
_LONG_SPACE = re.compile(r"\s{2000}")


@lru_cache(maxsize=2)
def _encodings(ranks_file: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines())}
    return tuple(tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) for name, pattern in (("whole", PATTERN), ("piece", r"(?s).+")))


def _length(text: str, whole, piece) -> int:
    if not _LONG_SPACE.search(text):
        return len(whole.encode_ordinary(text))
    import regex

    return sum(len(piece.encode_ordinary(m.group())) for m in regex.finditer(PATTERN, text))


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``n_tokens`` of every whole text, one row per document, in no order. Null and empty texts have 0."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:  # on the driver; about 1 MB goes to the executors
        ranks_file = spark.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, piece = _encodings(ranks_file.value)
        for batch in batches:
            found = [_length(text.as_py() or "", whole, piece) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["n_tokens"])

    return docs.select("text").mapInArrow(count, "n_tokens long")


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """For each encoded length L that occurs, seen as a context limit:

    ``n_tokens`` (L), ``docs`` (of that length), ``docs_at_least``, ``tokens_at_least`` (documents
    of length L or more, and their tokens), ``quantile`` (share of documents of length L or less),
    ``truncated_total`` (tokens left when every document is cut at L), ``total_docs``, ``total_tokens``.

    Documents are encoded and counted by length before the shuffle; suffix sums go over blocks of
    lengths, then inside each block, so no task gets more than a block's lengths or the blocks.
    An empty table gives an empty histogram; null and empty texts have length 0.
    """
    hist = token_lengths(docs, vocabulary).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))
    hist = hist.withColumns({"tokens": F.col("n_tokens") * F.col("docs"), "block": F.floor(F.col("n_tokens") / BLOCK)})
    hist = written(hist)
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    blocks = hist.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(everything).alias("total_docs"),
        F.sum("t").over(everything).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    sums = hist.withColumns({"d": F.sum("docs").over(within), "t": F.sum("tokens").over(within)}).join(blocks, "block")
    sums = sums.withColumns({"docs_at_least": F.col("d") + F.col("docs_after"), "tokens_at_least": F.col("t") + F.col("tokens_after")})
    return sums.select(
        "n_tokens",
        "docs",
        "docs_at_least",
        "tokens_at_least",
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("docs")) / F.col("total_docs")).alias("quantile"),
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        "total_docs",
        "total_tokens",
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Truncated totals for any context limits, from the next length that occurs: ``limit``,
    ``docs_over`` (longer documents), ``truncated_total``. Limits above all lengths truncate nothing."""
    wanted = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    per_limit = [
        F.min(F.when(F.col("n_tokens") > x, F.struct("n_tokens", "docs_at_least", "tokens_at_least"))).alias(f"l{i}") for i, x in enumerate(limits)
    ]
    row = histogram.agg(F.max("total_tokens").alias("total"), *per_limit)
    rows = row.select("total", F.explode(F.array(*[F.struct(F.lit(int(x)).cast("long").alias("limit"), F.col(f"l{i}").alias("next")) for i, x in enumerate(limits)])).alias("x"))
    over, tokens = F.coalesce("x.next.docs_at_least", F.lit(0)), F.coalesce("x.next.tokens_at_least", F.lit(0))
    rows = rows.select("x.limit", over.alias("docs_over"), (F.coalesce("total", F.lit(0)) - tokens + F.col("x.limit") * over).alias("truncated_total"))
    return wanted.join(rows, "limit")

"""Merkle manifest of a table: levels built upwards and written, proofs pushed downwards through joins.

Every row is a leaf of its group's tree; the groups' subroots, in order, are the leaves of one more tree.
A proof lists, from the leaf up, the digests to the left and to the right of the node at each level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import folded, written

FANOUT = 16
_PATH = "array<struct<left string, right string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of texts put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value so that no two lists of values read alike: ``-`` if null, else its UTF-8 length, ``:`` and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def record_digest(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def tampered(doc_id: Column, text: Column, one_in: int = 5) -> Column:
    """The text with A-Z lower-cased where ``one_in`` divides the id's crc32; rows without an id stay."""
    return F.when(F.crc32(doc_id.cast("string")) % one_in == 0, folded(text)).otherwise(text)


def folded_up(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, leaf, lambda at, step: digest(step["left"], at, step["right"]))


def proof_text(path: Column) -> Column:
    """The proof's digests, level by level from the leaf's, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with ``tree`` (a number for each group, rising in its order, null first), ``at`` (the place in
    the group by ``order``, nulls first) and ``n`` (the group's rows). Written.

    The table is range-partitioned by group and order, so a group of any size lies over several
    partitions; places come from running sums over the partitions' counts, a row for each group in each.
    Rows that tie in all of ``order`` are told apart by where they were read, so copies don't pile up.
    """
    keyed = written(rows.withColumn("_uid", F.monotonically_increasing_id()))
    keys = [F.asc_nulls_first(c) for c in (group, *order, "_uid")]
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    line = F.monotonically_increasing_id()
    dealt = written(dealt.withColumns({"_part": F.shiftright(line, 33).cast("int"), "_line": line.bitwiseAND((1 << 33) - 1)}))
    found = dealt.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_line").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = found.groupBy("_part").agg(F.sum("_n").alias("_all")).select("_part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_start"))
    whole = Window.partitionBy(group)
    spans = found.join(parts, "_part").withColumn("tree", F.min(F.col("_start") + F.col("_first")).over(whole)).withColumn("n", F.sum("_n").over(whole))
    spans = spans.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), "tree", "n", (F.col("_start") - F.col("tree")).alias("_shift"))
    both = dealt.join(spans, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return both.withColumn("at", F.col("_line") + F.col("_shift")).drop("_uid", "_part", "_line", "_p", "_g", "_shift")


@dataclass
class Levels:
    """A forest's written levels: ``runs`` of at most ``FANOUT`` nodes (``kids``) and their digest, for
    each level from the leaves on; ``tops``, the one node that remains of each tree, by level."""

    runs: list[DataFrame]
    tops: list[DataFrame]
    roots: DataFrame


def build(leaves: DataFrame, keep: list[str] | None = None, fanout: int = FANOUT) -> Levels:
    """Levels over ``leaves`` (``tree``, ``at``, ``n``, ``digest``, and columns to ``keep`` with a leaf).
    A run is one group of the aggregation, so no task sees more than ``fanout`` rows of a key. The number
    of levels is the logarithm of the largest tree; only that tree's size comes to the driver."""
    most, depth = leaves.agg(F.max("n")).first()[0] or 0, 0
    while fanout**depth < most:
        depth += 1
    nodes, kept, runs, tops = leaves, keep or [], [], []
    for _ in range(depth + 1):
        tops.append(nodes.filter("n = 1").select("tree", "at", "digest", *kept))
        if len(tops) > depth:
            break
        many = nodes.filter("n > 1").withColumn("run", F.floor(F.col("at") / fanout).cast("long"))
        run = many.groupBy("tree", "run").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "digest", *kept))).alias("kids"))
        runs.append(written(run.withColumn("digest", F.sha2(F.array_join("kids.digest", ""), 256))))
        nodes, kept = runs[-1].select("tree", F.col("run").alias("at"), F.ceil(F.col("n") / fanout).alias("n"), "digest"), []
    roots = tops[0].select("tree", "digest")
    for top in tops[1:]:
        roots = roots.unionByName(top.select("tree", "digest"))
    return Levels(runs, tops, roots)


def pushed(levels: Levels, above: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The leaves (``tree``, ``digest``, ``keep``) with ``path`` and what their tree inherits ``above``:
    a row for each ``tree`` with the ``path`` over its top, and other columns. From the top level down,
    each run hands its children its own path, with the child's siblings before it."""
    more = [c for c in above.columns if c not in ("tree", "path")]

    def topped(level: int, kept: list[str]) -> DataFrame:
        return levels.tops[level].join(above, "tree").select("tree", "at", "digest", *kept, "path", *more)

    known = topped(len(levels.runs), [] if levels.runs else keep or [])
    for level in reversed(range(len(levels.runs))):
        kept = (keep or []) if level == 0 else []
        run = levels.runs[level].select("tree", F.col("run").alias("at"), "kids").join(known.select("tree", "at", "path", *more), ["tree", "at"])
        each = run.select("tree", "path", *more, "kids", F.posexplode("kids").alias("pos", "kid"))
        side = lambda start, length: F.array_join(F.slice("kids.digest", start, length), "")
        step = F.struct(side(F.lit(1), F.col("pos")).alias("left"), side(F.col("pos") + 2, F.size("kids")).alias("right"))
        each = each.select("tree", "kid.at", "kid.digest", *[F.col(f"kid.{c}").alias(c) for c in kept], F.concat(F.array(step), "path").cast(_PATH).alias("path"), *more)
        known = each.unionByName(topped(level, kept))
    return known.drop("at")


def manifest(leaves: DataFrame, group: str, order: list[str], fanout: int = FANOUT) -> DataFrame:
    """Leaves (``digest``, ``group``, ``order`` and other columns) with ``leaf``, ``subroot`` of their group,
    ``root``, and ``path``, their proof. Leaves ascend by ``order`` (nulls first), ties by digest; groups
    ascend, null first. An empty table gives an empty manifest. Columns called ``tree``, ``at``, ``n`` or
    ``path`` may be among the others, as all go in one struct ``row``."""
    packed = leaves.select(F.struct(*leaves.columns).alias("row"), F.col(group).alias("group"), "digest", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    at = placed(packed, "group", [f"_o{i}" for i in range(len(order))] + ["digest"])
    trees = build(at.select("tree", "at", "n", "digest", "row"), ["row"], fanout)
    subroots = written(trees.roots)
    over = placed(subroots.select(F.lit(0).alias("all"), "tree", "digest").withColumnRenamed("tree", "group"), "all", ["group"])
    crown = build(over.select("tree", "at", "n", "digest", "group"), ["group"], fanout)
    top = crown.roots.select("tree", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    above = pushed(crown, top, ["group"]).select(F.col("group").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    return pushed(trees, above, ["row"]).select("row", F.col("digest").alias("leaf"), "subroot", "root", "path")


def verified_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents by source, and its check against texts of which some were tampered with:
    ``row`` (``doc_id``, ``digest``, ``seen``: the leaf as it is met again), ``leaf``, ``subroot``, ``root``,
    ``path``, ``folded_root``, ``verified``.

    A leaf is the digest of doc_id, source, lang, n_chars and text, nulls and whole texts included; other
    columns take no part. Documents without an id come first in their source and are never tampered
    with; equal ids are ordered by their digest, and repeated rows are leaves of their own. Texts are
    read once, hashed and left behind."""
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf, again = record_digest(*rest, F.col("text")), record_digest(*rest, tampered(F.col("doc_id"), F.col("text")))
    leaves = docs.select("doc_id", "source", leaf.alias("digest"), again.alias("seen"))
    found = manifest(leaves, "source", ["doc_id"]).withColumn("folded_root", folded_up(F.col("row.seen"), F.col("path")))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))

"""MinHash near-dedup on fast similarity sketches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, doc_key, hash_pair, joined_hot, packed, scratch, unpacked, written
from .components import components
from .shingles import byte_slices, mixed, shingle_hashes, shingle_sets

#: Bands and coordinates of a band: a pair of similarity 0.8 shares no band with probability 3e-6.
BANDS, ROWS = 42, 6
#: Different texts, and shingles, of a group of candidates that meet in one task.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
_FRACTION = np.uint64(10)


def sketches(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketches (texts x size) of the shingles ``hashes[at[i]:at[i + 1]]``.

    In round i each element goes to one hashed bin with the value i plus a hashed fraction, and bins
    keep their least value; from round ``size`` on, round i puts all elements into bin ``i - size``.
    A text is done as soon as its bins are full, which 2 * size rounds guarantee, and larger sets
    need few. Texts without elements keep the largest value everywhere.
    """
    texts = len(at) - 1
    out = np.full(texts * size, np.iinfo(np.uint64).max, np.uint64)
    text = np.repeat(np.arange(texts), np.diff(at))
    for i in range(2 * size):
        if not len(hashes):
            break
        h = mixed(hashes + np.uint64((i + 1) * 0x9FB21C651E98DF25 % 2**64))
        bins = (h % np.uint64(size)).astype(np.int64) if i < size else i - size
        value = (np.uint64(i) << np.uint64(54)) | (mixed(h) >> _FRACTION)
        np.minimum.at(out, text * size + bins, value)
        open_ = (out.reshape(texts, size) == np.iinfo(np.uint64).max).any(1)[text]
        if not open_.all():
            hashes, text = hashes[open_], text[open_]
    return out.reshape(texts, size)


def _sketched(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for start, data, offsets in byte_slices(batch.column(1)):
                hashes, at = shingle_hashes(data, offsets, words)
                found = sketches(hashes, at, BANDS * ROWS).reshape(-1, BANDS, ROWS)
                keys = np.zeros(found.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + found[:, :, r])
                sets = [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                names = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                half = lambda shift: pa.array(np.array([(n >> shift) % 2**64 for n in names], np.uint64).view(np.int64))
                list_ = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64)))
                n = len(sets)
                cols = [batch.column(0).slice(start, n), batch.column(2).slice(start, n), batch.column(3).slice(start, n), pa.array([len(s) for s in sets], pa.int64()), half(64), half(0), list_]
                yield pa.RecordBatch.from_arrays(cols, names=["did", "t1", "t2", "n_shingles", "s1", "s2", "keys"])

    return run


def _links(sets: list[np.ndarray], left: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join what is similar among sets: of two sides if ``left`` marks one, else of all.
    A spanning forest of the links is returned, as they matter for reachability only."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[inverse] > 1  # what one text alone holds is in no intersection
    owner, inverse = owner[shared], inverse[shared]
    order = np.argsort(inverse, kind="stable")
    posting = owner[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(df)))])
    own_at = np.searchsorted(owner, np.arange(len(sets) + 1))
    two_sides = left.any() and not left.all()
    root = np.arange(len(sets))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in range(len(sets)):
        if two_sides and not left[i]:
            continue
        mine = inverse[own_at[i] : own_at[i + 1]]
        lengths = begin[mine + 1] - begin[mine]
        if not len(mine):
            continue
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begin[mine], lengths)
        both = np.bincount(posting[place], minlength=len(sets))
        near = 100 * both >= percent * (sizes + sizes[i] - both)
        near &= ~left if two_sides else np.arange(len(sets)) > i
        for j in np.flatnonzero(near & (both > 0)):
            a, b = find(i), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, int(j)))
    return out


def size_level(n: Column, percent: int) -> Column:
    """Number of a set's level of sizes: sets of ``100 * both >= percent * either`` have sizes in a ratio
    of at most ``100 / percent``, so their levels differ by 1 at most (the width is a little more)."""
    return F.floor(F.log(n) / (math.log(100 / percent) + 1e-9)).cast("long")


def _block(level: Column, k: Column) -> Column:
    return level * 2**32 + k


def _base(docs: DataFrame, columns: list[str]) -> DataFrame:
    t1, t2 = hash_pair(F.col("body"))
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("doc"), doc_key(docs["doc_id"]).alias("did"), F.coalesce(docs["text"], F.lit("")).alias("body"))
    return rows.withColumns({"t1": t1, "t2": t2})


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose shingle sets are linked by ``100 * both >= percent * either``.

    A document's set holds its distinct runs of ``words`` words (A-Z lower-cased, split at
    ``[\\x20\\x09-\\x0D]+``); a text with fewer words has its whole sequence as one element, one
    without words, or null, has none and is linked with nothing.

    1. Each text is sketched where it is read; documents with equal sets become one class with a
       number of its own, so exact copies cost one row per map task.
    2. Band keys that several classes share link each of them with the smallest of the key, never all
       pairs; components of these links are the groups of candidates.
    3. The texts of groups meet, and every link inside a group is decided on the full sets. Groups of
       over ``BLOCK`` different sets are dealt out by levels of size (``size_level``), and by pairs of
       blocks within a level and between adjacent ones, so no task grows with a group.
       Tasks return a spanning forest of the links they find.
    4. Components of the confirmed links are the result.

    Band keys, groups and components that hold a large part of the rows are broadcast to them
    (``joined_hot``), so none makes a large task of its own.

    Returns one row per input row: ``doc`` (struct of the input's columns, without text), ``did``
    (its id), ``n_shingles``, ``component_id`` (the smallest doc_id reachable), ``kept`` (whether it is
    the first of its group, by id and hash of the text). Different texts are documents of their own
    also where they share an id or have none; rows without one come after all others. An
    empty table gives an empty result.
    """
    base = _base(docs, [c for c in docs.columns if c != "text"])
    rows = _rooted(base, words, percent)
    return base.select("doc", "did", "t1", "t2").join(rows, ["did", "t1", "t2"]).select("doc", "did", "n_shingles", F.col("root").alias("component_id"), "kept")


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns as they are, of which the first of each group of
    ``near_duplicates`` stays. Of several rows with its id and text one stays; rows with neither id
    nor words are in no group and all stay."""
    base, ident = _base(docs, docs.columns), ["did", "t1", "t2"]
    first = _rooted(base, words, percent).filter("kept").select(*ident, "n_shingles")
    alone = F.when((F.col("did") == LAST_ID) & (F.col("n_shingles") == 0), F.monotonically_increasing_id())
    return base.select("doc", *ident).join(first, ident).withColumn("alone", alone).dropDuplicates([*ident, "alone"]).select("doc.*")


def _rooted(base: DataFrame, words: int, percent: int) -> DataFrame:
    """``did``, ``t1``, ``t2``, ``n_shingles``, ``root`` and ``kept`` of each different text of each id."""
    made = base.select("did", "body", "t1", "t2").mapInArrow(_sketched(words), "did long, t1 long, t2 long, n_shingles long, s1 long, s2 long, keys array<long>")
    made = written(made)
    classes = made.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min("n_shingles").alias("n"), F.count(F.lit(1)).alias("held"), F.first("keys").alias("keys"), F.min(F.struct("did", "t1", "t2")).alias("text"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()))
    with scratch(base.sparkSession) as keep:
        same = keep(_firsts(base, classes, words, percent))
    # a set that very many texts hold is hot; texts without words have none and meet nothing
    sets = made.select("did", "t1", "t2", "n_shingles", "s1", "s2")
    rows = joined_hot(sets.filter("n_shingles > 0"), same, ["s1", "s2"], made.count())
    rows = rows.unionByName(sets.filter("n_shingles = 0"), allowMissingColumns=True)
    kept = F.coalesce(F.struct("did", "t1", "t2") == F.col("first"), F.lit(True))
    rows = rows.select("did", "t1", "t2", "n_shingles", F.coalesce("first.did", "did").alias("root"), kept.alias("kept"))
    return rows.groupBy("did", "t1", "t2").agg(F.min("n_shingles").alias("n_shingles"), F.min("root").alias("root"), F.max("kept").alias("kept"))


def _firsts(base: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The first text (``first``) of the component of each class, by its set (``s1``, ``s2``), with the texts that hold it (``n``)."""
    bands = classes.select("cls", F.explode("keys").alias("key"))
    hubs = bands.groupBy("key").agg(F.min("cls").alias("hub"), F.max("cls").alias("last"), F.count(F.lit(1)).alias("n"))
    hubs = written(hubs.filter("hub < last").select("key", "hub", "n"))
    met = joined_hot(bands, hubs, ["key"], BANDS * classes.count()).filter("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    groups = components(met)
    members = classes.select("cls", "n", "text.*").join(groups, F.col("cls") == F.col("node")).select("cls", "n", "did", "t1", "t2", F.col("root").alias("grp"))
    members = written(members)
    # groups are put together to tasks of some size; of a large one the sets are dealt out by size, as
    # similar sets are in one level of sizes or in two adjacent ones, and only these levels meet
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    sums = [F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")]
    members = members.withColumn("level", size_level(F.col("n"), percent))
    levels = members.groupBy("grp", "level").agg(*sums).withColumn("blocks", blocks)
    whole = Window.partitionBy("grp")
    levels = levels.withColumns({"split": F.greatest(F.ceil(F.sum("m").over(whole) / BLOCK), F.ceil(F.sum("total").over(whole) / BLOCK_SHINGLES)) > 1})
    by = Window.partitionBy("grp").orderBy("level")
    above = F.when(F.lead("level").over(by) == F.col("level") + 1, F.lead("blocks").over(by))
    below = F.when(F.lag("level").over(by) == F.col("level") - 1, F.lag("blocks").over(by))
    levels = written(levels.select("grp", "level", "blocks", "split", F.coalesce(above, F.lit(0)).alias("above"), F.coalesce(below, F.lit(0)).alias("below"), F.col("m").alias("n")))
    held, total = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bins = max(1, -(-total // (BLOCK_SHINGLES // 2)))
    dealt = joined_hot(members.drop("n"), levels, ["grp", "level"], held)
    small = dealt.filter(~F.col("split")).withColumns({"mine": F.lit(0).cast("long"), "bin": F.pmod(F.xxhash64("grp"), F.lit(bins))})
    small = small.withColumn("pair", F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))
    mine = _block(F.col("level"), F.pmod(F.xxhash64("cls"), F.col("blocks")))

    def meets(step: int, count: str) -> Column:
        def pair(k: Column) -> Column:
            other = _block(F.col("level") + step, k)
            return F.struct(F.least(other, F.col("mine")).alias("i"), F.greatest(other, F.col("mine")).alias("j"))

        return F.transform(F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>")), pair)

    large = dealt.filter("split").withColumns({"mine": mine, "bin": F.col("grp")})
    large = large.withColumn("pair", F.explode(F.concat(meets(0, "blocks"), meets(1, "above"), meets(-1, "below"))))
    names = ["cls", "did", "t1", "t2", "grp", "mine", "split", "bin", "pair.i", "pair.j"]
    placed = small.select(*names).unionByName(large.select(*names))
    # members grow with the input, so this join is the same at every size: never a broadcast
    texts = packed(base.select("did", "t1", "t2", "body")).join(placed.hint("merge"), ["did", "t1", "t2"])

    def link(table: pa.Table) -> pa.Table:
        table = table.take(np.unique(table["cls"].to_numpy(), return_index=True)[1])  # repeated rows
        sets = list(shingle_sets(pa.array(map(unpacked, table["packed"].to_pylist()), pa.large_binary()), words))
        cls, grp, side = (table[c].to_numpy() for c in ("cls", "grp", "mine"))
        order = np.argsort(grp, kind="stable")
        out = []
        for part in np.split(order, np.flatnonzero(np.diff(grp[order])) + 1):
            left = side[part] == side[part].min()
            out += [(cls[part[a]], cls[part[b]]) for a, b in _links([sets[x] for x in part], left, percent)]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    confirmed = texts.groupBy("split", "bin", "i", "j").applyInArrow(link, "a long, b long")
    found = written(classes.select("cls", "text").join(components(confirmed), F.col("cls") == F.col("node")).select("cls", "text", "root"))
    firsts = written(found.groupBy("root").agg(F.min("text").alias("first"), F.count(F.lit(1)).alias("n")))
    found = joined_hot(found, firsts, ["root"], found.count()).select("cls", "first")
    return classes.join(found, "cls", "left").select("s1", "s2", F.col("held").alias("n"), F.coalesce("first", "text").alias("first"))

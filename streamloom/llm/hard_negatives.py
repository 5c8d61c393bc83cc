"""Hard negatives by vantage-point trees over norm-augmented vectors.

With one more component, ``sqrt(M^2 - |v|^2)`` for rows and 0 for anchors (M the largest norm), an inner
product s is a distance: ``d^2 = |q|^2 + M^2 - 2 s``. So the best scores are the nearest rows, and a window
of scores is an annulus around the anchor. Two kinds of tree prune by it: one over a bounded sample deals
all rows to cells, one in each cell deals its rows to leaves. Pruning leaves room for rounding; scores
themselves are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a leaf; components that the upper tree is fitted on; components of a cell before it is split by hash.
LEAF, SAMPLE, CELL = 128, 1 << 19, 1 << 22
#: Cells of the upper tree: at least so many, so that tasks share the work, at most so many.
LEAST_CELLS, MOST_CELLS = 16, 4096
#: Cells without a tree, for vectors of other lengths and for those with components beyond TAME.
OTHERS = 64
TAME = 2.0**31
#: Sums of products up to this are exact as doubles; larger ones are taken as integers of any length.
EXACT = 2.0**53
MOST = 2**63 - 1
#: Part of ``|q|^2 + M^2`` by which a bound may be off after rounding.
SLACK = 1e-6
_ROW = "id bigint, label bigint, dims int, wild boolean, norm double, vec binary"
_FOUND = "rid bigint, found array<struct<tag:bigint,score:bigint,id:bigint>>"


def _vectors(vecs: pa.Array, wild: bool) -> np.ndarray:
    """Equally long vectors as rows of doubles."""
    flat = np.frombuffer(b"".join(v.as_py() for v in vecs), np.float64 if wild else np.int32)
    return flat.reshape(len(vecs), -1).astype(np.float64)


@dataclass
class Tree:
    """A vantage-point tree: its points, and for each leaf the points above it (``paths``: point, least and
    greatest distance of the leaf's rows from it). ``radii`` and ``sides`` (of the upper tree) deal rows out:
    child numbers below 0 are leaves, counted from -1 on."""

    points: list[np.ndarray] = field(default_factory=list)
    paths: list[list[tuple[int, float, float]]] = field(default_factory=list)
    radii: list[float] = field(default_factory=list)
    sides: list[list[int]] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def bounds(self, queries: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query and leaf, the greatest and the least score that the leaf's rows can have."""
        both = (queries**2).sum(axis=1)[:, None] + size
        slack = SLACK * both + 1e-3
        near, far = np.zeros((len(queries), len(self.paths))), np.full((len(queries), len(self.paths)), np.inf)
        if self.points:
            away = np.sqrt(np.maximum(both - 2 * queries @ np.array([p[: queries.shape[1]] for p in self.points]).T, 0))
            for leaf, path in enumerate(self.paths):
                for point, low, high in path:
                    d = away[:, point]
                    np.maximum(near[:, leaf], np.maximum(d - high, low - d), out=near[:, leaf])
                    np.minimum(far[:, leaf], d + high, out=far[:, leaf])
        return (both - near**2) / 2 + slack, (both - far**2) / 2 - slack

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each augmented vector is dealt to."""
        at = np.full(len(vectors), 0 if self.sides else -1)
        for _ in range(len(self.sides)):
            inner = np.unique(at[at >= 0])
            if not len(inner):
                break
            for node in inner:
                rows = np.flatnonzero(at == node)
                d = np.sqrt(((vectors[rows] - self.points[node]) ** 2).sum(axis=1))
                at[rows] = np.where(d <= self.radii[node], *self.sides[node])
        return -1 - at


def augmented(vectors: np.ndarray, size: float) -> np.ndarray:
    return np.hstack([vectors, np.sqrt(np.maximum(size - (vectors**2).sum(axis=1), 0))[:, None]])


def grown(vectors: np.ndarray, leaf: int, strict: bool) -> Tree:
    """A tree over augmented vectors, halved at the median distance from the row that is farthest from
    their mean. ``strict`` (the upper tree) keeps rows of one distance together, so that rows outside
    the sample can be dealt out by it, and bounds leaves by the radii alone; else halves are of equal size
    whatever ties, and leaves are bounded by the distances that their rows have."""
    tree, todo = Tree(), [(np.arange(len(vectors)), [], None)]
    while todo:
        rows, path, parent = todo.pop()
        own = vectors[rows]
        away = np.zeros(len(rows))
        if len(rows) > leaf:
            point = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
            away = np.sqrt(((own - point) ** 2).sum(axis=1))
        if away.max(initial=0) == away.min(initial=0):  # few rows, or all alike
            number = -1 - len(tree.leaves)
            tree.leaves.append(rows)
            tree.paths.append(path)
        else:
            number = len(tree.points)
            order = np.argsort(away, kind="stable")
            half = len(rows) // 2
            radius = float(away[order[half - 1]])
            if strict:
                half = int((away <= radius).sum())
                if half == len(rows):  # the greatest distance is the median too
                    radius = float(away[away < radius].max())
                    half = int((away <= radius).sum())
            tree.points.append(point)
            tree.radii.append(radius)
            tree.sides.append([0, 0])
            for side, part in ((1, order[half:]), (0, order[:half])):
                low, high = ((0.0, radius), (radius, np.inf))[side] if strict else (float(away[part].min()), float(away[part].max()))
                todo.append((rows[part], [*path, (number, low, high)], (number, side)))
        if parent:
            tree.sides[parent[0]][parent[1]] = number
    return tree


class Cell:
    """The rows of one length in a cell. Of rows that are alike in vector and label only the ``most``
    smallest ids are kept, as no list of results holds more of them; equal rows count once."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, size: float | None, most: int):
        kind = np.unique(np.hstack([vectors, labels[:, None].astype(np.float64)]), axis=0, return_inverse=True)[1].reshape(-1)
        order = np.lexsort((ids, kind))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (kind[order][1:] != kind[order][:-1]) | (ids[order][1:] != ids[order][:-1])
        order = order[fresh]
        first = np.flatnonzero(np.concatenate([[True], kind[order][1:] != kind[order][:-1]]))
        place = np.arange(len(order)) - np.repeat(first, np.diff([*first, len(order)]))
        rows = order[place < most]
        self.size, self.tree = size, None
        if size is not None:
            self.tree = grown(augmented(vectors[rows], size), LEAF, False)
            self.edges = np.cumsum([0, *map(len, self.tree.leaves)])
            rows = rows[np.concatenate(self.tree.leaves)]
        self.ids, self.labels, self.vectors = ids[rows], labels[rows], vectors[rows]
        self.reach = float(np.abs(self.vectors).max(initial=0)) * max(vectors.shape[1], 1)

    def scores(self, query: np.ndarray, first: int, last: int) -> np.ndarray:
        own = self.vectors[first:last]
        if float(np.abs(query).max(initial=0)) * self.reach < EXACT:
            return (own @ query).astype(np.int64)
        whole = [int(x) for x in query]
        return np.array([max(-MOST, min(MOST, sum(a * int(b) for a, b in zip(whole, row)))) for row in own], np.int64)

    def nearest(self, query: np.ndarray, own: int, label: int, same: bool, windows: list[dict], k: int, bounds: tuple[np.ndarray, np.ndarray] | None) -> list[tuple[int, int, int]]:
        """For each window of scores the ``k`` best rows of the same label, or of other labels: leaves are
        visited nearest first within the annulus, until no leaf left can better any window's."""
        low, high = min(w["low"] for w in windows), max(w["high"] for w in windows)
        if bounds is None:
            order, top, edges = np.zeros(1, int), np.full(1, np.inf), np.array([0, len(self.ids)])
        else:
            top, bottom = bounds
            order, edges = np.argsort(-top, kind="stable"), self.edges
            order = order[(top[order] >= low) & (bottom[order] <= high)]
        scores, ids, at, step, out = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 2, []
        while at < len(order):
            for leaf in order[at : at + step]:
                first, last = edges[leaf], edges[leaf + 1]
                s = self.scores(query, first, last)
                fit = (s >= low) & (s <= high) & ((self.labels[first:last] == label) == same) & (self.ids[first:last] != own)
                scores, ids = np.concatenate([scores, s[fit]]), np.concatenate([ids, self.ids[first:last][fit]])
            at, step = at + step, step * 2
            sort = np.lexsort((ids, -scores))
            scores, ids, out, enough = scores[sort], ids[sort], [], True
            for w in windows:
                first = int(np.searchsorted(-scores, -w["high"]))
                last = min(first + k, int(np.searchsorted(-scores, -w["low"], side="right")))
                out += [(w["tag"], int(s), int(i)) for s, i in zip(scores[first:last], ids[first:last])]
                worst = scores[last - 1] if last - first == k else w["low"]
                enough &= at >= len(order) or top[order[at]] < worst
            if enough:
                break
        return out


@dataclass
class Index:
    """All rows, dealt to cells (``cell``, ``sub``), and what prunes cells: the upper tree over vectors of
    ``dims`` components and of squares up to ``size``, and the parts that each cell is split into."""

    rows: DataFrame
    tree: Tree
    dims: int
    size: float
    subs: dict[int, int]


def integers(rows: DataFrame, scale: int = 256) -> DataFrame:
    """Rows that take part: ``floor(scale * x)`` of each component, as 32-bit integers where all fit, else as doubles (``wild``)."""
    x = F.col("embedding").cast("array<double>")
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.coalesce(F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * scale == float("inf"))), F.lit(False))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, edges = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            own = [flat[a:b] for a, b in zip(edges, edges[1:])]
            wild = [bool(len(v)) and float(np.abs(v).max()) >= TAME for v in own]
            with np.errstate(over="ignore"):
                norm = [float((v**2).sum()) for v in own]
            vec = [v.tobytes() if w else v.astype(np.int32).tobytes() for v, w in zip(own, wild)]
            columns = [batch.column(0), batch.column(1), pa.array(np.diff(edges).astype(np.int32)), pa.array(wild, pa.bool_()), pa.array(norm, pa.float64()), pa.array(vec, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "dims", "wild", "norm", "vec"])

    return rows.filter(whole).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), x.alias("x")).mapInArrow(made, _ROW)


def indexed(items: DataFrame) -> Index:
    """The upper tree is fitted on the rows of the commonest length whose ids hash lowest, at most
    ``SAMPLE`` components in all; every row is dealt to a cell. What comes to the driver is that sample
    and a count for each of at most ``MOST_CELLS + OTHERS`` cells."""
    tame = items.filter("not wild")
    most = tame.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("size")).orderBy(F.desc("n"), "dims").first()
    dims, size, tree = (most["dims"], most["size"] * (1 + 1e-9) + 1, Tree()) if most else (0, 1.0, Tree())
    if most and dims:
        sample = tame.filter(F.col("dims") == dims).orderBy(F.xxhash64("id"), "id", "vec").limit(max(SAMPLE // (dims + 1), 2)).select("vec").toArrow()["vec"]
        cells = min(MOST_CELLS, max(LEAST_CELLS, -(-most["n"] * dims * 2 // CELL)))
        tree = grown(augmented(_vectors(sample, False), size), max(len(sample) // cells, 1), True)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, wild = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            cell = -1 - length % OTHERS
            usual = np.flatnonzero((length == dims) & ~wild)
            if tree.paths and len(usual):
                cell[usual] = tree.leaf_of(augmented(_vectors(batch.column(5).take(pa.array(usual)), False), size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

    rows = written(items.mapInArrow(dealt, f"{_ROW}, cell int"))
    subs = {r["cell"]: -(-r["n"] // CELL) for r in rows.groupBy("cell").agg(F.sum(F.col("dims") + 1).alias("n")).collect()}
    return Index(rows, tree, dims, size, subs)


def _dispatched(requests: DataFrame, index: Index, first: bool) -> DataFrame:
    """Requests with each cell that they go to: ``first``, the one that may hold the best score; else all
    others that can hold any of the scores that are asked for."""
    tree, dims, size, subs = index.tree, index.dims, index.size, index.subs
    trees = np.array(sorted(c for c in subs if c >= 0), int)
    kept = ["rid", "id", "label", "dims", "wild", "vec", "windows"]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, wild = batch.column(3).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)
            usual, pairs = np.flatnonzero((length == dims) & ~wild), []
            place = {int(r): n for n, r in enumerate(usual)}
            if len(trees) and len(usual):
                top, bottom = (b[:, trees] for b in tree.bounds(_vectors(batch.column(5).take(pa.array(usual)), False), size))
            for r, windows in enumerate(batch.column(6).to_pylist()):
                goes = []
                if r in place and len(trees):
                    best = int(np.argmax(top[place[r]]))
                    fits = (top[place[r]] >= min(w["low"] for w in windows)) & (bottom[place[r]] <= max(w["high"] for w in windows))
                    goes = [trees[best]] if first else [c for n, c in enumerate(trees) if fits[n] and n != best]
                elif not first and length[r] == dims:
                    goes = list(trees)
                if not first and -1 - length[r] % OTHERS in subs:
                    goes.append(-1 - length[r] % OTHERS)
                pairs += [(r, int(c), s) for c in goes for s in range(subs[int(c)])]
            rows, cells, parts = (np.array(x, np.int32) for x in zip(*pairs)) if pairs else [np.zeros(0, np.int32)] * 3
            for at in range(0, max(len(rows), 1), 8192):
                some = slice(at, at + 8192)
                taken = batch.take(pa.array(rows[some]))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells[some]), pa.array(parts[some])], names=[*kept, "cell", "sub"])

    return requests.select(*kept).mapInArrow(sent, "rid bigint, id bigint, label bigint, dims int, wild boolean, vec binary, windows array<struct<tag:bigint,low:bigint,high:bigint>>, cell int, sub int")


def _visited(requests: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """What each request finds in each cell that it goes to. A cell's rows come first in its task and are
    held (at most ``CELL`` components and one row); the requests stream past them."""
    size, count = index.size, len(index.subs)
    parts = F.create_map(*[F.lit(x) for kv in index.subs.items() for x in kv]) if 0 < count <= 64 else None
    split = F.coalesce(parts[F.col("cell")], F.lit(1)) if parts is not None else None
    if split is None:
        table = index.rows.sparkSession.createDataFrame([*index.subs.items()] or [(0, 1)], "cell int, parts int")
        rows = index.rows.join(F.broadcast(table), "cell").withColumnRenamed("parts", "_parts")
    else:
        rows = index.rows.withColumn("_parts", split)
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    none = F.lit(None)
    rows = rows.select("cell", "sub", none.cast("bigint").alias("rid"), "id", "label", "dims", "wild", "vec", none.cast("array<struct<tag:bigint,low:bigint,high:bigint>>").alias("windows"))
    asked = requests.select("cell", "sub", "rid", "id", "label", "dims", "wild", "vec", "windows")
    both = rows.unionByName(asked).repartition("cell", "sub").sortWithinPartitions("cell", "sub", F.asc_nulls_first("rid"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, cells = [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).is_null().to_numpy(zero_copy_only=False)], axis=1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(key)]
            for a, b in zip(edges, edges[1:]):
                part, own = batch.slice(a, b - a), tuple(key[a][:2])
                if own != now:
                    held, now, cells = [], own, None
                if key[a][2]:
                    held.append(part.select(["id", "label", "dims", "wild", "vec"]))
                    continue
                if cells is None:
                    cells, held = _cells(held, size if now[0] >= 0 else None, k + 1), []
                yield _answers(part, cells, k, same)

    return both.mapInArrow(visit, _FOUND)


def _cells(held: list[pa.RecordBatch], size: float | None, most: int) -> dict[int, Cell]:
    if not held:
        return {}
    rows = pa.Table.from_batches(held).combine_chunks()
    ids, labels, length, wild = (rows[c].to_numpy(zero_copy_only=False) for c in ("id", "label", "dims", "wild"))
    vecs, out = rows["vec"].combine_chunks(), {}
    for dims in np.unique(length):
        own = [np.flatnonzero((length == dims) & (wild == w)) for w in (False, True)]
        order = np.concatenate(own)
        vectors = np.vstack([_vectors(vecs.take(pa.array(o)), w) if len(o) else np.zeros((0, dims)) for o, w in zip(own, (False, True))])
        out[int(dims)] = Cell(ids[order], labels[order], vectors, size, most)
    return out


def _answers(asked: pa.RecordBatch, cells: dict[int, Cell], k: int, same: bool) -> pa.RecordBatch:
    rids, found = [], []
    length, wild = asked.column("dims").to_numpy(), asked.column("wild").to_numpy(zero_copy_only=False)
    ids, labels, windows = asked.column("id").to_numpy(), asked.column("label").to_numpy(), asked.column("windows").to_pylist()
    for dims in np.unique(length):
        cell = cells.get(int(dims))
        for is_wild in (False, True):
            rows = np.flatnonzero((length == dims) & (wild == is_wild))
            if cell is None or not len(rows):
                continue
            queries = _vectors(asked.column("vec").take(pa.array(rows)), is_wild) if dims else np.zeros((len(rows), 0))
            top, bottom = cell.tree.bounds(queries, cell.size) if cell.tree and not is_wild else (None, None)
            for n, r in enumerate(rows):
                got = cell.nearest(queries[n], ids[r], labels[r], same, windows[r], k, None if top is None else (top[n], bottom[n]))
                if got:
                    rids.append(asked.column("rid")[int(r)].as_py())
                    found.append([{"tag": t, "score": s, "id": i} for t, s, i in got])
    kind = pa.list_(pa.struct([("tag", pa.int64()), ("score", pa.int64()), ("id", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(found, kind)], names=["rid", "found"])


def _best(found: DataFrame, k: int) -> DataFrame:
    """(``rid``, ``tag``, ``score``, ``id``, ``rank``): the ``k`` best of all cells' finds, each once."""
    each = found.select("rid", F.explode("found").alias("f")).select("rid", "f.*").distinct()
    by = Window.partitionBy("rid", "tag").orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def searched(requests: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """The ``k`` best of each request's windows. Each request first visits its nearest cell; what it finds there
    raises the scores that other cells must reach, and spares it most of them where vectors cluster."""
    home = written(_visited(_dispatched(requests, index, True), index, k, same))
    worst = _best(home, k).groupBy("rid", "tag").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).filter(F.col("n") == k)
    worst = worst.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("tag", "s"))).alias("worst"))
    raised = F.transform("windows", lambda w: F.struct(w["tag"].alias("tag"), F.greatest(w["low"], F.try_element_at("worst", w["tag"])).alias("low"), w["high"].alias("high")))
    rest = requests.join(worst, "rid", "left").withColumn("windows", raised)
    return _best(home.unionByName(_visited(_dispatched(rest, index, False), index, k, same)), k)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """For each row that ``anchor`` says, and each of its first ``positives`` other rows of the same label, the
    first ``negatives`` rows of other labels whose score is ``low`` to ``high`` hundredths of the positive's:
    ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``rows`` has ``vec_id``, ``embedding`` and ``label``; other columns take no part, nor do rows in which one of
    the three, or a component, is null, or with a component that isn't finite (or isn't when scaled). Vectors meet those of
    their own length only. Higher scores come first, ties by smaller id. A row that repeats another in all
    three columns counts once; different rows of one id are anchors and candidates of their own, but
    never each other's. Scores beyond 64 bits are held at the largest. An empty table gives no rows.
    """
    items = written(integers(rows, scale))
    index = indexed(items)
    chosen = rows.filter(anchor).select(F.col("vec_id").cast("long").alias("id")).distinct()
    asked = items.join(chosen, "id", "left_semi").dropDuplicates(["id", "label", "vec"]).withColumn("rid", F.monotonically_increasing_id())
    window = lambda tag, lo, hi: F.struct(tag.cast("long").alias("tag"), lo.cast("long").alias("low"), hi.cast("long").alias("high"))
    asked = written(asked.withColumn("windows", F.array(window(F.lit(0), F.lit(-MOST), F.lit(MOST)))))
    found = written(searched(asked, index, positives, True).select("rid", F.col("rank").alias("tag"), "score", F.col("id").alias("positive_id")).filter("score >= 0"))
    share = lambda part: F.col("score").cast("decimal(20,0)") * part / 100
    near, far = F.floor(share(high)), F.ceil(share(low))
    windows = found.filter(near >= far).groupBy("rid").agg(F.array_sort(F.collect_list(window(F.col("tag"), far, near))).alias("windows"))
    wanted = written(asked.drop("windows").join(windows, "rid"))
    pairs = searched(wanted, index, negatives, False).select("rid", "tag", "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
    full = pairs.join(found, ["rid", "tag"]).join(asked.select("rid", F.col("id").alias("anchor_id")), "rid")
    return full.select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")

"""Suffix-array dedup: bytes covered by a string of minimum length that also starts elsewhere."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, hash_pair, joined_hot, packed, unpacked, written
from .shingles import byte_slices, mixed, prefix_hashes

#: Bytes of the grams of which each window's least hash names the group that decides about it.
GRAM = 64
#: Bytes of different strings that meet in one task, as far as groups can be put together; a group of
#: over MOST_BYTES is split by longer contexts first.
TASK_BYTES, MOST_BYTES = 1 << 19, 1 << 20
#: Texts are read in slices of so many bytes; longer texts in pieces, which overlap by a window.
PIECE = 1 << 18
#: Windows that share a context, level by level of the split: at the last, the context is the window.
WIDTHS = (64, 16, 4, 1)
#: Bytes of cut or cleaned texts in one batch on its way back from Python.
BATCH_BYTES = 2 << 20


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    sums, inverse = prefix_hashes(data.astype(np.uint64) + np.uint64(1))
    return mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(data) - GRAM + 1])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _least_places(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and for each window the place of its first gram of the least hash."""
    grams, low = _gram_hashes(data), np.uint64((1 << 24) - 1)
    least = _sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1) & low
    return grams, least.astype(np.int64)


def stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of ``length`` bytes that share one least gram: (text, first window's place in
    ``data``, windows, span, the gram's hash). Equal windows have equal grams wherever they stand, so
    all their occurrences fall to one group. Every window of every text is in exactly one stretch.

    A periodic run, whose least gram comes again at every period, is one stretch: its first period of
    ``windows`` stands for all ``span`` windows, each of which repeats inside the run."""
    nothing = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if len(data) < length:
        return nothing
    grams, least = _least_places(data, length)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + length <= offsets[text + 1])
    if not len(at):
        return nothing
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(least[at]) != 0) | (np.diff(text[at]) != 0)]))
    first, windows, place = at[begin], np.diff(np.append(begin, len(at))), least[at[begin]]
    owner, gram, span = text[first], grams[place], windows.copy()
    follows = (np.diff(first) == windows[:-1]) & (np.diff(owner) == 0) & (np.diff(gram) == 0)
    if follows.any():
        keep, more = np.ones(len(first), bool), []
        step = np.where(follows, np.diff(place), 0)
        edge = np.flatnonzero(np.diff(step) != 0) + 1
        for a, b in zip([0, *edge], [*edge, len(step)], strict=True):  # stretches a..b come at one step
            a, period = a + (not keep[a]), int(step[a])
            if not period:
                continue
            low, high = first[a : b + 1], first[a : b + 1] + windows[a : b + 1]
            run = data[low[0] : high[-1] + length - 1]
            differ = np.flatnonzero(run[period:] != run[:-period])
            start = low[0] + np.append(0, differ + 1)
            total = low[0] + np.append(differ, len(run) - period) + period - length + 1 - start
            start, total = start[total > period], total[total > period]
            if not len(start):
                continue
            more += [(int(x), period, int(n), owner[a], gram[a]) for x, n in zip(start, total, strict=True)]
            for x, y in zip([low[0], *(start + total)], [*start, high[-1]], strict=True):  # the windows between periodic runs stay as they were
                left, right = np.maximum(low, x), np.minimum(high, y)
                more += [(int(p), int(q - p), int(q - p), owner[a], gram[a]) for p, q in zip(left[left < right], right[left < right], strict=True)]
            keep[a : b + 1] = False
        if more:
            cols = [np.array(c, x.dtype) for c, x in zip(zip(*more, strict=True), (first, windows, span, owner, gram), strict=True)]
            first, windows, span, owner, gram = (np.concatenate([x[keep], c]) for x, c in zip((first, windows, span, owner, gram), cols, strict=True))
            order = np.argsort(first)
            first, windows, span, owner, gram = (x[order] for x in (first, windows, span, owner, gram))
    return owner, first, windows, span, gram


def _suffix_order(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, by prefix doubling. Symbol 0 ends a string; suffixes equal up
    to it are in order of place, as if every end had a symbol of its own."""
    n = len(symbols)
    key = np.zeros(n, np.int64)
    left = ends - np.arange(n)
    for i in range(7):
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - i)] = symbols[i:]
        key = (key << 9) | np.where(left >= i, ahead, 0)
    step = 7
    while True:
        order = np.argsort(key, kind="stable")
        ranks = np.empty(n, np.int64)
        ranks[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]) + 1
        if ranks[order[-1]] == n or step > left.max():
            return order
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - step)] = ranks[step:]
        key = ranks * (n + 1) + np.where(left >= step, ahead, 0)
        step *= 2


def repeated_windows(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, which of its windows of ``length`` bytes start a string that also starts
    elsewhere among all strings.

    Common prefixes of neighbouring suffixes are derived on the Burrows-Wheeler transform in order of
    their value: an interval of suffixes that begin with one string is extended backward by every
    byte that stands before it; the end of the new interval is a border where the common prefix is
    as long as the string was, if it was not found before, and only then is the interval extended
    further. The values come level by level and stop at ``length``: borders without a value by then
    have at least ``length`` bytes in common.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols = np.zeros(at[-1], np.int64)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    symbols[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
    ends = np.repeat(at[1:] - 1, sizes + 1)
    n, m = len(symbols), len(strings)
    order = _suffix_order(symbols, ends).astype(np.int32)  # a task's places fit 32 bits
    symbols = symbols.astype(np.int16)
    row = np.empty(n, np.int32)
    row[order] = np.arange(n, dtype=np.int32)
    del ends
    starts = np.zeros(n, bool)
    starts[at[:-1]] = True
    opens = starts[order]  # nothing stands before a string's first byte
    last = np.where(opens, 0, symbols[order - 1])
    back = row[order - 1]
    # the transform as runs of one byte: rows of a run step back to rows in a row
    run_at = np.flatnonzero(np.concatenate([[True], (np.diff(last) != 0) | opens[1:]]))
    run_end = np.append(run_at[1:], n)
    run_byte, run_to, run_open = last[run_at].astype(np.int64), back[run_at].astype(np.int64), opens[run_at]
    first_symbol = symbols[order]
    del last, back, row, symbols
    known = np.zeros(n + 1, bool)
    borders = np.unique(np.concatenate([np.arange(m + 1), np.flatnonzero(np.diff(first_symbol)) + 1, [n]]))
    known[borders] = True
    low, high = borders[:-1], borders[1:]
    for _ in range(1, length):
        if not len(low):
            break
        first = np.searchsorted(run_at, low, "right") - 1
        many = np.searchsorted(run_at, high - 1, "right") - first
        owner = np.repeat(np.arange(len(low)), many)
        run = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        some = ~run_open[run]
        owner, run = owner[some], run[some]
        if not len(run):
            break
        by = np.argsort(owner * 257 + run_byte[run], kind="stable")
        owner, run = owner[by], run[by]
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(run_byte[run]) != 0)]))
        end = np.append(begin[1:], len(run)) - 1
        head, tail = run[begin], run[end]
        new_low = run_to[head] + np.maximum(low[owner[begin]] - run_at[head], 0)
        new_high = run_to[tail] + np.minimum(high[owner[end]], run_end[tail]) - run_at[tail]
        fresh = ~known[new_high]
        low, high = new_low[fresh], new_high[fresh]
        known[high] = True
    long = np.flatnonzero(~known[1:n]) + 1
    hit = np.zeros(n, bool)
    hit[order[long]] = True
    hit[order[long - 1]] = True
    return [hit[a : a + max(0, s - length + 1)] for a, s in zip(at[:-1], sizes, strict=True)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``size`` bytes of their last column."""
    held, full = [], 0
    for row in rows:
        held.append(row)
        full += 64 + len(row[-1] or b"")
        if full > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, full = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _pieces(batch_column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place in its text, bytes, offsets): slices of texts, long ones in overlapping pieces."""
    for first, data, offsets in byte_slices(batch_column, PIECE):
        if len(data) <= PIECE + length:
            yield first, 0, data, offsets
            continue
        for row in range(len(offsets) - 1):
            text = data[offsets[row] : offsets[row + 1]]
            for start in range(0, max(1, len(text) - length + 1), PIECE):
                part = text[start : start + PIECE + length - 1]
                yield first + row, start, part, np.array([0, len(part)])


def _stretched(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for row, base, data, offsets in _pieces(batch.column(0), length):
                text, first, windows, span, gram = stretches(data, offsets, length)
                view = memoryview(np.ascontiguousarray(data))
                name = np.fromiter((xxhash.xxh3_64_intdigest(view[a : a + c + length - 1]) for a, c in zip(first.tolist(), windows.tolist(), strict=True)), np.uint64, len(first))
                take = pa.array(row + text)
                cols = [*(batch.column(i).take(take) for i in (1, 2, 3)), pa.array(base + first - offsets[text]), pa.array(windows), pa.array(span), pa.array(gram.view(np.int64)), pa.array(name.view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["did", "t1", "t2", "start", "windows", "span", "gram", "name"])

    return run


_CONTENT = "gram long, name long, at long, windows long, key long, hash long, large boolean, bytes binary"
_CONTENT_NAMES, _CONTENT_KINDS = [c.split()[0] for c in _CONTENT.split(", ")], [*[pa.int64()] * 6, pa.bool_(), pa.binary()]


def _cut_out(length: int):
    """The bytes of the wanted stretches of packed texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for frame, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = unpacked(frame.as_py())
                for w in wanted:
                    yield w["gram"], w["name"], 0, w["windows"], w["gram"], w["name"], w["large"], text[w["start"] : w["start"] + w["windows"] + length - 1]

    return lambda batches: _batches(rows(batches), _CONTENT_NAMES, _CONTENT_KINDS, BATCH_BYTES)


def _split(length: int, width: int):
    """Contents in parts of up to ``width`` windows that have the same bytes in common around their
    least gram. Equal windows have their least gram at one distance, so they fall to parts of one key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        import xxhash

        for batch in batches:
            for gram, name, at, key, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 7)), strict=True):
                _, least = _least_places(np.frombuffer(text, np.uint8), length)
                part = (least - np.arange(len(least))) // width
                begin = np.flatnonzero(np.concatenate([[True], (np.diff(least) != 0) | (np.diff(part) != 0)]))
                for w, n, place, k in zip(begin.tolist(), np.diff(np.append(begin, len(least))).tolist(), least[begin].tolist(), part[begin].tolist(), strict=True):
                    core, own = place - k * width, text[w : w + n - 1 + length]
                    context = xxhash.xxh3_64_intdigest(text[core : core + length - width + 1], seed=(key + 8191 * k) % 2**64)
                    yield gram, name, at + w, n, context - 2**63, xxhash.xxh3_64_intdigest(own) - 2**63, False, own

    return lambda batches: _batches(rows(batches), _CONTENT_NAMES, _CONTENT_KINDS, BATCH_BYTES)


def _removed(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for did, t1, t2, frame, runs in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4).to_pylist(), strict=True):
                text = unpacked(frame.as_py())
                edge = np.zeros(len(text) + 1, np.int64)
                for r in runs or ():
                    edge[r["a"]] += 1
                    edge[r["b"] + length - 1] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                yield did, t1, t2, int(gone.sum()), len(_runs(gone)[0]), hashlib.sha256(kept).hexdigest(), kept

    kinds = [*[pa.int64()] * 5, pa.string(), pa.binary()]
    return lambda batches: _batches(rows(batches), ["did", "t1", "t2", "n_removed", "n_spans", "sha", "kept"], kinds, BATCH_BYTES)


def _expanded(rows: DataFrame, total: int, length: int) -> DataFrame:
    """The repeated windows ``[a, b)`` of contents, ``key`` by ``key``: keys are put together to tasks of
    ``TASK_BYTES``, each of which expands intervals over all its contents."""

    def expand(table: pa.Table) -> pa.Table:
        names = list(zip(table["key"].to_pylist(), table["hash"].to_pylist(), strict=True))
        keys, low, high = [], [], []
        for name, flags in zip(names, repeated_windows(table["bytes"].to_pylist(), length), strict=True):
            a, b = _runs(flags)
            keys += [name] * len(a)
            low += a.tolist()
            high += b.tolist()
        return pa.table({"key": pa.array([k for k, _ in keys], pa.int64()), "hash": pa.array([h for _, h in keys], pa.int64()), "a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64())})

    bins = max(1, -(-2 * total // TASK_BYTES))
    binned = rows.select("key", "hash", "bytes").withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins)))
    return binned.groupBy("bin").applyInArrow(expand, "key long, hash long, a long, b long")


def _sized(contents: DataFrame, length: int) -> tuple[DataFrame, int, int]:
    """Keys with several contents (``key``, the rows ``n`` that hold it, ``large``), the bytes of those
    that one task can decide, and how many are larger."""
    sizes = contents.groupBy("key").agg(F.count(F.lit(1)).alias("contents"), F.sum("n").alias("n"), F.sum(F.col("windows") + (length - 1)).alias("bytes")).filter("contents > 1")
    sizes = written(sizes.select("key", "n", "bytes", (F.col("bytes") > MOST_BYTES).alias("large")))
    found = sizes.agg(F.sum(F.when(~F.col("large"), F.col("bytes"))).alias("bytes"), F.count_if("large").alias("large")).first()
    return sizes.select("key", "n", "large"), found["bytes"] or 0, found["large"]


def _marks(cut: DataFrame, total: int, large: int, length: int) -> DataFrame:
    """``gram``, ``name``, ``a``, ``b``: the windows of contents that are known to repeat. Keys of over
    ``MOST_BYTES`` are split by the bytes that ever fewer windows share, until their intervals can be
    expanded in a task; at the last level a key's windows are equal, so that nothing is left open."""
    marks = _expanded(cut.filter(~F.col("large")), total, length).select(F.col("key").alias("gram"), F.col("hash").alias("name"), "a", "b")
    left = cut.filter("large")
    for width in [w for w in WIDTHS if w <= length] if large else []:
        parts = written(left.mapInArrow(_split(length, width), _CONTENT))
        contents = written(parts.groupBy("key", "hash").agg(F.count(F.lit(1)).alias("n"), F.max("windows").alias("windows")))
        rows = parts.count()
        twice = joined_hot(parts, contents.filter("n > 1").select("key", "hash", "n"), ["key", "hash"], rows)
        marks = marks.unionByName(twice.select("gram", "name", F.col("at").alias("a"), (F.col("at") + F.col("windows")).alias("b")))
        sizes, total, large = _sized(contents, length)
        once = written(joined_hot(parts.drop("large"), sizes, ["key"], rows).select(*_CONTENT_NAMES).dropDuplicates(["key", "hash"]))
        found = _expanded(once.filter(~F.col("large")), total, length).join(contents.filter("n = 1").select("key", "hash"), ["key", "hash"])
        back = once.select("gram", "name", "at", "key", "hash").join(found, ["key", "hash"])
        marks = marks.unionByName(back.select("gram", "name", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b")))
        if not large:
            break
        # a content that stands at several places is decided; one of them speaks for it further on
        left = once.filter("large")
    return marks


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """Remove every byte that a string of ``length`` bytes covers which also starts anywhere else.

    1. The windows of every text are cut where they are read into stretches that share the least of
       their grams' hashes. Equal windows share the gram, so a gram's stretches decide on their own.
       Only a stretch's place, its gram's hash and the hash of its bytes are kept. A periodic run is
       one stretch, and known to repeat.
    2. Grams that occur once hold nothing that repeats. Of the others, each different content is taken
       once: what stands at two places repeats as a whole, whatever their number.
    3. Each content whose gram has other contents is cut out of one text, at one place. Grams are put
       together to tasks of ``TASK_BYTES``; each builds a suffix array and its Burrows-Wheeler
       transform and expands intervals up to ``length`` (``repeated_windows``). Grams of over
       ``MOST_BYTES``, as at the borders of a passage in very many documents, are first split by the
       longer contexts that their windows share (``_split``); so no task grows with a group.
    4. The repeated windows of each content go to all its places, and the texts lose what they cover.

    Strings are UTF-8 bytes and judged on the input; matches never cross documents. Null texts are
    empty. Returns one row per input row: ``doc`` (struct of the input's columns without text),
    ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` and ``kept`` (the
    remaining bytes; null where nothing was removed). Rows with one id are documents like others. An
    empty table gives an empty result.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    t1, t2 = hash_pair(F.col("body"))
    base = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("doc"), doc_key(docs["doc_id"]).alias("did"), F.coalesce(docs["text"], F.lit("")).alias("body")).withColumns({"t1": t1, "t2": t2})
    ident = ["did", "t1", "t2"]
    long = base.filter(F.octet_length("body") >= length).select("body", *ident)
    made = written(long.mapInArrow(_stretched(length), "did long, t1 long, t2 long, start long, windows long, span long, gram long, name long"))
    periodic = F.col("span") > F.col("windows")
    again = made.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.max(periodic).alias("periodic")).filter("n > 1 or periodic")
    found = written(joined_hot(made, written(again.select("gram", "n")), ["gram"], made.count()).drop("n"))
    contents = found.groupBy("gram", "name").agg(F.count(F.lit(1)).alias("n"), F.max(periodic).alias("periodic"), F.min(F.struct(*ident, "start", "windows")).alias("one"))
    contents = written(contents.select("gram", "name", "n", "periodic", "one.*"))
    sizes, total, large = _sized(contents.select(F.col("gram").alias("key"), "windows", F.lit(1).alias("n")), length)
    picked = joined_hot(contents.drop("n"), sizes.withColumnRenamed("key", "gram"), ["gram"], contents.count())
    wanted = picked.groupBy(*ident).agg(F.collect_list(F.struct("gram", "name", "start", "windows", "large")).alias("wanted"))
    texts = packed(long.select(*ident, "body"))
    cut = texts.join(wanted, ident).dropDuplicates(ident).select("packed", "wanted").mapInArrow(_cut_out(length), _CONTENT)
    cut = written(cut)
    copies = contents.filter("n > 1 or periodic").select("gram", "name", F.lit(0).cast("long").alias("a"), F.col("windows").alias("b"))
    open_ = contents.filter("n = 1 and not periodic").select("gram", "name")
    marks = copies.unionByName(_marks(cut, total, large, length).join(open_, ["gram", "name"]))
    marks = marks.groupBy("gram", "name").agg(F.collect_set(F.struct("a", "b")).alias("marks"))
    marks = written(marks.join(contents.select("gram", "name", "n"), ["gram", "name"]))
    placed = joined_hot(found, marks, ["gram", "name"], found.count())
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("span").alias("b")))
    runs = placed.select(*ident, "start", F.explode(F.when(periodic, whole).otherwise(F.col("marks"))).alias("m"))
    runs = runs.groupBy(*ident).agg(F.collect_set(F.struct((F.col("start") + F.col("m.a")).alias("a"), (F.col("start") + F.col("m.b")).alias("b"))).alias("runs"))
    cleaned = texts.join(runs, ident).dropDuplicates(ident).select(*ident, "packed", "runs").mapInArrow(_removed(length), "did long, t1 long, t2 long, n_removed long, n_spans long, sha string, kept binary")
    rows = base.select("doc", *ident, F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("whole"))
    zero = F.lit(0).cast("long")
    return rows.join(cleaned, ident, "left").select("doc", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"), "kept")

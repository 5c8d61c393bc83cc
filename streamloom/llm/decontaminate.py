"""Benchmark decontamination: pieces that the edits leave, CGK embedding, bit-sampling LSH and exact edit distances."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shingles import BASE, byte_slices, mixed

#: A passage is a leak of an item if it takes at most this share of the item's bytes in edits.
MAX_EDITS = 0.15
#: Bytes of a piece of an item, and how many pieces at least must then be left after all edits (longest first).
PIECES = ((5, 4), (4, 3), (3, 2), (3, 1), (2, 1), (1, 1))
#: Left pieces asked for, where an item has more: the items' rarest pieces do.
ENOUGH = 6
#: Places of pieces in texts that are held at once; longer runs of texts are halved.
ENTRIES = 4 << 20
#: Shorter items are looked for as they are, between the borders of words, without edits.
SHORTEST = 32
#: Sampled places of a repetition; the repetitions follow from the recall wanted at MAX_EDITS.
BITS, RECALL, MOST_REPETITIONS = 2, 0.99, 512
#: Bytes of items that go to the executors at once: more are looked for in further passes.
ITEM_BYTES = 16 << 20
#: Bytes of strings that are embedded together.
STACKED = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
_TABLE = 20


def folded_bytes(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, white space as blanks."""
    return _LOWER[data]


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """The ``q`` bytes at each place as a number."""
    out = np.zeros(max(0, len(data) - q + 1), np.uint64)
    for i in range(q if len(out) else 0):
        out = (out << np.uint64(8)) | data[i : len(out) + i]
    return out


def _slots(codes: np.ndarray) -> np.ndarray:
    return ((codes * BASE) >> np.uint64(64 - _TABLE)).astype(np.int64)


class Pieces:
    """Pieces of ``q`` bytes of some items, which do not overlap: ``most`` edits change at most as many of
    them, so a passage within the edits keeps ``need`` of an item's ``most + need`` pieces, and
    the places at which these would let the item begin lie within ``most`` of each other."""

    def __init__(self, q: int, which: list[int], items: list[np.ndarray], most: np.ndarray):
        self.q, self.need = q, np.zeros(len(items), np.int64)
        every, times = np.unique(np.concatenate([grams(items[i], q) for i in which]), return_counts=True)
        codes, owner, offset = [], [], []
        for i in which:
            mine = grams(items[i], q)[::q]
            self.need[i] = min(ENOUGH, len(mine) - int(most[i]))
            rare = np.argsort(times[np.searchsorted(every, mine)], kind="stable")[: int(most[i] + self.need[i])]
            codes.append(mine[rare])
            owner.append(np.full(len(rare), i))
            offset.append(rare * q)
        code = np.concatenate(codes)
        order = np.argsort(code, kind="stable")
        self.owner, self.offset = np.concatenate(owner)[order], np.concatenate(offset)[order]
        self.codes, self.low, self.many = np.unique(code[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _TABLE, bool)
        self.seen[_slots(self.codes)] = True
        self.least, self.widest = int(self.need[which].min()), int(most[which].max())

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces stand inside one text, and which."""
        codes = grams(data, self.q)
        at = np.flatnonzero(self.seen[_slots(codes)])
        place = np.searchsorted(self.codes, codes[at])
        place[place == len(self.codes)] = 0
        inside = np.zeros(len(data) + 1, bool)
        for j in range(1, self.q):
            inside[np.maximum(offsets[1:] - j, 0)] = True  # would end in a later text
        real = (self.codes[place] == codes[at]) & ~inside[at]
        return at[real], place[real]


def within(masks: list[int], length: int, most: int, region: bytes) -> bool:
    """Whether a part of region is within ``most`` edits of the item with these places of each byte (Myers' bit vectors)."""
    full, high = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = full, 0, length
    for byte in region:
        equal = masks[byte]
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | (full & ~(across | plus)), plus & across
        if up & high:
            score += 1
        elif down & high:
            score -= 1
            if score <= most:
                return True
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
    return score <= most


class Coins:
    """A fair coin for each step and byte, from a hash, of which a block of steps is held at once."""

    def __init__(self, seed: int):
        self.seed, self.block, self.rows = seed, -1, np.empty((0, 256), np.int64)

    def __getitem__(self, at: tuple[int, np.ndarray]) -> np.ndarray:
        step, byte = at
        if step >> 12 != self.block:
            self.block = step >> 12
            numbers = np.arange(self.block << 20, (self.block + 1) << 20, dtype=np.uint64) + np.uint64(self.seed << 44)
            self.rows = (mixed(numbers) >> np.uint64(63)).astype(np.int64).reshape(4096, 256)
        return self.rows[step & 4095][byte]


def cgk(windows: np.ndarray, lengths: np.ndarray, coins: np.ndarray | Coins) -> np.ndarray:
    """CGK embedding of rows of bytes: step j writes the byte under the pointer (0 behind the end),
    and the coin of j and this byte decides whether the pointer moves on. Strings of small edit
    distance have embeddings of small Hamming distance, as their walks meet again after each edit."""
    n, rows = len(windows), np.arange(len(windows))
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint8)], axis=1)
    steps = 2 * int(lengths.max(initial=0))
    out, at = np.zeros((n, steps), np.uint8), np.zeros(n, np.int64)
    for j in range(steps):
        byte = np.where(at < lengths, padded[rows, np.minimum(at, lengths)], 0).astype(np.uint8)
        out[:, j] = byte
        at += coins[j, byte]
    return out


def embeddings(rows: list[np.ndarray], coins: Coins) -> tuple[np.ndarray, np.ndarray]:
    """The embeddings of all rows, one behind the other, of twice each row's length, and where each
    begins. Rows of like length are embedded together, ``STACKED`` bytes at once: a long one pads no other."""
    sizes = np.array([len(x) for x in rows], np.int64)
    begin = np.concatenate([[0], np.cumsum(2 * sizes)])
    out, order, start = np.zeros(begin[-1], np.uint8), np.argsort(-sizes, kind="stable"), 0
    while start < len(order):
        widest = max(1, int(sizes[order[start]]))
        part = order[start : start + max(1, STACKED // widest)]
        stacked = np.zeros((len(part), widest), np.uint8)
        for i, row in enumerate(part):
            stacked[i, : sizes[row]] = rows[row]
        made = cgk(stacked, sizes[part], coins)
        for i, row in enumerate(part):
            out[begin[row] : begin[row + 1]] = made[i, : 2 * sizes[row]]
        start += len(part)
    return out, begin


def edited(item: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    """The item after random substitutions, insertions and deletions, for fitting and tests."""
    out = list(item)
    for _ in range(int(share * len(item))):
        at, kind = int(rng.integers(len(out))), rng.integers(3)
        if kind == 0:
            out[at] = rng.integers(97, 123)
        elif kind == 1:
            out.insert(at, rng.integers(97, 123))
        elif len(out) > 1:
            del out[at]
    return np.array(out, np.uint8)


def closest(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(edit distance, start, end) of the part of region that is closest to the item, the first such."""

    def end_of(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
        steps = np.arange(len(region) + 1)
        row = np.zeros(len(region) + 1, np.int64)
        for i, byte in enumerate(item):
            new = np.empty_like(row)
            new[0] = i + 1
            np.minimum(row[:-1] + (region != byte), row[1:] + 1, out=new[1:])
            row = np.minimum.accumulate(new - steps) + steps  # insertions, all at once
        end = int(row.argmin())
        return int(row[end]), end

    distance, end = end_of(item, region)
    _, back = end_of(item[::-1], region[:end][::-1])
    return distance, end - back, end


class Finder:
    """A bounded set of items with their seeds, embeddings and samples."""

    def __init__(self, ids: list[int], texts: list[bytes], max_edits: float = MAX_EDITS, recall: float = RECALL, seed: int = 11):
        rng = np.random.default_rng(seed)
        keep = [i for i, t in enumerate(texts) if len(t) >= SHORTEST]
        folded = ((i, folded_bytes(np.frombuffer(t, np.uint8)).tobytes().strip()) for i, t in enumerate(texts) if len(t) < SHORTEST)
        short = [(i, t) for i, t in folded if t]
        self.short = [t for _, t in short]
        self.ids, self.max_edits = [ids[i] for i in keep] + [ids[i] for i, _ in short], max_edits
        self.items = [folded_bytes(np.frombuffer(texts[i], np.uint8)) for i in keep]
        self.lengths = np.array([len(x) for x in self.items], np.int64)
        self.most = (self.max_edits * self.lengths).astype(np.int64)
        kinds: dict[int, list[int]] = {}
        for i, (n, most) in enumerate(zip(self.lengths.tolist(), self.most.tolist(), strict=True)):
            kinds.setdefault(next(q for q, left in PIECES if n // q - most >= left), []).append(i)
        self.pieces = [Pieces(q, which, self.items, self.most) for q, which in sorted(kinds.items())]
        self.masks: dict[int, list[int]] = {}
        if self.items:
            self.coins = Coins(seed)
            self.embedded, self.begin = embeddings(self.items, self.coins)
            self.samples = rng.uniform(0, 1, (self._repetitions(recall, rng), BITS))

    def _repetitions(self, recall: float, rng: np.random.Generator) -> int:
        """How many find a passage of MAX_EDITS with the recall wanted, as random edits of up to 256 items show."""
        some = [self.items[i] for i in rng.permutation(len(self.items))[:256]]
        changed = [edited(x, self.max_edits, rng)[: len(x)] for x in some]
        (a, at), (b, bt) = embeddings(some, self.coins), embeddings(changed, self.coins)
        widths = np.minimum(np.diff(at), np.diff(bt))
        equal = [(a[i : i + w] == b[j : j + w]).mean() for i, j, w in zip(at, bt, widths, strict=False) if w]
        p = max(0.05, float(np.quantile(equal, 0.1))) ** BITS
        return int(np.clip(np.ceil(np.log(1 - recall) / np.log1p(-p)), 8, MOST_REPETITIONS))

    def _collisions(self, item: np.ndarray, windows: list[np.ndarray]) -> np.ndarray:
        """In how many repetitions a window and its item agree at all sampled places."""
        out = []
        for start in range(0, len(windows), 4096):
            part, which = windows[start : start + 4096], item[start : start + 4096]
            mine, begin = embeddings(part, self.coins)
            width = np.minimum(np.diff(begin), 2 * self.lengths[which])
            places = (self.samples[None] * width[:, None, None]).astype(np.int64)
            left, right = begin[:-1, None, None] + places, self.begin[which][:, None, None] + places
            out.append((mine[left] == self.embedded[right]).all(2).sum(1) * (width > 0) if len(mine) else np.zeros(len(part), np.int64))
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def _near(self, item: int, region: np.ndarray, most: int) -> bool:
        if item not in self.masks:
            masks = [0] * 256
            for at, byte in enumerate(self.items[item].tolist()):
                masks[byte] |= 1 << at
            self.masks[item] = masks
        return within(self.masks[item], int(self.lengths[item]), most, region.tobytes())

    def _places(self, pieces: Pieces, at: np.ndarray, place: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, text, begin) where enough pieces of an item let it begin within its edits of each other."""
        many = pieces.many[place]
        reach = int(self.lengths.max() + self.most.max()) + 1
        if many.sum() > ENTRIES and len(at) and at[-1] - at[0] > 8 * reach:
            middle = (int(at[0]) + int(at[-1])) // 2
            left, right = np.searchsorted(at, [middle + reach, middle - reach])
            yield from self._places(pieces, at[:left], place[:left], offsets)
            yield from self._places(pieces, at[right:], place[right:], offsets)
            return
        text = np.searchsorted(offsets, at, "right") - 1
        apart = at + (text + 1) * reach  # so texts are further apart than any item reaches
        entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - pieces.low[place], many)
        span = np.int64(offsets[-1] + (len(offsets) + 1) * reach)
        keys = np.sort(pieces.owner[entry] * span + np.repeat(apart, many) - pieces.offset[entry])
        some = np.flatnonzero(keys[pieces.least - 1 :] - keys[: len(keys) - pieces.least + 1] <= pieces.widest)
        item = keys[some] // span
        last = some + pieces.need[item] - 1
        some, item, last = (x[last < len(keys)] for x in (some, item, last))
        enough = keys[last] - keys[some] <= self.most[item]
        item, begin = item[enough], keys[some[enough]] - item[enough] * span
        starts = offsets[:-1] + np.arange(1, len(offsets)) * reach
        text = np.searchsorted(starts, begin + self.lengths[item], "right") - 1
        yield item, text, begin - (text + 1) * reach

    def find(self, data: np.ndarray, offsets: np.ndarray, any_item: bool = False) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, end) for each text and the items that it leaks, the closest
        passage of each; with ``any_item``, a region that holds one, for each text that leaks any."""
        data = folded_bytes(data)
        return self._long(data, offsets, any_item) + (self._short(data, offsets) if self.short else [])

    def _short(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """The first place of each short item in each text where no letter or digit goes on beyond its ends."""
        if not hasattr(self, "automaton"):
            import ahocorasick

            self.automaton, same = ahocorasick.Automaton(), {}
            for i, item in enumerate(self.short):
                same.setdefault(item.decode("latin-1"), []).append(len(self.items) + i)
            for item, which in same.items():
                self.automaton.add_word(item, (len(item), which))
            self.automaton.make_automaton()
        inner = lambda byte: 48 <= byte < 58 or 97 <= byte < 123 or byte >= 128
        out, seen = [], set()
        for t, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            text = data[low:high].tobytes()
            for last, (n, which) in self.automaton.iter(text.decode("latin-1")):
                first, end = last - n + 1, last + 1
                within = first and inner(text[first - 1]) and inner(text[first]) or end < len(text) and inner(text[end]) and inner(text[last])
                if not within and (t, which[0]) not in seen:
                    seen.add((t, which[0]))
                    out += [(t, i, 0, first, end) for i in which]
        return out

    def _long(self, data: np.ndarray, offsets: np.ndarray, any_item: bool) -> list[tuple[int, int, int, int, int]]:
        if not self.items or not len(data):
            return []
        found = [part for pieces in self.pieces for part in self._places(pieces, *pieces.hits(data, offsets), offsets)]
        item, text, begin = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(item):
            return []
        order = np.lexsort((begin, item, text))
        text, item, begin = text[order], item[order], begin[order]
        # regions that overlap are one: of any passage in reach of a begin, no byte is left out
        new = np.concatenate([[True], (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(begin) > (self.lengths + 2 * self.most)[item[1:]])])
        final = begin[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(begin) - 1]])]
        text, item, begin = text[new], item[new], begin[new]
        low = np.maximum(begin - self.most[item], offsets[text])
        high = np.minimum(final + self.lengths[item] + self.most[item], offsets[text + 1])
        begin = np.maximum(begin, offsets[text])
        end = np.minimum(begin + self.lengths[item], offsets[text + 1])
        # the likeliest first, so that the others only have to be as close
        order = np.argsort(-self._collisions(item, [data[a:b] for a, b in zip(begin, end, strict=True)]), kind="stable")
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done: set[int] = set()
        for t, i, a, b in zip(*(x[order].tolist() for x in (text, item, low, high)), strict=True):
            known = best.get((t, i))
            if t in done or not self._near(i, data[a:b], known[0] if known else int(self.most[i])):
                continue
            if any_item:
                done.add(t)
                best[t, i] = (int(self.most[i]), a - int(offsets[t]), b - int(offsets[t]))
                continue
            distance, start, stop = closest(self.items[i], data[a:b])
            passage = (distance, start + a - int(offsets[t]), stop + a - int(offsets[t]))
            best[t, i] = min(known or passage, passage)
        return [(t, i, *found) for (t, i), found in best.items()]


def _finders(spark: SparkSession, items: DataFrame, max_edits: float) -> Iterator:
    """Broadcast sets of items of ``ITEM_BYTES`` at most (or one longer item), which hold all items."""
    rows = items.select(items["item_id"].cast("long").alias("item_id"), "text").filter(F.octet_length("text") > 0).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // (ITEM_BYTES // 2)) if size > ITEM_BYTES else 1
    for n in range(passes):
        part = rows if passes == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == n)
        found = part.orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(Finder([r["item_id"] for r in found], [r["text"].encode() for r in found], max_edits))


def leaks(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """Documents with passages of benchmark items: ``doc_id``, ``item_id``, ``distance`` (byte edits),
    ``start``, ``end`` (bytes in the text), one row per document and item, for its closest passage.

    A-Z count as a-z, and all white space as blanks. Items are cut to pieces of which the edits must
    leave some (``Pieces``), so every passage within ``max_edits`` has a region where these stand in
    the text: none is missed, however the edits are spread. The windows of the regions and the item
    are embedded by CGK, and repeated bit sampling says which to take first. The exact edit
    distance, ends free, decides every region.

    Whole texts are searched where they are read; nothing is shuffled. The items are broadcast in
    sets of bounded size, one pass for each set. Items of under ``SHORTEST`` bytes are found by their
    exact bytes (folded as above), where no word goes on beyond their ends. Null and empty texts or items
    match nothing. Items with one id are one item, as are those without (item_id null); repeated documents are each
    reported. Empty tables give an empty result.
    """
    spark, kinds = docs.sparkSession, "doc_id long, item_id long, distance long, start long, end long"
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")

    def run(shared) -> Callable:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = shared.value
            for batch in batches:
                for first, data, offsets in byte_slices(batch.column(1)):
                    best: dict = {}
                    for t, i, *rest in finder.find(data, offsets):
                        key = (first + t, finder.ids[i])
                        best[key] = min(best.get(key, rest), rest)
                    cols = [batch.column(0).take(pa.array([t for t, _ in best], pa.int64())), pa.array([i for _, i in best], pa.int64())]
                    cols += [pa.array([v[k] for v in best.values()], pa.int64()) for k in range(3)]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "distance", "start", "end"])

        return find

    out = None
    for shared in _finders(spark, items, max_edits):
        found = rows.mapInArrow(run(shared), kinds)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """The documents without those that ``leaks`` would report, all columns as they are. Null and empty texts, null ids and repeated rows stay; empty tables give what they must."""
    place = docs.columns.index("text")

    def run(shared) -> Callable:
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, data, offsets in byte_slices(batch.column(place)):
                    keep[[first + hit[0] for hit in shared.value.find(data, offsets, any_item=True)]] = False
                yield batch.filter(pa.array(keep))

        return clean

    for shared in _finders(docs.sparkSession, items, max_edits):
        docs = docs.mapInArrow(run(shared), docs.schema)
    return docs

"""Byte-level BPE of whole texts, long ones by halves that are encoded apart and joined exactly.

What makes a join exact, for a tokenizer that cuts text into words by a pattern without look-behind, then
merges the bytes of each word by rank:

* A word's end is decided by at most ``LOOK`` bytes after it, and nothing before its start matters. So
  words that end that far before the join stay; and once a re-encoded window and the right half start
  a word at the same place, they agree from there on.
* Within a word, tokens are the word's encoding exactly if every two neighbours are the encoding of
  their own bytes. So in a word longer than a window, the window's outermost token has only to be the
  one that stood there before.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a piece that is encoded at once; longer texts are joined from such pieces.
PIECE = 16_384
#: Levels of the tree that are joined between two shuffles.
LEVELS = 3
#: Tokens decoded at once.
BLOCK = 1 << 20
#: Tokens on each side of a join in the first window.
WINDOW = 32
_IDS = np.dtype("<u4")
#: The bit of a token that says, between tasks, that it starts a word.
_HEAD = np.uint32(1 << 31)
#: The public word pattern of byte-level vocabularies, and characters whose class (letter,
#: number, space, other) is the same in every version of Unicode that a matcher may have been built on.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SETTLED = re.compile("[\t\n\r -~\u00a1-\u0233\u0400-\u04ff\u2010-\u2027\u3001\u3002\u3041-\u3094\u30a1-\u30f6\u4e00-\u9fa5\uff01-\uff5e]*")
#: The faster matcher gives up on longer runs of white space.
_LONG_SPACE = re.compile(r"\s{1000}")


class Codec:
    """A tokenizer file, with the bytes of each token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        words = self.model.get_vocab(with_added_tokens=True)
        shown = byte_letters()
        self.token = [b""] * (max(words.values()) + 1)
        for word, n in words.items():
            self.token[n] = bytes(shown[c] for c in word) if all(c in shown for c in word) else word.encode()
        self.length = np.array([len(t) for t in self.token], np.int64)
        #: Whether a token begins with the first byte of a character.
        self.starts = np.array([not t or not 0x80 <= t[0] < 0xC0 for t in self.token])
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.look = 4 * max([3, *(len(t.encode()) for t in self.added)]) + 12
        self.ranked = self._ranked()

    def _ranked(self):
        """A faster encoder of the same vocabulary, which merges by the rank of what comes out. That is the
        same if the ids rank the merges, if the file asks for nothing but bytes, words and merges, and if
        every token encodes to itself: then no other two neighbours ever make up its bytes."""
        import tiktoken

        file = json.loads(self.model.to_str())
        cut, merge, added = file["pre_tokenizer"], file["model"], {t["content"] for t in file["added_tokens"]}
        plain = cut and cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and merge["type"] == "BPE" and not file["normalizer"] and not any(merge.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        words = {w: n for w, n in merge["vocab"].items() if w not in added} if plain else {}
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merge["merges"]] if plain else []
        plain = plain and [words.get(w) for w in made] == list(range(256, 256 + len(made))) and len(words) == 256 + len(made)
        if not plain or any([t.id for t in self.model.model.tokenize(w)] != [n] for w, n in words.items()):
            return None
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks={self.token[n]: n for n in words.values()}, special_tokens={})

    def _settled(self, text: str) -> bool:
        """Whether the faster encoder gives the same for a text."""
        return bool(self.ranked and (text.isascii() or SETTLED.fullmatch(text)) and not _LONG_SPACE.search(text) and not any(t in text for t in self.added))

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        return np.array(self.ranked.encode_ordinary(text) if self._settled(text) else self.model.encode(text, add_special_tokens=False).ids, _IDS)

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, whether each starts a word)."""
        if self._settled(text):
            import regex

            ids = np.array(self.ranked.encode_ordinary(text), _IDS)
            found = regex.findall(PATTERN, text)
            sizes = np.array([*map(len, found)] if text.isascii() else [len(w.encode()) for w in found], np.int64)
            return ids, np.isin(np.cumsum(self.length[ids]) - self.length[ids], np.cumsum(sizes) - sizes)
        made = self.model.encode(text, add_special_tokens=False)
        word = np.array([-1 if w is None else w for w in made.word_ids], np.int64)
        return np.array(made.ids, _IDS), np.concatenate([np.ones(min(len(word), 1), bool), word[1:] != word[:-1]])

    def bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The library's decoding, in blocks that begin with the first byte of a character, where the
        decoding of what comes before can't matter."""
        out, at = [], 0
        while at < len(ids):
            end = min(at + BLOCK, len(ids))
            while end < len(ids) and not self.starts[ids[end]]:
                end += 1
            try:
                out.append(self.bytes(ids[at:end]).decode())
            except UnicodeDecodeError:  # the library says what stands for broken bytes
                out.append(self.model.decode(ids[at:end].tolist(), skip_special_tokens=False))
            at = end
        return "".join(out)

    def join(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """The encoding of two texts put together from the encodings of both: a window around the join
        is encoded again, and grows until it agrees with both sides; at last it is all of them."""
        (left, left_heads), (right, right_heads) = a, b
        if not len(left) or not len(right):
            return a if len(left) else b
        while True:
            i, inside_left = self._left(left, left_heads, window)
            j, inside_right = self._right(right, right_heads, window)
            ids, heads = self.words(self.bytes(np.concatenate([left[i:], right[:j]])).decode())
            agreed = not inside_left or ids[0] == left[i]
            heads[0] = left_heads[i]
            cut = (len(ids), j) if j == len(right) else self._agreed(ids, heads, left[i:], right[:j], right_heads[:j], inside_right)
            if agreed and cut:
                k, m = cut
                return np.concatenate([left[:i], ids[:k], right[m:]]), np.concatenate([left_heads[:i], heads[:k], right_heads[m:]])
            window *= 2

    def _left(self, ids: np.ndarray, heads: np.ndarray, window: int) -> tuple[int, bool]:
        """Where the window begins in the left half: at a word's start that the join can't move, else, in a
        word that is longer than the window, at a token (True)."""
        reach = np.searchsorted(np.cumsum(self.length[ids[::-1][: self.look + 1]]), self.look) + 1
        most = max(len(ids) - int(reach), 0)
        near = np.flatnonzero(heads[max(most - window, 0) : most + 1])
        if len(near):
            return max(most - window, 0) + int(near[-1]), False
        i = most - window
        while not heads[i] and not self.starts[ids[i]]:
            i -= 1
        return i, not heads[i]

    def _right(self, ids: np.ndarray, heads: np.ndarray, window: int) -> tuple[int, bool]:
        """Where the window ends in the right half: the next word's start after ``window`` tokens and what a
        word's end depends on; in a longer word, a token within it (True)."""
        least = int(np.searchsorted(np.cumsum(self.length[ids[: self.look + 1]]), self.look)) + 1 + window
        if least + window >= len(ids):
            return len(ids), False
        near = np.flatnonzero(heads[least : least + window])
        if len(near):
            return least + int(near[0]), False
        j = least
        while j < len(ids) and not heads[j] and not self.starts[ids[j]]:
            j += 1
        return j, j < len(ids) and not heads[j]

    def _agreed(self, ids: np.ndarray, heads: np.ndarray, left: np.ndarray, right: np.ndarray, right_heads: np.ndarray, inside: bool) -> tuple[int, int] | None:
        """(tokens of the window, tokens of the right half) from which on both are the same."""
        starts = np.cumsum(self.length[ids]) - self.length[ids] - self.length[left].sum()
        sure = np.flatnonzero(heads & (starts >= 0) & (starts <= self.length[right].sum() - self.look))
        at = np.cumsum(self.length[right]) - self.length[right]
        same = np.intersect1d(starts[sure], at[right_heads])
        if len(same):
            return int(np.searchsorted(starts, same[0])), int(np.searchsorted(at, same[0]))
        if inside:
            own, others = (int(x[-1]) if len(x) else 0 for x in (np.flatnonzero(heads), np.flatnonzero(right_heads)))
            long = min(self.length[ids[own:]].sum(), self.length[right[others:]].sum()) >= self.look
            if long and ids[-1] == right[-1]:
                return len(ids), len(right)
        return None


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, the rest,
    in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _binary(parts) -> pa.Array:
    return pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary())


def encoded(rows: DataFrame, path: str, column: str = "text", piece: int = PIECE) -> DataFrame:
    """``doc`` (a struct of all columns but the text) and ``ids``, the whole text's token ids as
    little-endian unsigned 32-bit integers. Null texts count as empty and have no ids.

    Texts of up to ``piece`` characters are encoded in one pass without a shuffle. Longer ones are cut,
    their pieces dealt over all tasks and encoded there; then halves are joined, ``LEVELS`` levels of the tree
    between two shuffles, as deep as halving the longest text goes. A text's ids come together in one row, as the text itself is one.
    Rows need no key: each is numbered where it is read, so ids that are null or repeated don't matter,
    nor do the names of other columns.
    """
    spark_rows = rows.select(F.struct(*[c for c in rows.columns if c != column]).alias("doc"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    doc = spark_rows.schema["doc"].dataType.simpleString()
    long = F.char_length("text") > piece

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(codec(path).ids(t.as_py()) for t in batch.column(1))], names=["doc", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                text = batch.column(2)[at].as_py()
                for first in range(0, len(text), piece * 64):
                    parts = [text[i : i + piece] for i in range(first, min(first + piece * 64, len(text)), piece)]
                    n = len(parts)
                    docs = batch.column(0).slice(at, 1).take(pa.array([None if first or i else 0 for i in range(n)], pa.int64()))
                    nodes = pa.array(range(first // piece, first // piece + n), pa.int64())
                    yield pa.RecordBatch.from_arrays([docs, pa.array([batch.column(1)[at].as_py()] * n, pa.int64()), nodes, pa.array(parts)], names=["doc", "uid", "node", "text"])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = (codec(path).words(t.as_py()) for t in batch.column(3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _binary(np.where(heads, ids | _HEAD, ids) for ids, heads in made)], names=["doc", "uid", "node", "ids"])

    def joined(last: bool):
        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for kids in batch.column(3):
                    both = [np.frombuffer(k["ids"].as_buffer(), _IDS) for k in kids]
                    nodes = [(x & ~_HEAD, x >= _HEAD) for x in both]
                    while len(nodes) > 1:
                        nodes = [codec(path).join(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
                    ids, heads = nodes[0]
                    out.append(ids if last else np.where(heads, ids | _HEAD, ids))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], _binary(out)], names=["doc", "uid", "node", "ids"])

        return join

    node = f"doc {doc}, uid bigint, node bigint, ids binary"
    numbered = spark_rows.filter(long).select("doc", F.monotonically_increasing_id().alias("uid"), "text")
    pieces = numbered.mapInArrow(cut, f"doc {doc}, uid bigint, node bigint, text string")
    nodes = pieces.repartition("uid", "node").mapInArrow(leaf, node)
    longest = spark_rows.agg(F.max(F.char_length("text")).alias("n")).first()["n"] or 0
    count = -(-longest // piece)
    while count > 1:
        count = -(-count // (1 << LEVELS))
        groups = nodes.groupBy("uid", F.shiftright("node", LEVELS).alias("node")).agg(F.max_by("doc", -F.col("node")).alias("doc"), F.array_sort(F.collect_list(F.struct("node", "ids"))).alias("kids"))
        nodes = groups.select("doc", "uid", "node", "kids").mapInArrow(joined(count == 1), node)
    made = spark_rows.filter(~long).mapInArrow(whole, f"doc {doc}, ids binary")
    return made.unionByName(nodes.select("doc", "ids")) if longest > piece else made


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``doc`` and ``ids`` with the ``text`` that the ids stand for, special tokens among them."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [codec(path).decode(np.frombuffer(x.as_buffer() or b"", _IDS)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, "text"])

    return rows.mapInArrow(text, f"{kinds}, text string")

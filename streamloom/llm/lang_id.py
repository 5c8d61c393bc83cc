"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Training documents of each language, longest text of these (in characters), and rounds of the fit.
SAMPLE, SAMPLE_CHARS, ROUNDS = 1500, 65_536, 3
#: Longer runs of letters are scored one by one, and not learned from.
LONGEST = 128
#: Labels that a model has room for (pieces x languages are broadcast); more make more models.
MOST_LANGUAGES = 512
#: Words whose scores a task remembers.
REMEMBERED = 300_000
START, UNKNOWN, SMOOTHING = "▁", -14.0, 0.1
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall(text.lower())


def read_vocabulary(path: str) -> list[str]:
    """Pieces of letters, with or without the mark of a word's start, in lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p == START or _WORD.fullmatch(p.removeprefix(START)))


class Pieces:
    """The vocabulary as a trie in sorted arrays, walked for many words at once."""

    def __init__(self, pieces: list[str]):
        edges: dict[tuple[int, int], int] = {}
        ends = {}
        for number, piece in enumerate(pieces):
            node = 0
            for ch in map(ord, piece):
                node = edges.setdefault((node, ch), len(edges) + 1)
            ends[node] = number
        keys = np.array([(node << 21) | ch for node, ch in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.piece = np.full(len(edges) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())
        self.size, self.depth = len(pieces), max(map(len, pieces), default=1)

    def steps(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[tuple[np.ndarray, int, np.ndarray]]]]:
        """For words sorted by falling length: their lengths with the mark, and for each start the
        (words, length, piece) that can follow. Every single character can: without a piece of its
        own it is piece -1."""
        lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        chars = np.zeros((len(words), int(lengths.max()) + 1), np.int64)
        flat = np.frombuffer("".join(START + w for w in words).encode("utf-32-le"), np.uint32)
        chars[np.repeat(np.arange(len(words)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        found = []
        for start in range(int(lengths.max())):
            here = []
            alive = np.arange(np.searchsorted(-lengths, -start, "left"))  # those longer than start
            node = np.zeros(len(alive), np.int64)
            for m in range(1, self.depth + 1):
                inside = lengths[alive] >= start + m
                alive, node = alive[inside], node[inside]
                if not len(alive):
                    break
                key = (node << 21) | chars[alive, start + m - 1]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                known = self.keys[at] == key
                node = np.where(known, self.nodes[at], 0)
                piece = np.where(known, self.piece[node], -1)
                use = piece >= 0 if m > 1 else np.ones(len(alive), bool)
                if use.any():
                    here.append((alive[use], m, piece[use]))
                alive, node = alive[known], node[known]
            found.append(here)
        return lengths, chars, found

    def forward(self, lengths: np.ndarray, steps: list, weight) -> np.ndarray:
        """Log sums over all segmentations: words x places x languages. weight(words, pieces): log
        probabilities of pieces, a column per language."""
        width = weight(np.zeros(1, np.int64), np.zeros(1, np.int64)).shape[1]
        alpha = np.full((len(lengths), int(lengths.max()) + 1, width), -np.inf)
        alpha[:, 0] = 0
        for start, here in enumerate(steps):
            for words, m, piece in here:
                alpha[words, start + m] = np.logaddexp(alpha[words, start + m], alpha[words, start] + weight(words, piece))
        return alpha

    def scores(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language; logp has a last row for unknown characters."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        lengths, _, steps = self.steps([words[i] for i in order])
        alpha = self.forward(lengths, steps, lambda _, piece: logp[piece])
        out = np.empty((len(words), logp.shape[1]))
        out[order] = alpha[np.arange(len(words)), lengths]
        return out

    def long_score(self, word: str, logp: np.ndarray) -> np.ndarray:
        """As ``scores``, for one word of any length: only the sums that pieces still reach are held."""
        text = START + word
        ahead = deque([np.zeros(logp.shape[1])] + [np.full(logp.shape[1], -np.inf)] * self.depth)
        for start in range(len(text)):
            here, node = ahead.popleft(), 0
            ahead.append(np.full(logp.shape[1], -np.inf))
            for m, ch in enumerate(text[start : start + self.depth]):
                key = (node << 21) | ord(ch)
                at = int(np.searchsorted(self.keys, key))
                known = at < len(self.keys) and self.keys[at] == key
                node = int(self.nodes[at]) if known else 0
                piece = int(self.piece[node]) if known else -1
                if piece >= 0 or m == 0:
                    ahead[m] = np.logaddexp(ahead[m], here + logp[piece])
                if not known:
                    break
        return ahead[0]

    def expected(self, words: list[str], times: np.ndarray, lang: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected uses of pieces over all segmentations: pieces x languages."""
        order = np.array(sorted(range(len(words)), key=lambda i: -len(words[i])))
        times, lang = times[order], lang[order]
        lengths, _, steps = self.steps([words[i] for i in order])
        own = lambda w, piece: logp[piece, lang[w]][:, None]
        alpha = self.forward(lengths, steps, own)[:, :, 0]
        beta = np.full(alpha.shape, -np.inf)
        beta[np.arange(len(lengths)), lengths] = 0
        total, out = alpha[np.arange(len(lengths)), lengths], np.zeros((self.size + 1, logp.shape[1]))
        for start in range(len(steps) - 1, -1, -1):
            for w, m, piece in steps[start]:
                on = logp[piece, lang[w]] + beta[w, start + m]
                np.add.at(out, (piece, lang[w]), times[w] * np.exp(alpha[w, start] + on - total[w]))
                beta[w, start] = np.logaddexp(beta[w, start], on)
        return out[:-1]


@dataclass
class LanguageModel:
    """Log probabilities, pieces x languages and a last row for unknown characters."""

    pieces: Pieces
    langs: list[str]
    logp: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray = None

    def __getstate__(self):
        return {"pieces": self.pieces, "langs": self.langs, "logp": self.logp, "known": {}, "rows": None}

    def classify(self, texts: list[str]) -> list[tuple[str | None, float, float]]:
        """For each text the likeliest language, its log probability, and the sum of all languages' probabilities
        as a multiple of its own; no language for texts without words."""
        split = [words_of(t) for t in texts]
        if len(self.known) > REMEMBERED or self.rows is None:
            self.known, self.rows = {}, np.empty((0, len(self.langs)))
        new = list({w for words in split for w in words if w not in self.known}) if self.langs else []
        short = [w for w in new if len(w) <= LONGEST]
        for start in range(0, len(short), 20_000):
            part = short[start : start + 20_000]
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part)), strict=True))
            self.rows = np.concatenate([self.rows, self.pieces.scores(part, self.logp)])
        for word in (w for w in new if len(w) > LONGEST):
            self.known[word] = len(self.known)
            self.rows = np.concatenate([self.rows, self.pieces.long_score(word, self.logp)[None]])
        found = []
        for words in split:
            if not words or not self.langs:
                found.append((None, 0.0, 0.0))
                continue
            total = self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(0)
            best = int(total.argmax())
            found.append((self.langs[best], float(total[best]), float(np.exp(total - total[best]).sum())))
        return found


def fit_languages(docs: DataFrame, held_out: Column, vocabulary: str = VOCABULARY, sample: int = SAMPLE, longest: int = SAMPLE_CHARS) -> Iterator[LanguageModel]:
    """Piece probabilities of each language by expectation maximisation over all segmentations: a model for each
    ``MOST_LANGUAGES`` labels, in order, so that no machine holds more at once. Languages are fitted
    on their own texts alone, so what a label learns doesn't depend on the others of its model.

    Fitted on a bounded sample: of each language's documents that are not held out, the ``sample``
    rows of the smallest md5 of their id, then of their text's hash (rows that repeat both count once), without texts of over ``longest`` characters and runs of
    over ``LONGEST`` letters (neither is left out when texts are scored). Their words are
    counted once; a round is a Spark job over these counts that returns one row per language and
    piece used.
    """
    spark = docs.sparkSession
    pieces = read_vocabulary(vocabulary)
    trie = Pieces(pieces)
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.char_length("text") <= longest) & ~held_out)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    by = Window.partitionBy("lang").orderBy("key", "doc_id", "hash")
    chosen = rows.select("lang", "doc_id", "hash", key.alias("key")).withColumn("place", F.row_number().over(by)).filter(F.col("place") <= sample)
    chosen = written(chosen.select("lang", "doc_id", "hash").distinct())
    if chosen.count() <= 200_000:  # two short columns
        chosen = F.broadcast(chosen)
    texts = rows.join(chosen, (rows["lang"] == chosen["lang"]) & rows["doc_id"].eqNullSafe(chosen["doc_id"]) & (rows["hash"] == chosen["hash"]), "left_semi")
    texts = texts.dropDuplicates(["lang", "doc_id", "hash"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [w for w in words_of(text) if len(w) <= LONGEST]
                langs += [lang] * len(found)
                words += found
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string())], names=["lang", "word"])

    counts = written(texts.select("lang", "text").mapInArrow(split, "lang string, word string").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    known = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    for start in range(0, len(known), MOST_LANGUAGES):
        langs = known[start : start + MOST_LANGUAGES]
        some = counts if len(known) <= MOST_LANGUAGES else counts.filter(F.col("lang").between(langs[0], langs[-1]))
        yield _fitted(some, langs, pieces, trie)


def _fitted(counts: DataFrame, langs: list[str], pieces: list, trie: Pieces) -> LanguageModel:
    spark = counts.sparkSession
    place = {lang: i for i, lang in enumerate(langs)}
    logp = np.full((len(pieces) + 1, len(langs)), -np.log(len(pieces)))
    logp[-1] = UNKNOWN
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((trie, logp, place))

        def uses(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie, logp, place = shared.value
            total = np.zeros((trie.size, len(place)))
            for batch in batches:
                lang = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
                words, times = batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float)
                if words:
                    total += trie.expected(words, times, lang, logp)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], names=["piece", "lang", "uses"])

        spread = counts.repartition(spark.sparkContext.defaultParallelism, "word")
        summed = spread.mapInArrow(uses, "piece long, lang long, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
        total = np.full((len(pieces), len(langs)), SMOOTHING)
        total[summed["piece"], summed["lang"]] += summed["uses"]
        logp = np.vstack([np.log(total / total.sum(0)), np.full(len(langs), UNKNOWN)])
    return LanguageModel(trie, langs, logp)


def identify(docs: DataFrame, held_out_mod: int = 4, held_out_rest: int = 2, vocabulary: str = VOCABULARY) -> DataFrame:
    """Predict the language of every whole text, from the text alone.

    A text's score in a language is the sum over its words (lower-cased runs of letters) of the log
    probability of the word, a forward algorithm's sum over all its segmentations into pieces of the
    vocabulary. Rows stay where they are read; the model (pieces x languages) is broadcast. With more
    labels than a model holds, the rows pass one model after the other, written in between.

    Returns all of docs' columns as the struct ``doc``, ``held_out``, ``lang_pred`` (a language of the
    training rows; ``und`` if the text is null or has no letter, or nothing could be learned) and
    ``score`` (its posterior under equal priors; 0 for ``und``). One row per input row, an empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    held = crc_mod(F.col("doc_id"), held_out_mod) == held_out_rest
    scored = "best string, top double, mass double"
    rows = docs.select(F.struct("*").alias("doc"), held.alias("held_out"), docs["text"].alias("text"), *[F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in scored.split(", ")])
    schema, several = rows.schema, False

    def predicted(shared) -> Callable:
        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                for start in range(0, batch.num_rows, 500):
                    part = batch.slice(start, 500)
                    found = model.classify([t.as_py() or "" for t in part.column(2)])
                    found = [_likelier(a, b) for a, b in zip(zip(*(c.to_pylist() for c in part.columns[3:])), found)]
                    columns = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.float64()))]
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], names=part.schema.names)

        return predict

    for model in fit_languages(docs, held, vocabulary):
        rows = (written(rows) if several else rows).mapInArrow(predicted(spark.sparkContext.broadcast(model)), schema)
        several = True
    known = F.col("best").isNotNull()
    return rows.select("doc", "held_out", F.coalesce("best", F.lit("und")).alias("lang_pred"), F.when(known, 1 / F.col("mass")).otherwise(0.0).alias("score"))


def _likelier(one: tuple, other: tuple) -> tuple:
    """What two models say of a text, as if they were one: the likelier language, and the sum of all."""
    if one[0] is None or other[0] is None:
        return other if one[0] is None else one
    best, rest = (one, other) if one[1] >= other[1] else (other, one)
    return best[0], best[1], best[2] + rest[2] * float(np.exp(rest[1] - best[1]))

"""Manifest, byte-pair encoding and hard negatives against brute force, with odd rows: nulls, empty and long
texts, ties, repeated rows, empty tables, extra columns with names that clash."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from streamloom.llm import hard_negatives as hn
from streamloom.llm.bpe import Codec, decoded, encoded
from streamloom.llm.merkle import folded_up, manifest, proof_text, verified_manifest
from streamloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves, fanout):
    """(root, for each leaf its siblings left and right at every level)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for i, path in enumerate(paths):
            run, k = runs[at[i] // fanout], at[i] % fanout
            path.append(("".join(run[:k]), "".join(run[k + 1 :])))
            at[i] //= fanout
        level = [sha("".join(r)) for r in runs]
    return level[0], paths


def proofs(rows):
    """Contract of the manifest, by hand: rows of (doc_id, source, lang, n_chars, text)."""
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(code, r)))
    low = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    seen = lambda r: (*r[:4], low(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    subs = []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs.append((own, *tree([leaf(r) for r in own], 16)))
    if not subs:
        return []
    root, tops = tree([s[1] for s in subs], 16)
    out = []
    for (own, sub, paths), top in zip(subs, tops):
        for r, path in zip(own, paths):
            at = leaf(seen(r))
            for left, right in path + top:
                at = sha(left + at + right)
            out.append((r[0], leaf(r), sub, root, sha("".join(a + b for a, b in path + top)), at, at == root))
    return out


def manifest_rows(docs):
    return verified_manifest(docs).select("row.doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256), "folded_root", "verified").collect()


@pytest.mark.parametrize("sources", [1, 3, 40])
def test_manifest(spark, sources):
    rng = random.Random(sources)
    name = lambda: rng.choice([None, "ü", *[f"s{i}" for i in range(sources)]] if sources > 1 else ["s"])
    rows = [(i, name(), rng.choice(["en", None]), 3, rng.choice(["Text", "plain", "", None, "É: 1:-"])) for i in range(700)]
    rows += [(None, "s1", None, None, "X"), (None, "s1", None, None, None), (5, "s1", "en", 3, "Again"), *[(9, "s1", "en", 3, "Copy")] * 40, (10, "alone", "en", 1, "A" * 200_000)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id bigint, source string, lang string, n_chars int, text string, tree string, at int, n int")
    got = manifest_rows(docs.repartition(5))
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=order) == sorted(proofs(rows), key=order)
    assert 0 < sum(not r.verified for r in got) < len(rows) / 3


def test_manifest_small(spark):
    ddl = "doc_id bigint, source string, lang string, n_chars int, text string"
    assert manifest_rows(spark.createDataFrame([], ddl)) == []
    one = [(1, None, None, None, None)]
    assert list(map(tuple, manifest_rows(spark.createDataFrame(one, ddl)))) == proofs(one)
    leaves = spark.range(30).select("id", F.lit("g").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    found = manifest(leaves, "g", ["id"], fanout=3).withColumn("again", folded_up(F.col("leaf"), F.col("path"))).collect()
    assert {r.again for r in found} == {tree([sha(str(i)) for i in range(30)], 3)[0]} and len(found) == 30


@pytest.fixture(scope="module")
def codec():
    return Codec(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


ATOMS = [" ", "  ", "\n", "\t", "'", "'s", "'re", "''", "a", "aaaa", "the", "hello ", "world", " don't", "1", "12345", "...", "!?", "。", "漢字", "ひらがな", "é", " ", " ", "🎉", "\x1c", "<|endoftext|>", "<|end", "oftext|>", "<|", "|>", "ǅ", "Ⅷ", "͸"]


def odd_text(rng):
    kind = rng.random()
    if kind < 0.4:
        pool = rng.sample(ATOMS, rng.randint(1, 6))
        return "".join(rng.choice(pool) for _ in range(rng.randint(1, 1500)))
    if kind < 0.6:
        pool = rng.sample(ATOMS, rng.randint(1, 3))
        return "".join(rng.choice(pool) * rng.randint(1, 400) for _ in range(rng.randint(1, 12)))
    letters = rng.choice(["abcdefghijklmnopqrstuvwxyz", "漢字日本語中文ですがのはを。、", "ab '", "а1 б"])
    return "".join(rng.choice(letters) for _ in range(rng.randint(1, 4000))) + rng.choice(["", "x", " x", "s", "'s"]) * rng.randint(0, 300)


def test_joins_are_exact(codec, library):
    """Trees of pieces of any size give the library's ids, and the same words; windows stay small."""
    rng = random.Random(11)
    for _ in range(250):
        text, piece, window = odd_text(rng), rng.choice([40, 200, 1000]), rng.choice([2, 8, 32])
        nodes = [codec.words(text[i : i + piece]) for i in range(0, len(text), piece)]
        while len(nodes) > 1:
            nodes = [codec.join(*nodes[i : i + 2], window) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        made = library.encode(text, add_special_tokens=False)
        assert nodes[0][0].tolist() == made.ids and nodes[0][1].tolist() == [a != b for a, b in zip(made.word_ids, [-1, *made.word_ids])]
        assert codec.ids(text).tolist() == made.ids
    seen, halves = [], [codec.words("word " * 30_000), codec.words("z" * 60_000)]
    for half in halves:
        words, codec.words = codec.words, lambda t: seen.append(len(t)) or words(t)
        codec.join(half, half)
        codec.words = words
    assert max(seen) < 2000


def test_encode_and_decode(spark, library):
    rng = random.Random(5)
    texts = [None, "", " ", "<|endoftext|>", "a<|endoftext|> b", *[odd_text(rng) for _ in range(40)], "q" * 9000, " " * 9000, "long words " * 2000, *["copy " * 700] * 3]
    rows = spark.createDataFrame([(i % 7 or None, t, "x", 3) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, node int")
    found = decoded(encoded(rows, VOCABULARY, piece=300), VOCABULARY).select("doc.doc_id", "doc.ids", F.col("ids").alias("made"), "text").collect()
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i % 7 or None, "x", struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)))
    assert sorted([(r.doc_id, r.ids, bytes(r.made), r.text) for r in found], key=repr) == sorted(want, key=repr)
    assert encoded(rows.limit(0), VOCABULARY).count() == 0
    broken = [[50256, 162, 120], [120], [], [257, 227, 50256]]  # bytes that are no UTF-8
    odd = spark.createDataFrame([(i, bytearray(struct.pack(f"<{len(x)}I", *x))) for i, x in enumerate(broken)], "doc int, ids binary")
    assert [r.text for r in decoded(odd, VOCABULARY).orderBy("doc").collect()] == [library.decode(x, skip_special_tokens=False) for x in broken]


def test_op12(spark, library):
    want = {}
    for r in pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r[0]: tuple(r)[1:] for r in QUERIES["op12_bpe"](spark, DATA).collect()} == want


def mined(rows, anchors, positives=5, negatives=3, low=50, high=95):
    """Rows of (id, ints, label), each once."""
    rows, out = sorted(set(rows), key=repr), []
    for i, v, label in (r for r in rows if r[0] in anchors):
        score = lambda w: sum(a * b for a, b in zip(v, w))
        others = sorted((-score(w), j, k == label) for j, w, k in rows if j != i and len(w) == len(v))
        for s, j, _ in [o for o in others if o[2]][:positives]:
            fit = [o for o in others if not o[2] and low * -s <= 100 * -o[0] <= high * -s]
            out += [(i, j, n + 1, o[1], -s, -o[0]) for n, o in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("cells", [(128, 16, 1 << 22), (8, 16, 1 << 22), (8, 4, 600)])
@pytest.mark.parametrize("kind", ["even", "clustered", "copies", "mixed"])
def test_hard_negatives(spark, monkeypatch, cells, kind):
    for name, value in zip(("LEAF", "LEAST_CELLS", "CELL"), cells):
        monkeypatch.setattr(hn, name, value)
    rng = np.random.default_rng(len(kind))
    n, centres = 500, rng.normal(size=(12, 6))
    points = {"even": rng.normal(size=(n, 6)), "clustered": centres[rng.integers(0, 12, n)] * 3 + rng.normal(size=(n, 6)) * 0.1, "copies": centres[rng.integers(0, 3, n)], "mixed": rng.normal(size=(n, 6))}[kind]
    labels = rng.integers(0, 3, n)
    rows = [(i, [float(x) for x in points[i]], int(labels[i])) for i in range(n)]
    if kind == "mixed":
        rows = [(i, v[: 3 if i % 5 == 0 else 6], k) for i, v, k in rows]
        rows += [(600, None, 1), (610, [1.0] * 6, None), (None, [1.0] * 6, 1), (620, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (630, [float("nan")] * 6, 1), (640, [float("inf")] * 6, 1), (650, [0.0] * 6, 1), (660, [], 1), (670, [], 2), (680, [], 1)]
        rows += [(700, [1e9, 1.0, 1.0, 1.0, 1.0, 2.0], 1), (710, [-1e9, 2e9, 1.0, 1.0, 1.0, 1.0], 2), rows[20], rows[20], (20, [0.5] * 6, 0)]
    whole = lambda v: tuple(int(np.floor(x * 256)) for x in v)
    usable = [(i, whole(v), k) for i, v, k in rows if i is not None and v is not None and k is not None and all(x is not None and np.isfinite(x) for x in v)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, dims string, rid int").repartition(3)
    got = hn.hard_negatives(frame, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == mined(usable, {i for i, _, _ in usable if i % 10 == 0})


def test_hard_negatives_of_nothing(spark):
    ddl = "vec_id bigint, embedding array<float>, label int"
    assert hn.hard_negatives(spark.createDataFrame([], ddl), F.lit(True)).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(1, None, 1), (2, [0.5], 1)], ddl), F.lit(True)).count() == 0


def test_cells_are_pruned(spark):
    """In clustered data an anchor visits few cells and leaves."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    vectors = np.floor(centres[rng.integers(0, 40, 4000)] * 1024 + rng.normal(size=(4000, 8)))
    size = float((vectors**2).sum(axis=1).max()) + 1
    built = hn.grown(hn.augmented(vectors, size), 64, False)
    top, _ = built.bounds(vectors[:50], size)
    best = np.sort(vectors[:50] @ vectors.T, axis=1)[:, -5]
    assert (top >= best[:, None]).sum(axis=1).mean() < 0.35 * len(built.leaves)

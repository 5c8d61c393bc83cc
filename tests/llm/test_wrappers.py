"""The queries without SQL, over the smallest tables, against brute force or held-out labels."""

import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from streamloom.llm.decontaminate import closest, folded_bytes
from streamloom.llm.lang_id import words_of
from streamloom.llm.minhash import size_level
from streamloom.llm.queries import QUERIES
from streamloom.llm.token_counts import PATTERN, VOCABULARY
from tests.llm.test_texts import _spans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{DATA}/documents.parquet").to_pylist()


def _held(doc_id, n, rest):
    return zlib.crc32(str(doc_id).encode()) % n == rest


def test_op1(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op1_lang_id"](spark, DATA).collect()}
    assert set(got) == {d["doc_id"] for d in documents}
    assert all(r.held_out == _held(i, 4, 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert all((got[d["doc_id"]].lang_pred == "und") == (not words_of(d["text"] or "")) for d in documents)
    held = [d for d in documents if _held(d["doc_id"], 4, 2) and d["lang"] is not None and words_of(d["text"] or "")]
    assert sum(got[d["doc_id"]].lang_pred == d["lang"] for d in held) >= 0.95 * len(held)


def test_op2(spark):
    table = pq.read_table(f"{DATA}/embeddings.parquet")
    ids, x = np.array(table["vec_id"]), np.array(table["embedding"].to_pylist(), np.float64)
    found, hit, all_ = {}, 0, 0
    for r in QUERIES["op2_ann"](spark, DATA).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    for q, near in found.items():
        s = dict(zip(ids.tolist(), (x @ x[ids == q][0]).tolist(), strict=True))
        s.pop(q)
        near.sort()
        assert [n for n, _, _ in near] == list(range(1, min(20, len(s)) + 1)) and all(abs(s[v] - z) < 1e-12 for _, v, z in near)
        true = sorted(s, key=lambda v: (-s[v], v))[:20]
        hit, all_ = hit + len({v for _, v, _ in near} & set(true)), all_ + len(true)
    assert hit >= 0.9 * all_


def test_op3(spark, documents):
    want = _spans([(d["text"] or "").encode() for d in documents], 400)
    got = QUERIES["op3_suffix_dedup"](spark, DATA).collect()
    assert sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == sorted(zip([d["doc_id"] for d in documents], want, strict=True))


def _merged(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of a piece by merging the pair of the least rank until none is known."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == len(ranks):
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return len(parts)


def test_op6(spark, documents):
    """Encoded lengths from the merges themselves, without the tokenizer library."""
    import base64

    import regex

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    known: dict[str, int] = {}
    lengths = []
    for d in documents:
        pieces = regex.findall(PATTERN, d["text"] or "")
        known |= {p: _merged(p.encode(), ranks) for p in set(pieces) - set(known)}
        lengths.append(sum(known[p] for p in pieces))
    want = Counter(lengths)
    got = {r.n_tokens: r for r in QUERIES["op6_token_counts"](spark, DATA).collect()}
    assert {n: r.docs for n, r in got.items()} == dict(want)
    for n, r in got.items():
        assert (r.docs_at_least, r.tokens_at_least) == (sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))


def test_op7(spark, documents):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist() if r["quality"] is not None}
    got = {r.doc_id: r for r in QUERIES["op7_quality"](spark, DATA).collect()}
    assert set(got) == {d["doc_id"] for d in documents}
    assert all(r.held_out == _held(i, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    held = [i for i in labels if i in got and _held(i, 5, 0)]
    if len(set(labels.values())) > 1 and held:
        assert sum(got[i].predicted == labels[i] for i in held) >= 0.9 * len(held)


def test_op10(spark, documents):
    """Every document against every item, by the distance table alone."""
    items = [r for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist() if r["text"] and r["item_id"] is not None]
    texts = {d["doc_id"]: folded_bytes(np.frombuffer((d["text"] or "").encode(), np.uint8)) for d in documents}
    want = {}
    for item in items:
        pattern = folded_bytes(np.frombuffer(item["text"].encode(), np.uint8))
        for doc_id, text in texts.items():
            if len(text):
                distance = closest(pattern, text)[0]
                if 100 * distance <= 15 * len(pattern):
                    want[doc_id, item["item_id"]] = distance
    got = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op10_decontaminate"](spark, DATA).collect()}
    assert got == want


@pytest.mark.parametrize("percent", [50, 80, 95, 100])
def test_similar_sizes_are_in_adjacent_levels(spark, percent):
    n = spark.range(1, 3000).select(F.col("id").alias("n"), size_level(F.col("id"), percent).alias("level"))
    level = {r.n: r.level for r in n.collect()}
    assert all(0 <= level[hi] - level[lo] <= 1 for hi in level for lo in {-(-hi * percent // 100), hi})


def test_scratch_keeps_what_is_asked_for(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from streamloom.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    rows, tables = spark.range(5), lambda: sum(1 for _ in Path(tmp_path).rglob("_SUCCESS"))
    with common.scratch(spark) as keep:
        once = common.written(rows)
        with common.scratch(spark) as keep_inner:
            twice = keep_inner(common.written(once))
            assert tables() == 3
        assert tables() == 2 and twice.count() == 5
        kept = keep(twice)
    assert tables() == 1 and kept.count() == 5
    with pytest.raises(ZeroDivisionError), common.scratch(spark):
        common.written(rows)
        1 / 0
    assert tables() == 1

"""Operators on texts against brute force, with odd rows: nulls, empty and long texts, ties, repeated
rows, empty tables, extra columns with names that clash."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamloom.llm import suffix_dedup
from streamloom.llm.components import components
from streamloom.llm.decontaminate import Finder, cgk, closest, decontaminated, edited, folded_bytes, leaks
from streamloom.llm.line_dedup import line_dedup
from streamloom.llm.minhash import _links, deduplicated, near_duplicates, sketches
from streamloom.llm.mixing import fair_queue
from streamloom.llm.shingles import shingle_sets
from streamloom.llm.token_counts import at_limits, length_histogram, token_lengths

WORD = re.compile(r"[^ \x09-\x0D]+")
EXTRA = "doc_id bigint, text string, lang string, source string, t1 string, did int, body string, gram int, key string, n int"


def table(spark, rows):
    """(id, text[, source]) with columns whose names the operators use too."""
    return spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else None, "x", 1, "b", 2, "k", 3) for r in rows], EXTRA)


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(words))


@pytest.mark.parametrize(("least", "parts"), [(2, 4096), (3, 4096), (2, 20), (3, 1)])
def test_line_dedup(spark, monkeypatch, least, parts):
    monkeypatch.setattr("streamloom.llm.common.HOT_PARTS", parts)  # all, some or none decided by broadcast
    rng = random.Random(1)
    pool = [prose(rng, 4) for _ in range(12)] + ["short", "", " Same Line here \t", "same line HERE"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 8)))) for i in range(30)] + [(30, None), (31, ""), (None, pool[0]), (5, pool[1]), (5, pool[1]), (40, "\n".join(["x" * 30] * 5000))]
    key = lambda x: re.sub(r"^[ \x09-\x0D]+|[ \x09-\x0D]+$", "", x).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    place = lambda i: 10**9 if i is None else i
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(place(i))
    want = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (len(key(x)) >= 10 and len(held[key(x)]) >= least and min(held[key(x)]) < place(i))]
        want.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    got = line_dedup(table(spark, rows), min_docs=least).select("doc.doc_id", "n_lines", "n_dropped", "kept_text", "doc.key").collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)
    assert line_dedup(table(spark, [])).count() == 0


def test_fair_queue(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.choice([3, 10, 400])), f"s{rng.choice([0, 0, 0, 1, 2, 3])}") for i in range(80)] + [(90, None, "s1"), (91, " \t", None), (92, "a b c", None), (92, "a b c", None), (None, "a", "tiny")]
    queue = fair_queue(table(spark, rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, left, free, target = {s: i % 3 + 1 for i, s in enumerate(order)}, float(sum(sizes.values())), set(order), {}
    while free:
        per = left / sum(weight[s] for s in free)
        over = [s for s in free if per * weight[s] > 3 * sizes[s]]
        target |= {s: 3.0 * sizes[s] for s in over} if over else {s: per * weight[s] for s in free}
        left -= sum(3 * sizes[s] for s in over)
        free = free - set(over) if over else set()
    assert any(target[s] == 3 * sizes[s] for s in order)  # a source that runs dry
    docs = [r for r in queue if r.epoch == 0]
    assert len(docs) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in docs)
    for s in order:
        mine = [r for r in docs if r.doc.source == s]
        assert {round(r.target, 6) for r in mine} == {round(target[s], 6)} and abs(sum(r.taken for r in mine) - target[s]) < 1
    assert [r.finish for r in queue] == sorted(r.finish for r in queue)
    # the cut follows the finish times: whole entries before it, none after, one in service a source
    whole = max(r.finish for r in queue if r.size and r.words == r.size)
    for r in queue:
        assert not (0 < r.words < r.size) or sum(0 < x.words < x.size and x.doc.source == r.doc.source for x in queue) == 1
        assert not (r.size and r.words < r.size) or r.finish >= max((x.finish for x in queue if x.doc.source == r.doc.source and x.words == x.size > 0), default=0)
    assert all(r.words == r.size for r in queue if r.finish < whole and r.target >= 3 * r.source_size)
    given, order = 0, sorted((x for x in queue if x.words), key=lambda r: r.finish)
    for r in order:
        given += r.words
    assert sum(sizes.values()) - len(sizes) <= given <= sum(sizes.values())
    assert sum(r.words for r in queue) == sum(r.taken for r in docs)
    assert fair_queue(table(spark, [])).count() == 0
    assert [r.target for r in fair_queue(table(spark, [(1, None, "a")])).collect()] == [0.0]


def test_token_histogram(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 40))) for i in range(60)] + [(70, None), (71, ""), (72, " " * 20_000), (73, "x" * 50_000), (74, "<|endoftext|>")]
    lengths = sorted(r.n_tokens for r in token_lengths(table(spark, rows)).collect())
    assert len(lengths) == len(rows) and lengths[:2] == [0, 0]
    hist = length_histogram(table(spark, rows))
    for r in hist.collect():
        over = [n for n in lengths if n >= r.n_tokens]
        assert (r.docs, r.docs_at_least, r.tokens_at_least) == (lengths.count(r.n_tokens), len(over), sum(over))
        assert r.truncated_total == sum(min(n, r.n_tokens) for n in lengths) and r.total_tokens == sum(lengths)
        assert abs(r.quantile - sum(n <= r.n_tokens for n in lengths) / len(lengths)) < 1e-12
    limits = [1, 17, 100, 10**7]
    assert {r["limit"]: (r.docs_over, r.truncated_total) for r in at_limits(hist, limits).collect()} == {x: (sum(n > x for n in lengths), sum(min(n, x) for n in lengths)) for x in limits}
    assert length_histogram(table(spark, [])).count() == 0


def test_token_lengths_of_long_space():
    from streamloom.llm.token_counts import VOCABULARY, _encodings, _length

    with open(VOCABULARY, "rb") as f:
        both = _encodings(f.read())
    for text in ("a" + " " * 3000 + "b", "\n" * 2500, "x y" + "\t" * 2100):
        assert _length(text, *both) > 0
    from unittest.mock import patch

    with patch("streamloom.llm.token_counts._LONG_SPACE", re.compile("z{9}")):
        plain = [_length(t, *both) for t in ("a  b\n\n c  ", "it's 12 o'clock   ")]
    with patch("streamloom.llm.token_counts._LONG_SPACE", re.compile("")):
        assert [_length(t, *both) for t in ("a  b\n\n c  ", "it's 12 o'clock   ")] == plain


def test_shingles_and_sketches():
    texts = ["A b c d e f", "a B c d e f", "a b", "", None, "a b c  d\te f\n", "x " * 1000]
    sets = list(shingle_sets(__import__("pyarrow").array(texts), 4))
    assert [len(s) for s in sets] == [3, 3, 1, 0, 0, 3, 1]
    assert all((sets[0] == sets[i]).all() for i in (1, 5))
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 2**63, (2, 400), dtype=np.uint64)
    pair = np.concatenate([np.concatenate([a[:300], b[:50]]), np.concatenate([a[:300], b[50:100]])])
    s = sketches(pair, np.array([0, 350, 700]), 1024)
    assert (s != np.iinfo(np.uint64).max).all() and abs((s[0] == s[1]).mean() - 0.75) < 0.06
    tiny = sketches(a[:1], np.array([0, 1, 1]), 16)
    assert (tiny[0] != np.iinfo(np.uint64).max).all() and (tiny[1] == np.iinfo(np.uint64).max).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, 7), (7, 100), (5, 5)] + [(200, x) for x in range(201, 260)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 10 for i in range(10, 41)} | {7: 7, 100: 7} | {x: 200 for x in range(200, 260)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def _near(rows, words, percent):
    sets, root = {}, {}
    place = lambda i: 2**63 - 1 if i is None else i
    for n, (i, t) in enumerate(rows):
        w = WORD.findall((t or "").lower())
        sets[n] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
        root[n] = place(i)
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if root[a] > root[b] and (both and 100 * both >= percent * len(sets[a] | sets[b]) or rows[a][0] == rows[b][0]):
                    root[a], changed = root[b], True
    return sorted(((i, len(sets[n]), root[n]) for n, (i, t) in enumerate(rows)), key=repr)


def test_near_duplicates(spark, monkeypatch):
    rng = random.Random(6)
    base = [prose(rng, 60) for _ in range(4)]
    rows = []
    for i in range(70):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "changed" + str(rng.randrange(9))
        rows.append((i, " ".join(w[: rng.choice([60, 60, 55, 50, 45, 40])])))  # several levels of sizes
    rows += [(80, None), (81, ""), (82, "one two"), (83, "ONE  two"), (None, base[0]), (3, rows[3][1]), (90, prose(rng, 3000))]
    want = _near(rows, 4, 80)
    for block in (2048, 8):  # in one task, and by levels of sizes and pairs of blocks
        monkeypatch.setattr("streamloom.llm.minhash.BLOCK", block)
        got = near_duplicates(table(spark, rows), 4, 80).collect()
        assert sorted(((r.doc.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
    kept = deduplicated(table(spark, rows), 4, 80)
    assert kept.columns == table(spark, []).columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted({i for i, _, c in want if i == c})
    assert near_duplicates(table(spark, [])).count() == 0


def test_links_are_those_of_all_pairs():
    rng = np.random.default_rng(7)
    sets = [np.unique(np.concatenate([np.arange(40)[rng.random(40) < 0.95], rng.integers(100, 200, 2)])).astype(np.uint64) for _ in range(30)]
    links = _links(sets, np.zeros(30, bool), 80)
    for a, b in links:
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)


@pytest.mark.parametrize("seed", range(4))
def test_interval_expansion(seed):
    rng = random.Random(seed)
    for length in (1, 2, 3, 6, 9):
        strings = ["".join(rng.choice("abc"[: 2 + seed % 2]) for _ in range(rng.randint(0, 60))).encode() for _ in range(8)]
        strings += [strings[0] + b"z", b"a" * 30, b""]
        count = {}
        for s in strings:
            for i in range(len(s) - length + 1):
                count[s[i : i + length]] = count.get(s[i : i + length], 0) + 1
        for s, flags in zip(strings, suffix_dedup.repeated_windows(strings, length), strict=True):
            assert flags.tolist() == [count[s[i : i + length]] > 1 for i in range(len(s) - length + 1)]


def _spans(texts, length):
    count = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1 << 20, 900, 1])
def test_repeated_spans(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_BYTES", most)  # the smaller ones: groups are split by longer contexts
    monkeypatch.setattr(suffix_dedup, "PIECE", 3000)
    rng = random.Random(8)
    passage, other = prose(rng, 60), prose(rng, 70) + " é€"
    texts = [prose(rng, rng.randint(5, 120)) + rng.choice(["", passage, other, passage[30:-20]]) + prose(rng, rng.randint(0, 90)) for _ in range(40)]
    texts += [texts[0], texts[0], None, "", "ab" * 900, "ab" * 120, prose(rng, 2500) + passage]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    want = sorted(zip([i for i, _ in rows], _spans([(t or "").encode() for t in texts], 150), strict=True), key=repr)
    got = suffix_dedup.repeated_spans(table(spark, rows), 150).collect()
    assert sorted(((r.doc.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got), key=repr) == want
    assert suffix_dedup.repeated_spans(table(spark, []), 150).count() == 0


def test_stretches_of_periodic_texts():
    """Every window is in one stretch, and a periodic run is one stretch with its period."""
    for unit, most in ((b"a", 1), (b"ab", 2), (b"abc", 3), (b"0123456789" * 9, 10), (bytes(range(40, 130)), 90)):
        data = np.frombuffer(b"start of it " + unit * (60_000 // len(unit)) + b" and its end", np.uint8)
        text, first, windows, span, gram = suffix_dedup.stretches(data, np.array([0, len(data)]), 400)
        assert span.sum() == len(data) - 399 and (first[1:] == (first + span)[:-1]).all()
        assert span.max() > 59_000 and windows[span.argmax()] == most and len(first) < 60


def test_long_periodic_texts(spark):
    rows = [(1, "ab" * 500_000), (2, "ab" * 500_000), (3, "x" + "ba" * 150_000 + "y"), (4, "abc" * 200), (5, "-" * 399), (6, "q" * 401)]
    want = {1: (10**6, 1), 2: (10**6, 1), 3: (300_000, 1), 4: (600, 1), 5: (0, 0), 6: (401, 1)}
    got = suffix_dedup.repeated_spans(table(spark, rows)).collect()
    assert {r.doc.doc_id: (r.n_removed, r.n_spans) for r in got} == want


def test_edit_distance_and_embedding():
    rng = np.random.default_rng(9)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    for _ in range(40):
        a, b = rng.integers(97, 100, rng.integers(1, 12)), rng.integers(97, 100, rng.integers(1, 20))
        assert closest(a.astype(np.uint8), b.astype(np.uint8))[0] == slow(a, b)
    item = rng.integers(97, 123, 200).astype(np.uint8)
    coins = rng.integers(0, 2, (402, 256))
    near, far = edited(item, 0.05, rng)[:200], rng.integers(97, 123, 200).astype(np.uint8)
    pad = lambda x: np.pad(x, (0, 200 - len(x)))
    e = cgk(np.stack([item, pad(near), far]), np.array([200, len(near), 200]), coins)
    assert (e[0] == e[1]).mean() > 0.5 > (e[0] == e[2]).mean() + 0.2


def test_embedding_pads_no_item_to_the_longest():
    rng = np.random.default_rng(21)
    rows = [rng.integers(97, 123, n).astype(np.uint8) for n in (5, 0, 300, 40_000, 7)] + [rng.integers(97, 123, 60).astype(np.uint8) for _ in range(300)]
    from streamloom.llm.decontaminate import Coins, embeddings

    out, begin = embeddings(rows, Coins(3))
    assert len(out) == 2 * sum(map(len, rows))
    for i in (0, 2, 3, 4, 200):
        alone = cgk(rows[i][None], np.array([len(rows[i])]), Coins(3))[0]
        assert (out[begin[i] : begin[i + 1]] == alone).all()
    finder = Finder([1, 2], [bytes(rows[2]), bytes(rows[3])])
    text = np.concatenate([rows[5], rows[3], rows[6]])
    assert [hit[:3] for hit in finder.find(text, np.array([0, len(text)]))] == [(0, 1, 0)]


def test_leaks(spark):
    rng = random.Random(10)
    nrng = np.random.default_rng(10)
    items = [(i, prose(rng, 30)) for i in range(20)] + [(30, " Too\tshort "), (31, None), (3, None), (32, ""), (33, "é!"), (34, "tail"), (None, "zz top"), (None, "ZZ Top")]
    rows = [(i, prose(rng, 200)) for i in range(40)]
    for i in range(20):
        changed = bytes(edited(folded_bytes(np.frombuffer(items[i][1].encode(), np.uint8)), 0.02 * (i % 5), nrng)).decode()
        rows.append((100 + i, prose(rng, 30) + "\n" + changed.upper() + " " + prose(rng, 30)))
    rows += [(200, None), (201, ""), (202, items[0][1].replace(" ", "\n")), (202, items[0][1]), (203, prose(rng, 20_000) + items[1][1])]
    rows += [(300, "it is TOO short."), (301, "tooshort, too shorter"), (302, "é!é! xé!"), (303, "to the tail"), (304, "tailor, detail, tail9"), (305, "tails tail"), (306, "x zz top y")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(table(spark, rows), bench).collect()}
    short = {(300, 30), (302, 33), (303, 34), (305, 34), (306, None)}  # exact, and not within a word
    want = {(100 + i, i) for i in range(20)} | {(202, 0), (203, 1)} | short
    assert short <= got <= want and len(want - got) <= 1
    clean = decontaminated(table(spark, rows), bench)
    assert clean.columns == table(spark, []).columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {d for d, _ in got}
    assert leaks(table(spark, []), bench).count() == 0
    assert leaks(table(spark, rows), bench.limit(0)).count() == 0


def test_finder_recall():
    rng, nrng = random.Random(11), np.random.default_rng(11)
    items = [prose(rng, 35).encode() for _ in range(60)]
    finder, found = Finder(list(range(60)), items), 0
    for i, item in enumerate(items):
        text = np.frombuffer(prose(rng, 50).encode() + b" " + bytes(edited(np.frombuffer(item, np.uint8), 0.1, nrng)) + b" " + prose(rng, 50).encode(), np.uint8)
        found += any(hit[1] == i for hit in finder.find(text, np.array([0, len(text)])))
    assert found >= 57


def test_hash_of_bytes_is_stable(spark):
    rows = table(spark, [(1, "a b c d e")])
    assert near_duplicates(rows).select(F.col("n_shingles")).first()[0] == 1


def test_finder_misses_no_spread_edits():
    """Edits at every so many bytes leave no long run: all passages within the edits are found, and no others."""
    rng = random.Random(13)
    items = [prose(rng, 35).encode()[: rng.randint(40, 200)] for _ in range(24)]
    finder = Finder(list(range(24)), items)
    for every in (16, 12, 8, 7):
        texts = []
        for item in items:
            changed = bytearray(item)
            changed[every - 1 :: every] = b"#" * len(changed[every - 1 :: every])
            texts.append(prose(rng, 50).encode() + b" " + bytes(changed) + b" " + prose(rng, 50).encode())
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        want = {(t, i) for i, x in enumerate(items) for t in range(24) if closest(np.frombuffer(x, np.uint8), np.frombuffer(texts[t], np.uint8))[0] <= int(0.15 * len(x))}
        assert want >= {(i, i) for i, x in enumerate(items) if len(x) // every <= int(0.15 * len(x))}
        assert {hit[:2] for hit in finder.find(data, offsets)} == want
        assert {hit[0] for hit in finder.find(data, offsets, any_item=True)} == {t for t, _ in want}


def test_finder_against_all_places(monkeypatch):
    rng, nrng = random.Random(14), np.random.default_rng(14)
    items = ["".join(rng.choice("ab -") for _ in range(n)).encode() for n in (33, 40, 80, 150)] + [b"-" * 64]
    texts = [b"", b"-" * 500, b"ab" * 100]
    for _ in range(60):
        item = rng.choice(items)
        changed = bytes(edited(np.frombuffer(item, np.uint8), rng.choice([0, 0.1, 0.14, 0.15, 0.18]), nrng))
        texts.append(rng.choice([b"", prose(rng, 9).encode()]) + changed + rng.choice([b"", prose(rng, 9).encode()]))
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    best = {(t, i): closest(np.frombuffer(x, np.uint8), np.frombuffer(text, np.uint8))[0] for i, x in enumerate(items) for t, text in enumerate(texts)}
    for entries in (4 << 20, 2000):
        monkeypatch.setattr("streamloom.llm.decontaminate.ENTRIES", entries)
        got = {hit[:2]: hit[2] for hit in Finder(list(range(5)), items).find(data, offsets)}
        assert got == {(t, i): n for (t, i), n in best.items() if n <= int(0.15 * len(items[i]))}


def test_documents_that_share_an_id_or_have_none(spark):
    """Different texts stay, whatever their ids; of near copies one stays."""
    rng = random.Random(15)
    a, b, c, d, e, f = (prose(rng, 60) for _ in range(6))
    rows = [(1, a), (None, a + " more"), (None, b), (None, c), (None, c), (None, c + " more"), (7, d), (7, e), (7, e), (9, f), (2, f + " more"), (None, None), (None, ""), (None, "")]
    kept = [(r.doc_id, r.text) for r in deduplicated(table(spark, rows), 4, 80).collect()]
    last = [x for x in kept if x[1] and x[1].startswith(c)]
    assert len(last) == 1 and sorted((x for x in kept if x not in last), key=repr) == sorted([(1, a), (None, b), (7, d), (7, e), (2, f + " more"), (None, None), (None, ""), (None, "")], key=repr)
    got = near_duplicates(table(spark, rows), 4, 80).filter("doc.doc_id is not null or n_shingles > 0").collect()
    assert sorted((r.doc.doc_id or 0, r.component_id, r.kept) for r in got if r.doc.doc_id) == [(1, 1, True), (2, 2, True), (7, 7, True), (7, 7, True), (7, 7, True), (9, 2, False)]
    none = sorted((r.component_id, r.kept) for r in got if not r.doc.doc_id)
    assert none[0] == (1, False) and none in ([(1, False)] + [(2**63 - 1, False)] * x + [(2**63 - 1, True)] * (4 - x) for x in (1, 2))

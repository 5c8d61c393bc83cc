"""Columns of the input whose names an operator uses too go through ``doc`` as they are, and change nothing."""

import pytest
from pyspark.sql import functions as F

from streamloom.llm.bpe import encoded
from streamloom.llm.decontaminate import decontaminated, leaks
from streamloom.llm.lang_id import identify
from streamloom.llm.line_dedup import line_dedup
from streamloom.llm.minhash import deduplicated, near_duplicates
from streamloom.llm.mixing import fair_queue
from streamloom.llm.quality import quality_scores
from streamloom.llm.queries import op11_merkle
from streamloom.llm.suffix_dedup import repeated_spans
from streamloom.llm.token_counts import length_histogram

NAMES = ["doc", "size", "held_out", "key", "n", "row", "best", "score", "taken", "kept", "ids", "uid", "digest", "quality", "did", "body", "start", "item_id", "tree", "gone"]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, f"line of {i % 7} words that all share\nand another line {i}", "en" if i % 2 else "de", f"s{i % 3}", 9) for i in range(40)] + [(50, None, "en", "s1", 0), (51, "", None, None, 0)]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return plain, plain.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in NAMES])


def rows_of(frame):
    """Results by id, without what merely passes through."""
    own = [c for c in frame.columns if c != "doc"]
    return sorted(frame.select("doc.doc_id", *own).collect(), key=repr)


@pytest.mark.parametrize("operator", [identify, fair_queue, line_dedup, near_duplicates, repeated_spans, lambda d: encoded(d, "/opt/tokenizers/byte_bpe_50k.json", piece=20)], ids=["op1", "op5", "op4", "op9", "op3", "op12"])
def test_columns_in_doc(tables, operator):
    plain, odd = map(operator, tables)
    assert rows_of(plain) == rows_of(odd)
    passed = {f.name for f in odd.schema["doc"].dataType.fields}
    assert set(NAMES) <= passed
    assert odd.filter("doc.size <> concat('size-', doc.doc_id) or doc.n <> concat('n-', doc.doc_id)").count() == 0


def test_columns_beside(spark, tables, tmp_path):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40, 2)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, "line of 3 words that all share and another line 3")], "item_id bigint, text string")
    found = []
    for n, docs in enumerate(tables):
        docs.write.parquet(str(tmp_path / f"{n}/documents.parquet"))
        kept = [f(docs) for f in (deduplicated, lambda d: decontaminated(d, items))]
        assert all(k.columns == docs.columns for k in kept)
        made = [length_histogram(docs), leaks(docs, items), quality_scores(docs, labels), op11_merkle(spark, str(tmp_path / str(n)))]
        found.append([sorted(map(repr, m.collect())) for m in made] + [sorted(r.doc_id for r in k.collect()) for k in kept])
    assert found[0] == found[1]

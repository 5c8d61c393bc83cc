"""The stages in a row, each with its effect, and the queries that have SQL against it."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from streamloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_texts import WORD, prose

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(name, spark):
    duck = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        duck.execute(f"create view {path.stem} as select * from '{path}'")
    frame = QUERIES[name](spark, str(DATA))
    found = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    near = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    sort = lambda names, rows: sorted(repr([near(r[names.index(c)]) for c in sorted(names)]) for r in rows)
    assert sorted(frame.columns) == sorted(columns)
    assert sort(frame.columns, frame.collect()) == sort(columns, found.fetchall())


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(12)
    item = prose(rng, 40)
    texts = [prose(rng, 80) for _ in range(12)]
    near = texts[0].split(" ")
    near[40] = "other"
    shared = "a line that many documents hold"
    rows = [(i, t + "\n" + shared) for i, t in enumerate(texts)] + [(20, " ".join(near)), (21, prose(rng, 20) + " " + item + " " + prose(rng, 20)), (22, "%% 12 %%"), (23, None), (24, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "mixing":
            assert now.columns == docs.columns
        kept[name] = {r.doc_id: r for r in now.collect()}
    clean = set(range(12))
    assert set(kept["language_id"]) == set(kept["line_dedup"]) == clean | {20, 21}
    lines = kept["line_dedup"]
    assert shared in lines[0].text and all(shared not in lines[i].text and lines[i].n_chars == len(lines[i].text) for i in range(1, 12))
    assert set(kept["near_dedup"]) == clean | {21} and set(kept["decontamination"]) == set(kept["mixing"]) == clean
    total = sum(len(WORD.findall(r.text)) for r in kept["decontamination"].values())
    queue = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "words", "finish", F.col("target"), "source")
    assert abs(queue.agg(F.sum("words")).first()[0] - total) <= 3
    empty = now.sparkSession.createDataFrame([], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name

import os

import duckdb
import pytest

from voxelake.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str) == expected


def test_frame_walk_takes_all_words(spark, tmp_path):
    texts = ["one", "", None, "a  b é", " ".join(f"w{k}" * (k % 5 + 1) for k in range(700)), "x" * 300 + " y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for doc, text in enumerate(texts):
        words, at = [w.encode() for w in (text or "").split(" ") if w], 476 + 8
        for frame, word in enumerate(words if len(words) > 1 else []):
            want.add((doc, frame, at + 8, len(word)))
            at += 8 + len(word)
    got = [tuple(r) for r in catalogue.QUERIES["frame_offsets_walk"](spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) == 705


def test_frame_walk_neither_nests_nor_sends_back_items(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalogue.QUERIES["frame_offsets_walk"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "transform(" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_removal_reads_either_side_once(spark):
    plan = catalogue.QUERIES["remove_with_guards"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_requests_are_routed_once(spark):
    plan = catalogue.QUERIES["request_answers"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftOuter") == 1 and max(map(len, plan.splitlines())) < 5000

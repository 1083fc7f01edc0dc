import duckdb
import pytest

import corpus_pipeline
from tessera.llm import queries

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "conversations")


def told(columns, rows):
    """Rows as text, columns by name."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_runs_and_agrees_with_its_sql(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    rows = got.collect()
    assert len(rows)
    if name in queries.ORACLE:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = con.execute(queries.ORACLE[name])
        columns = [x[0] for x in want.description]
        assert sorted(got.columns) == sorted(columns) and told(got.columns, rows) == told(columns, want.fetchall())


def test_all_queries():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14)) and set(queries.ORACLE) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]


def test_stages(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(300))
    near = base.replace("w100", "v100")
    rows = [(i, f"a clean text of number {i} " + " ".join(f"c{i}x{k}" for k in range(60)), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, base, "en", "s0", 0), (101, near, "en", "s1", 0), (102, "you grobix zlurp grobix of a zlurp", "en", "s2", 0), (103, None, None, None, None), (None, "no id", "en", "s0", 5)]
    rows += [(200 + i, f"grobix number {i} is a zlurp and grobix again", "en", "s1", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 0) for i in range(40)] + [(200 + i, 1) for i in range(30)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id for r in at.collect()})
        assert k == 4 or at.columns == docs.columns
    clean = set(range(40))
    assert clean <= seen[0] and not {200 + i for i in range(30)} & seen[0] and 102 not in seen[0]
    assert clean <= seen[1] and None not in seen[1]
    assert clean <= seen[2] and 100 in seen[2] and 101 not in seen[2]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count() > 0

"""Every stage of the pipeline on rows and columns that are out of the ordinary."""

import corpus_pipeline as P
import pytest

CLASHING = ["__plan", "__key", "__h", "__copies", "__copy", "key", "h", "plan", "copy", "_key", "node", "root", "entry", "fp", "full", "score", "size", "set", "row", "place", "copies", "ids_", "clash"]
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long_ = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))
    odd = [(9001, None, "en", "src0", None), (9002, "", None, None, 0), (9003, "   ", "de", "src0", 3), (9004, long_, "en", "src1", len(long_)), (9005, long_, "en", "src1", len(long_)), (None, "a b c d e f", None, None, 11), (None, None, None, None, None)]
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in given] + odd + odd[:1] + [given[0], given[0]]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("k", range(5))
def test_stage(spark, docs, k):
    name, stage = P.STAGES[k]
    more = docs.selectExpr("*", *(f"concat('{c}', coalesce(string(doc_id), '')) AS `{c}`" for c in CLASHING))
    plain, wide = stage(spark, docs, FOLDER), stage(spark, more, FOLDER)
    last = k == len(P.STAGES) - 1
    assert last or wide.columns == more.columns
    got, rows = wide.collect(), plain.collect()
    assert got and all(r[c] == f"{c}{'' if r.doc_id is None else r.doc_id}" for r in got for c in CLASHING), name
    order = lambda found: sorted((repr(tuple(r[c] for c in docs.columns)) for r in found))
    assert order(got) == order(rows), name
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert stage(spark, docs.limit(0), FOLDER).count() == 0
    if name == "SimHash near-dedup":
        kept = [r.doc_id for r in rows]
        assert (9004 in kept) and 9005 not in kept and kept.count(9001) <= 1
    if name in ("PII surrogates", "BPE tokens"):
        assert len(rows) == docs.count()

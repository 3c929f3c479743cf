import corpus_pipeline as P
from plumbline.llm import bpe, mixing, quality_classifier, simhash, surrogates
from plumbline.llm.queries import QUERIES, SURROGATE_KEY, tokenizer_path


def test_stages_and_run(spark):
    folder = "/root/testdata/sf0.001"
    assert [name for name, _ in P.STAGES] == ["quality classifier", "SimHash near-dedup", "PII surrogates", "source mixing", "BPE tokens"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality_classifier.score_quality(docs, quality_classifier.train(docs, labels)).collect()}
    kept = docs.filter(docs.doc_id.isin([i for i, s in scores.items() if s >= 0.3])).collect()
    kept = spark.createDataFrame(kept, docs.schema)
    least = {r.doc_id: r.component_id for r in simhash.similar_copies(kept, 5, 0.8).collect()}
    kept = spark.createDataFrame([r for r in kept.collect() if least[r.doc_id] == r.doc_id], docs.schema)
    use = surrogates.surrogates(SURROGATE_KEY)
    rows = [(r.doc_id, use.replace(r.text)[0], r.lang, r.source) for r in kept.collect()]
    private = spark.createDataFrame([(*r, len(r[1])) for r in rows], docs.schema)
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(private).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode(private, tokenizer_path("byte_bpe_50k.json")).collect()}
    expected = sorted((i, t, lang, source, len(t), len(ids[i]), ids[i]) for i, t, lang, source in rows for _ in range(copies[i]))
    got = sorted(tuple(r) for r in P.run(spark, folder).collect())
    assert got == expected and len(got) > 50
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]

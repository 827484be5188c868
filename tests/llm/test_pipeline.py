"""The pipeline's stages against plain Python versions, each on the input it gets."""

import brute
import corpus_pipeline
from conftest import FOLDER, pairs

import __spark_entry__ as contract
from trialweave.llm import exchange, pieces, pii, queries


def test_stages(spark):
    folder = FOLDER.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        kept.append(exchange.stored(stage(spark, docs, folder), "stage")[0])
        docs = kept[-1]
    good, single, clean, private, ids = kept
    assert all(d.columns == good.columns for d in (single, clean, private))
    smallest = {c for _, _, c in brute.ngram_join(pairs(good))}
    assert {r.doc_id for r in single.collect()} == smallest
    items = [" ".join(brute.words(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for _, t in pairs(clean):
        assert not any(f" {i} " in f" {' '.join(brute.words(t))} " for i in items)
    was = dict(pairs(clean))
    for d, t in pairs(private):
        assert t == pii.redacted(was[d], sum(pii.spans_of(was[d]), []))
    back = pieces.decode(ids, queries.vocabulary_path())
    assert dict(pairs(back)) == dict(pairs(private))


def test_stages_on_hard_rows(spark, hard):
    """Nulls, empty and long texts, ties, repeated rows and clashing names: each stage keeps the columns and its right rows."""
    folder = FOLDER.replace("0.001", "0.01")
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        docs = hard.withColumn("n_chars", exchange.F.length("text").cast("long"))
        out, _ = exchange.stored(stage(spark, docs, folder), "stage")
        if name != names[-1]:
            assert out.columns == docs.columns
        else:
            assert set(out.columns) == set(docs.columns) - {"text"} | {"ids"} and out.count() == docs.count()
        if name == "n-gram Jaccard join":
            assert {r.doc_id for r in out.collect()} == {c for _, _, c in brute.ngram_join(pairs(docs))}


def test_stages_on_an_empty_table(spark, nothing):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, FOLDER).count() == 0


def test_registered():
    assert "pipeline" in contract.queries() and {f"op{n}_" for n in range(1, 14)} <= {
        q.split("_")[0] + "_" for q in contract.queries()
    }


def test_stages_ask_for_small_batches(spark, documents):
    """No stage takes batches of Spark's default size into its Python workers; a smaller limit stays."""
    before = spark.conf.get(exchange.BATCH)

    def sizes(batches):
        for b in batches:
            yield exchange.pa.RecordBatch.from_arrays([exchange.pa.array([b.nbytes])], ["bytes"])

    long = documents.select("text").limit(20).select(exchange.F.repeat("text", 2000).alias("text")).repartition(1)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(exchange.BATCH)
            stage(spark, documents.limit(5), FOLDER)
            got = [r.bytes for r in long.union(long).repartition(1).mapInArrow(sizes, "bytes long").collect()]
            longest = max(len(r.text.encode()) for r in long.collect())
            assert max(got) <= exchange.BATCH_BYTES + 2 * longest and sum(got) > 3 * exchange.BATCH_BYTES
        spark.conf.set(exchange.BATCH, "1m")
        corpus_pipeline.personal_data(spark, documents, FOLDER)
        assert spark.conf.get(exchange.BATCH) == "1m"
    finally:
        spark.conf.set(exchange.BATCH, before)

"""The pipeline's stages against their definitions, each on its own input."""

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brambleq.llm._common import BATCH_BYTES, bound_batches, materialise, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = materialise(stage(spark, docs, SF))
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after and after <= before
        if k < 4:
            assert docs.columns == columns
        if k == 1:
            assert after == before
    assert docs.where("text <> decoded").count() == 0
    assert corpus_pipeline.run(spark, SF).select(*docs.columns).exceptAll(docs).count() == 0


def test_stages_on_odd_rows(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", None, 0, 2), (2, None, "en", "s", None, 3), (3, "the cat sat on the mat", "en", "s", 22, 4), (3, "the cat sat on the mat", "en", "s", 22, 4)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __fp int")
    for _, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs.drop("__fp"), SF)
            assert out.count() <= docs.count()


BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbounded(spark):
    """The session with Spark's own bound on Arrow batches, before and after."""
    spark.conf.unset(BYTES)
    yield spark
    spark.conf.unset(BYTES)


@pytest.mark.parametrize("k", [0, 2, 3, 4])
def test_stages_bound_what_goes_to_python_at_once(unbounded, k):
    spark = unbounded
    long = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 300).alias("text"), F.lit("en").alias("lang"))
    out = corpus_pipeline.STAGES[k][1](spark, long.limit(5), SF)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    got = long.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 3000
    assert max(r["size"] for r in got) < BATCH_BYTES + 8000
    assert out.count() <= 5


def test_a_lower_bound_stays_and_results_do_not_depend_on_it(unbounded):
    spark = unbounded
    docs = materialise(table(spark, SF, "documents"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        spark.conf.unset(BYTES)
        whole = materialise(stage(spark, docs, SF))
        spark.conf.set(BYTES, "3k")
        small = materialise(stage(spark, docs, SF))
        assert spark.conf.get(BYTES) == "3k"
        assert whole.count() == small.count(), k
        assert whole.exceptAll(small).count() == 0, k
        docs = whole
    spark.conf.unset(BYTES)
    bound_batches(spark)
    assert spark.conf.get(BYTES) == str(BATCH_BYTES)

"""What the pipeline's stages leave in executors beside their rows."""

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tracewright.llm import exact_dedup, packing, simhash
from tracewright.llm.common import TEXT_BATCHES, settings

UNLOADS = "spark.sql.streaming.stateStore.unloadOnCommit"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_exact_dedup_starts_no_python_workers_and_unloads_its_state(spark, make_docs, monkeypatch):
    docs = make_docs([(i, prose(i % 7, 20)) for i in range(30)])
    held = []

    def no_rows_of_the_driver(*_, **__):
        raise AssertionError("rows of the driver pass through Python workers")

    def feed(*args, plain=exact_dedup.keyed_state):
        held.append(spark.conf.get(UNLOADS))
        return plain(*args)

    monkeypatch.setattr(type(spark), "createDataFrame", no_rows_of_the_driver)
    monkeypatch.setattr(exact_dedup, "keyed_state", feed)
    assert exact_dedup.find_duplicates(docs).where("kept").count() == 7
    assert held[-1] == "true" and spark.conf.get(UNLOADS) == "false"


@pytest.mark.parametrize("module", [packing, simhash])
def test_texts_go_to_python_in_small_batches(spark, make_docs, monkeypatch, module):
    docs = make_docs([(i, prose(i % 7, 60)) for i in range(30)])
    held = {}

    def written(df, name, *args, plain=module.materialize, **named):
        held[name] = spark.conf.get(BATCH_BYTES)
        return plain(df, name, *args, **named)

    monkeypatch.setattr(module, "materialize", written)
    before = spark.conf.get(BATCH_BYTES)
    rows = packing.pack_documents(docs) if module is packing else simhash.near_duplicates(docs)
    assert rows.count() >= 30
    assert held["pieces" if module is packing else "fingerprints"] == TEXT_BATCHES[BATCH_BYTES] and spark.conf.get(BATCH_BYTES) == before


def test_a_small_batch_is_bounded_by_bytes(spark):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([len(batch)])], names=["bytes", "rows"])

    texts = spark.range(0, 900, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    with settings(spark, TEXT_BATCHES):
        found = texts.mapInArrow(sizes, "bytes long, rows long").collect()
    assert sum(r.rows for r in found) == 900 and max(r.bytes for r in found) < 2 * int(TEXT_BATCHES[BATCH_BYTES])


def test_settings_come_back_after_a_failure(spark):
    name = "spark.sql.test.of.settings"
    with pytest.raises(ValueError), settings(spark, {name: "1"}):
        raise ValueError
    assert spark.conf.get(name, None) is None

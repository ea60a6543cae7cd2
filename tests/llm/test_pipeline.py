"""The corpus pipeline: what each stage decides takes effect."""

import corpus_pipeline
from test_decontaminate import brute as contaminated
from test_jaccard import brute as classes

from lorewell.llm import common, jaccard, mixing

SMALL = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, SMALL)
    assert kept.columns == columns and 0.7 * docs.count() < kept.count() <= docs.count()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    one = stages["near_duplicates"](spark, kept, SMALL)
    assert one.columns == columns
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, c, _ in classes(rows)})
    clean = stages["decontamination"](spark, one, SMALL)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = {d for d, x in contaminated([(r.doc_id, r.text) for r in one.collect()], items).items() if x[4]}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - bad
    plain = stages["pii"](spark, clean, SMALL)
    assert plain.columns == columns and plain.count() == clean.count()
    assert all("@" not in r.text and r.n_chars == len(r.text) for r in plain.collect() if r.text)


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0 and {"doc_id", "text", "mix_key"} <= set(out.columns)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None


def test_few_tasks_around_small_tables(spark):
    """Links, classes and blocks are few rows: shuffles between them, not their number of partitions, are what the driver would hold."""
    base = [f"w{k}" for k in range(60)]
    rows = [(k, "s", " ".join([*base[:59], f"own{k}"] if k < 30 else [f"v{k * 60 + i}" for i in range(60)])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(2)
    wide = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in wide}
    context = spark.sparkContext
    tasks = {}
    try:
        for k, v in wide.items():
            spark.conf.set(k, v)
        for name, stage in (("near", jaccard.deduplicate), ("mix", mixing.mix)):
            context.setJobGroup(name, name)
            assert stage(docs).count() == {"near": 31, "mix": 60}[name]
            told = context.statusTracker()
            stages = {s for job in told.getJobIdsForGroup(name) for s in told.getJobInfo(job).stageIds}
            tasks[name] = sum(info.numTasks for s in stages if (info := told.getStageInfo(s)) and info.numCompletedTasks)
            common.release()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert tasks["near"] < 1000 and tasks["mix"] < 500, tasks

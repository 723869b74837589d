"""The pipeline: every stage against its rule on its own input, and the whole on small tables."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from normtrace.llm import near_copies, queries

SF = "/root/testdata/sf0.01"


def test_stages_keep_what_they_should(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["toxicity", "language", "near_duplicates", "best_fit_packing"]
    kept = [docs]
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
        assert kept[-1].columns == columns
    labels = queries.table(spark, SF, "labels")
    label = {r.doc_id: r.toxic for r in labels.collect()}
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    gone = ids[0] - ids[1]
    toxic = {i for i, t in label.items() if t}
    assert toxic <= gone
    assert sum(label.get(i) == 0 for i in gone) <= 0.01 * len(label)
    letters = {r.doc_id for r in kept[1].collect() if r.text and any(map(str.isalpha, r.text))}
    assert ids[2] <= letters and len(letters - ids[2]) <= 0.01 * len(letters)
    groups = {}
    for r in near_copies.near_groups(kept[2]).collect():
        groups.setdefault(r.group_id, set()).add(r.doc_id)
    assert ids[3] == {min(g) for g in groups.values()} and kept[3].count() == len(ids[3])


def test_run(spark):
    rows = pipeline.run(spark, SF).collect()
    docs = queries.table(spark, SF, "documents").count()
    pieces = {(r.doc_id, r.piece) for r in rows}
    assert len(pieces) == len(rows) and 0.5 * docs < len({r.doc_id for r in rows}) < docs
    used = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.03 * used / 2048 + 1


def test_odd_documents(spark, odd_docs, no_docs):
    odd = odd_docs.withColumn("lang", F.when(F.col("doc_id") > 4, "en"))
    for docs in (odd, no_docs):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= docs.count() or name == "best_fit_packing"
    lettered = [r for r in odd.collect() if r.text and any(map(str.isalpha, r.text))]
    stages = dict(pipeline.STAGES)
    assert stages["toxicity"](spark, odd, SF).count() == odd.count()
    assert stages["language"](spark, odd, SF).count() == len(lettered)
    assert stages["near_duplicates"](spark, odd, SF).count() == len({(r.text or "").strip() for r in odd.collect()})

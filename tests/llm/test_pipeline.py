"""The pipeline's stages in order, and what each decides."""

import corpus_pipeline
from symloom.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    clean = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    item = " ".join(f"bench{j}" for j in range(20))
    rows = [(i, clean(i), "en", f"s{i % 2}", 0) for i in range(60)]
    rows += [(100 + i, clean(i), "en", "s0", 0) for i in range(5)]
    rows += [(200, f"{clean(200)} {item}", "en", "s1", 0), (201, f"{clean(201)} token=abcd1234efgh5678", "en", "s1", 0)]
    rows += [(300 + i, "!!! $$$ " * 50 + f"JUNK{i}", "en", "s1", 0) for i in range(30)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 300), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.dtypes, []
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, folder)
        docs.write.parquet(f"{folder}/{len(seen)}.parquet")
        docs = spark.read.parquet(f"{folder}/{len(seen)}.parquet")
        seen.append(docs)
        if len(seen) < 5:
            assert docs.dtypes == columns, name
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert ids[0] == {r[0] for r in rows if r[0] < 300}
    assert ids[1] == ids[0] - set(range(100, 105))
    assert ids[2] == ids[1] - {200} and ids[3] == ids[2] == ids[4]
    assert seen[3].where("doc_id = 201").first().text.endswith("token=[SECRET]")
    assert corpus_pipeline.run(spark, folder).count() == len(ids[4])


def test_one_query_for_each_operator():
    names = queries.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10


def test_stages_send_small_batches(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 10000)
    try:
        docs = spark.range(5000).selectExpr("id AS doc_id", "concat('w', id) AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars").coalesce(1)
        docs.limit(0).selectExpr("doc_id AS item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
        corpus_pipeline.STAGES[2][1](spark, docs, str(tmp_path))

        def rows(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

        sizes = [r.n for r in docs.mapInArrow(rows, "n long").collect()]
        assert sum(sizes) == 5000 and max(sizes) <= 1024
        spark.conf.set(key, 100)
        corpus_pipeline.STAGES[2][1](spark, docs, str(tmp_path))
        assert spark.conf.get(key) == "100"
    finally:
        spark.conf.unset(key)

import datetime as dt

from pyspark.sql import functions as F

from evigraph.operators import code as K
from evigraph.sources import transfer as T
from evigraph.sources.snapshot import change_snapshot, read_snapshot, upsert
from evigraph.streaming import jobs as J


def put(spark, rows, schema, path, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{n}")


def stream(spark, schema, path):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def test_intake_over_two_runs(spark, tmp_path):
    schema = "document_id string, text string, created_at int"
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    put(spark, [("a", "same text", 1), ("b", "same text", 2), ("c", "other " * 400, 1)], schema, src, 1)
    J.run_batches(stream(spark, schema, src), J.intake_batch(store), str(tmp_path / "cp"))
    put(spark, [("d", "same text", 3), ("e", "fresh", 3)], schema, src, 2)
    J.run_batches(stream(spark, schema, src), J.intake_batch(store), str(tmp_path / "cp"))
    docs = {r.document_id for r in spark.read.parquet(f"{store}/documents").collect()}
    assert docs == {"a", "c", "e"}
    assert {r.document_id for r in spark.read.parquet(f"{store}/chunks").collect()} == docs


def test_idempotent_stream(spark, tmp_path):
    schema = "project_id string, operation string, key string, ts timestamp, n int"
    t0, src = dt.datetime(2024, 1, 1), str(tmp_path / "in")
    put(spark, [("p", "create", "k", t0, 1), ("p", "create", "k2", t0, 2), ("p", "delete", "k", t0, 3)], schema, src, 1)
    J.run_available(J.idempotent_stream(stream(spark, schema, src)), str(tmp_path / "out"), str(tmp_path / "cp"), "append")
    put(spark, [("p", "create", "k", t0 + dt.timedelta(hours=2), 4), ("p", "create", "k3", t0 + dt.timedelta(hours=3), 5)], schema, src, 2)
    J.run_available(J.idempotent_stream(stream(spark, schema, src)), str(tmp_path / "out"), str(tmp_path / "cp"), "append")
    assert {r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 2, 3, 5}


def test_stuck_stream_timer(spark, tmp_path):
    schema = "job_id string, stage string, ts timestamp, event_id long"
    t0, src = dt.datetime(2024, 1, 1), str(tmp_path / "in")
    at = lambda m: t0 + dt.timedelta(minutes=m)
    # out of order inside the batch; two events of one time, of which the later id decides
    put(spark, [("j1", "reading", at(20), 2), ("j1", "queued", at(0), 1), ("j2", "complete", at(0), 4), ("j2", "queued", at(0), 3), ("j4", "queued", at(5), 6), ("j4", "failed", at(5), 5)], schema, src, 1)
    put(spark, [("j3", "queued", at(60), 7)], schema, src, 2)
    put(spark, [("j3", "complete", at(61), 8), ("j5", "queued", at(300), 9)], schema, src, 3)
    J.run_available(J.stuck_stream(stream(spark, schema, src)), str(tmp_path / "out"), str(tmp_path / "cp"), "append")
    got = {(r.job_id, r.stage, r.since, r.condition) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("j1", "queued", at(0), "late update"), ("j1", "reading", at(20), "no update"), ("j4", "queued", at(5), "no update")}


def test_file_sync_drops_removed_symbols(spark, tmp_path):
    schema = "file_path string, code string, changed_at int"
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    put(spark, [("m.py", "def one():\n  pass\ndef two():\n  pass\n", 1), ("n.go", "func keep() {\n}\n", 1)], schema, src, 1)
    J.run_batches(stream(spark, schema, src), J.sync_batch(store), str(tmp_path / "cp"))
    put(spark, [("m.py", "def two():\n  pass\n", 2)], schema, src, 2)
    J.run_batches(stream(spark, schema, src), J.sync_batch(store), str(tmp_path / "cp"))
    rows = read_snapshot(spark, store, K.symbols(spark.createDataFrame([], "file_path string, code string")).schema).filter("kind <> 'file'").collect()
    assert {(r.file_path, r.name) for r in rows} == {("m.py", "two"), ("n.go", "keep")}


def test_code_calls_belong_to_enclosing_symbol(spark):
    code = "import os\nclass A(B):\n    def run(self):\n        return helper(1)\n\ndef helper(x):\n    return x\n"
    files = spark.createDataFrame([("a/b.py", code)], "file_path string, code string")
    found = {(r.kind, r.target_name, r.line_number) for r in K.text_relations(files).collect()}
    assert found == {("imports", "os", 1), ("inherits", "B", 2), ("calls", "helper", 4)}
    _, edges = K.code_graph(files)
    assert {r.relation_type for r in edges.collect()} == {"contains", "calls"}


def test_plugins_and_dataset_io(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "hello Bob"), ("c2", "nothing")], "chunk_id string, text string")
    found = T.apply_extractor(chunks, lambda t: ([{"name": w, "type": "Name", "confidence": 1.0} for w in t.split() if w[0].isupper()], []))
    assert {r.chunk_id: [e.name for e in r.entities] for r in found.collect()} == {"c1": ["Bob"], "c2": []}
    ctx = chunks.withColumn("context", F.array(F.lit("before")))
    assert T.apply_context_extractor(ctx, lambda t, c: ([{"name": c[0], "type": "T", "confidence": 0.5}], [])).count() == 2
    files = spark.createDataFrame([("f", bytearray(b"a|b"))], "path string, content binary")
    assert [r.text for r in T.apply_parser(files, lambda b: [{"text": x, "k": 1} for x in b.decode().split("|")]).collect()] == ["a", "b"]
    docs = spark.createDataFrame([("d", "ab")], "document_id string, text string")
    assert [r.text for r in T.apply_chunker(docs, lambda i, t: list(t)).collect()] == ["a", "b"]
    path = str(tmp_path / "ds")
    T.write_dataset(spark.createDataFrame([("p", "d1", 1), ("p", "d2", 2), ("q", "d1", 3)], "project_id string, dataset_id string, v int"), path)
    T.write_dataset(spark.createDataFrame([("p", "d1", 9)], "project_id string, dataset_id string, v int"), path, "overwrite")
    assert {r.v for r in T.read_dataset(spark, path, "p").collect()} == {9, 2}
    assert {r.v for r in T.read_dataset(spark, path, "q", "d1").collect()} == {3}


def test_snapshot_rewrites_touched_buckets_only(spark, tmp_path):
    store, schema = str(tmp_path / "store"), spark.createDataFrame([], "k long, v string").schema
    put_rows = lambda version, rows: change_snapshot(store, version, rows, ["k"], schema, lambda old, new: upsert(old, new, ["k"]), 8)
    put_rows(1, spark.range(1000).selectExpr("id AS k", "'old' AS v"))
    change = spark.createDataFrame([(7, "new")], schema)
    put_rows(2, change)
    put_rows(2, change)  # a repeated batch
    rows = {r["k"]: r["v"] for r in read_snapshot(spark, store, schema).collect()}
    assert len(rows) == 1000 and rows[7] == "new" and sum(v == "new" for v in rows.values()) == 1
    assert len([p for p in (tmp_path / "store" / "rows" / "v2").iterdir() if p.name.startswith("bucket=")]) == 1
    assert read_snapshot(spark, str(tmp_path / "none"), schema).count() == 0

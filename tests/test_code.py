"""Whole symbols and whole files in chunks of source code."""

from evigraph.operators import code as K


def test_long_symbols_and_files_stay_whole(spark):
    body = [f"        x{k} = {k}" for k in range(60)]
    inner = ["class Big:", "    def long(self):", *body, "    def next(self):", "        pass"]
    python = "\n".join(["import os", *inner, *[""] * 30, "def after():", "    return 1"])
    script = "\n".join(["function f(", "  a", ") {", *[f"  g({k})" for k in range(50)], "}", "function h() {", "}"])
    plain = "".join(f"value_{k} = {k}\n" for k in range(400))
    rows = [("a/big.py", python), ("a/f.js", script), ("a/plain.py", plain), ("a/small.py", " x = 1\n"), ("a/empty.py", ""), ("a/null.py", None)]
    files = spark.createDataFrame(rows, "file_path string, code string")
    ends = {r["name"]: (r["start_line"], r["end_line"]) for r in K.symbols(files).collect()}
    n, m = len(python.split("\n")), len(script.split("\n"))
    assert ends == {"Big": (2, n - 2), "long": (3, 63), "next": (64, n - 2), "after": (n - 1, n), "f": (1, m - 2), "h": (m - 1, m)}

    chunks = K.symbol_chunks(files).orderBy("file_path", "chunk_index").collect()
    by_name = {r["symbol_name"]: r for r in chunks}
    assert by_name["long"]["text"].split("\n") == ["    def long(self):", *body] and "  g(49)\n}" in by_name["f"]["text"]
    pieces = [r for r in chunks if r["file_path"] == "a/plain.py"]
    assert len(pieces) > 3 and {line for r in pieces for line in r["text"].split("\n")} >= set(plain.split("\n")) - {""}
    lines = plain.split("\n")
    for r in pieces:
        assert r["text"].split("\n")[1:-1] == lines[r["start_line"]:r["end_line"] - 1]
    assert [r["chunk_index"] for r in pieces] == list(range(len(pieces)))
    assert by_name["small.py"]["text"] == " x = 1\n" and by_name["empty.py"]["text"] == ""

    cut = {r["symbol_name"]: r for r in K.symbol_chunks(files, max_lines=20, max_chars=K.CHUNK_CHARS).collect()}
    assert cut["long"]["end_line"] == 23 and cut["plain.py"]["text"] == plain[:1200]


def test_short_symbols_end_before_the_next(spark):
    code = "def a():\n    pass\n\ndef b(): pass\nclass C:\n    def c(self):\n        def d():\n            e()\n        f()\n    x = g()\nh()\n"
    files = spark.createDataFrame([("s.py", code)], "file_path string, code string")
    got = {r["name"]: (r["start_line"], r["end_line"]) for r in K.symbols(files).collect()}
    assert got == {"a": (1, 3), "b": (4, 4), "C": (5, 11), "c": (6, 11), "d": (7, 11)}
    names = {r["id"]: r["name"] for r in K.symbols(files).collect()}
    calls = {(r["target_name"], names[r["source_id"]]) for r in K.text_relations(files).where("kind = 'calls'").collect()}
    assert calls == {("e", "d"), ("f", "c"), ("g", "C")}


def test_symbols_are_joined_without_a_broadcast(spark, tmp_path):
    from evigraph.plans import catalog

    # The files on disk are far smaller than the texts that the query derives from them.
    spark.range(50).selectExpr("id AS p_partkey", "CAST(id % 3 AS INT) AS p_size", "'ECONOMY' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    for name in ("cg3_text_relations", "cg5_j10_code_relations", "cg6_ag15_ingest_totals"):
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan, name

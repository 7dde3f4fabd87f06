import json
import random
import re
import unicodedata

from pyspark.sql import functions as F

from evigraph.functions import scalars as X
from evigraph.operators import chunking as C
from evigraph.operators import construction as B
from evigraph.operators import extraction as E
from evigraph.plans import build
from evigraph.sources import corpus as S
from evigraph.sources import html as H


def test_find_evidence_keeps_source_quote(spark):
    cases = [
        ("Acme  Corp builds", "Acme Corp", 0, "Acme  Corp"),
        ("an inter-\nnational firm", "international", 3, "inter-\nnational"),
        ("the ﬁnal word", "final", 4, "ﬁnal"),
        ("co\xadoperate now", "cooperate", 0, "co\xadoperate"),
        ("exact hit", "hit", 6, "hit"),
        ("Acme Corp", "Acme Corporation", None, None),
    ]
    df = spark.createDataFrame([(a, b) for a, b, *_ in cases], "text string, mention string")
    got = [(r.s.start, r.s.quote) if r.s else (None, None) for r in df.select(B.find_evidence(F.col("text"), F.col("mention")).alias("s")).collect()]
    assert got == [(c[2], c[3]) for c in cases]


def test_normalize_name_unicode(spark):
    words = ["  ＡＣＭＥ   Straße ", "Éclair\tX", "plain Name", "ﬁn"]
    df = spark.createDataFrame([(w,) for w in words], "v string")
    got = [r[0] for r in df.select(X.normalize_name(F.col("v"))).collect()]
    assert got == [" ".join(unicodedata.normalize("NFKC", w).casefold().split()) for w in words]


def _spans(text, size, overlap):
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            cut = max(text[start:end].rfind(c) for c in "\n ") + start
            if cut > start + size // 2:
                end = cut + 1
        out.append((start, end))
        if end == len(text):
            return out
        start = max(start + 1, end - overlap)
    return out


def test_chunks_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["", "x", "a" * 5000]
    for n in (10, 1199, 1200, 1201, 3000, 9000, 40000):
        texts.append("".join(rng.choice(["ab", "é", " ", "\n", ". ", "\n\n", "wörter"]) for _ in range(n))[:n])
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: [(s.start_char, s.end_char, s.text) for s in r.s] for r in df.select("i", C.chunk_pieces(F.col("text")).alias("s")).collect()}
    want = {}
    for i, t in enumerate(texts):
        kept = [(a + len(t[a:b]) - len(t[a:b].lstrip()), t[a:b].strip()) for a, b in _spans(t, 1200, 200)]
        want[i] = [(a, a + len(v), v) for a, v in kept if v]
    assert got == want


def test_page_segment_stays_whole(spark):
    df = spark.createDataFrame([("d", " one page ", 3), ("e", "word " * 400, 4), ("f", " tail ", None)], "d string, text string, page int")
    rows = C.split_segments(df, ["d"]).orderBy("d", "segment_part").collect()
    assert (rows[0].text, rows[0].start_char, rows[0].end_char, rows[0].segment_count) == ("one page", 1, 9, 1)
    assert [r.d for r in rows].count("e") == 2
    assert all(("word " * 400)[r.start_char:r.end_char] == r.text for r in rows if r.d == "e")


def test_heuristic_entities_against_python(spark):
    phrase = re.compile(E.PHRASE.replace("(?U)", ""))
    texts = [
        "Meet Anna Berg and Carl Émile Dufour at Big Data Forum. mail x.y@site.org or X.Y@site.org. We like python and Docker.",
        "No names here.",
        " ".join(f"Word{chr(65 + i)} Part{chr(65 + i)}," for i in range(26)) * 2,
        "Typed Thing [Company] and Other Name",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got, unstopped = {}, {}
    for r in E.heuristic_entities(docs, ["i"], phrase_stop=24).collect():
        got.setdefault(r.i, set()).add((r.norm_name, r.type))
    for r in E.heuristic_entities(docs, ["i"]).collect():
        unstopped.setdefault(r.i, set()).add((r.norm_name, r.type))
    assert 3 not in got
    for i, text in enumerate(texts[:3]):
        base = {(m.lower(), "Contact") for m in re.findall(r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", text)}
        base |= {(m.lower(), "Skill") for m in re.findall(E.SKILL.replace("(?iU)", "(?i)"), text)}
        names = [" ".join(m.group(0).split()).casefold() for m in phrase.finditer(text)]
        ordered = list(dict.fromkeys(n for n in names if 4 <= len(n) <= 80))
        assert got.get(i, set()) == base | {(n, "Entity") for n in ordered[: max(1, 24 - len(base))]}
        assert unstopped.get(i, set()) == base | {(n, "Entity") for n in ordered}


def test_redact_nested_json(spark):
    doc = {"a": [{"Api-Key": "x", "note": "password=abc ok"}], "pattern": "password=abc", "n": 3}
    df = spark.createDataFrame([(json.dumps(doc),)], "d string")
    got = json.loads(df.select(X.redact_json("d")).first()[0])
    assert got == {"a": [{"Api-Key": "[REDACTED]", "note": "password=[REDACTED] ok"}], "pattern": "password=abc", "n": 3}


def test_json_validity_of_whole_text(spark):
    good, bad = ['{"a": 1}', "[1, 2]", "3", ' "x" '], ['{"a": 1} x', "1, 2", "][", "1][2", "", "NaN", '{"a": NaN}', "[1,", '1,2],[']
    df = spark.createDataFrame([(v,) for v in good + bad], "v string")
    assert [r[0] for r in df.select(S.json_valid(F.col("v"))).collect()] == [True] * len(good) + [False] * len(bad)


def test_csv_quotes_and_blank_records(spark):
    text = '﻿name,note\r\n"A ""B""","x,\ny"\r\n , \r\nshort\r\n'
    rows = S.csv_records(spark.createDataFrame([("d", text)], "document_id string, text string")).orderBy("record_number").collect()
    assert [(r.record_number, r["values"], r.text) for r in rows] == [
        (1, {"name": 'A "B"', "note": "x,\ny"}, 'name: A "B"; note: x,\ny'), (2, {"name": "short"}, "name: short")]


def test_html_sections(spark):
    html = "<body><h1>A</h1><p>one<p>two<h3>C</h3><ul><li>x</li></ul><h2>B</h2><pre>a\n b</pre><table><tr><td>q</td><td>r</td></tr></table>tail</body>"
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    rows = S.section_paths(H.html_blocks(df)).orderBy("position").collect()
    assert [(r.block_type, r.text, r.section_path) for r in rows] == [
        ("paragraph", "one", ["A"]), ("paragraph", "two", ["A"]), ("list", "x", ["A", "C"]),
        ("code", "a\nb", ["A", "B"]), ("table", "q\nr", ["A", "B"])]


def test_admission_reasons(spark):
    cases = [
        ("a.txt", "text/plain", b"hi", None), ("", "text/plain", b"hi", "invalid filename or extension"), ("../a.txt", "text/plain", b"hi", "invalid filename or extension"),
        ("a.exe", "text/plain", b"hi", "invalid filename or extension"), ("a.txt", "text/plain", b"", "empty file"), ("a.txt", "text/plain", b"\xff\xfe", "not UTF-8"),
        ("a.txt", "text/plain", b"a\x00b", "binary data"), ("a.pdf", "application/pdf", b"%PDF-1.7", None), ("a.pdf", "application/pdf", b"PDF", "invalid PDF signature"),
        ("a.html", "text/html", b" <HTML>", None), ("a.html", "text/html", b"hello", "invalid HTML content"), ("a.json", "application/json", b"{", "invalid JSON content"),
        ("a" * 260 + ".txt", "text/plain", b"hi", "filename exceeds 255 characters"), ("a.csv", "text/html", b"x", "MIME type does not match extension")]
    df = spark.createDataFrame([c[:3] for c in cases], "f string, m string, c binary")
    assert [r[0] for r in df.select(S.reject_reason(F.col("f"), F.col("m"), F.col("c"))).collect()] == [c[3] for c in cases]


def test_redact_json_bad_rows_and_lists(spark):
    rows = ['["password=abc", [1, "x secret: y"], {"deep": {"token": 5, "l": ["pwd=1"]}}]', "not json", None, '"pwd=q"']
    got = [r.o for r in spark.createDataFrame([(i, d) for i, d in enumerate(rows)], "i int, d string").orderBy("i").select(X.redact_json("d").alias("o")).collect()]
    assert json.loads(got[0]) == ["password=[REDACTED]", [1, "x secret: [REDACTED]"], {"deep": {"token": "[REDACTED]", "l": ["pwd=[REDACTED]"]}}]
    assert got[1] is None and got[2] is None and json.loads(got[3]) == "pwd=[REDACTED]"


def test_long_quoted_csv_cells(spark):
    cell = 'a ""quoted"" word, ' * 60_000
    wide = ",".join(f'"c{i}"' for i in range(5000))
    docs = spark.createDataFrame([("d", f'x,y\n"{cell}",2\n'), ("w", f"{wide}\n{wide}\n"), ("s", '"a,x,y";b\n1;2')], "document_id string, text string")
    got = {(r.document_id, r.record_number): r for r in S.csv_records(docs).collect()}
    assert got["d", 1]["values"]["x"] == cell.replace('""', '"').strip() and got["d", 1]["values"]["y"] == "2"
    assert len(got["w", 1]["columns"]) == 5000 and got["s", 1]["values"] == {"a,x,y": "1", "b": "2"}


def test_json_with_a_tail_is_refused(spark):
    docs = spark.createDataFrame([("a", '{"b":1,"a":2} garbage'), ("b", '{"b":1}')], "document_id string, text string")
    assert [r.document_id for r in S.json_records(docs).collect()] == ["b"]


def test_grammar_endpoints_are_stripped(spark):
    docs = spark.createDataFrame([(1, "\tAlice -> KNOWS -> Bob\t\r\n")], "i int, text string")
    assert [(r.source, r.target) for r in E.grammar_relations(docs, ["i"]).collect()] == [("Alice", "Bob")]


def test_python_sees_texts_in_small_batches(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from evigraph.session import cut_in_small_batches

    @F.pandas_udf("int")
    def batch_rows(ids: pd.Series) -> pd.Series:
        return pd.Series([len(ids)] * len(ids))

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = cut_in_small_batches(spark.range(0, 4000, 1, 1).select(batch_rows("id").alias("n")))
    assert rows.agg(F.max("n")).first()[0] <= 500 and rows.count() == 4000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_spoken_answers_are_dealt_out(spark, monkeypatch):
    # The customer file is one split, which one task would parse.
    monkeypatch.setattr(build, "ANSWERS_PER_TASK", 10)
    texts = build.told(spark, "/root/testdata/sf0.001", build.SPOKEN)
    sizes = texts.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 15 and max(r["count"] for r in sizes) <= 11

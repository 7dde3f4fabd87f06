"""HTML blocks, malformed CSV and nested secrets."""

from pyspark.sql import functions as F

from evigraph.operators import memory as Mm
from evigraph.operators.secrets import json_leaves, secrets_in
from evigraph.sources import corpus as S
from evigraph.sources import html as H


def blocks(page):
    return [(tag, " ".join(raw.split())) for tag, raw in H.page_blocks(page)]


def test_only_outermost_blocks_count():
    assert blocks("<ul><li>one<p>two</p> tail<ul><li>a<li>b</ul> end</li><li>c</ul>out<p>d") == [("li", "one two tail a b end"), ("li", "c"), ("p", "d")]
    assert blocks("<table><tr><td><p>x</p><table><tr><td>y</table></td></tr></table><p>z") == [("table", "x y"), ("p", "z")]


def test_open_elements_end_where_html_ends_them():
    assert blocks("<p>a <b>b<p>c<div>out</div><h2>h<p>d</div>e") == [("p", "a b"), ("p", "c"), ("h2", "h"), ("p", "d e")]
    assert blocks("<div><li>x</div>y<p>1 < 2 <br>3") == [("li", "x"), ("p", "1 < 2 3")]
    assert blocks("</p></li><p>cut <a hre") == [("p", "cut")]


def test_character_references():
    assert blocks("<p>&eacute;&#8217;&#x2019;&NotEqualTilde;&amp;amp;&copy &unknown;") == [("p", "é’’≂̸&amp;© &unknown;")]


def test_malformed_csv_is_refused_whole(spark):
    docs = spark.createDataFrame(
        [("open", 'a,b\n1,"x\n2,3'), ("late", 'a,b\n"x"y,2\n'), ("fine", 'a,b\n1 "x",""\n'), ("empty", ""), ("null", None)], "document_id string, text string")
    assert {r["document_id"] for r in S.csv_errors(docs).collect()} == {"open", "late"}
    assert [(r["document_id"], r["values"]) for r in S.csv_records(docs).collect()] == [("fine", {"a": '1 "x"', "b": ""})]


def test_leaves_of_any_depth(spark):
    deep = '{"a": ' * 9 + '"pwd=1"' + "}" * 9
    docs = spark.createDataFrame([(1, deep), (2, '[[1, "x"], {"my_token": {"k": [1]}}, null]'), (3, "secret: x"), (4, None), (5, '{"a": 1} pwd=2')], "id int, t string")
    leaves = {(r["id"], r["path"]): (r["type"], r["value"]) for r in json_leaves(docs, "id", "t").collect()}
    assert leaves[1, "$" + ".a" * 9] == ("string", "pwd=1") and leaves[2, "$[0][1]"] == ("string", "x") and leaves[2, "$[1].my_token"][1] == '{"k":[1]}'
    assert leaves[2, "$[2]"][0] == "null" and leaves[3, "$"] == ("text", "secret: x") and len([k for k in leaves if k[0] == 2]) == 4
    found = {(r["id"], r["path"], r["family"]) for r in secrets_in(docs, "id", "t").collect()}
    assert found == {(1, "$" + ".a" * 9, "assignment"), (2, "$[1].my_token", "key"), (3, "$", "assignment"), (5, "$", "assignment")}


def test_intake_keeps_types_and_refuses_what_is_no_object(spark):
    rows = [(1, '{"summary": "s", "verified": true, "verification_evidence": "e"}', None), (2, '["summary"]', None), (3, '{"summary": "s"} x', None),
            (4, '{"summary": "s", "verified": "true"}', None), (5, "{}", '{"a": [{"password": {"x": 1}}]}'), (6, None, "[]")]
    raw = spark.createDataFrame(rows, "id int, content string, metadata string").withColumns({"domain": F.lit("research"), "type": F.lit("bugfix")})
    good, bad = Mm.intake(raw)
    assert {r["id"]: r["reject_reason"] for r in bad.collect()} == {2: "invalid content", 3: "invalid content", 4: "invalid verified", 6: "invalid metadata"}
    kept = {r["id"]: r for r in good.collect()}
    assert '"verified": true' in kept[1]["content"] and kept[5]["metadata"] == '{"a": [{"password": "[REDACTED]"}]}'

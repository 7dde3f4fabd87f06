"""Registered corpus queries: intake, parsing, chunking and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import chunking as C
from evigraph.operators import ranking as R
from evigraph.plans.inputs import Inputs
from evigraph.plans.registry import query, with_ctes
from evigraph.session import cut_in_small_batches, cut_lineage, spread
from evigraph.sources import corpus as S
from evigraph.sources import html as H

# Check-side spelling of the characters removed at text ends.
WS = "||".join(["' '"] + [f"chr({ord(c)})" for c in S.WHITESPACE if c != " "])


@query("src1_corpus_scan", "SELECT doc_id, lang, source, length(text) AS n FROM documents")
def src1(spark: SparkSession, sf: str) -> DataFrame:
    return Inputs(spark, sf).documents.select("doc_id", "lang", "source", F.length("text").cast("bigint").alias("n"))


@query("src3_admission", """
SELECT page_id, CASE WHEN k = 1 THEN 'invalid filename or extension' WHEN k = 2 THEN 'MIME type does not match extension'
 WHEN k = 3 THEN 'invalid PDF signature' WHEN k = 4 THEN 'invalid JSON content'
 WHEN NOT (lower(html) LIKE '<!doctype html%' OR lower(html) LIKE '<html%' OR lower(html) LIKE '<head%' OR lower(html) LIKE '<body%') THEN 'invalid HTML content' END AS reason
FROM (SELECT page_id, html, CASE WHEN contains(url, '/de/') THEN 1 WHEN contains(url, '/fr/') THEN 2 WHEN contains(url, '?') THEN 3 WHEN contains(url, '#') THEN 4 ELSE 5 END AS k FROM pages) p""")
def src3(spark: SparkSession, sf: str) -> DataFrame:
    def pick(*values: str) -> F.Column:
        return (F.when(F.contains("url", F.lit("/de/")), values[0]).when(F.contains("url", F.lit("/fr/")), values[1])
                .when(F.contains("url", F.lit("?")), values[2]).when(F.contains("url", F.lit("#")), values[3]).otherwise(values[4]))

    name = pick("../x.html", "x.html", "x.pdf", "x.json", "x.html")
    mime = pick("text/html", "text/plain", "application/pdf", "application/json", "text/html; charset=utf-8")
    return Inputs(spark, sf).pages.select("page_id", S.reject_reason(name, mime, F.encode(F.concat(F.lit(S.BOM + "\n\t \u00a0"), "html"), "UTF-8")).alias("reason"))


@query("src4_json_valid", """
SELECT event_id, TRY_CAST(doc AS JSON) IS NOT NULL AND NOT contains(doc, 'NaN') AS valid FROM (
 SELECT event_id, CASE WHEN event_type = 'error' THEN props || 'x' WHEN event_type = 'view' THEN '[' || props || ', NaN]' ELSE props END AS doc FROM events) e""")
def src4(spark: SparkSession, sf: str) -> DataFrame:
    doc = (F.when(F.col("event_type") == "error", F.concat("props", F.lit("x")))
           .when(F.col("event_type") == "view", F.concat(F.lit("["), "props", F.lit(", NaN]"))).otherwise(F.col("props")))
    return Inputs(spark, sf).events.select("event_id", S.json_valid(doc).alias("valid"))


@query("src5_duplicate_flag", """
SELECT doc_id, row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY doc_id) > 1 AS duplicate FROM documents""")
def src5(spark: SparkSession, sf: str) -> DataFrame:
    docs = Inputs(spark, sf).documents.select("doc_id", "lang", S.content_hash(F.col("text")).alias("content_hash"))
    return S.flag_duplicates(docs.withColumn("created_at", F.lit(0)), ["lang", "content_hash"], doc_id="doc_id").select("doc_id", "duplicate")


@query("src6_format_routing", """
SELECT doc_id, CASE WHEN m = 'text/plain' AND f = '.md' THEN 'markdown' WHEN m = 'text/plain' AND f = '.csv' THEN 'csv'
 WHEN m = 'text/plain' AND f = '.json' THEN 'json' WHEN m = 'text/plain' THEN 'text' WHEN m = 'text/html' THEN 'html'
 WHEN m = 'text/json' THEN 'json' ELSE 'unsupported' END AS format
FROM (SELECT doc_id, CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.csv' WHEN 'de' THEN '.json' ELSE '.txt' END AS f,
 CASE WHEN source = 'src1' THEN 'text/html' WHEN source = 'src2' THEN 'text/json' WHEN source = 'src3' THEN 'image/png' ELSE 'text/plain' END AS m FROM documents) d""")
def src6(spark: SparkSession, sf: str) -> DataFrame:
    suffix = F.when(F.col("lang") == "en", "a.MD").when(F.col("lang") == "fr", "a.csv").when(F.col("lang") == "de", "a.json").otherwise("a.txt")
    mime = (F.when(F.col("source") == "src1", "text/html").when(F.col("source") == "src2", "text/json")
            .when(F.col("source") == "src3", "image/png").otherwise("text/plain"))
    return Inputs(spark, sf).documents.select("doc_id", S.format_of(mime, suffix).alias("format"))


RAW_TEXT = "chr(65279) || '  ' || replace(text, chr(10), chr(13) || chr(10) || chr(10) || chr(13) || chr(10)) || chr(10)"
PLAIN_SQL = f"regexp_replace(trim(replace(regexp_replace(raw, '^' || chr(65279), ''), chr(13) || chr(10), chr(10)), {WS}), chr(10) || '{{3,}}', chr(10) || chr(10), 'g')"


@query("src7_plain_text", f"SELECT doc_id, sha256({PLAIN_SQL}) AS text_hash FROM (SELECT doc_id, {RAW_TEXT} AS raw FROM documents) d")
def src7(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("﻿  "), F.replace("text", F.lit("\n"), F.lit("\r\n\n\r\n")), F.lit("\n"))
    return Inputs(spark, sf).documents.select("doc_id", F.sha2(S.plain_text(raw), 256).alias("text_hash"))


@query("src8_csv_errors", """
SELECT p_partkey AS doc_id, 'malformed CSV: quote' AS error FROM part WHERE p_partkey % 3 < 2""")
def src8_errors(spark: SparkSession, sf: str) -> DataFrame:
    third = F.col("p_partkey") % 3
    doc = F.concat(F.lit("id,note\n1,"), F.when(third == 0, '"unclosed\n2,3').when(third == 1, '"closed" too early\n').otherwise('in "the" middle\n2,""\n'), "p_name")
    return S.csv_errors(Inputs(spark, sf).part.select(F.col("p_partkey").alias("doc_id"), doc.alias("text")), "doc_id")


# Four documents: 5 000 quoted columns, and a cell of a million characters full of doubled quotes.
@query("src8_large_cells", """
SELECT DISTINCT p_size % 4 AS doc_id, i AS record_number, CASE i WHEN 1 THEN 5000 ELSE 1 END AS n_cells, CASE i WHEN 1 THEN 1 ELSE 1000000 END AS longest FROM part, (VALUES (CAST(1 AS BIGINT)), (2)) v(i)""")
def src8_large(spark: SparkSession, sf: str) -> DataFrame:
    groups = Inputs(spark, sf).part.groupBy((F.col("p_size") % 4).alias("doc_id")).agg(F.count("*").alias("n"))
    # sizes that depend on a row, so that no text of this length becomes a literal of the plan
    numbers = F.sequence(F.lit(1), F.least(F.col("n") + 5000, F.lit(5000)))
    header = F.array_join(F.transform(numbers, lambda i: F.concat(F.lit('"c'), i.cast("string"), F.lit('"'))), ",")
    wide = F.array_join(F.transform(numbers, lambda i: F.concat(F.lit('" '), "doc_id", F.lit('\n"'))), ",")
    cell = F.repeat(F.lit('x""y'), F.least(F.col("n") + 333_333, F.lit(333_333)).cast("int"))
    doc = F.concat(header, F.lit("\n"), wide, F.lit('\n"'), cell, "doc_id", F.lit('"\n'))
    docs = cut_lineage(groups.select("doc_id", doc.alias("text")))
    cells = F.map_values("values")
    return S.csv_records(docs, "doc_id").select("doc_id", "record_number", F.size(cells).alias("n_cells"), F.array_max(F.transform(cells, lambda c: F.char_length(c))).alias("longest"))


@query("src8_csv_records", """
SELECT p_partkey AS doc_id, i AS record_number,
 CASE i WHEN 1 THEN 'name: ' || p_name || '; note: a;"b"; size: ' || CAST(p_size AS VARCHAR)
        ELSE 'name: ' || p_brand || '; note: ' || p_type END AS text
FROM part, (VALUES (CAST(1 AS BIGINT)), (2)) v(i)""")
def src8(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.concat(
        F.lit("name;note;size\r\n"), "p_name", F.lit(';"a;""b""";'), F.col("p_size").cast("string"), F.lit("\n ; ;\n"),
        F.col("p_brand"), F.lit("; "), "p_type", F.lit("\n"))
    docs = Inputs(spark, sf).part.select(F.col("p_partkey").alias("doc_id"), doc.alias("text"))
    return S.csv_records(docs, "doc_id").select("doc_id", "record_number", "text")


@query("src9_json_records", """
SELECT event_id AS doc_id, 'array' AS root_type, i AS record_number, '$[' || CAST(i - 1 AS VARCHAR) || ']' AS json_path,
 CASE i WHEN 1 THEN '{"k":' || json_extract_string(props, '$.k') || '}' ELSE CAST(user_id AS VARCHAR) END AS text
FROM events, (VALUES (CAST(1 AS BIGINT)), (2)) v(i)""")
def src9(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.concat(F.lit("["), "props", F.lit(", "), F.col("user_id").cast("string"), F.lit("]"))
    docs = Inputs(spark, sf).events.select(F.col("event_id").alias("doc_id"), doc.alias("text"))
    return S.json_records(docs, "doc_id")


def _sql_decoded(text: str) -> str:
    """The references that occur in the pages and the fixture."""
    for name, char in (("&copy;", 169), ("&middot;", 183), ("&quot;", 34), ("&eacute;", 233), ("&#8217;", 8217), ("&#x2019;", 8217), ("&NotEqualTilde;", None)):
        text = f"replace({text}, '{name}', {f'chr({char})' if char else 'chr(8770) || chr(824)'})"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


def _sql_tidy(raw: str, lines: bool) -> str:
    if lines:
        return f"trim(regexp_replace({raw}, '[ \\t\\r]*\\n[ \\t\\r\\n]*', chr(10), 'g'), {WS})"
    return f"trim(regexp_replace({raw}, '[ \\t\\r\\n]+', ' ', 'g'), {WS})"


_CLEAN = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _tag in ("script", "style", "noscript"):
    _CLEAN = f"regexp_replace({_CLEAN}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'g')"

# Hard cases put into every page: nested lists with text after them, unclosed items and headings, references, tables in tables, stray tags.
HARD_HTML = """<ul><li>one<p>two</p> tail t&eacute;t&eacute; &#8217;x&#x2019;<ul><li>deep<li>deeper</ul> end</li><li>last &NotEqualTilde; a < b</ul>between
<h3>Open heading<p>under <b>it<p>next</b> one</div><table><tr><td><p>cell</p>
 two<table><tr><td>inner</td></tr></table> after</td></tr></table><pre>a
  b <i>c</i>
</pre></article>"""


def hard_pages(t: Inputs) -> DataFrame:
    return t.pages.withColumn("html", F.replace("html", F.lit("</article>"), F.lit(HARD_HTML)))


def _cut(stack: str, tag: str) -> str:
    """``stack`` before its last ``tag``."""
    return f"{stack}[1:len({stack}) - list_position(list_reverse({stack}), {tag})]"


def _at(stack: str, tag: str) -> str:
    return f"CASE WHEN list_contains({stack}, {tag}) THEN len({stack}) - list_position(list_reverse({stack}), {tag}) + 1 ELSE 0 END"


_P_ENDS = "','".join(H.ENDS_PARAGRAPH)
_VOID = "','".join(H.VOID)
_BLOCK = "tg IN ('h1','h2','h3','h4','h5','h6','p','li','pre','table')"
_LIST_AT = lambda s: f"greatest({_at(s, chr(39) + 'ul' + chr(39))}, {_at(s, chr(39) + 'ol' + chr(39))})"
_HEAD = "list_filter({0}, lambda x: x IN ('h1','h2','h3','h4','h5','h6'))[-1]"
HTML_CTES = {
    "cleaned": f"SELECT page_id, {_CLEAN} AS clean FROM (SELECT page_id, replace(html, '</article>', '{HARD_HTML.replace(chr(39), chr(39) * 2)}') AS html FROM pages) h",
    "tokens": f"""SELECT page_id, k, tok, lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tg, starts_with(tok, '</') AS closing FROM (
      SELECT page_id, unnest(l) AS tok, generate_subscripts(l, 1) AS k FROM (SELECT page_id, regexp_extract_all(clean, '{H.TOKEN}') AS l FROM cleaned) a) b""",
    # The open elements after each token, the one that a block begins with (0 between blocks) and the blocks so far.
    "fold": f"""SELECT page_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS stack, CAST(0 AS BIGINT) AS begun, CAST(0 AS BIGINT) AS n, false AS fresh FROM cleaned
     UNION ALL
     SELECT page_id, k, stack, CASE WHEN fresh THEN len(stack) ELSE still END, n + CAST(fresh AS BIGINT), fresh FROM (
      SELECT page_id, k, n, still, CASE WHEN opens THEN list_append(d, tg) ELSE d END AS stack, opens AND still = 0 AND {_BLOCK} AS fresh FROM (
       SELECT *, CASE WHEN len(d) < begun THEN 0 ELSE begun END AS still FROM (
        SELECT *, CASE WHEN tg = '' THEN c
          WHEN closing THEN CASE WHEN list_contains(c, tg) AND NOT (tg = 'li' AND {_at('c', 'tg')} < {_LIST_AT('c')}) THEN {_cut('c', 'tg')} ELSE c END
          WHEN tg = 'li' AND {_at('c', 'tg')} > {_LIST_AT('c')} THEN {_cut('c', 'tg')} ELSE c END AS d FROM (
         SELECT *, CASE WHEN NOT closing AND {_BLOCK} AND {_HEAD.format('b')} IS NOT NULL THEN {_cut('b', _HEAD.format('b'))} ELSE b END AS c FROM (
          SELECT t.*, f.n, f.begun, NOT t.closing AND t.tg <> '' AND t.tg NOT IN ('{_VOID}') AS opens,
           CASE WHEN NOT t.closing AND t.tg IN ('{_P_ENDS}') AND list_contains(f.stack, 'p') THEN {_cut('f.stack', chr(39) + 'p' + chr(39))} ELSE f.stack END AS b
          FROM fold f JOIN tokens t ON t.page_id = f.page_id AND t.k = f.k + 1) s1) s2) s3) s4) s5""",
    "raws": f"""SELECT page_id, n - 1 AS position, first(tg ORDER BY k) AS tag, string_agg(piece, '' ORDER BY k) AS raw FROM (
      SELECT f.page_id, f.n, f.k, t.tg, CASE WHEN f.fresh THEN '' WHEN t.tg <> '' THEN chr(0) WHEN regexp_matches(t.tok, '^<.') THEN '' ELSE {_sql_decoded('t.tok')} END AS piece
      FROM fold f JOIN tokens t ON t.page_id = f.page_id AND t.k = f.k WHERE f.begun > 0) x GROUP BY 1, 2""",
    "blocks": f"""SELECT page_id, position, tag, text FROM (SELECT page_id, position, tag,
      CASE WHEN tag IN ('pre', 'table') THEN {_sql_tidy("replace(raw, chr(0), chr(10))", True)} ELSE {_sql_tidy("replace(raw, chr(0), ' ')", False)} END AS text FROM raws) y WHERE text <> ''""",
}


@query("src10_html_blocks", with_ctes("SELECT page_id, position, tag, text FROM blocks", **HTML_CTES).replace("WITH ", "WITH RECURSIVE ", 1))
def src10(spark: SparkSession, sf: str) -> DataFrame:
    return H.html_blocks(hard_pages(Inputs(spark, sf)))


@query("src10_html_titles", f"""SELECT page_id, nullif({_sql_tidy(_sql_decoded("regexp_replace(regexp_extract(" + _CLEAN + ", '(?is)<title[^>]*>(.*?)</title\\s*>', 1), '<[^>]*>', ' ', 'g')"), False)}, '') AS title FROM pages""")
def src10_title(spark: SparkSession, sf: str) -> DataFrame:
    return Inputs(spark, sf).pages.select("page_id", H.html_title(F.col("html")).alias("title"))


_LEVELS = ", ".join(f"max(CASE WHEN tag = 'h{k}' THEN position END) OVER w AS p{k}" for k in range(1, 7))
_PATH = " || ".join(
    "CASE WHEN p{k} IS NOT NULL {above} THEN ' > ' || (SELECT h.text FROM blocks h WHERE h.page_id = s.page_id AND h.position = s.p{k}) ELSE '' END".format(
        k=k, above=" ".join(f"AND p{k} > coalesce(p{j}, -1)" for j in range(1, k))) for k in range(1, 7))


@query("src10_wn9_section_paths", with_ctes(
    f"""SELECT page_id, position, CASE tag WHEN 'li' THEN 'list' WHEN 'table' THEN 'table' WHEN 'pre' THEN 'code' ELSE 'paragraph' END AS block_type, {_PATH} AS section_path
    FROM (SELECT *, {_LEVELS} FROM blocks WINDOW w AS (PARTITION BY page_id ORDER BY position)) s WHERE NOT starts_with(tag, 'h')""", **HTML_CTES).replace("WITH ", "WITH RECURSIVE ", 1))
def src10_sections(spark: SparkSession, sf: str) -> DataFrame:
    found = S.section_paths(H.html_blocks(hard_pages(Inputs(spark, sf))))
    path = F.array_join(F.transform("section_path", lambda h: F.concat(F.lit(" > "), h)), "")
    return found.select("page_id", "position", "block_type", path.alias("section_path"))


# Chunking ----------------------------------------------------------------

CHUNK_SQL = f"""
WITH RECURSIVE cut AS (
 SELECT doc_id, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS fin, true AS seed FROM documents
 UNION ALL
 SELECT doc_id, nxt AS start, CASE WHEN lim < n AND near > 0 AND lim - near > nxt + 600 THEN lim - near + 1 ELSE lim END AS fin, false AS seed FROM (
  SELECT *, CASE WHEN nl = 0 THEN sp WHEN sp = 0 THEN nl ELSE least(nl, sp) END AS near FROM (
   SELECT *, strpos(reverse(w), chr(10)) AS nl, strpos(reverse(w), ' ') AS sp FROM (
    SELECT *, substring(text, nxt + 1, lim - nxt) AS w FROM (
     SELECT c.doc_id, d.text, length(d.text) AS n, CASE WHEN c.seed THEN 0 ELSE greatest(c.start + 1, c.fin - 200) END AS nxt,
      least(CASE WHEN c.seed THEN 0 ELSE greatest(c.start + 1, c.fin - 200) END + 1200, length(d.text)) AS lim
     FROM cut c JOIN documents d USING (doc_id) WHERE length(d.text) > 0 AND (c.seed OR c.fin < length(d.text))) a) b) e) f),
spans AS (SELECT * FROM cut WHERE NOT seed),
piece AS (SELECT doc_id, start, substring(text, start + 1, fin - start) AS raw FROM spans JOIN documents USING (doc_id)),
chunks AS (SELECT doc_id, start + length(raw) - length(ltrim(raw, {WS})) AS start_char, trim(raw, {WS}) AS text FROM piece WHERE trim(raw, {WS}) <> ''),
numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_char) AS segment_part, count(*) OVER (PARTITION BY doc_id) AS segment_count,
 start_char, start_char + length(text) AS end_char, text FROM chunks)
"""


def document_chunks(t: Inputs, *columns: str) -> DataFrame:
    """``columns`` of the chunks of all documents."""
    docs = spread(t.documents.select("doc_id", "text")).withColumn("content_hash", S.content_hash(F.col("text")))
    return cut_in_small_batches(C.split_segments(docs, ["doc_id", "content_hash"]).select(*columns))


@query("g1_chunk_offsets", CHUNK_SQL + "SELECT doc_id, segment_part, segment_count, start_char, end_char FROM numbered")
def g1(spark: SparkSession, sf: str) -> DataFrame:
    return document_chunks(Inputs(spark, sf), "doc_id", "segment_part", "segment_count", "start_char", "end_char")


@query("g2_chunk_rows", CHUNK_SQL + """
SELECT doc_id, segment_part - 1 AS chunk_index,
 'chunk_' || substr(sha256(concat_ws(chr(31), CAST(doc_id AS VARCHAR), (SELECT sha256(d.text) FROM documents d WHERE d.doc_id = n.doc_id), 'chunks-v1', CAST(segment_part - 1 AS VARCHAR))), 1, 32) AS chunk_id,
 CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS token_count FROM numbered n""")
def g2(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.number_chunks(document_chunks(Inputs(spark, sf), "doc_id", "content_hash", "segment_part", "text"), "doc_id", ["segment_part"], "content_hash")
    return rows.select("doc_id", "chunk_index", "chunk_id", "token_count")


@query("g2_chunk_replace", """
SELECT conv_id, turn, CASE WHEN conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') THEN 'new' ELSE 'old' END AS origin FROM conversations""")
def g2_replace(spark: SparkSession, sf: str) -> DataFrame:
    conv = Inputs(spark, sf).conversations.select("conv_id", "turn", "role")
    touched = conv.filter("role = 'system'").select("conv_id").distinct()
    old = conv.select("conv_id", "turn", F.lit("old").alias("origin"))
    new = conv.join(touched, "conv_id", "left_semi").select("conv_id", "turn", F.lit("new").alias("origin"))
    return C.replace_chunks(old, new, "conv_id")


@query("wn5_previous_context", """
SELECT c.conv_id, c.turn, c.turn // 2 AS batch, p.turn AS context_index FROM conversations c JOIN conversations p
ON p.conv_id = c.conv_id AND p.turn < (c.turn // 2) * 2 AND p.turn >= (c.turn // 2) * 2 - 3""")
def wn5(spark: SparkSession, sf: str) -> DataFrame:
    conv = Inputs(spark, sf).conversations.select("conv_id", "turn")
    return C.context_windows(conv, "conv_id", "turn", 2, 3).select("conv_id", "turn", "batch", "context_index")


@query("wn6_batches", """
SELECT conv_id, turn, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS BIGINT) AS batch,
 CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 6 AS BIGINT) AS batch_group FROM conversations""")
def wn6(spark: SparkSession, sf: str) -> DataFrame:
    conv = Inputs(spark, sf).conversations.select("conv_id", "turn")
    seq = R.sequence_in_group(conv, ["conv_id"], F.floor(F.col("turn") / 1000), [F.col("turn")], "seq")
    return seq.select("conv_id", "turn", R.fixed_batches(F.col("seq"), 3).alias("batch"), R.fixed_batches(F.col("seq"), 6).alias("batch_group"))


@query("wn7_segment_parts", CHUNK_SQL + "SELECT doc_id, max(segment_part) AS last_part, max(segment_count) AS segment_count FROM numbered GROUP BY doc_id")
def wn7(spark: SparkSession, sf: str) -> DataFrame:
    return document_chunks(Inputs(spark, sf), "doc_id", "segment_part", "segment_count").groupBy("doc_id").agg(
        F.max("segment_part").alias("last_part"), F.max("segment_count").alias("segment_count"))

"""Document intake: reading, admission, routing, duplicates and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.functions.scalars import let
from evigraph.sources.html import BLOCK_TYPES
from evigraph.sources.text import WHITESPACE, strip

BOM = chr(0xFEFF)
# MIME types accepted for each file extension.
MIME_TYPES = {
    ".txt": ("text/plain",),
    ".md": ("text/markdown", "text/plain"),
    ".html": ("text/html",),
    ".json": ("application/json", "text/json", "text/plain"),
    ".pdf": ("application/pdf",),
    ".csv": ("text/csv", "text/plain", "application/csv"),
}
# Parser chosen for each MIME type.
FORMATS = {
    "text/plain": "text", "text/csv": "csv", "application/csv": "csv", "application/json": "json",
    "text/json": "json", "text/markdown": "markdown", "text/html": "html", "application/pdf": "pdf",
}
HTML_STARTS = ("<!doctype html", "<html", "<head", "<body")
CSV_DELIMITERS = (",", ";", "\t", "|")


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Raw files as (path, content); listing and reading run on the executors."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
        .select("path", "length", "modificationTime", "content")
    )


def reject_reason(filename: Column, mime: Column, content: Column) -> Column:
    """First admission rule a file breaks, else null. ``content`` is binary."""
    extension = F.lower(F.regexp_extract(filename, r"[^.](\.[^./\\]+)$", 1))
    kind = F.lower(F.element_at(F.split(F.coalesce(mime, F.lit("")), ";"), 1))
    allowed = F.lit(False)
    for ext, types in MIME_TYPES.items():
        allowed = allowed | ((extension == ext) & kind.isin(*types))
    is_pdf = extension == ".pdf"
    text = F.try_validate_utf8(content)
    start = F.lower(F.left(F.ltrim(F.coalesce(text, F.lit("")), F.lit(BOM + WHITESPACE)), F.lit(64)))
    html_ok = F.lit(False)
    for prefix in HTML_STARTS:
        html_ok = html_ok | start.startswith(prefix)
    return F.coalesce(
        F.when(filename.isNull() | (filename == "") | filename.contains("/") | filename.contains("\\")
               | ~extension.isin(*MIME_TYPES), "invalid filename or extension"),
        F.when(F.length(filename) > 255, "filename exceeds 255 characters"),
        F.when(~allowed, "MIME type does not match extension"),
        F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "empty file"),
        F.when(is_pdf & (F.coalesce(F.left(F.decode(content, "ISO-8859-1"), F.lit(5)), F.lit("")) != "%PDF-"),
               "invalid PDF signature"),
        F.when(~is_pdf & text.isNull(), "not UTF-8"),
        F.when(~is_pdf & F.contains(text, F.lit("\x00")), "binary data"),
        F.when((extension == ".html") & ~html_ok, "invalid HTML content"),
        F.when((extension == ".json") & ~json_valid(text), "invalid JSON content"),
    )


def json_valid(text: Column) -> Column:
    """The whole text is one JSON document.

    The parser stops after the first value, so the text is parsed as the first
    item of an array whose second item is a hash of the text: it is found there
    only if nothing follows or closes the value early.
    """
    mark = F.sha2(text, 256)
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    return F.coalesce(F.try_variant_get(wrapped, "$[1]", "string") == mark, F.lit(False))


def format_of(mime: Column, filename: Column) -> Column:
    """Parser for a file; plain text is re-routed by its suffix."""
    plain = mime == "text/plain"
    name = F.lower(filename)
    table = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return (
        F.when(plain & name.endswith(".md"), "markdown").when(plain & name.endswith(".csv"), "csv")
        .when(plain & name.endswith(".json"), "json")
        .otherwise(F.coalesce(F.try_element_at(table, mime), F.lit("unsupported")))
    )


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def flag_duplicates(documents: DataFrame, key: list[str], order: str = "created_at", doc_id: str = "document_id") -> DataFrame:
    """``duplicate`` is true for all but the first document of each ``key``.

    The first copy is found with a partial aggregate and matched back on the
    unique document id, so a text copied into a third of all rows stays spread.
    """
    first = documents.groupBy(*key).agg(F.min(F.struct(order, doc_id)).alias("_first"))
    keepers = first.select(F.col(f"_first.{doc_id}").alias(doc_id), F.lit(False).alias("duplicate"))
    return documents.join(keepers, doc_id, "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(True)))


def new_documents(arrivals: DataFrame, stored: DataFrame, key: list[str], order: str = "created_at", doc_id: str = "document_id") -> DataFrame:
    """Arrivals whose content is neither stored nor repeated earlier in the batch."""
    fresh = flag_duplicates(arrivals, key, order, doc_id).filter(~F.col("duplicate")).drop("duplicate")
    return fresh.join(stored.select(*key).distinct(), key, "left_anti")


# Segments ----------------------------------------------------------------

def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def plain_text(text: Column) -> Column:
    """Drop a leading byte-order mark, unify line ends, strip, keep at most one blank line."""
    unmarked = F.regexp_replace(text, "^﻿", "")
    return collapse_blank_lines(strip(F.replace(unmarked, F.lit("\r\n"), F.lit("\n"))))


def csv_delimiter(text: Column) -> Column:
    """Most frequent candidate delimiter of the first line, comma first on ties."""
    outside = F.regexp_replace(text, '"[^"]*+"', "")  # marks inside quotes do not count

    def best(head: Column) -> Column:
        counts = [F.struct((F.length(head) - F.length(F.replace(head, F.lit(mark), F.lit("")))).alias("n"), F.lit(-i).alias("order"), F.lit(mark).alias("mark"))
                  for i, mark in enumerate(CSV_DELIMITERS)]
        return F.array_max(F.array(*counts))["mark"]

    return let(F.element_at(F.split(outside, "\r?\n", 2), 1), best)


def csv_parsed(text: Column) -> Column:
    """Struct ``records`` (their fields) and ``error`` of a whole CSV text.

    Fields are matched one behind the other, each with the delimiter or line end
    before it; a quoted field runs to its closing quote and must be followed by
    a delimiter, a line end or the end. Where that fails matching stops, so an
    unclosed quote or text after a closing one leaves characters over: an error.
    """
    body = F.replace(F.regexp_replace(text, f"^{BOM}", ""), F.lit("\r\n"), F.lit("\n"))

    def parsed(bound: Column) -> Column:
        mark, whole = bound["mark"], F.concat(F.lit("\n"), bound["body"])
        safe = F.when(mark == "|", F.lit("\\|")).otherwise(mark)
        # possessive: a plain repetition of a group recurses, and a long quoted cell overflows the stack
        quoted = F.concat(F.lit('"[^"]*+(?:""[^"]*+)*+"(?=\n|\\z|'), safe, F.lit(")"))
        pattern = F.concat(F.lit("\\G(?:\n|"), safe, F.lit(")(?:"), quoted, F.lit('|(?!")[^\n'), safe, F.lit("]*+)"))
        return let(F.regexp_extract_all(whole, pattern, F.lit(0)), lambda tokens: F.struct(
            _csv_rows(tokens).alias("records"),
            F.when(F.char_length(F.array_join(tokens, "")) < F.char_length(whole), "malformed CSV: quote").alias("error")))

    return let(F.struct(body.alias("body"), csv_delimiter(body).alias("mark")), parsed)


def _csv_rows(tokens: Column) -> Column:
    """Fields by record from fields that begin with the sign before them."""
    def value(token: Column) -> Column:
        field = F.substring(token, F.lit(2), F.char_length(token))
        inner = F.substring(field, F.lit(2), F.char_length(field) - 2)
        return strip(F.when(field.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(field))

    starts = F.array_compact(F.transform(tokens, lambda t, i: F.when(t.startswith("\n"), i)))

    def rows(bound: Column) -> Column:
        ends = F.concat(F.slice(bound["starts"], F.lit(2), F.size(bound["starts"])), F.array(F.size(bound["values"])))
        return F.zip_with(bound["starts"], ends, lambda a, b: F.slice(bound["values"], a + 1, b - a))

    return let(F.struct(F.transform(tokens, value).alias("values"), starts.alias("starts")), rows)


def csv_errors(documents: DataFrame, doc_id: str = "document_id", text: str = "text") -> DataFrame:
    """The documents that ``csv_records`` rejects as a whole, with the reason."""
    return documents.select(doc_id, csv_parsed(F.col(text))["error"].alias("error")).where("error IS NOT NULL")


def csv_records(documents: DataFrame, doc_id: str = "document_id", text: str = "text") -> DataFrame:
    """One row per CSV record of a well-formed document: number, columns, values and ``k: v; …`` text.

    A record ends at a line end outside quotes. Blank records are dropped; short
    records keep the columns they fill; a document with an unclosed quote gives
    no record at all (see ``csv_errors``).
    """
    rows = documents.select(doc_id, csv_parsed(F.col(text)).alias("_csv")).where("_csv.error IS NULL")
    kept = rows.select(doc_id, F.filter("_csv.records", lambda c: F.exists(c, lambda v: v != "")).alias("_rows"))
    header = F.element_at(F.col("_rows"), 1)
    body_rows = F.slice("_rows", F.lit(2), F.greatest(F.size("_rows") - 1, F.lit(0)))
    out = kept.filter(F.size("_rows") > 0).select(doc_id, header.alias("columns"), F.posexplode(body_rows).alias("_pos", "_cells"))
    width = F.least(F.size("columns"), F.size("_cells"))
    keys, values = F.slice("columns", F.lit(1), width), F.slice("_cells", F.lit(1), width)

    def by_name(b: Column) -> Column:
        names = F.array_distinct(b["k"])
        # a repeated name takes its last value
        return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(b["v"], -F.array_position(b["back"], k).cast("int"))))

    return out.select(
        doc_id, (F.col("_pos") + 1).cast("bigint").alias("record_number"), "columns",
        let(F.struct(keys.alias("k"), values.alias("v"), F.reverse(keys).alias("back")), by_name).alias("values"),
        F.array_join(F.zip_with(keys, values, lambda k, v: F.concat(k, F.lit(": "), v)), "; ").alias("text"),
    )


def json_type(variant: Column) -> Column:
    """Root kind of a parsed document."""
    kind = F.schema_of_variant(variant)
    return (
        F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
        .when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
        .otherwise("number")
    )


def json_records(documents: DataFrame, doc_id: str = "document_id", text: str = "text") -> DataFrame:
    """One segment per item of a top-level array, else one for the whole value; keys come sorted."""
    bare = F.regexp_replace(F.col(text), "^﻿", "")
    parsed = documents.select(doc_id, F.when(json_valid(bare), F.try_parse_json(bare)).alias("_doc")).filter("_doc IS NOT NULL")
    parsed = parsed.withColumn("root_type", json_type(F.col("_doc")))
    items = F.when(F.col("root_type") == "array", F.try_variant_get("_doc", "$", "array<variant>")).otherwise(F.array("_doc"))
    out = parsed.select(doc_id, "root_type", F.posexplode(items).alias("_pos", "_item"))
    listed = F.col("root_type") == "array"
    return out.select(
        doc_id, "root_type",
        F.when(listed, (F.col("_pos") + 1).cast("bigint")).alias("record_number"),
        F.when(listed, F.concat(F.lit("$["), F.col("_pos").cast("string"), F.lit("]"))).otherwise("$").alias("json_path"),
        F.to_json("_item").alias("text"),
    )


def section_paths(blocks: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Body blocks with the path of enclosing headings.

    A heading of level k clears deeper levels: level j counts only if its last
    heading is not older than the last heading of every higher level.
    """
    w = Window.partitionBy(page_id).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))
    out = blocks.withColumn("_level", level)
    for k in range(1, 7):
        here = F.when(F.col("_level") == k, F.struct("position", "text"))
        out = out.withColumn(f"_h{k}", F.last(here, ignorenulls=True).over(w))
    kept = []
    for k in range(1, 7):
        newest_above = F.greatest(*[F.coalesce(F.col(f"_h{j}.position"), F.lit(-1)) for j in range(1, k)], F.lit(-1), F.lit(-1))
        kept.append(F.when(F.col(f"_h{k}.position") > newest_above, F.col(f"_h{k}.text")))
    types = F.create_map(*[F.lit(x) for pair in BLOCK_TYPES.items() for x in pair])
    return out.filter(F.col("_level").isNull()).select(
        page_id, "position", types[F.col("tag")].alias("block_type"), "text",
        F.filter(F.array(*kept), lambda h: h.isNotNull()).alias("section_path"),
    )

"""Symbols, chunks and relations of source files, and their entry into the graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from evigraph.functions.scalars import language_of, let, symbol_id, token_count
from evigraph.operators.chunking import chunk_pieces
from evigraph.session import shuffled

# Fixed value: a line that opens a symbol.
SYMBOL_LINE = r"^\s*(?:async\s+)?(def|function|fn|func|class|struct|interface|type)\s+([A-Za-z0-9_]+)"
FUNCTION_WORDS = ("def", "function", "fn", "func")
CHUNK_CHARS = 1200
# Files taken from a source tree.
SOURCE_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".c", ".cpp", ".h", ".hpp")
IGNORED_FOLDERS = (".venv", "venv", ".git", "__pycache__", "build", "dist", "node_modules", "out", ".next", "generated", ".prisma")
GENERATED_ENDINGS = (".min.js", ".d.ts")


def wanted_source(path: Column) -> Column:
    """Source files by suffix, outside ignored folders, without generated ones."""
    low = F.lower(path)
    ends = lambda endings: F.lit(False) if not endings else low.rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")
    return ends(SOURCE_SUFFIXES) & ~ends(GENERATED_ENDINGS) & ~F.arrays_overlap(
        F.split(path, "/"), F.array(*[F.lit(f) for f in IGNORED_FOLDERS]))


def lines_of(code: Column) -> Column:
    """Lines as ``splitlines`` counts them: a final line end adds no empty line."""
    return F.split(F.regexp_replace(code, "\r?\n$", ""), "\r?\n")


def _file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _opened(lines: Column) -> Column:
    """The lines that open a symbol: place, word, name, indentation and the line."""
    part = lambda line, k: F.regexp_extract(line, SYMBOL_LINE, k)
    found = F.transform(lines, lambda line, i: F.struct(
        i.alias("at"), part(line, 1).alias("word"), part(line, 2).alias("name"),
        F.length(F.regexp_extract(line, r"^\s*", 0)).alias("indent"), line.alias("line")))
    return F.filter(found, lambda s: s["word"] != "")


def _symbol_ends(symbols: Column, n_lines: Column, max_lines: int | None) -> Column:
    """Last line of each symbol: before the next one of equal or lower indentation, else the file's last.

    The symbols are folded from the last one; the stack holds the later ones
    that still can end an earlier one, so it is as deep as the indentation.
    ``max_lines`` ends a symbol so many lines after its first.
    """
    if max_lines is not None:
        return F.transform(symbols, lambda s: F.least(s["at"] + 1 + max_lines, n_lines))
    start = F.struct(F.array().cast("array<struct<at: int, indent: int>>").alias("stack"), F.array().cast("array<int>").alias("ends"))

    def step(acc: Column, s: Column) -> Column:
        def settled(kept: Column) -> Column:
            return F.struct(F.concat(kept, F.array(F.struct(s["at"].alias("at"), s["indent"].alias("indent")))).alias("stack"),
                            F.concat(acc["ends"], F.array(F.coalesce(F.try_element_at(kept, F.lit(-1))["at"], n_lines))).alias("ends"))

        return let(F.filter(acc["stack"], lambda later: later["indent"] <= s["indent"]), settled)

    return F.reverse(F.aggregate(F.reverse(symbols), start, step, lambda acc: acc["ends"]))


def symbols(files: DataFrame, path: str = "file_path", code: str = "code", max_lines: int | None = None) -> DataFrame:
    """Symbols per file: kind, name, 1-based line range, signature, id and parent file id."""
    lang = language_of(F.col(path))
    base = files.select(F.col(path).alias("file_path"), lang.alias("language"), lines_of(F.col(code)).alias("_lines"))
    base = base.withColumn("parent_id", symbol_id(F.col("language"), F.col("file_path"), _file_name(F.col("file_path")), F.lit("file")))
    base = base.select("file_path", "language", "parent_id", F.size("_lines").alias("_n"), _opened(F.col("_lines")).alias("_symbols"))
    found = base.withColumn("_end", _symbol_ends(F.col("_symbols"), F.col("_n"), max_lines)).select(
        "file_path", "language", "parent_id", F.explode(F.arrays_zip("_symbols", "_end")).alias("_r")).select(
        "file_path", "language", "parent_id", "_r._symbols.*", F.col("_r._end").alias("_end"))
    kind = F.when(F.col("word").isin(*FUNCTION_WORDS), "function").otherwise("class")
    return found.withColumn("kind", kind).select(
        "file_path", "language", "name", "kind", (F.col("at") + 1).cast("bigint").alias("start_line"), F.col("_end").cast("bigint").alias("end_line"),
        F.trim("line").alias("signature"), symbol_id(F.col("language"), F.col("file_path"), F.col("name"), F.col("kind")).alias("id"), "parent_id")


def file_nodes(files: DataFrame, path: str = "file_path", code: str = "code") -> DataFrame:
    p = F.col(path)
    lang = language_of(p)
    return files.select(
        p.alias("file_path"), lang.alias("language"), _file_name(p).alias("name"), F.lit("file").alias("kind"), F.lit(1).cast("bigint").alias("start_line"),
        F.greatest(F.lit(1), F.size(lines_of(F.col(code)))).cast("bigint").alias("end_line"), p.alias("signature"),
        symbol_id(lang, p, _file_name(p), F.lit("file")).alias("id"), F.lit(None).cast("string").alias("parent_id"))


def _line_numbers(text: Column, places: Column) -> Column:
    """1-based line of each of the ascending places in a text."""
    @F.pandas_udf(ArrayType(IntegerType()))
    def numbers(texts: pd.Series, all_places: pd.Series) -> pd.Series:
        rows = []
        for value, wanted in zip(texts, all_places):
            if value is None or wanted is None:
                rows.append(None)
                continue
            out, line, before = [], 1, 0
            for place in wanted:
                line, before = line + value.count("\n", before, place), place
                out.append(line)
            rows.append(out)
        return pd.Series(rows, dtype=object)

    return numbers(text, places)


def symbol_chunks(files: DataFrame, path: str = "file_path", code: str = "code", max_lines: int | None = None, max_chars: int | None = None) -> DataFrame:
    """One chunk per symbol (its lines); a file without symbols is one chunk, or the overlapping chunks of its text if that is long.

    Stays inside the file's row. ``max_lines`` and ``max_chars`` cut a symbol and a file without symbols.
    """
    base = files.select(F.col(path).alias("file_path"), F.col(code).alias("code"), lines_of(F.col(code)).alias("_lines"))
    base = base.withColumn("_symbols", _opened(F.col("_lines"))).withColumn("_n", F.size("_lines"))
    own = F.zip_with("_symbols", _symbol_ends(F.col("_symbols"), F.col("_n"), max_lines), lambda s, end: F.struct(
        s["name"].alias("name"), (s["at"] + 1).alias("first"), end.alias("last"),
        F.array_join(F.slice("_lines", s["at"] + 1, end - s["at"]), "\n").alias("text")))
    name = _file_name(F.col("file_path")).alias("name")
    if max_chars is not None:
        base = base.withColumn("code", F.left("code", F.lit(max_chars)))
    one = F.array(F.struct(name, F.lit(1).alias("first"), F.col("_n").alias("last"), F.col("code").alias("text")))
    long = (F.size("_symbols") == 0) & (F.length("code") > CHUNK_CHARS) & F.lit(max_chars is None)
    base = base.withColumn("_pieces", chunk_pieces(F.when(long, F.col("code")), CHUNK_CHARS))
    base = base.withColumn("_firsts", _line_numbers(F.col("code"), F.col("_pieces.start_char"))).withColumn(
        "_lasts", _line_numbers(F.col("code"), F.col("_pieces.end_char")))
    several = F.transform(F.arrays_zip("_pieces", "_firsts", "_lasts"), lambda p: F.struct(
        name, p["_firsts"].alias("first"), p["_lasts"].alias("last"), p["_pieces"]["text"].alias("text")))
    each = base.select("file_path", F.posexplode(F.when(F.size("_symbols") > 0, own).when(long, several).otherwise(one)).alias("chunk_index", "_s"))
    return each.select(
        "file_path", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("_s.name").alias("symbol_name"),
        F.col("_s.first").cast("bigint").alias("start_line"), F.col("_s.last").cast("bigint").alias("end_line"),
        F.col("_s.text").alias("text"), token_count(F.col("_s.text")).alias("token_count"))


def contains_edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("parent_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("contains").alias("kind"),
                        "file_path", F.col("start_line").alias("line_number"), F.lit(None).cast("string").alias("target_name"))


# Line patterns of the other relation kinds.
IMPORT_LINE = r"^\s*(?:import|from|use|#include)\s+[\"'<{]?\s*([A-Za-z0-9_./:]+)"
INHERIT_LINE = r"^\s*(?:class|struct|interface)\s+[A-Za-z0-9_]+\s*(?:\(|extends\s+|:\s*(?:public\s+)?)([A-Za-z0-9_]+)"
CALL = r"([A-Za-z_][A-Za-z0-9_]*)\s*\("
NOT_CALLS = ("if", "for", "while", "switch", "return", "def", "fn", "func", "function", "class", "print", "catch", "with", "match")


def _relation_lines(lines: Column) -> Column:
    """The lines that may hold a relation, with their place and the innermost symbol open there.

    A line belongs to the last symbol above it that is indented less (any symbol
    that closed that one would come later and be taken itself); a line that
    opens a symbol belongs to it.
    """
    def owned(every: Column, opened: Column) -> Column:
        def owner(line: Column, at: Column) -> Column:
            indent = F.length(F.regexp_extract(line, r"^\s*", 0))
            return F.try_element_at(F.filter(opened, lambda s: (s["at"] == at) | ((s["at"] < at) & (s["indent"] < indent))), F.lit(-1))

        marked = F.transform(every, lambda line, at: F.when(line.rlike(f"{SYMBOL_LINE}|{IMPORT_LINE}|{CALL}"), F.struct(
            at.alias("at"), line.alias("line"), owner(line, at).alias("own"))))
        return F.array_compact(marked)

    return let(lines, lambda every: let(_opened(every), lambda opened: owned(every, opened)))


def text_relations(files: DataFrame, path: str = "file_path", code: str = "code") -> DataFrame:
    """Imports, inheritance and calls by line; a call belongs to the innermost symbol open at its line, one outside all symbols to none.

    Only lines that open a symbol or hold a relation leave the file's row.
    """
    p = F.col(path)
    base = files.select(p.alias("file_path"), language_of(p).alias("language"), F.explode(_relation_lines(lines_of(F.col(code)))).alias("r"))
    kind = F.when(F.col("r.own.word").isin(*FUNCTION_WORDS), "function").otherwise("class")
    rows = base.select("file_path", "language", F.col("r.line").alias("_line"), (F.col("r.at") + 1).cast("bigint").alias("line_number"),
                       F.when(F.col("r.own").isNotNull(), F.struct(F.col("r.own.name").alias("name"), kind.alias("kind"))).alias("_own"))
    file_id = symbol_id(F.col("language"), F.col("file_path"), _file_name(F.col("file_path")), F.lit("file"))
    owner_id = F.when(F.col("_own").isNotNull(), symbol_id(F.col("language"), F.col("file_path"), F.col("_own.name"), F.col("_own.kind")))
    calls = F.filter(F.regexp_extract_all("_line", F.lit(CALL), F.lit(1)), lambda c: ~c.isin(*NOT_CALLS) & (c != F.regexp_extract("_line", SYMBOL_LINE, 2)))
    kinds = F.concat(
        F.when(F.col("_line").rlike(IMPORT_LINE), F.array(F.struct(F.lit("imports").alias("kind"), F.regexp_extract("_line", IMPORT_LINE, 1).alias("target_name"), file_id.alias("source_id"))))
        .otherwise(F.array().cast("array<struct<kind:string,target_name:string,source_id:string>>")),
        F.when(F.col("_line").rlike(INHERIT_LINE), F.array(F.struct(F.lit("inherits").alias("kind"), F.regexp_extract("_line", INHERIT_LINE, 1).alias("target_name"), owner_id.alias("source_id"))))
        .otherwise(F.array().cast("array<struct<kind:string,target_name:string,source_id:string>>")),
        F.when(F.col("_own").isNotNull(), F.transform(calls, lambda c: F.struct(F.lit("calls").alias("kind"), c.alias("target_name"), owner_id.alias("source_id"))))
        .otherwise(F.array().cast("array<struct<kind:string,target_name:string,source_id:string>>")))
    found = rows.select("file_path", "language", "line_number", F.explode(kinds).alias("r"))
    target_kind = F.when(F.col("r.kind") == "inherits", "class").when(F.col("r.kind") == "imports", "import").otherwise("function")
    return found.select(
        "r.source_id", symbol_id(F.col("language"), F.col("file_path"), F.col("r.target_name"), target_kind).alias("target_id"), "r.kind",
        "file_path", "line_number", "r.target_name")


def symbol_table(found: DataFrame) -> DataFrame:
    """Id per symbol name and per lower-cased name; the last file and line wins."""
    at = F.struct("file_path", "start_line")
    names = found.select(F.explode(F.array_distinct(F.array(F.col("name"), F.lower("name")))).alias("name"), "id", at.alias("_at"))
    return names.groupBy("name").agg(F.max_by("id", F.struct("_at", "id")).alias("id"))


def link_relations(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations with both ends known: target by id, else by its name in the symbol table."""
    ids = nodes.select("id").distinct()
    table = symbol_table(nodes.filter(F.col("kind") != "file"))
    linked = (
        relations.join(shuffled(ids.withColumnRenamed("id", "source_id")), "source_id", "left_semi")
        .join(shuffled(ids.select(F.col("id").alias("target_id"), F.lit(True).alias("_here"))), "target_id", "left")
        .join(shuffled(table.select(F.col("name").alias("target_name"), F.col("id").alias("_named"))), "target_name", "left")
    )
    target = F.when(F.col("_here"), F.col("target_id")).otherwise(F.col("_named"))
    return linked.select("source_id", target.alias("target_id"), "kind").filter(
        F.col("target_id").isNotNull() & (F.col("source_id") != F.col("target_id"))).distinct()


def code_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of ``files(file_path, code)`` in graph form: approved, confidence 1."""
    found = symbols(files)
    nodes = found.unionByName(file_nodes(files))
    relations = link_relations(contains_edges(found).unionByName(text_relations(files)), nodes)
    entities = nodes.groupBy("id").agg(F.max(F.struct("start_line", "name", "kind", "file_path")).alias("n")).select(
        "id", F.col("n.name").alias("canonical_name"), F.concat(F.lit("code."), F.col("n.kind")).alias("entity_type"), F.col("n.file_path").alias("file_path"),
        F.lit(1.0).alias("confidence"), F.lit("approved").alias("review_state"))
    edges = relations.select(
        F.concat_ws(":", "source_id", "kind", "target_id").alias("id"), F.col("source_id").alias("source_entity_id"),
        F.col("target_id").alias("target_entity_id"), F.col("kind").alias("relation_type"), F.lit(1.0).alias("confidence"), F.lit("approved").alias("review_state"))
    return entities, edges


def totals(files: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Files, lines of code, entities and relations of an ingest, as one row."""
    loc = files.agg(F.count("*").alias("files"), F.sum(F.size(lines_of(F.col("code")))).alias("loc"))
    return loc.crossJoin(entities.agg(F.count("*").alias("entities"))).crossJoin(relations.agg(F.count("*").alias("relations")))


def sync_files(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Symbols after some files changed: their old symbols go, including removed ones."""
    fresh = symbols(changed).unionByName(file_nodes(changed))
    paths = changed.select("file_path").distinct()
    return stored.join(shuffled(paths), "file_path", "left_anti").unionByName(fresh)

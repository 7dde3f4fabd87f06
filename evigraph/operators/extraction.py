"""Entities and relations found in text by explicit grammar, sentence patterns and heuristics.

Every extractor returns two tables, ``entities(keys…, name, type, confidence,
position)`` and ``relations(keys…, source, type, target, confidence, position)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.scalars import ascii_name, clamp01, normalize_name
from evigraph.session import cut_lineage
from evigraph.sources.corpus import strip

# The grammar, the heuristics and the sentence patterns.
WORD = r"\p{L}\p{N}_"
ENTITY_GRAMMAR = rf"([A-Z][{WORD} .&'-]*?)\s*\[([A-Za-z][{WORD}-]*)\]"
RELATION_GRAMMAR = r"([^\n;]+?)\s*->\s*([A-Z][A-Z0-9_]*)\s*->\s*([^\n;]+)"
EMAIL = rf"[{WORD}.+-]+@[{WORD}.-]+\.[A-Za-z]{{2,}}"
SKILLS = (
    "FastAPI", "Next.js", "PostgreSQL", "Docker", "Python", "Machine Learning", "LLM", "OCR", "MinIO", "Electron",
    "GitHub Actions", "Neo4j", "Qdrant", "React", "TypeScript",
)
SKILL = r"(?iU)\b(?:" + "|".join(s.replace(".", r"\.") for s in SKILLS) + r")\b"
PHRASE = (
    r"(?U)\b(?:[A-Z][A-Za-zÀ-ÿ0-9&+./'-]*|[A-Z]{2,})(?:\s+(?:[A-Z][A-Za-zÀ-ÿ0-9&+./'-]*|[A-Z]{2,})){1,5}\b"
)
NAME_PART = r"[A-Z][A-Za-z0-9&' -]{1,79}?"
SENTENCES = (
    ("WORKS_AT", "works at", NAME_PART, "Person", "Organization"),
    ("ACQUIRED", "(?:acquired|bought)", NAME_PART, "Organization", "Organization"),
    ("BUILT", "(?:built|developed|created)", NAME_PART, "Person", "Product"),
    ("USES", "(?:use|uses)", r"[A-Z][A-Za-z0-9&' .+-]{1,79}?", "Organization", "Technology"),
)
SENTENCE_CONFIDENCE = 0.85


def _groups(text: Column, pattern: str, *groups: tuple[str, int]) -> Column:
    """All matches of a pattern as an array of structs, one field per group."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for _, g in groups]
    return F.transform(
        F.arrays_zip(*found),
        lambda m: F.struct(*[m[str(i)].alias(name) for i, (name, _) in enumerate(groups)]),
    )


def grammar_entities(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``Name [Type]`` mentions, one per normalised (name, type); the last spelling wins."""
    hits = docs.select(*keys, F.posexplode(_groups(F.col(text), ENTITY_GRAMMAR, ("name", 1), ("type", 2))).alias("position", "m"))
    hits = hits.select(*keys, "position", strip(F.col("m.name")).alias("name"), F.col("m.type").alias("type"))
    return (
        hits.groupBy(*keys, normalize_name(F.col("name")).alias("norm_name"), ascii_name(F.col("type")).alias("norm_type"))
        .agg(F.max_by(F.struct("name", "type"), "position").alias("m"), F.min("position").alias("position"))
        .select(*keys, "m.name", "m.type", "norm_name", "norm_type", F.lit(1.0).alias("confidence"), "position")
    )


def grammar_relations(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``A -> REL -> B`` assertions in text order."""
    hits = docs.select(*keys, F.posexplode(
        _groups(F.col(text), RELATION_GRAMMAR, ("source", 1), ("type", 2), ("target", 3))).alias("position", "m"))
    return hits.select(
        *keys, strip(F.col("m.source")).alias("source"), F.col("m.type").alias("type"), strip(F.col("m.target")).alias("target"),
        F.lit(1.0).alias("confidence"), "position")


def sentence_relations(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Relations asserted by fixed verb phrases, with fixed endpoint types."""
    def matches(kind: str, verb: str, target: str, source_type: str, target_type: str) -> Column:
        pattern = rf"({NAME_PART})\s+{verb}\s+({target})(?=[.!?;]|$)"
        return F.transform(
            _groups(F.col(text), pattern, ("source", 1), ("target", 2)),
            lambda m: F.struct(
                F.lit(kind).alias("type"), m["source"].alias("source"), m["target"].alias("target"),
                F.lit(source_type).alias("source_type"), F.lit(target_type).alias("target_type")))

    parts = [matches(*rule) for rule in SENTENCES]
    hits = docs.select(*keys, F.posexplode(F.concat(*parts)).alias("position", "m"))
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return hits.select(
        *keys, "position", F.col("m.type").alias("type"), tidy(F.col("m.source")).alias("source"),
        tidy(F.col("m.target")).alias("target"), "m.source_type", "m.target_type", F.lit(SENTENCE_CONFIDENCE).alias("confidence"))


def sentence_entities(relations: DataFrame, keys: list[str]) -> DataFrame:
    """Endpoints of sentence relations; a later spelling of a name replaces an earlier one."""
    ends = F.explode(F.array(
        F.struct(F.col("source").alias("name"), F.col("source_type").alias("type"), (2 * F.col("position")).alias("at")),
        F.struct(F.col("target").alias("name"), F.col("target_type").alias("type"), (2 * F.col("position") + 1).alias("at"))))
    return (
        relations.select(*keys, ends.alias("e"))
        .groupBy(*keys, ascii_name(F.col("e.name")).alias("norm_name"), F.col("e.type").alias("type"))
        .agg(F.max_by("e.name", "e.at").alias("name"), F.min("e.at").alias("position"))
        .withColumn("confidence", F.lit(SENTENCE_CONFIDENCE))
    )


def _fold_latin(name: Column) -> Column:
    """Case fold of the phrase alphabet (ASCII and Latin-1 letters)."""
    return F.replace(F.lower(name), F.lit("ß"), F.lit("ss"))


def heuristic_entities(docs: DataFrame, keys: list[str], text: str = "text", phrase_stop: int | None = None) -> DataFrame:
    """Contacts, skills and capitalised phrases of texts without typed entities.

    Works on arrays inside the row of the text, so nothing is shuffled. Phrases
    are taken until the number of entities reaches ``phrase_stop`` (None: all),
    which is tested after each accepted phrase.
    """
    body = F.col(text)
    typed = F.regexp_like(body, F.lit(ENTITY_GRAMMAR))
    emails = F.regexp_extract_all(body, F.lit(EMAIL), F.lit(0))
    skills = F.regexp_extract_all(body, F.lit(SKILL), F.lit(0))
    phrases = F.filter(
        F.transform(F.regexp_extract_all(body, F.lit(PHRASE), F.lit(0)), lambda p: F.regexp_replace(p, r"(?U)\s+", " ")),
        lambda p: F.length(p).between(4, 80))
    rows = docs.filter(~typed).select(*keys, emails.alias("_emails"), skills.alias("_skills"), phrases.alias("_phrases"))

    def last_of(names: str, fold) -> Column:
        folded = F.transform(names, fold)
        return F.transform(F.array_distinct(folded), lambda k: F.struct(
            F.element_at(F.col(names), (F.size(folded) - F.array_position(F.reverse(folded), k) + 1).cast("int")).alias("name"),
            k.alias("norm_name")))

    rows = rows.withColumn("_contacts", last_of("_emails", lambda v: ascii_name(v))).withColumn(
        "_abilities", last_of("_skills", lambda v: ascii_name(v)))
    base = F.size("_contacts") + F.size("_abilities")
    folded = F.transform("_phrases", _fold_latin)
    taken = F.array_distinct(folded)
    if phrase_stop is not None:
        taken = F.slice(taken, F.lit(1), F.greatest(F.lit(1), F.lit(phrase_stop) - base))
    named = F.transform(taken, lambda k: F.struct(
        F.element_at(F.col("_phrases"), F.array_position(folded, k).cast("int")).alias("name"), k.alias("norm_name")))

    def typed_rows(items: Column, kind: str, confidence: float) -> Column:
        return F.transform(items, lambda m: F.struct(
            m["name"].alias("name"), m["norm_name"].alias("norm_name"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence")))

    found = F.concat(
        typed_rows(F.col("_contacts"), "Contact", 0.7), typed_rows(F.col("_abilities"), "Skill", 0.7),
        typed_rows(named, "Entity", 0.6))
    return rows.select(*keys, F.posexplode(found).alias("position", "m")).select(
        *keys, "position", "m.name", "m.norm_name", "m.type", "m.confidence")


# Stored extraction payloads ----------------------------------------------

_ITEM = "array<variant>"


def _text_of(item: Column, *fields: str) -> Column:
    """First field that holds non-blank text."""
    picks = []
    for f in fields:
        raw = F.try_variant_get(item, f"$.{f}", "variant")
        value = F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(item, f"$.{f}", "string"))
        picks.append(F.when(strip(value) != "", value))
    return F.coalesce(*picks)


def _texts_of(item: Column, field: str) -> Column:
    """The items of a list that are text."""
    listed = F.coalesce(F.try_variant_get(item, f"$.{field}", _ITEM), F.array().cast(_ITEM))
    return F.transform(F.filter(listed, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))


def _confidence_of(item: Column) -> Column:
    raw = F.try_variant_get(item, "$.confidence", "variant")
    numeric = F.regexp_like(F.schema_of_variant(raw), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"))
    return F.coalesce(F.when(numeric, clamp01(F.try_variant_get(item, "$.confidence", "double"))), F.lit(0.8))


def payload_object(content: Column) -> Column:
    """The JSON object in a stored answer: fences removed, else the outermost braces."""
    bare = strip(content)
    bare = F.when(bare.startswith("```"), F.regexp_replace(F.regexp_replace(bare, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(bare)
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0)))


def payload_tables(docs: DataFrame, keys: list[str], content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Entities and relations of stored answers, with field aliases and ids resolved to names."""
    parsed = docs.select(*keys, payload_object(F.col(content)).alias("_doc")).filter(F.col("_doc").isNotNull())

    def items(*names: str) -> Column:
        lists = [F.try_variant_get("_doc", f"$.{n}", _ITEM) for n in names]
        return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])

    entity = F.transform(items("entities", "nodes"), lambda i: F.struct(
        _text_of(i, "name", "label", "id").alias("name"), F.coalesce(_text_of(i, "type"), F.lit("Entity")).alias("type"),
        _confidence_of(i).alias("confidence"), _text_of(i, "id").alias("id"), _texts_of(i, "aliases").alias("aliases")))
    known = F.filter(entity, lambda e: e["name"].isNotNull())
    staged = parsed.withColumn("_entities", F.coalesce(known, F.array().cast("array<struct<name:string,type:string,confidence:double,id:string,aliases:array<string>>>")))
    entities = staged.select(*keys, F.posexplode("_entities").alias("position", "e")).select(
        *keys, "position", "e.name", "e.type", "e.confidence", "e.aliases")

    def name_of(ref: Column) -> Column:
        named = F.filter("_entities", lambda e: e["id"] == ref)
        # A repeated id keeps its last name.
        return F.coalesce(F.try_element_at(named, F.lit(-1))["name"], ref)

    relation = F.transform(items("relations", "edges"), lambda i: F.struct(
        _text_of(i, "source", "from").alias("source"), _text_of(i, "target", "to").alias("target"),
        _text_of(i, "type", "relation").alias("type"), _confidence_of(i).alias("confidence"),
        _text_of(i, "source_type").alias("source_type"), _text_of(i, "target_type").alias("target_type"),
        _text_of(i, "quote").alias("quote")))
    whole = F.filter(relation, lambda r: r["source"].isNotNull() & r["target"].isNotNull() & r["type"].isNotNull())
    relations = staged.select(*keys, "_entities", F.posexplode(whole).alias("position", "r")).select(
        *keys, "position", name_of(F.col("r.source")).alias("source"), name_of(F.col("r.target")).alias("target"),
        "r.type", "r.confidence", "r.source_type", "r.target_type", "r.quote")
    return entities, relations


def deterministic(docs: DataFrame, keys: list[str], text: str = "text", phrase_stop: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of all fixed rules: the grammar, and contacts, skills and phrases where no entity is typed."""
    columns = [*keys, "name", "type", "confidence"]
    entities = grammar_entities(docs, keys, text).select(*columns).unionByName(heuristic_entities(docs, keys, text, phrase_stop).select(*columns))
    return entities, grammar_relations(docs, keys, text).select(*keys, "source", "type", "target", "confidence")


def extract(
    docs: DataFrame, keys: list[str], content: str = "content", text: str = "text", phrase_stop: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Entities and relations per document with ``extraction_source``.

    A stored answer counts if it holds anything; else the fixed rules speak for
    the document, whether the answer is no JSON object or an empty one.
    """
    entities, relations = payload_tables(docs, keys, content)
    entities = entities.select(*keys, "name", "type", "confidence", "aliases", F.lit("answer").alias("extraction_source"))
    relations = relations.select(*keys, "source", "type", "target", "confidence", F.lit("answer").alias("extraction_source"))
    answered = cut_lineage(entities.select(*keys).unionByName(relations.select(*keys)).distinct())
    silent = docs.join(answered, keys, "left_anti")
    found, links = deterministic(silent, keys, text, phrase_stop)
    rules = F.lit("rules").alias("extraction_source")
    return (entities.unionByName(found.select("*", F.array().cast("array<string>").alias("aliases"), rules)),
            relations.unionByName(links.select("*", rules)))


def resolve_candidates(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions matched to the one entity with the same normalised name and type in the dataset."""
    keyed = entities.select(
        "dataset_id", normalize_name(F.col("canonical_name")).alias("norm_name"),
        normalize_name(F.col("entity_type")).alias("norm_type"), "id")
    unique = keyed.groupBy("dataset_id", "norm_name", "norm_type").agg(F.count("*").alias("_n"), F.min("id").alias("entity_id"))
    return (
        mentions.withColumn("norm_name", normalize_name(F.col("name"))).withColumn("norm_type", normalize_name(F.col("type")))
        .join(unique.filter("_n = 1").drop("_n"), ["dataset_id", "norm_name", "norm_type"], "left")
    )

import random

from pyspark.sql import functions as F

from evigraph.operators import communities as C
from evigraph.operators import construction as B
from evigraph.operators import extraction as E
from evigraph.operators import lifecycle as L
from evigraph.operators import measures as M
from evigraph.operators import predicates as P
from evigraph.operators import queries as Q
from evigraph.operators import ranking as R
from evigraph.operators import walk as Wk
from evigraph.plans.graph import current_graph
from evigraph.plans.inputs import DERIVED, Inputs

DOCS = [
    ("d1", "Nova Labs [Company]\nMira Stone [Person]\nNova Labs -> EMPLOYS -> Mira Stone"),
    ("d2", "Mira Stone [Person]; Comet [Project]\nMira Stone -> LEADS -> Comet"),
    ("d3", "Sam [Person]\nSam [Team]\nSam -> LEADS -> Sam"),
    ("d4", "NOVA  LABS [Company]"),
]


def built(spark, loose=True):
    chunks = spark.createDataFrame([(d, "p", "ds", d, 0, t) for d, t in DOCS],
                                   "chunk_id string, project_id string, dataset_id string, document_id string, chunk_index int, text string")
    mentions = E.grammar_entities(chunks, ["chunk_id"]).select("chunk_id", "name", "type", "confidence", "position")
    entities, ev, placed = B.persist_entities(mentions, chunks, "x", loose)
    relations, rev, resolved = B.persist_relations(E.grammar_relations(chunks, ["chunk_id"]), placed, chunks, "x", loose)
    return entities, ev, relations, rev, resolved


def test_cross_document_entities_and_ambiguity(spark):
    entities, ev, relations, rev, resolved = built(spark)
    names = {(r.canonical_name, r.entity_type) for r in entities.collect()}
    assert names == {("Nova Labs", "Company"), ("Mira Stone", "Person"), ("Comet", "Project"), ("Sam", "Person"), ("Sam", "Team")}
    assert {r.relation_type for r in relations.collect()} == {"EMPLOYS", "LEADS"}
    assert [r.skip_reason for r in resolved.filter("chunk_id = 'd3'").collect()] == ["missing_or_ambiguous_endpoint"]
    docs = {r.canonical_name: r.document_count for r in B.entity_documents(ev).join(entities, F.col("entity_id") == F.col("id")).collect()}
    assert docs["Nova Labs"] == 2 and docs["Comet"] == 1
    text = dict(DOCS)
    assert all(text[r.chunk_id][r.start_offset:r.end_offset] == r.quote for r in ev.collect())
    assert rev.count() == 2


def test_same_ids_on_shuffled_input(spark):
    a = {r.id for r in built(spark)[0].collect()}
    random.Random(1).shuffle(DOCS)
    assert a == {r.id for r in built(spark)[0].collect()}


def test_garbage_collection(spark):
    ent = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    rel = spark.createDataFrame([("r1", "a", "b"), ("r2", "b", "c"), ("r3", "e", "f")], "id string, source_entity_id string, target_entity_id string")
    ev = spark.createDataFrame(
        [("v1", "gone", "r1", None), ("v2", "gone", "r2", None), ("v3", "kept", "r2", None), ("v4", "gone", None, "d"), ("v5", "gone", "r3", None), ("v6", "kept", None, "e"), ("v7", "gone", None, "g")],
        "id string, document_id string, relation_id string, entity_id string")
    aliases = spark.createDataFrame([("al1", "a", "A1"), ("al2", "e", "E1"), ("al3", "g", "G1")], "alias_id string, entity_id string, alias string")
    links = spark.createDataFrame([("al3", "v7")], "alias_id string, evidence_id string")
    merges = spark.createDataFrame([("f", "c"), ("a", "d")], "source_entity_id string, target_entity_id string")
    dead = L.collect_garbage(spark.createDataFrame([("gone",)], "document_id string"), ent, rel, ev, aliases, merges, links)
    assert {r.id for r in dead["relations"].collect()} == {"r1", "r3"}
    # a, d and g lost everything; f did too but was merged with c, which survives.
    assert {r.id for r in dead["entities"].collect()} == {"a", "d", "g"}
    assert {(r.entity_id, r.alias) for r in dead["aliases"].collect()} == {("a", "A1"), ("g", "G1")}
    assert {(r.source_entity_id, r.target_entity_id) for r in dead["merges"].collect()} == {("a", "d")}


def graph(spark, edges, entities=None):
    ids = sorted({x for e in edges for x in e[1:3]} | set(entities or ()))
    ent = spark.createDataFrame([(i, i.upper(), "T", 1.0, "approved", None, None) for i in ids],
                                "id string, canonical_name string, entity_type string, confidence double, review_state string, valid_until timestamp, superseded_by string")
    rel = spark.createDataFrame([(i, a, b, w, "approved", None, None) for i, a, b, w in edges],
                                "id string, source_entity_id string, target_entity_id string, confidence double, review_state string, valid_until timestamp, superseded_by string")
    ev = spark.createDataFrame([], "id string, document_id string, chunk_id string, entity_id string, relation_id string, confidence double")
    return ent, rel, ev


def test_walk_limits_and_paths(spark):
    edges = [("r1", "a", "b", 1.0), ("r2", "a", "c", 1.0), ("r3", "d", "a", 1.0), ("r4", "b", "e", 1.0), ("r5", "c", "e", 1.0), ("r6", "e", "f", 1.0)]
    ent, rel, ev = graph(spark, edges)
    roots = spark.createDataFrame([("q", "a")], "query_id string, root string")
    e = Wk.walk_edges(*P.supported_graph(ent, rel, ev))
    nodes, rels = Wk.bounded_walk(roots, e, 3, 200, 100)
    assert {r.node: r.path_relations for r in nodes.collect()} == {
        "a": [], "b": ["r1"], "c": ["r2"], "d": ["r3"], "e": ["r1", "r4"], "f": ["r1", "r4", "r6"]}
    assert {r.relation_id for r in rels.collect()} == {f"r{i}" for i in range(1, 7)}
    nodes, rels = Wk.bounded_walk(roots, e, 2, 3, 100)
    assert {r.node for r in nodes.collect()} == {"a", "b", "c"} and {r.relation_id for r in rels.collect()} == {"r1", "r2"}
    nodes, rels = Wk.bounded_walk(roots, e, 2, 200, 4)
    assert {r.relation_id for r in rels.collect()} == {"r1", "r2", "r3", "r4"}


def test_communities(spark):
    pair = [("r1", "a", "b", 1.0), ("r2", "b", "c", 1.0), ("r3", "a", "c", 1.0), ("r4", "x", "y", 1.0), ("r5", "y", "z", 1.0), ("r6", "x", "z", 1.0), ("r7", "c", "x", 0.1)]
    ent, rel, _ = graph(spark, pair, ["lone"])
    members, edges = C.hierarchy(ent, rel)
    got = {}
    for r in members.collect():
        got.setdefault(r.level, {}).setdefault(r.community_id, set()).add(r.entity_id)
    assert sorted(map(sorted, got[0].values())) == [["a", "b", "c"], ["lone"], ["x", "y", "z"]]
    for level in (1, 2):
        assert all(any(low <= high for high in got[level].values()) for low in got[level - 1].values())
        assert {"lone"} in got[level].values()
    again = {(r.entity_id, r.level, r.community_id) for r in C.hierarchy(ent.orderBy(F.desc("id")), rel.orderBy(F.desc("id")))[0].collect()}
    assert again == {(r.entity_id, r.level, r.community_id) for r in members.collect()}
    base = members.filter("level = 0").select(F.col("entity_id").alias("id"), "community_id")
    alone = base.withColumn("community_id", F.col("id"))
    assert C.modularity(edges, base).first()[0] > max(0.0, C.modularity(edges, alone).first()[0])


def test_a_round_asks_only_the_nodes_with_a_turn(spark, monkeypatch):
    ids = [str(i) for i in range(40)]
    pairs = [(str(i), str(j), 1.0 + (i * j) % 3) for i in range(40) for j in range(i + 1, 40) if (i * 7 + j * 3) % 11 == 0]
    nodes, edges = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "a string, b string, weight double")
    rounds, plain = [], C._wishes

    def seen(links, placed, total, resolution, step, turn):
        got = plain(links, placed, total, resolution, step, turn)
        rounds.append(({r.n: (r.k, r.c) for r in placed.collect()}, [tuple(r) for r in links.select("src", "dst", "w").collect()], total, got.collect(),
                       {r.n for r in placed.where(C._has_turn("coin", step) == F.lit(turn)).collect()}))
        return got

    monkeypatch.setattr(C, "_wishes", seen)
    C.detect(nodes, edges, 1.0, max_rounds=2).collect()
    state, links, total, got, asked = rounds[1]
    assert {r.n for r in got} == asked and 0 < len(asked) < len(state)
    size, mass = {}, {}
    for k, c in state.values():
        size[c], mass[c] = size.get(c, 0) + 1, mass.get(c, 0) + k
    for r in got:
        k, own = state[r.n]
        w = {own: 0}
        for a, b, x in links:
            if a == r.n:
                w[state[b][1]] = w.get(state[b][1], 0) + x
        score = {c: x - k * (mass[c] - (k if c == own else 0)) / total for c, x in w.items() if c == own or size[c] > 1 or size[own] > 1 or c < own}
        best = min(score, key=lambda c: (-score[c], c))
        assert r.c == (best if score[best] > score[own] + 1e-6 else own)


def test_refresh_skips_known_graph(spark, tmp_path):
    ent, rel, _ = graph(spark, [("r1", "a", "b", 1.0), ("r2", "c", "d", 1.0)])
    store = str(tmp_path / "analytics")
    assert C.refresh(spark, store, "p", "ds", ent, rel)
    assert not C.refresh(spark, store, "p", "ds", ent, rel)
    assert spark.read.parquet(f"{store}/memberships").count() == 12
    assert C.refresh(spark, store, "p", "ds", ent, rel.filter("id = 'r1'"))
    assert spark.read.parquet(f"{store}/runs").count() == 2


def test_sequence_in_group_with_hot_key(spark):
    rows = [("hot", i * 7 % 1000, i) for i in range(1000)] + [("cold", 5, 5000)]
    df = spark.createDataFrame(rows, "k string, t int, i int")
    got = R.sequence_in_group(df, ["k"], F.floor(F.col("t") / 50), [F.col("t"), F.col("i")]).collect()
    want = {r: n for k in ("hot", "cold") for n, r in enumerate(sorted((x for x in rows if x[0] == k), key=lambda x: x[1:]), 1)}
    assert {(r.k, r.t, r.i): r.sequence for r in got} == want


def test_digest_ignores_order(spark):
    ent, rel, _ = graph(spark, [("r1", "a", "b", 1.0), ("r2", "c", "d", 0.5)])
    one = M.graph_digest(ent, rel).first()
    assert one == M.graph_digest(ent.orderBy(F.desc("id")), rel.orderBy(F.desc("id"))).first()
    assert one.snapshot_hash != M.graph_digest(ent, rel.limit(1)).first().snapshot_hash


def test_a_node_without_early_turns_still_moves(spark):
    ids = spark.range(0, 8_000_000, 1, 16)
    late = ids.where(" AND ".join(f"pmod(xxhash64(xxhash64(id), {k}), 2) <> 0" for k in range(20))).limit(3).collect()
    assert late  # only the larger of two lone nodes may move, and these had no turn in rounds 0 to 19
    for node in late:
        nodes = spark.createDataFrame([(-1,), (node.id,)], "id bigint")
        edges = spark.createDataFrame([(-1, node.id, 1.0)], "a bigint, b bigint, weight double")
        assert {r.community_id for r in C.detect(nodes, edges, 1.0, tolerance=0.0).collect()} == {-1}


def test_equal_weights_are_ordered_by_id(spark):
    from evigraph.operators import queries as Q

    rows = [("a", 0.3 + 0.2 + 0.1), ("b", 0.1 + 0.2 + 0.3), ("c", 0.61)]
    assert rows[1][1] > rows[0][1]
    nodes = spark.createDataFrame(rows, "id string, weighted_degree double")
    assert [r.id for r in Q.most_important(nodes, 2).collect()] == ["c", "a"]


def test_only_supported_relations_and_needed_columns_are_written(spark):
    ent, rel, _ = graph(spark, [("r1", "a", "b", 1.0), ("r2", "b", "c", 1.0), ("r3", "c", "d", 1.0)])
    rel = rel.withColumn("review_state", F.when(F.col("id") == "r3", "approved").otherwise("unreviewed"))
    ev = spark.createDataFrame([("r1",)], "relation_id string")
    people, links = P.supported_graph(ent.withColumn("review_state", F.lit("unreviewed")), rel, ev, ("confidence",))
    stored = spark.read.parquet(*links.inputFiles())  # r2 is neither cited nor approved; r3 is, but backs no entity
    assert {r.id for r in stored.collect()} == {r.id for r in links.collect()} == {"r1", "r3"}
    assert set(links.columns) == {"id", "source_entity_id", "target_entity_id", "review_state", "confidence"}
    assert {r.id for r in people.collect()} == {"a", "b"}


def test_evidence_for_spark_equals_its_check(spark):
    t = Inputs(spark, "/root/testdata/sf0.001")
    mine = t.g_evidence_unique
    t.g_evidence.createOrReplaceTempView("g_evidence")
    plain = spark.sql(DERIVED["g_evidence_unique"][0])
    assert mine.schema == plain.schema and mine.count() == plain.count() > 5000
    assert mine.exceptAll(plain).isEmpty()
    exchanges = mine._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(document_id")
    assert exchanges == 0


def test_a_summary_looks_up_its_own_relations_only(spark, monkeypatch):
    t = Inputs(spark, "/root/testdata/sf0.001")
    people, links = current_graph(t)
    nodes = Q.ranked_summary(people, links, 100)
    seen, plain = [], Q.with_citations

    def counting(relations, evidence, *rest):
        seen.append((relations.count(), evidence.count()))
        return plain(relations, evidence, *rest)

    monkeypatch.setattr(Q, "with_citations", counting)
    judged = Q.summary_relations(nodes, links, t.g_evidence_unique, t.g_chunks, 100, supported=True).orderBy("id").collect()
    whole = Q.summary_relations(nodes, t.g_relations, t.g_evidence_unique, t.g_chunks, 100).orderBy("id").collect()
    assert judged == whole and len(whole) > 20 and Q.summary_relations(nodes, links, t.g_evidence_unique, t.g_chunks, depth=0).isEmpty()
    assert all(e < t.g_evidence_unique.count() / 2 for _, e in seen)


def test_garbage_marks_are_written_once(spark):
    ent = spark.createDataFrame([(x,) for x in "abc"], "id string")
    rel = spark.createDataFrame([("r1", "a", "b"), ("r2", "b", "c"), ("r3", "a", "c")], "id string, source_entity_id string, target_entity_id string")
    ev = spark.createDataFrame([("e1", "gone", None, "r1"), ("e2", "gone", None, "r2"), ("e3", "kept", None, "r2")],
                               "id string, document_id string, entity_id string, relation_id string")
    gone = spark.createDataFrame([("gone",)], "document_id string")
    aliases = spark.createDataFrame([], "entity_id string, alias string")
    merges = spark.createDataFrame([], "source_entity_id string, target_entity_id string")
    dead = {only: L.collect_garbage(gone, ent, rel, ev, aliases, merges, cited_only=only) for only in (False, True)}
    ids = lambda df: sorted(r["id"] for r in df.collect())
    for tables in dead.values():
        assert ids(tables["evidence"]) == ["e1", "e2"] and ids(tables["relations"]) == ["r1"]
        for name in ("evidence", "relations"):  # read off the marks, not derived and joined again
            assert "Join" not in tables[name]._jdf.queryExecution().optimizedPlan().toString()
    # r3 has no evidence: it holds its entities unless only cited relations count
    assert ids(dead[False]["entities"]) == [] and ids(dead[True]["entities"]) == ["a"]


def test_citation_places_travel_as_numbers(spark):
    ev = spark.createDataFrame([("e1", "r1", "d", "c1", "q1"), ("e2", "r1", "d", "c2", "q2")], "id string, relation_id string, document_id string, chunk_id string, quote string")
    chunks = spark.createDataFrame([("c1", '{"record_number": 3, "page_number": "x"}'), ("c2", "no json")], "id string, metadata string")
    cited = Q.citations(ev, chunks.hint("merge"))
    got = {r["id"]: r["source_location"] and r["source_location"]["record_number"] for r in cited.collect()}
    assert got == {"e1": 3, "e2": None}
    above = cited._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "metadata" not in above


def test_closed_communities_are_set_aside(spark, monkeypatch):
    # Cliques of one to five nodes beside a ring of cliques: the same result with and without setting closed communities
    # aside and with and without the rounds of one task, and later rounds read fewer and fewer nodes.
    edges = [(g * 10 + i, g * 10 + j, 1.0) for g in range(100) for i in range(g % 5 + 1) for j in range(i)]
    ring = [(9000 + 10 * g + i, 9000 + 10 * g + j, 1.0) for g in range(12) for i in range(4) for j in range(i)]
    ring += [(9000 + 10 * g, 9000 + 10 * ((g + 1) % 12) + 1, 1.0) for g in range(12)]
    ids = sorted({x for a, b, _ in edges + ring for x in (a, b)} | {g * 10 for g in range(100)})
    for kind, name in (("string", lambda x: f"n{x:06d}"),):
        nodes = spark.createDataFrame([(name(i),) for i in ids], f"id {kind}")
        links = spark.createDataFrame([(name(a), name(b), w) for a, b, w in edges + ring], f"a {kind}, b {kind}, weight double")
        got, asked, plain = {}, {}, C._wishes
        for apart, small in ((10**9, 0), (50, 0), (50, 300)):
            seen = asked[apart, small] = []
            monkeypatch.setattr(C, "APART", apart)
            monkeypatch.setattr(C, "SMALL", small)
            monkeypatch.setattr(C, "_wishes", lambda links, placed, *rest: seen.append(placed.count()) or plain(links, placed, *rest))
            got[apart, small] = sorted(map(tuple, C.detect(nodes, links, 1.0, tolerance=0.0).collect()))
            monkeypatch.setattr(C, "_wishes", plain)
        whole = got.pop((10**9, 0))
        assert all(other == whole for other in got.values()) and len(whole) == len(ids)
        assert min(asked[50, 0]) < len(ids) / 4 < max(asked[50, 0]) and len(asked[50, 300]) < len(asked[50, 0])
        cliques = {i: c for i, c in whole if i < name(9000)}
        assert all(c == name(min(j for j in ids if j // 10 == int(str(i).lstrip("n")) // 10)) for i, c in cliques.items())


def test_a_query_without_room_is_not_asked_again(spark, monkeypatch):
    # q is full after one level; of r's second level only what it has left, beyond walked relations, may reach the ranking.
    edges = [(f"a{i}", "a", f"x{i}", 1.0) for i in range(6)] + [(f"b{i}{j:02d}", f"x{i}", f"y{i}{j}", 1.0) for i in range(6) for j in range(30)]
    edges += [("a9", "a", "a", 1.0), ("c1", "b", "x0", 1.0), ("c2", "b", "b", 1.0), ("c3", "b", "b", 1.0), ("c4", "b", "b", 1.0)]
    ent, rel, ev = graph(spark, edges)
    people, links = P.supported_graph(ent, rel, ev)
    roots = spark.createDataFrame([("q", "a"), ("r", "b")], "query_id string, root string")
    ranked, plain = [], Wk.top_n_per_group

    def counting(df, *rest):
        ranked.append({r["query_id"]: r["count"] for r in df.groupBy("query_id").count().collect()} if "query_id" in df.columns else None)
        return plain(df, *rest)

    monkeypatch.setattr(Wk, "top_n_per_group", counting)
    nodes, rels = Wk.bounded_walk(roots, Wk.both_ends(links), 2, 200, 6, Wk.may_enter(people))
    got = {q: sorted(r["relation_id"] for r in rels.where(F.col("query_id") == q).collect()) for q in "qr"}
    assert got == {"q": [f"a{i}" for i in range(6)], "r": ["a0", "b000", "c1", "c2", "c3", "c4"]}
    assert all(counts is None or counts.get("r", 0) <= 6 for counts in ranked) and "q" not in ranked[2]
    whole = Wk.bounded_walk(roots, Wk.walk_edges(people, links), 2, 200, 6)
    assert sorted(map(str, whole[0].collect())) == sorted(map(str, nodes.collect()))
    assert sorted(map(str, whole[1].collect())) == sorted(map(str, rels.collect()))


def test_a_traversal_writes_no_quotes_and_deals_edges_once(spark, monkeypatch):
    edges = [(f"r{i:02d}", "a", f"x{i}", 1.0 - i / 100) for i in range(40)] + [("s", "x0", "y", 0.5), ("t", "a", "a", 0.99)]
    ent, rel, _ = graph(spark, edges)
    ev = spark.createDataFrame([(f"e{i}", "d", f"c{i}", None, r[0], f"quote {i}", r[3]) for i, r in enumerate(edges)],
                               "id string, document_id string, chunk_id string, entity_id string, relation_id string, quote string, confidence double")
    written, plain = [], Wk.cut_lineage

    def seen(df):
        written.append((set(df.columns), df.count()))
        return plain(df)

    monkeypatch.setattr(Wk, "cut_lineage", seen)
    names = spark.createDataFrame([("q", "A")], "query_id string, name string")
    chunks = spark.createDataFrame([("q", "c41")], "query_id string, chunk_id string")
    got = Wk.evidence_traversal(chunks, names, ent, rel, ev, 2, 2, 20).collect()
    assert not any({"quote", "document_id"} & columns for columns, _ in written)
    lists = [n for columns, n in written if "from_source" in columns]
    assert lists == [len(ent.collect()) + 3 + 2]  # one table of lists: a has r00, r01, r02 and t from both ends
    # First level r00 and r01 (two relations for the one seed), second level s beside x0; e41 is the chunk's own.
    assert sorted(r["id"] for r in got) == ["e0", "e1", "e40", "e41"]


def test_neighbours_of_citations_are_found_once(spark, monkeypatch):
    edges = [(f"r{i:02d}", "hub", f"x{i}", 1.0) for i in range(40)]
    ent, rel, _ = graph(spark, edges)
    rel = rel.withColumn("relation_type", F.lit("T"))
    ev = spark.createDataFrame([(f"e{i}", "d", f"c{i}", None, r[0], f"quote {i}", 1.0) for i, r in enumerate(edges)],
                               "id string, document_id string, chunk_id string, entity_id string, relation_id string, quote string, confidence double")
    chunks = ev.select(F.col("chunk_id").alias("id"), F.lit("{}").alias("metadata"))
    near = Q.neighbours(ent.where("id <> 'x3'").select(F.col("id").alias("root")), ent, rel, ev, 5)
    assert sorted((r["root"], r["rank"]) for r in near.collect()) == sorted([("hub", k) for k in range(1, 6)] + [(f"x{i}", 1) for i in range(40) if i != 3])
    cited = Q.neighbour_citations(near, ev, chunks)
    assert cited.count() == 44 and {r["citations"][0]["quote"] for r in cited.where("root = 'hub'").collect()} == {f"quote {i}" for i in range(5)}
    # The names travel with shown neighbours only, and the neighbours are read, not found again, for the citations.
    plan = cited._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and plan.count("canonical_name") and "row_number() windowspecdefinition(node" not in plan

"""Merkle manifest, benchmark decontamination and prefix trie against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evigraph.llm import decontamination, merkle, numbering, prefix_trie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def crc(number):
    return zlib.crc32(str(number).encode())


# --- Merkle manifest


def plain_tree(nodes):
    """The root and, per leaf, (run, slot) of every level."""
    paths, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[i:i + 16] for i in range(0, len(nodes), 16)]
        for r, run in enumerate(runs):
            for slot in range(len(run)):
                for leaf in below[16 * r + slot]:
                    paths[leaf].append((run, slot))
        below = [sum(below[16 * r:16 * r + 16], []) for r in range(len(runs))]
        nodes = [sha(*run) for run in runs]
    return nodes[0] if nodes else None, paths


def plain_manifest(rows):
    def leaf(r, text):
        values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    by_source = defaultdict(list)
    for r in rows:
        tampered = None
        if r["doc_id"] is not None and crc(r["doc_id"]) % 5 == 0:
            tampered = leaf(r, r["text"] and r["text"].translate(LOWER))
        by_source[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), tampered))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in sources]
    root, upper = plain_tree([t[0] for t in trees])
    out = []
    for s, (subroot, paths), top in zip(sources, trees, upper):
        for (known, doc_id, own, tampered), path in zip(sorted(by_source[s], key=lambda x: x[:3]), paths):
            path, folded = path + top, tampered or own
            for run, slot in path:
                folded = sha(*run[:slot], folded, *run[slot + 1:])
            proof = sha(*[n for run, slot in path for i, n in enumerate(run) if i != slot])
            out.append((doc_id if known else None, own, subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def leaf_docs(spark):
    """A hot source, many small ones, a null and an empty one; repeated ids and rows; null fields."""
    rng = random.Random(3)
    rows = []
    for _ in range(700):
        source = "hot" if rng.random() < 0.45 else rng.choice([None, "", "Hot", "é", "z"] + [f"s{i}" for i in range(40)])
        rows.append((rng.choice([None] + list(range(300))), rng.choice(["Text", "text", "", None, "É日本"]), rng.choice(["en", None]), source, rng.choice([1, None])))
    return spark.createDataFrame(rows + rows[:5], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("local", [1, 2, 3])
def test_manifest_equals_plain_tree(leaf_docs, local):
    got = sorted((tuple(r) for r in merkle.verified(leaf_docs, local).collect()), key=repr)
    assert got == plain_manifest([r.asDict() for r in leaf_docs.collect()])
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_odd_tables(odd_docs, no_docs):
    got = merkle.verified(odd_docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_manifest([r.asDict() for r in odd_docs.collect()])
    assert merkle.verified(no_docs).count() == 0
    one = merkle.manifest(merkle.document_leaves(odd_docs.limit(1))).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["path"] == []


def test_every_block_receives_its_whole_runs(leaf_docs):
    rows = merkle.manifest(merkle.document_leaves(leaf_docs), local=1).collect()
    assert all(step["nodes"][step["slot"]] for r in rows for step in r["path"])
    assert all(None not in step["nodes"] and len(step["nodes"]) <= merkle.FANOUT for r in rows for step in r["path"])


def test_places_do_not_depend_on_partitions(spark):
    rows = spark.range(2000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("o")).union(spark.range(50).select(F.lit(None).alias("g"), F.lit(1).alias("o")))
    table = numbering.sorted_parts(rows, ["g"], ["o"])
    got = numbering.placed(table, numbering.group_runs(table, ["g"]), ["g"]).collect()
    by_group = defaultdict(list)
    for r in got:
        by_group[r["g"]].append((r["pos"], r["o"]))
    for held in by_group.values():
        assert [p for p, _ in sorted(held)] == list(range(len(held)))
        assert [o for _, o in sorted(held)] == sorted(o for _, o in held)


# --- decontamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_contamination(docs, items, window):
    windows = defaultdict(set)
    for r in items:
        w = plain_words(r["text"])
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            windows[tuple(w[i:i + window])].add(r["item_id"])
    out = []
    for r in docs:
        w, hit, found = plain_words(r["text"]), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                ids = windows.get(tuple(w[i:i + n]))
                if ids:
                    hit |= set(range(i, i + n))
                    found |= ids
        out.append((r["doc_id"], len(w), len(hit), tuple(sorted(str(i) for i in found if i is not None)), len(found)))
    return sorted(out, key=repr)


def found_rows(docs, items, **how):
    got = decontamination.contamination(docs, items, **how)
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["n_items"]) for r in got.collect()), key=repr)


@pytest.mark.parametrize("window,shingle", [(10, 5), (3, 2), (4, 5), (1, 1)])
def test_contamination_equals_plain_search(spark, window, shingle):
    rng = random.Random(window)
    word = lambda: rng.choice(["a", "B", "c9", "é", "d"])
    texts = [rng.choice([" ", "\n", "--", "\x00", "_"]).join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 40]))) for _ in range(60)]
    items = [(rng.choice([None] + list(range(20))), rng.choice(texts + [None, "", "!!"])) for _ in range(40)]
    docs = [(i % 50 or None, t + " " + rng.choice(texts)) for i, t in enumerate(texts)] + [(7, None), (8, ""), (9, texts[3]), (9, texts[3])]
    docs = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(1).alias("words"), F.lit(2).alias("h"), F.lit(3).alias("item_id"))
    items = spark.createDataFrame(items + items[:3], "item_id long, text string").withColumn("doc_id", F.lit("x"))
    want = plain_contamination(docs.collect(), items.collect(), window)
    assert found_rows(docs, items, window=window, shingle=shingle) == want
    assert any(r[2] for r in want)


def test_contamination_of_odd_tables(spark, odd_docs, no_docs):
    passage = "small boats carry Green stones, quiet; water under old birds and light"
    items = spark.createDataFrame([(1, passage), (2, passage.upper()), (10, "two words"), (3, None), (4, "")], "item_id long, text string")
    docs = odd_docs.withColumn("text", F.when(F.col("doc_id") == 11, F.concat("text", F.lit(" " + passage))).otherwise(F.col("text")))
    got = found_rows(docs, items)
    assert got == plain_contamination(docs.collect(), items.collect(), 10)
    by_id = {r[0]: r for r in got}
    assert by_id[11][2:] == (12, ("1", "2"), 2) and by_id[10][2:] == (2, ("10",), 1) and by_id[1][2] == 0
    assert found_rows(no_docs, items) == []
    assert all(r[2] == 0 for r in found_rows(docs, items.where("false")))


def test_contamination_stays_in_the_jvm(spark, odd_docs):
    items = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    plan = decontamination.contamination(odd_docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# --- prefix trie


def plain_trie(rows):
    own = defaultdict(list)
    for r in rows:
        if r["conv_id"] is not None:
            role, text = r["role"] or "", r["text"] or ""
            own[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, sha(f"{len(role)}:{role}{text}")[:32], (role, text)))
    own = {c: [t[-1] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = crc(c) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    below = {}
    for path in sorted(members, key=len, reverse=True):
        kids = [below[k] for k in children[path]]
        saved = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        below[path] = (sum(k[0] for k in kids) or 1, saved + sum(k[1] for k in kids))
    out = []
    for path, convs in members.items():
        ends = sorted(c for c in convs if len(whole[c]) == len(path))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children[path]), *below[path], sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def talks(spark):
    """Shared openings, copies, a very long conversation and a copy of it, repeated and null turns, nulls in every column."""
    rng = random.Random(8)
    say = lambda k: (rng.choice(["user", "bot", None]), rng.choice(["hi", "Hi", "", None, "é🎉"][:k]))
    rows = [(None, 1, "user", "lost"), (5, None, None, None), (5, None, None, None), (5, 1, "user", "x"), (640, 0, "user", "absent base")]
    for c in rng.sample(range(400), 160):
        rows += [(c, rng.choice([None, t, t, t]), *say(2 + c % 4)) for t in range(rng.randint(1, 9))]
    for c in (700, 741, 742):
        rows += [(c, t, "user", f"turn {t % 7}" + (f" of {c % 2}" if t > 4 else "")) for t in range(300 + c % 2)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("pos"), F.lit(2).alias("rep"), F.lit(3).alias("len"))


@pytest.mark.parametrize("bound", [3, 60, 4096])
def test_trie_equals_plain_trie(talks, bound):
    """The smaller bounds burst containers and leave the long conversations as chains."""
    got = sorted((tuple(r) for r in prefix_trie.trie_nodes(talks, bound).collect()), key=repr)
    assert got == plain_trie(talks.collect())


def test_trie_of_odd_tables(spark, talks):
    assert prefix_trie.trie_nodes(talks.where("false")).count() == 0
    one = spark.createDataFrame([(3, 1, None, None)], "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in prefix_trie.trie_nodes(one).collect()]
    assert sorted(got, key=repr) == plain_trie(one.collect()) and crc(3) % 6 > 0 and len(got) == 1


def test_ends_are_hashed_in_order_over_blocks(spark):
    members = spark.range(2500).select(F.lit(1).cast("long").alias("rep"), (F.col("id") * 37 % 2500).alias("conv_id")).union(spark.range(3, 5).selectExpr("2L", "id"))
    got = {r["end_rep"]: r["ends"] for r in prefix_trie.ends_digests(members, block=100).collect()}
    assert got == {1: sha(",".join(map(str, range(2500)))), 2: sha("3,4")}

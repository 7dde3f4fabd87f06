"""Quality rules, line deduplication, mixing and fingerprints."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from evigraph.llm import lines, mixing, quality, queries, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    from check import compare

    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    verdict = compare(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name])
    assert verdict.startswith("ok"), verdict


def plain_features(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(5)}
    held = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(held), len(held) - len(set(held)), len(covered)


def test_features_and_cascade(odd_docs, no_docs):
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    got = sorted(((r["doc_id"], *[r[n] for n in names]) for r in quality.judged_features(odd_docs).collect()), key=repr)
    assert got == sorted(((r["doc_id"], *plain_features(r["text"])) for r in odd_docs.collect()), key=repr)
    verdicts = {r["doc_id"]: r["failed_rule"] for r in quality.cascade(odd_docs).collect()}
    assert verdicts[1] is None and verdicts[11] is None
    assert verdicts[10] == "few_words" and verdicts[4] is not None and verdicts[15] is not None and verdicts[16] is not None
    assert set(verdicts.values()) - {None} <= {r.name for r in quality.text_rules(F.col("text"))}
    both = quality.judged_features(odd_docs)
    assert both.where(F.col("base_failed") & F.col("failed_rule").isNull()).count() == 0
    assert quality.judged_features(no_docs).count() == 0 and quality.cascade(no_docs).count() == 0


def test_rules_are_ordered_by_rejection_per_cost(spark):
    sample = spark.range(2000).select("id", F.lit("x").alias("text"))
    never, often = quality.Rule("never", F.col("id") < 0), quality.Rule("often", F.col("id") < 1500)
    assert [r.name for r in quality.ordered(sample, [never, often])] == ["often", "never"]


def plain_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(strip))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20 and i is not None:
                holders[key(x)].add(i)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (len(holders[key(x)]) >= 3 and i != max(holders[key(x)]))]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(odd_docs, no_docs):
    got = [(r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.dedup_lines(odd_docs).collect()]
    want = plain_lines([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[2] for r in got) == 2
    assert lines.dedup_lines(no_docs).count() == 0


def water_level(sizes, weights, total):
    """Reshare what is above the caps until nothing is."""
    caps = {s: 2 * n for s, n in sizes.items()}
    target, left, free = dict.fromkeys(sizes, 0.0), float(total), set(sizes)
    while left > 1e-9 and free:
        share = left / sum(weights[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += share * weights[s]
            if target[s] > caps[s]:
                left += target[s] - caps[s]
                target[s] = float(caps[s])
                free.discard(s)
    return target


def test_mixing_targets_and_copies(odd_docs, no_docs):
    rows = mixing.repetitions(odd_docs).collect()
    sizes = Counter()
    for r in odd_docs.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_level(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for r in rows:
        assert r["target"] == pytest.approx(want[r["row"]["source"]]) and r["copies"] <= 2
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    emitted = Counter(r["doc_id"] for r in mixed.collect())
    expected = Counter()
    for r in rows:
        expected[r["row"]["doc_id"]] += r["copies"]
    assert emitted == +expected
    assert mixing.mix(no_docs).count() == 0 and mixing.repetitions(no_docs).count() == 0


def test_mixing_comes_near_its_targets(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    rows = mixing.repetitions(docs).groupBy("row.source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.03 * r["target"] + 1 for r in rows)


def test_edited_texts_and_likeness(odd_docs, no_docs):
    docs = odd_docs.where("doc_id is null or doc_id <> 12")
    got = {r["doc_id"]: r for r in simhash.report(docs, query_step=1).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = sorted((i for i in texts if i is not None), reverse=True)
    bits = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 64
    for k, i in enumerate(ids):
        n, m = texts[i], len(texts[i]) // 3
        edited = n[:len(n) - m] + texts[ids[(k + 1) % len(ids)]][:m]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(n), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(bits(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(bits(r["fingerprint"], got[ids[(k + 1) % len(ids)]]["fingerprint"]))
        others = {x["fingerprint"] for x in got.values()} - {r["fingerprint"]}
        assert r["n_close"] == sum(bits(r["fingerprint"], f) >= 1 - 3 / 64 for f in others)
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and bits(got[1]["fingerprint"], got[3]["fingerprint"]) > 0.75
    assert got[None]["near_next"] is None
    assert simhash.report(no_docs).count() == 0
    assert simhash.report(odd_docs).count() == odd_docs.count()


def test_fingerprint_is_the_majority_of_term_bits(spark):
    texts = [" ".join(f"w{i * k % 211}" for i in range(900)) for k in (1, 3, 7)] + ["one two", "", "a b c d e"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in frame.select(simhash.term_hashes(F.col("text")).alias("terms"), simhash.fingerprint(F.col("text")).alias("fp")).collect():
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r["terms"]) > len(r["terms"]))
        assert r["fp"] & (1 << 64) - 1 == want


def test_block_tables_find_all_within_the_radius(spark):
    import random

    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(1, 5))) for b in base for _ in range(6)]
    signed = [x - (1 << 64) if x >> 63 else x for x in base + near]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {(r["query"], r["found"]) for r in simhash.within_radius(frame, frame).collect()}
    want = {(a, b) for a in set(signed) for b in set(signed) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert got == want

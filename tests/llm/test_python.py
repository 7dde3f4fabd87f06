"""Token counts, codec, toxicity, near copies, repeated strings and main text."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evigraph.llm import bpe_codec, components, html_blocks, main_text, minhash, queries, substrings, token_counts, toxicity
from evigraph.llm.bwt import Collection

SF = "/root/testdata/sf0.001"


def given(table):
    import duckdb

    return duckdb.sql(f"SELECT * FROM '{SF}/{table}.parquet'").df()


def odd_texts():
    rng = random.Random(1)
    return ["", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "  \n\n  a  b", "a" * 3000, "don't we'll", " " * 1000, "日本語🎉🎉 é 　 x\x1c\x85y",
            "".join(rng.choice("abAB 'étn\n\t🎉१") for _ in range(5000)), "".join(rng.choice("ab") for _ in range(2000))]


def test_token_counts_are_the_librarys():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.VOCABULARY)
    texts = odd_texts() + [t for t in given("documents")["text"] if t]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Counter(token_counts.VOCABULARY).counts(texts) == want
    assert [token_counts.Counter(token_counts.VOCABULARY, known_limit=0).counts([t])[0] for t in texts[:20]] == want[:20]


def test_token_count_column(odd_docs, no_docs):
    got = odd_docs.select("doc_id", token_counts.count_tokens(F.col("text"), slice_chars=50).alias("n")).collect()
    by_id = {r["doc_id"]: r["n"] for r in got}
    assert len(got) == odd_docs.count() and by_id[4] == by_id[5] == 0 and by_id[10] == 2
    assert no_docs.select(token_counts.count_tokens(F.col("text"))).count() == 0


def test_codec_cuts_are_safe_and_round_trips():
    codec = bpe_codec.encoding(bpe_codec.RANK_FILE)
    for text in odd_texts() + list(given("documents")["text"].dropna())[:60]:
        want = codec.encode_ordinary(text)
        for chunk in (5, 60, 1000):
            assert "".join(bpe_codec.pieces(text, chunk)) == text
            assert bpe_codec.encode(text, chunk_chars=chunk) == want
        assert bpe_codec.decode(want) == text.encode()


def test_codec_query_and_columns(spark, odd_docs, no_docs):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op10_bpe_codec"](spark, SF).collect()}
    for _, d in given("documents").iterrows():
        ids = bpe_codec.encoding(bpe_codec.RANK_FILE).encode_ordinary(d["text"] or "")
        r = rows[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
    both = odd_docs.select("text", bpe_codec.encode_column(F.col("text")).alias("ids")).select("text", bpe_codec.decode_column(F.col("ids")).alias("b")).collect()
    assert all(bytes(r["b"]).decode() == (r["text"] or "") for r in both)
    assert no_docs.select(bpe_codec.round_trip(F.col("text"))).count() == 0


def test_clause_grammar():
    scorer = toxicity.Scorer(toxicity.seed_entries())
    total = lambda text: np.expm1(scorer.features(text)[1])
    assert total("what a fine morning") == 0 and total("") == 0
    assert total("you idiot") > total("this idiot") > total("he is not an idiot") > 0
    assert total("she said: an idiot") == total("an idiot") > total("she said an idiot")
    assert total("i will kill you") < total("you kill") or total("kill") < total("you kill")
    assert total("1d10t") == total("idiot") == total("IDIOT!")
    assert total("idiot idiot idiot idiot") < 4 * total("idiot")


def test_toxicity_learns_and_never_sees_the_held_out_part(spark, odd_docs, no_docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abdeginorst") for _ in range(5))
    plain = [word() for _ in range(300)]
    rows = [(i, " ".join(rng.choice(plain) for _ in range(60)) + (" zorblat zorblix" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = toxicity.is_held_out(F.col("doc_id"))
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    flipped = docs.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs.select("doc_id", "text"), flipped.select("doc_id", "toxic"))
    assert np.array_equal(model.coefficients, again.coefficients) and model.entries == again.entries
    got = docs.where(held).select("toxic", (toxicity.score_column(F.col("text"), model) >= toxicity.THRESHOLD).cast("int").alias("p")).collect()
    assert len(got) > 150 and all(r["toxic"] == r["p"] for r in got)
    import zlib

    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in docs.select("doc_id", held.alias("h")).collect())
    scores = [r[0] for r in odd_docs.select(toxicity.score_column(F.col("text"), model)).collect()]
    assert len(scores) == odd_docs.count() and all(0 <= s <= 1 for s in scores)
    unlabelled = toxicity.train(no_docs.select("doc_id", "text"), docs.where("false").select("doc_id", "toxic"))
    assert np.array_equal(unlabelled.coefficients, toxicity.DEFAULT_MODEL)
    assert no_docs.select(toxicity.score_column(F.col("text"), unlabelled)).count() == 0


def plain_groups(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, o in sets[:a]:
            if s and o and 100 * len(s & o) >= 75 * len(s | o):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for g in range(6):  # chains in which the ends are far apart, groups of close copies, and pairs about the threshold
        words = [f"w{rng.randrange(400)}" for _ in range(150)]
        for _ in range(25):
            words = [w if rng.random() > (0.01, 0.02, 0.03, 0.005, 0.04, 0.015)[g] else f"w{rng.randrange(400)}" for w in words]
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + k, rows[3][1]) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_groups(rows)
    got = {r["doc_id"]: r for r in minhash.duplicate_groups(docs).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_unlinked_near_copies_are_not_compared_in_pairs(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(400):  # edits of one text out of a few words; about half reach the similarity to some other one, and nearly all share buckets
        rate = rng.choice((0.01, 0.02, 0.03, 0.07, 0.08, 0.1))
        rows.append((i, " ".join(w if rng.random() > rate else f"w{rng.randrange(12)}" for w in words)))
    seen, sieved, confirmed = [], minhash._sieved, minhash._confirmed

    def counted(step):
        def run(pairs, *rest):
            seen.append(pairs.count())
            return step(pairs, *rest)
        return run

    monkeypatch.setattr(minhash, "_sieved", counted(sieved))
    monkeypatch.setattr(minhash, "_confirmed", counted(confirmed))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_groups(rows)
    assert len({c for _, c in got.values()}) > 100 and sum(seen) < 10 * len(rows)


def test_near_duplicates_of_odd_texts(odd_docs, no_docs):
    got = defaultdict(set)
    rows = minhash.duplicate_groups(odd_docs).collect()
    for r in rows:
        got[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert len(rows) == odd_docs.count()
    assert got[1] == {(1, True)} and got[2] == {(1, False)} and got[3] == {(1, False)}
    assert got[4] == {(4, True)} and got[5] == {(5, True)} and got[None] == {(None, True)} and got[13] == {(13, True)}
    assert minhash.duplicate_groups(no_docs).count() == 0
    kept = minhash.first_of_groups(odd_docs)
    assert kept.columns == odd_docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(
        (i for i in (r["doc_id"] for r in odd_docs.collect()) if i not in {i for i, v in got.items() if (i, True) not in v and i is not None and not all(k for _, k in v)}), key=repr)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(20, 90)] + [(3, 3), (5, 6), (6, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[k] == 7 for k in range(20, 90)) and got[6] == 5 and 3 not in got


def test_column_wise_transform():
    rng = random.Random(3)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab\x00\xf4") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 12))]
        made = Collection(strings)
        rows = sorted(((s[o:], i, o) for i, s in enumerate(strings) for o in range(len(s) + 1)), key=lambda x: x[:2])
        assert list(made.bwt) == [strings[i][o - 1] + 1 if o else 0 for _, i, o in rows]
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert list(made.lcp) == [0] + [common(a[0], b[0]) for a, b in zip(rows, rows[1:])]
        assert sorted(zip(*(x.tolist() for x in made.rows_of(2)))) == sorted((i, o, k) for k, (s, i, o) in enumerate(rows) if len(s) >= 2)


def plain_repeats(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, []
    for i, t in order:
        data = (t or "").encode()
        for p in range(len(data) - 49):
            first.setdefault(data[p:p + 50], i)
    for i, t in order:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if first[data[p:p + 50]] != i:
                gone[p:p + 50] = b"\x01" * 50
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_strings(spark, odd_docs, no_docs):
    rng = random.Random(12)
    parts = ["".join(rng.choice("abc ") for _ in range(rng.choice([30, 49, 50, 51, 70, 300]))) for _ in range(25)]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", "x", "é"]) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    rows += [(r["doc_id"], r["text"]) for r in odd_docs.where("coalesce(doc_id, 0) not in (11, 12)").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text").collect()]
    rows += [(200, "ab" * 400), (201, "ab" * 300), (202, "a" * 200)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_repeats(rows), key=repr)
    assert substrings.remove_repeats(no_docs).count() == 0


def test_repeated_strings_of_hot_grams(spark):
    rng = random.Random(13)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(160)
    cut = [passage, passage[:120], passage[40:], passage[:60] + noise(9) + passage[60:]]
    rows = [(i, noise(rng.choice([0, 5, 20, 60])) + rng.choice(cut) + noise(rng.choice([0, 5, 60]))) for i in range(120)]
    rows += [(300 + i, "ab" * 60 + noise(i)) for i in range(4)] + [(400, rows[0][1]), (400, rows[1][1]), (None, rows[2][1])]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), sorted(plain_repeats(rows), key=repr)
    for gram_bytes in (0, 1000):  # all grams, and the ones of the passage: no task holds more of one gram than that
        got = substrings.remove_repeats(docs, gram_bytes=gram_bytes).drop("kept").collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_only_the_sides_that_segments_share_are_ordered(monkeypatch):
    gram, left, right = b"G" * 16, bytes(range(97, 114)), bytes(range(65, 82))
    contents = [b"0" * 17 + left + gram + right + b"1" * 9, b"0" * 17 + left + gram + b"3" * 26, b"4" * 34 + gram + right + b"5" * 9, b"6" * 34 + gram + b"7" * 26]
    seen, plain = [], substrings.owners

    def recorded(strings, least):
        seen.extend(strings)
        return plain(strings, least)

    monkeypatch.setattr(substrings, "owners", recorded)
    rows = pd.DataFrame({"at": [34] * 4, "content": contents, "least": [1, 2, 3, 4], "most": [9] * 4})
    out = pd.concat(substrings.decide(iter([rows])))
    assert seen == [contents[0], contents[1][:67], contents[2][17:]]  # both sides, the left, the right; the last one shares none
    per_window = sorted([o for b, e, o in zip([0, *ends], ends, who) for _ in range(b, e)] for ends, who in zip(out["ends"], out["owners"]))
    assert per_window == [[1] * 27, [1] + [2] * 26, [3] * 27, [4] * 27]


def test_repeated_strings_of_one_id_stay(spark):
    text = "this passage stands in two rows of the same document id and is longer than fifty bytes"
    docs = spark.createDataFrame([(1, text), (1, text + " more"), (2, "x" + text)], "doc_id long, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in substrings.remove_repeats(docs).collect()} == {(1, 0), (2, len(text))}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href='/b'>News</a></ul></nav><!-- ad --><div class="ad">Buy now</div>
<article><h1>Big &amp; small</h1><p>First   part<br>goes <b>on<p>Caf&eacute; &#8217;quoted&#8217; 1 < 2</p><ul><li>one<p>two</p> tail</li></ul></article>
<footer>&copy; site"""


def test_leaf_blocks():
    got = [b.text for b in html_blocks.leaf_blocks(PAGE)]
    assert got == ["Home", "News", "Buy now", "Big & small", "First part goes on", "Café ’quoted’ 1 < 2", "one", "two", "tail", "© site"]
    assert html_blocks.leaf_blocks("") == [] and [b.text for b in html_blocks.leaf_blocks("plain <b>text")] == ["plain text"]
    assert [b.text for b in html_blocks.leaf_blocks("<p>a<script>never closed <p>b")] == ["a"]
    for icon in ("<svg/>", '<svg class="i" viewBox="0 0 1 1" data-x="a>b"/>', "<SVG a='/' />", "<svg><path d='M0'/></svg>", "<math/>"):
        got = html_blocks.leaf_blocks(f"<article><p>one {icon}two</p><p>three</p><svg>icon</svg><p>four</p></article>")
        assert [b.text for b in got] == ["one two", "three", "four"]
    page = "<p>a <math><mi>x</mi></math> b</p><p>c <noscript><img src=i></noscript>d <object>fallback</object> e</p><noscript><p>plain</noscript><div>f</div>"
    got = html_blocks.leaf_blocks(page)
    assert [b.text for b in got] == ["a x b", "c d", "fallback", "e", "plain", "f"]
    assert [[n[0] for n in b.path] for b in got] == [["p"], ["p"], ["p", "object"], ["p"], ["noscript", "p"], ["div"]]
    assert len(html_blocks.leaf_blocks("<svg " + 'a="b" ' * 5000 + ">x</svg><p>y")) == 1
    assert len(html_blocks.leaf_blocks("<p>x" * 3000 + '<a href="' + "y" * 100_000)) >= 3000


def test_labeller_gradients():
    rng = np.random.default_rng(0)
    model = main_text.Labeller(rng)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask = rng.standard_normal((3, 5, main_text.INPUTS)), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], float)
    y = rng.integers(0, 2, (3, 5)) * mask
    loss = lambda: -(mask * (y * np.log(model.chances(x, mask)) + (1 - y) * np.log(1 - model.chances(x, mask)))).sum() / mask.sum()
    grads = model.gradients(x, mask, y)
    for k, v in model.p.items():
        for at in [tuple(rng.integers(0, s) for s in v.shape) for _ in range(4)]:
            old = v[at]
            v[at] = old + 1e-3
            up = loss()
            v[at] = old - 1e-3
            down = loss()
            v[at] = old
            assert grads[k][at] == pytest.approx((up - down) / 2e-3, abs=2e-4)


def test_main_text_of_the_given_pages(spark):
    import html
    import re

    rows = {r["page_id"]: r for r in queries.QUERIES["op2_html_extraction"](spark, SF).collect()}
    pages = given("pages")
    assert len(rows) == len(pages)
    for _, p in pages.iterrows():
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert rows[p["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)
        assert rows[p["page_id"]]["n_chars"] == len(rows[p["page_id"]]["text"])


def test_main_text_of_other_layouts_and_odd_pages(spark):
    model = main_text.train(list(given("pages")["html"])[:60])
    rng, right, total = random.Random(77), 0, 0
    for _ in range(120):
        page, labels = main_text.synthetic_page(rng, "one two three four five six seven eight nine ten".split())
        blocks = html_blocks.leaf_blocks(page)
        assert len(blocks) == len(labels)
        x, mask = main_text.padded([main_text.vectors(blocks)])
        right += int(((model.chances(x, mask)[0] >= 0.5) == np.array(labels)).sum())
        total += len(labels)
    assert right / total > 0.97
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (None, None, PAGE), (4, "v", PAGE), (4, "v", PAGE)], "page_id long, url string, html string")
    got = main_text.extract_main_text(pages.withColumn("text", F.lit("clash"))).collect()
    texts = Counter((r["page_id"], r["text"]) for r in got)
    assert texts[1, ""] == texts[2, ""] == 1 and max(n for (i, _), n in texts.items() if i == 4) == 2
    assert main_text.extract_main_text(pages.where("false")).count() == 0

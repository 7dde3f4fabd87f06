"""Toxicity by a weighted finite-state pattern grammar.

Words are read by a lexical transducer (a character trie): it turns a word into
a class - insult, threat, target, negation, report - with a weight. Function
words and a small seed lexicon are fixed; further stems and the weights of all
insults are learned from labelled documents, so that languages without seeds
are covered. Four clause transducers (target, threat, negation, reported
speech) read the classes and are composed once into one machine whose arcs hold
a factor; a matched word counts its lexical weight times the factor of the arc
that it takes, so an insult counts more at a target, and less when negated or
reported. Clauses, not single words, are scored; a logistic model over the
clause scores of a document gives its score.

Training: documents with a label whose crc32(doc_id) mod 3 is not 1, the first
``sample_rows`` of them in the order of a hash of the id. Stems are counted by
Spark; the logistic model reads a few numbers for each sampled document.

Cases: a null or empty text has no clauses and gets the score of such a text;
a null id is not in the held-out part and is never trained on, nor is a null
label; repeated rows are scored each; without labelled rows of both kinds the
seed weights and a fixed model are used; labels, lang, source and doc_id are
never part of a score; other columns pass unchanged; empty in, empty out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import read
from evigraph.session import cut_lineage

SAMPLE_ROWS = 12_000
MAX_STEMS = 4_000
MIN_EVIDENCE = 10.0
MIN_STEM_WEIGHT, MAX_STEM_WEIGHT = 1.2, 5.0
STEM_LENGTHS = range(3, 11)
THRESHOLD = 0.7

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)

# fixed values: seed lexicon (stems in lower case, matched from the start of a word; '=' marks a whole word)
SEEDS = {
    INSULT: "idiot moron imbecil stupid pathetic worthless disgusting scum trash loser clown jerk bastard asshole dumbass fool =pig "
            "dummkopf trottel arschloch abschaum wertlos connard imbécile salaud ordure débile estúpid basura idiota escoria".split(),
    THREAT: "kill murder destroy hurt strangle töten umbringen tuer détruire matar destruir".split(),
    TARGET: "=you =your =you're =yourself =u =du =dich =dein =deine =ihr =euch =tu =toi =te =vous =votre =ustedes =usted =eres =tú".split(),
    NEGATION: "=not =never =no =isn't =aren't =don't =without =nicht =kein =keine =nie =pas =jamais =nunca =ningún".split(),
    REPORT: "=said =says =wrote =claimed =quoted =reported =sagte =schrieb =dit =écrit =dijo =escribió".split(),
}
SEED_WEIGHT = 4.0
LEET = str.maketrans("013457$@", "oieastsa")
TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[.;:!?\n]|[$@\w]+")
LETTERS = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Machine:
    """A deterministic transducer over classes: arcs[(state, class)] = (next state, class out, factor); state 0 starts a clause."""

    arcs: dict = field(repr=False)


def machine(rules: dict[tuple[object, int], tuple[object, int, float]], states: list) -> Machine:
    """Rules for some arcs; every other arc keeps state and class with factor 1, and END returns to the start."""
    arcs = {}
    for s in states:
        for c in range(7):
            arcs[s, c] = (states[0], END, 1.0) if c == END else rules.get((s, c), (s, c, 1.0))
    return Machine(arcs)


def compose(first: Machine, second: Machine) -> Machine:
    """What ``second`` makes of what ``first`` puts out; factors multiply. States are numbered as they are reached from the start."""
    start = (next(iter(first.arcs))[0], next(iter(second.arcs))[0])
    number, queue, arcs = {start: 0}, [start], {}
    for a, b in queue:
        for c in range(7):
            to_a, mid, w = first.arcs[a, c]
            to_b, out, v = second.arcs[b, mid]
            to = (to_a, to_b)
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            arcs[number[a, b], c] = (number[to], out, w * v)
    return Machine(arcs)


def clause_machine(reach: int = 3) -> Machine:
    """Target, threat, negation and report, composed. Negation reaches over ``reach`` words."""
    target = machine({("-", TARGET): ("t", TARGET, 1.0), ("t", INSULT): ("t", INSULT, 1.5), ("t", THREAT): ("t", THREAT, 1.5)}, ["-", "t"])
    threat = machine({("-", THREAT): ("-", THREAT, 0.25), ("-", TARGET): ("t", TARGET, 1.0), ("t", THREAT): ("t", THREAT, 1.0)}, ["-", "t"])
    steps = [0, *range(1, reach + 1)]
    fading = {(k, c): (k - 1, c, 0.3 if c in (INSULT, THREAT) else 1.0) for k in steps[1:] for c in range(END)}
    negation = machine(fading | {(k, NEGATION): (reach, OTHER, 1.0) for k in steps}, steps)
    report = machine({("-", REPORT): ("r", REPORT, 1.0), ("r", INSULT): ("r", INSULT, 0.4), ("r", THREAT): ("r", THREAT, 0.4)}, ["-", "r"])
    return compose(compose(compose(target, threat), negation), report)


class Lexicon(dict):
    """token -> (class, weight): the longest stem in the trie that starts the word; a whole-word entry wins. Remembers words up to a bound."""

    def __init__(self, entries: dict[str, tuple[int, float]], limit: int = 400_000):
        super().__init__()
        self.entries, self.limit = entries, limit
        self.longest = max((len(e) for e in entries), default=0)
        self.starts = {e[:3] for e in entries if e[0] != "="}

    def __missing__(self, token: str) -> tuple[int, float]:
        if len(self) >= self.limit:
            self.clear()
        got = self.read(token)
        if not got[0] and LETTERS.search(token) and (plain := token.translate(LEET)) != token:
            got = self.read(plain)
        self[token] = got
        return got

    def read(self, word: str) -> tuple[int, float]:
        if word in ".;:!?\n":
            return END, 0.0
        if whole := self.entries.get("=" + word):
            return whole
        if word[:3] in self.starts:
            for n in range(min(len(word), self.longest), 2, -1):
                if hit := self.entries.get(word[:n]):
                    return hit
        return OTHER, 0.0


def seed_entries() -> dict[str, tuple[int, float]]:
    return {word: (kind, SEED_WEIGHT if kind in (INSULT, THREAT) else 0.0) for kind, words in SEEDS.items() for word in words}


N_FEATURES = 6


class Scorer:
    """Clause scores of texts."""

    def __init__(self, entries: dict[str, tuple[int, float]]):
        self.lexicon, self.arcs = Lexicon(entries), clause_machine().arcs

    def features(self, text: str) -> list[float]:
        tokens = TOKEN.findall(text.lower())
        read = list(map(self.lexicon.__getitem__, tokens))
        kinds = np.fromiter((k for k, _ in read), np.int8, len(read))
        ends = np.flatnonzero(kinds == END)
        n_words = len(read) - len(ends)
        hits = np.flatnonzero((kinds == INSULT) | (kinds == THREAT))
        if not len(hits):
            return [1.0, 0.0, 0.0, 0.0, 0.0, np.log1p(n_words)]
        scores, seen = [], {}
        for clause in np.unique(np.searchsorted(ends, hits)):
            begin = ends[clause - 1] + 1 if clause else 0
            end = ends[clause] if clause < len(ends) else len(read)
            state, score = 0, 0.0
            for token, (kind, weight) in zip(tokens[begin:end], read[begin:end]):
                state, out, factor = self.arcs[state, kind]
                if out in (INSULT, THREAT):  # a word repeated over and over counts less each time
                    seen[token] = seen.get(token, 0) + 1
                    score += weight * factor / seen[token]
            scores.append(score)
        total = sum(scores)
        return [1.0, np.log1p(total), np.log1p(max(scores)), np.log1p(200.0 * total / (n_words + 40)), len(scores) / (len(ends) + 1), np.log1p(n_words)]


DEFAULT_MODEL = np.array([-6.7, 2.4, 2.4, 3.0, -5.0, -1.8])


@dataclass
class Model:
    entries: dict[str, tuple[int, float]]
    coefficients: np.ndarray


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(doc_id, toxic, text) of at most ``sample_rows`` labelled documents outside the held-out part, in hash order of their ids."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # the sample has a fixed bound
    return cut_lineage(texts.groupBy("doc_id", "toxic").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")))


def stem_weights(rows: DataFrame, n_toxic: int, n_clean: int) -> dict[str, tuple[int, float]]:
    """Learned entries: stems and whole words by their smoothed log-odds between toxic and clean documents."""
    tokens = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)")), lambda w: F.char_length(w) >= STEM_LENGTHS.start))
    stems = F.array_distinct(F.flatten(F.transform(tokens, lambda w: F.array(
        F.concat(F.lit("="), w), *[F.when(F.char_length(w) >= n, F.substring(w, 1, n)) for n in STEM_LENGTHS]))))
    counts = rows.select("toxic", F.explode(stems).alias("stem")).where(F.col("stem").isNotNull()).groupBy("stem").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    odds = F.log((F.col("t") + 0.3) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.3) / (n_clean + 1.0))
    share, toxic, clean = n_toxic / (n_toxic + n_clean), F.col("t") / (F.col("t") + F.col("c")), F.col("c") / (F.col("t") + F.col("c"))
    # log-likelihood against the overall share: a stem of few documents must not be trusted by chance
    evidence = F.col("t") * F.log(toxic / share) + F.when(F.col("c") > 0, F.col("c") * F.log(clean / (1 - share))).otherwise(0.0)
    best = counts.where((F.col("t") > 0) & (evidence >= MIN_EVIDENCE)).withColumn("w", odds).where(F.col("w") >= MIN_STEM_WEIGHT)
    # a whole word that clean texts use as well is an exception to its stem
    plain = counts.where(F.col("stem").startswith("=") & (F.col("t") + F.col("c") >= 4)).withColumn("w", odds).where(F.col("w") < MIN_STEM_WEIGHT)
    top = best.orderBy(F.desc(F.col("w") * F.sqrt("t")), "stem").limit(MAX_STEMS).collect()
    entries = {r["stem"]: (INSULT, min(float(r["w"]), MAX_STEM_WEIGHT)) for r in top}
    if entries:
        shortest = {e[:3] for e in entries if e[0] != "="}
        exceptions = plain.where(F.substring("stem", 2, 3).isin(sorted(shortest))).orderBy(F.desc("c"), "stem").limit(MAX_STEMS).collect()
        entries |= {r["stem"]: (OTHER, 0.0) for r in exceptions}
    return entries


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton steps for the likelihood with a ridge towards the fixed model; all rows weigh alike."""
    w = DEFAULT_MODEL.copy()
    penalty = np.full(x.shape[1], ridge)

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.sum(np.logaddexp(0.0, z) - y * z) + 0.5 * np.sum(penalty * (v - DEFAULT_MODEL) ** 2))

    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * (w - DEFAULT_MODEL))
        size, here = 1.0, loss(w)
        while size > 1e-6 and loss(w + size * step) > here:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def feature_column(text: Column, entries: dict[str, tuple[int, float]]) -> Column:
    @F.pandas_udf("array<double>")
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(entries)
        for batch in texts:
            yield pd.Series([scorer.features(t) for t in batch], dtype=object)

    return features(F.coalesce(text, F.lit("")))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Half of the sample gives the stems, all of it the logistic model; halves by a hash of the id."""
    rows = training_rows(docs, labels, sample_rows)
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    entries = seed_entries()
    if sizes.get(1, 0) < 5 or sizes.get(0, 0) < 5:
        return Model(entries, DEFAULT_MODEL)
    # stems of one part are tested on the other, so that chance stems earn no trust; then the parts change places
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(2))
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    for k in (0, 1):
        learn, test = rows.where(part == k), rows.where(part != k)
        n = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        known = entries | stem_weights(learn, n.get(1, 0), n.get(0, 0))
        got = test.select("toxic", feature_column(F.col("text"), known).alias("x")).collect()
        if got:
            seen.append((np.array([r["x"] for r in got]), np.array([float(r["toxic"]) for r in got])))
    x, y = np.concatenate([a for a, _ in seen]), np.concatenate([b for _, b in seen])
    return Model(entries | stem_weights(rows, sizes[1], sizes[0]), fit_logistic(x, y))


def score_column(text: Column, model: Model) -> Column:
    weights = model.coefficients
    entries = model.entries

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(entries)
        for batch in texts:
            x = np.array([scorer.features(t) for t in batch]).reshape(-1, N_FEATURES)
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(x @ weights, -30, 30))))

    return score(F.coalesce(text, F.lit("")))


def model_for(spark, docs: DataFrame, sf_dir: str, sample_rows: int = SAMPLE_ROWS) -> Model:
    return train(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"), sample_rows)

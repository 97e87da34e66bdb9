"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols by a lexicon (insults, threats, intents, targets, negations, reports, commas), whose arcs bear a word's weight. Small
weighted transducers rewrite the symbols of a sentence, one after the other: negation marks a charged word within its reach, reported speech
marks what follows it, targets mark a charged word aimed at someone, and intents turn a threat verb into a threat. An arc that marks a word
bears the logarithm of what the mark is worth (ARCS), so a path's weight is the sum along it. The transducers are composed to one
table once; a sentence is then one walk through it. The last symbols of the walk are matched clauses of a kind (plain insult, aimed
insult, threat, and each of them negated or reported); their weights by kind, with a logistic function learned from labels, make the score.

Learning: at most TRAIN_ROWS labelled documents, the ones of least hash outside the held-out third, give (a) further
lexicon entries, all words or word beginnings that toxic documents hold five times as often, none a beginning of another, each a threat if an intent stands before it
in half of its places or more, else an insult, and (b) the function, by logistic regression with a ridge about the default weights: a kind of
clause that the sample does not hold keeps its default weight, so threats, negations and reports count even where no label speaks of them. Every key that enough
of the sampled documents hold is a candidate. Targets, negations, intents and reports are the base lexicon's: labels of whole documents do not
tell them from other words. Labels are used for nothing else, and language, source and doc_id never.

Defined results: null and empty texts match nothing and get the score of a text without matches; texts of any
length are read whole; repeated rows get a row each; a null doc_id is not held out; without labels the
default weights stand; an empty table gives no rows. Only `doc_id` and `text`, and `doc_id` and `toxic` of the
labels, are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod

TRAIN_ROWS = 12_000

# The base lexicon.
BASE = {
    "INSULT": "idiot moron stupid dumb loser scum trash pathetic worthless disgusting clown fool imbecile filth vermin idiota estúpido imbécil basura idiote stupide crétin ordure dummkopf abschaum trottel".split(),
    "THREAT": "kill hurt destroy beat shoot stab burn murder matar tuer töten".split(),
    "INTENT": "will gonna shall going must should werde voy vais".split(),
    "TARGET": "you your yours u ya he she they them him her this these those people tu usted vous toi ihr du dich él ella".split(),
    "NEGATION": "not no never nor isn't aren't wasn't don't doesn't nicht kein keine pas jamais nunca".split(),
    "REPORT": "said says say quoted quote called calls wrote according claimed claims told sagte dijo dit".split(),
}
SYMBOLS = ("OTHER", "COMMA", "INTENT", "TARGET", "NEGATION", "REPORT", "INSULT", "THREAT")
KINDS = ("insult", "aimed", "threat", "negated", "reported")

#: Log-weights of the arcs that mark a charged word.
ARCS = {"aimed": 0.4, "threat": 0.6, "negated": -1.5, "reported": -1.0}

#: A transducer is step(state, symbol): next state, symbol out, weight of the arc.
Symbol = tuple[str, frozenset]


def _marked(symbol: Symbol, mark: str) -> tuple[Symbol, float]:
    return (symbol[0], symbol[1] | {mark}), ARCS[mark]


def _negation(state: int, symbol: Symbol) -> tuple[int, Symbol, float]:
    """A charged word up to three words after a negation is negated; a comma ends the reach."""
    name, weight = symbol[0], 0.0
    if name == "NEGATION":
        return 3, symbol, weight
    if name in ("INSULT", "THREAT") and state:
        symbol, weight = _marked(symbol, "negated")
    return (0 if name == "COMMA" else max(0, state - 1)), symbol, weight


def _reported(state: int, symbol: Symbol) -> tuple[int, Symbol, float]:
    """What follows a verb of report in its sentence is reported, over commas too."""
    name, weight = symbol[0], 0.0
    if name in ("INSULT", "THREAT") and state:
        symbol, weight = _marked(symbol, "reported")
    return (1 if name == "REPORT" else state), symbol, weight


def _target(state: int, symbol: Symbol) -> tuple[int, Symbol, float]:
    """A charged word up to four words after a target is aimed at it."""
    name, weight = symbol[0], 0.0
    if name == "TARGET":
        return 4, symbol, weight
    if name in ("INSULT", "THREAT") and state:
        symbol, weight = _marked(symbol, "aimed")
    return max(0, state - 1), symbol, weight


def _threat(state: int, symbol: Symbol) -> tuple[int, Symbol, float]:
    """A threat verb needs an intent up to three words before; without one it is an ordinary word."""
    name, weight = symbol[0], 0.0
    if name == "INTENT":
        return 3, symbol, weight
    if name == "THREAT":
        symbol, weight = _marked(symbol, "threat") if state else (("OTHER", frozenset()), weight)
    return max(0, state - 1), symbol, weight


STEPS = (_negation, _reported, _target, _threat)


def compose(*steps):
    """One transducer that does the work of all, in order; its state is the tuple of theirs, its weight their sum."""

    def step(state: tuple, symbol: Symbol) -> tuple[tuple, Symbol, float]:
        after, total = [], 0.0
        for own, s in zip(state, steps, strict=True):
            s_state, symbol, weight = s(own, symbol)
            after.append(s_state)
            total += weight
        return tuple(after), symbol, total if symbol[0] != "OTHER" else 0.0

    return (0,) * len(steps), step


def kind_of(symbol: Symbol) -> int:
    """The kind of a clause that ends in a symbol, by its place in KINDS from 1; 0: none."""
    name, marks = symbol
    if name not in ("INSULT", "THREAT"):
        return 0
    return 4 if "negated" in marks else 5 if "reported" in marks else 3 if name == "THREAT" else 2 if "aimed" in marks else 1


def tabled(start, step) -> tuple[list[list[int]], list[list[int]], list[list[float]]]:
    """The reachable part of a transducer as tables by state and symbol: next state, the kind of a match, and what its arc's weight makes of a word's."""
    numbers, todo, go, out, factor = {start: 0}, [start], [], [], []
    while todo:
        state = todo.pop(0)
        rows = [step(state, (name, frozenset())) for name in SYMBOLS]
        for after, _, _ in rows:
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
        go.append([numbers[after] for after, _, _ in rows])
        out.append([kind_of(symbol) for _, symbol, _ in rows])
        factor.append([math.exp(weight) for _, _, weight in rows])
    return go, out, factor


GO, OUT, FACTOR = tabled(*compose(*STEPS))
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[,;:]|[.!?\n]")
_WORD = re.compile(r"[^\W\d_]+")


class Grammar:
    """The lexicon, with learned words and word beginnings, and the walk."""

    def __init__(self, learned: dict[str, float]):
        """learned: weight by `=word` or `^beginning`, with a `!` before it if it is a threat."""
        self.exact = {w: SYMBOLS.index(name) for name, words in BASE.items() for w in words}
        self.weight = {w: 1.0 for w in BASE["INSULT"] + BASE["THREAT"]}
        self.stems: dict[str, tuple[int, float]] = {}
        for key, w in learned.items():
            symbol, key = SYMBOLS.index("THREAT" if key[0] == "!" else "INSULT"), key.lstrip("!")
            if key[0] == "=":
                self.exact[key[1:]] = symbol
                self.weight[key[1:]] = w
            else:
                self.stems[key[1:]] = symbol, w
        self.lengths = sorted({len(s) for s in self.stems})
        import ahocorasick

        self.charged = ahocorasick.Automaton()
        for w in [*self.weight, *self.stems]:
            self.charged.add_word(w, len(w))
        self.charged.make_automaton()
        self.known: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        if word in self.exact:
            return self.exact[word], self.weight.get(word, 0.0)
        for n in self.lengths:
            if len(word) > n and word[:n] in self.stems:
                return self.stems[word[:n]]
        return 0, 0.0

    def matches(self, text: str | None) -> tuple[list[float], list[int]]:
        """(weight of the matches by kind, number by kind) over all sentences."""
        weights, counts = [0.0] * 6, [0] * 6
        low = (text or "").lower()
        if next(self.charged.iter(low), None) is None:
            return weights, counts
        state, known = 0, self.known
        if len(known) > 300_000:
            known.clear()
        for token in _TOKEN.findall(low):
            if token in ".!?\n":
                state = 0
                continue
            got = known.get(token)
            if got is None:
                got = known[token] = (1, 0.0) if token in ",;:" else self.symbol(token)
            s, w = got
            kind = OUT[state][s]
            if kind:
                weights[kind] += w * FACTOR[state][s]
                counts[kind] += 1
            state = GO[state][s]
        return weights, counts

    def features(self, text: str | None) -> list[float]:
        weights, counts = self.matches(text)
        total, number = sum(weights[1:4]), sum(counts[1:])
        per_word = 100 * number / max(1, len((text or "").split())) if number else 0.0
        return [1.0, *[math.log1p(w) for w in weights[1:]], float(number >= 2), float(number >= 3), math.log1p(per_word), min(total, 30.0) / 10]


N_FEATURES = 10
DEFAULT = [-3.0, 1.5, 2.0, 2.5, -0.5, -0.5, 1.0, 0.5, 1.0, 0.5]


def keys_of(text: str | None) -> Counter:
    """How often a text has each word (=word) and each word beginning of 4 to 8 letters (^beginning)."""
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall((text or "").lower())).items():
        if len(w) >= 3:
            out["=" + w] += n
        for k in range(4, min(9, len(w))):
            out["^" + w[:k]] += n
    return out


def _toxic_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one, two = Counter(), Counter()
    for b in batches:
        for text in b.column("text").to_pylist():
            counts = keys_of(text)
            one.update(counts.keys())
            two.update(k for k, n in counts.items() if n > 1)
    yield pa.RecordBatch.from_arrays([pa.array(list(one), pa.string()), pa.array(list(one.values()), pa.int64()), pa.array([two[k] for k in one], pa.int64())], ["key", "one", "two"])


def _counts_for(keys: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Counter(), Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                for k, n in keys_of(text).items():
                    if k in keys:
                        one[k] += 1
                        two[k] += n > 1
        yield pa.RecordBatch.from_arrays([pa.array(list(one), pa.string()), pa.array(list(one.values()), pa.int64()), pa.array([two[k] for k in one], pa.int64())], ["key", "one", "two"])

    return run


def _after_intents(learned: dict[str, float]):
    """How often each learned key occurs, and how often within three words of an intent before it."""
    intents = frozenset(BASE["INTENT"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, after = Counter(), Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                words = _WORD.findall((text or "").lower())
                for i, w in enumerate(words):
                    for k in ("=" + w, *("^" + w[:j] for j in range(4, min(9, len(w))))):
                        if k in learned:
                            n[k] += 1
                            after[k] += not intents.isdisjoint(words[max(0, i - 3) : i])
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([after[k] for k in n], pa.int64())], ["key", "n", "after"])

    return run


def choose(toxic: dict[str, tuple[int, int]], clean: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries by gain (documents times log-ratio), none a beginning of another; weight: the log-ratio, scaled."""
    scored = []
    for key, (t1, t2) in toxic.items():
        c1, c2 = clean.get(key, (0, 0))
        ratio = lambda t, c: math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        r1, r2 = ratio(t1, c1), ratio(t2, c2)
        gain, r, t = max((t1 * r1, r1, t1), (t2 * r2, r2, t2))
        if r >= math.log(5) and t >= max(4, 0.02 * n_toxic):
            scored.append((gain, key[0] == "=", len(key), key, r))
    out: dict[str, float] = {}
    for _, _, _, key, r in sorted(scored, reverse=True):
        if not any(k[1:].startswith(key[1:]) or key[1:].startswith(k[1:]) for k in out):
            out[key] = min(1.5, r / 4)
    return out


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30, prior: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression with a ridge about `prior` (zero, if there is none), by Newton's method."""
    prior = np.zeros(x.shape[1]) if prior is None else prior
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ (w - prior))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[dict[str, float], list[float]]:
    """(learned lexicon, weights) from the labelled documents outside the held-out third."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(crc_mod(F.col("doc_id"), 3) != 1)
    sample = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    picked = spark.createDataFrame(sample.collect(), "doc_id long, toxic int")  # train_rows rows at most
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).dropDuplicates()
    counted = {r["toxic"]: r["n"] for r in picked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = counted.get(1, 0), counted.get(0, 0)
    if not n_toxic or not n_clean:
        return {}, DEFAULT
    schema = "key string, one long, two long"
    least = max(4, int(0.02 * n_toxic))
    summed = lambda df: df.groupBy("key").agg(F.sum("one").alias("one"), F.sum("two").alias("two"))
    toxic = summed(rows.where("toxic = 1").select("text").mapInArrow(_toxic_keys, schema)).where(F.col("one") >= least)
    toxic_rows = toxic.collect()  # keys that one in fifty of the sample's toxic documents holds, or four of them
    keys = frozenset(r["key"] for r in toxic_rows)
    clean_rows = summed(rows.where("toxic = 0").select("text").mapInArrow(_counts_for(keys), schema)).collect()
    learned = choose({r["key"]: (r["one"], r["two"]) for r in toxic_rows}, {r["key"]: (r["one"], r["two"]) for r in clean_rows}, n_toxic, n_clean)

    threats = rows.where("toxic = 1").select("text").mapInArrow(_after_intents(learned), "key string, n long, after long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("after").alias("after")).collect()
    as_threat = {r["key"] for r in threats if 2 * r["after"] >= r["n"] > 0}
    learned = {("!" if k in as_threat else "") + k: w for k, w in learned.items()}

    def features(batches):
        grammar = Grammar(learned)
        for b in batches:
            x = [grammar.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("toxic")], ["x", "toxic"])

    # train_rows small vectors at most, in an order that does not hang on the partitions
    got = sorted((tuple(r["x"]), r["toxic"]) for r in rows.mapInArrow(features, "x array<double>, toxic int").collect())
    return learned, fit_weights(np.array([g[0] for g in got]), np.array([float(g[1]) for g in got]), prior=np.array(DEFAULT)).tolist()


def scored(docs: DataFrame, learned: dict[str, float], weights: list[float], name: str = "toxicity") -> DataFrame:
    """docs with the score of `text` added."""

    def run(texts: pa.Array) -> pa.Array:
        grammar = _grammar(tuple(sorted(learned.items())))
        return pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, sum(map(float.__mul__, weights, grammar.features(t))))))) for t in texts.to_pylist()], pa.float64())

    return docs.select("*", F.arrow_udf(run, T.DoubleType())(F.col("text")).alias(name))


_grammars: dict[tuple, Grammar] = {}


def _grammar(learned: tuple) -> Grammar:
    if learned not in _grammars:
        _grammars.clear()
        _grammars[learned] = Grammar(dict(learned))
    return _grammars[learned]

"""Toxicity by a weighted finite-state grammar over clauses.

One automaton finds lexicon words in a text; only the clauses around them, from stop to stop whatever their length, are parsed. Words become symbols - insult (with its learnt
weight), threat, target, negation, verb of speech, intent, intensifier - and five transducers read them, composed into one machine:

* insult: an intensifier before an insult strengthens it;
* threat: a word of intent up to INTENT words before a threat strengthens it;
* reported speech: from a verb of speech to the clause's end, insults and threats are reported;
* negation: the SCOPE words behind a negation are negated, unless they are reported;
* target: an insult or threat with a target up to NEAR words before or behind it is aimed and weighs more. What is behind can't be known when the insult is read, so the
  machine has a path that promises a target and fails if none comes; the best path that is accepted counts.

The composed machine's outputs are channels: plain, negated, reported, threat. A logistic layer over the clauses' channels gives the score.

Threats, targets, negations, verbs of speech, intents and intensifiers are fixed word lists. Insult words and stems and their weights (log odds of their document
counts) are learnt from labelled rows, of which near copies count once; so are the layer's coefficients, from features in
which each row's own count is taken out of the weights.

Cases: a null or empty text has no clauses and gets the layer's value for none (0 without any labelled row). Repeated rows and null ids are
scored row by row; ties in the order of lexicon entries change nothing. An empty table gives an empty result. Texts of any length are read whole. Extra columns pass; `score` and `n_clauses` replace
columns of these names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import mix, shingle_hashes, slices, text_bytes, word_hashes
from .shared import small_batches, written
from .transducers import Arc, Machine, Runner, compose

#: Labelled rows that are learnt from, at most (those with the smallest hash of their id).
MAX_FIT_ROWS = 12_000
STEMS = (5, 7)
LEAST_EVIDENCE = 16.0
#: Log ratio of a word's shares of toxic and of clean rows that an entry must exceed; it does not depend on the mix of labels.
LEAST_LOG_ODDS = 0.8
SCOPE = 3  # words over which a negation reaches
NEAR = 4  # words between an insult and its target
INTENT = 3  # words between an intent and its threat
STRONGER, INTENDED, AIMED = 1.15, 1.5, 1.25

# Words that the transducers know from the start.
THREATS = ["kill", "killed", "murder", "hurt", "destroy", "die", "beat", "stab", "shoot", "burn", "hang", "strangle", "poison", "töten", "umbringen", "sterben", "erschießen", "verprügeln", "abstechen", "erwürgen",
           "tuer", "mourir", "frapper", "égorger", "brûler", "étrangler", "matar", "morir", "golpear", "apuñalar", "quemar", "estrangular"]
TARGETS = ["you", "your", "yours", "he", "she", "they", "him", "her", "them", "his", "their", "is", "are", "was", "were", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "er", "sie", "bist", "ist", "seid", "sind",
           "tu", "toi", "te", "ton", "ta", "vous", "il", "elle", "ils", "elles", "est", "êtes", "es", "eres", "usted", "ustedes", "ellos", "ellas", "ella", "ti", "tú", "son"]
NEGATIONS = ["not", "no", "never", "without", "isn't", "aren't", "wasn't", "don't", "doesn't", "nicht", "kein", "keine", "keinen", "nie", "niemals", "ohne", "pas", "jamais", "sans", "aucun", "non", "nunca", "jamás", "sin", "ni", "ningún"]
SPEECH = ["said", "says", "say", "wrote", "writes", "called", "calls", "claims", "claimed", "quoted", "reported", "told", "asked", "sagte", "sagt", "schrieb", "nannte", "nennt", "behauptet", "fragte",
          "dit", "écrit", "appelé", "appelle", "affirme", "dijo", "dice", "escribió", "llamó", "afirma"]
INTENTS = ["will", "gonna", "going", "shall", "want", "should", "must", "werde", "werden", "will", "soll", "muss", "vais", "va", "veux", "dois", "voy", "va", "quiero", "debe"]
INTENSIFIERS = ["such", "so", "very", "total", "totally", "complete", "completely", "absolute", "absolutely", "utter", "really", "damn", "bloody", "fucking", "stupid", "dirty", "total", "völlig", "absolut", "echt", "verdammter", "verdammte",
                "vraiment", "totalement", "sale", "gros", "grosse", "muy", "tan", "totalmente", "maldito", "maldita"]

# A word of several lists has the first class. O is any other word; I is given by the lexicon.
_CLASS = {w: c for c, words in (("D", INTENSIFIERS), ("M", INTENTS), ("R", SPEECH), ("N", NEGATIONS), ("Y", TARGETS), ("T", THREATS)) for w in words}
_PLAIN = ["O", "Y", "N", "R", "M", "D"]


def insult_machine() -> Machine:
    """Reads I, T and plain words; an insult right behind an intensifier is stronger."""
    arcs = [Arc(s, x, x, STRONGER if s and x == "I" else 1.0, x == "D") for s in (False, True) for x in (*_PLAIN, "I", "T")]
    return Machine(False, frozenset([False, True]), tuple(arcs))


def threat_machine() -> Machine:
    """A state counts the words that an intent still reaches."""
    arcs = [Arc(k, x, x, INTENDED if k and x == "T" else 1.0, INTENT if x == "M" else max(0, k - 1)) for k in range(INTENT + 1) for x in (*_PLAIN, "I", "T")]
    return Machine(0, frozenset(range(INTENT + 1)), tuple(arcs))


def speech_machine() -> Machine:
    """Behind a verb of speech I and T become Ir and Tr."""
    arcs = [Arc(q, x, x + "r" if q and x in "IT" else x, 1.0, q or x == "R") for q in (False, True) for x in (*_PLAIN, "I", "T")]
    return Machine(False, frozenset([False, True]), tuple(arcs))


def negation_machine() -> Machine:
    """A state counts the words that a negation still reaches; there I and T become In and Tn."""
    arcs = [Arc(k, x, x + "n" if k and x in ("I", "T") else x, 1.0, SCOPE if x == "N" else max(0, k - 1)) for k in range(SCOPE + 1) for x in (*_PLAIN, "I", "T", "Ir", "Tr")]
    return Machine(0, frozenset(range(SCOPE + 1)), tuple(arcs))


#: What the last machine writes for each kind of insult or threat.
_CHANNEL = {"I": "plain", "T": "threat", "In": "negated", "Tn": "negated", "Ir": "reported", "Tr": "reported"}


def target_machine() -> Machine:
    """States: 0, no target near; k > 0, a target reaches k more words; k < 0, a target has been promised for one of the next -k words."""
    arcs = []
    for k in range(-NEAR, NEAR + 1):
        for x in _PLAIN:
            if x == "Y":
                arcs.append(Arc(k, x, "", 1.0, NEAR))
            elif k != -1:
                arcs.append(Arc(k, x, "", 1.0, k - 1 if k > 0 else k + 1 if k else 0))
        for x, channel in _CHANNEL.items():
            if k > 0:
                arcs.append(Arc(k, x, channel, AIMED, k - 1))
            elif k == 0:
                arcs += [Arc(0, x, channel, 1.0, 0), Arc(0, x, channel, AIMED, -NEAR)]
            elif k != -1:  # the target that is owed will be near this one, too
                arcs.append(Arc(k, x, channel, AIMED, k + 1))
    return Machine(0, frozenset(range(NEAR + 1)), tuple(arcs))


def machines() -> list[Machine]:
    """In the order in which they read."""
    return [insult_machine(), threat_machine(), speech_machine(), negation_machine(), target_machine()]


def grammar() -> Machine:
    return reduce(compose, machines())


_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
STOPS = ".!?;\n"
_STOP = re.compile(f"[{STOPS}]")
CHANNELS = ["plain", "negated", "reported", "threat", "largest", "clauses"]
WIDTH = len(CHANNELS)


@dataclass
class Lexicon:
    """Counts of labelled documents by entry; a key that ends in `*` is a stem."""

    toxic: int = 0
    clean: int = 0
    counts: dict[str, tuple[int, int]] = field(default_factory=dict)

    def weight(self, entry: str, own: int | None = None) -> float:
        p, n = self.counts[entry]
        a, b = self.toxic, self.clean
        if own is not None:
            p, a, n, b = p - own, a - own, n - (1 - own), b - (1 - own)
        return math.log((p + 1) / (a + 2)) - math.log((n + 1) / (b + 2))

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for word in {*(e.removesuffix("*") for e in self.counts), *THREATS}:
            out.add_word(word, len(word))
        out.make_automaton()
        return out

    def entry(self, word: str) -> str | None:
        if word in self.counts:
            return word
        for k in sorted(STEMS, reverse=True):
            if len(word) > k and (stem := word[:k] + "*") in self.counts:
                return stem
        return None


_runner: list[Runner] = []


def parse(words: list[str], lexicon: Lexicon, own: int | None) -> tuple[float, float, float, float, float]:
    """Run the composed machine over one clause: weights in the plain, negated, reported and threat channels, and the largest weight."""
    if not _runner:
        _runner.append(Runner(grammar()))
    symbols, met = [], False
    for w in words:
        kind, value = _CLASS.get(w, "O"), 0.0
        if entry := lexicon.entry(w):
            value = lexicon.weight(entry, own)
            kind = "I" if value > 0 else kind if kind != "T" else "O"
        elif kind == "T":
            value = 1.0
        met = met or kind in "IT"
        symbols.append((kind, value if kind in "IT" else 0.0))
    if not met:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    _, sums, largest = _runner[0].best(symbols)
    return sums.get("plain", 0.0), sums.get("negated", 0.0), sums.get("reported", 0.0), sums.get("threat", 0.0), largest


def channels(text: str, lexicon: Lexicon, automaton, own: int | None = None) -> np.ndarray:
    """The document's clause features."""
    text = text.lower()
    out = np.zeros(WIDTH)
    done = 0
    if not len(automaton):
        return out
    for last, size in automaton.iter(text):
        start = last - size + 1
        if start < done or start and text[start - 1].isalpha():
            continue
        # the clause around this word; later words in it are not parsed again
        first = max(done, *(text.rfind(c, done, start) + 1 for c in STOPS))
        stop = _STOP.search(text, start)
        done = stop.start() if stop else len(text)
        values = parse(_WORD.findall(text, first, done), lexicon, own)
        out[:4] += values[:4]
        out[4] = max(out[4], values[4])
        out[5] += values[4] > 0
    return out


def layer_inputs(x: np.ndarray) -> np.ndarray:
    return np.hstack([np.log1p(x), (x[:, 4:5] > 2), np.ones((len(x), 1))])


def fit_layer(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps."""
    a, w = layer_inputs(x), np.zeros(WIDTH + 2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + ridge * len(y) * 0.01 * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + (ridge * len(y) * 0.01 + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    layer: np.ndarray | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layer is None:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(layer_inputs(x) @ self.layer, -30, 30)))


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a value that near copies mostly share: the least hash of a text's 3-word shingles."""
    for batch in batches:
        for part in slices(batch, "text"):
            h, doc = shingle_hashes(*word_hashes(*text_bytes(part["text"])), 3)
            least = np.full(part.num_rows, np.uint64(0xFFFFFFFFFFFFFFFF))
            np.minimum.at(least, doc, mix(h))
            yield pa.record_batch([part["toxic"], part["text"], pa.array(least.view(np.int64))], ["toxic", "text", "copy"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for y, text in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words = set(_WORD.findall((text or "").lower()))
            (toxic if y else clean).update({w for w in words if len(w) > 2} | {w[:k] + "*" for w in words for k in STEMS if len(w) > k})
    every = list({*toxic, *clean})
    yield pa.record_batch([pa.array(every, pa.string()), pa.array([toxic[w] for w in every], pa.int64()), pa.array([clean[w] for w in every], pa.int64())], ["word", "p", "n"])


def _featured(lexicon: Lexicon) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def feature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            rows = [channels(t or "", lexicon, automaton, int(y)) for t, y in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True)]
            yield pa.record_batch([batch["toxic"], pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], ["toxic", "x"])

    return feature


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Model:
    """Learn from labels (doc_id, toxic) of docs; of repeated ids the largest label counts."""
    small_batches(docs.sparkSession)
    chosen = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    marked = texts.mapInArrow(_copies, "toxic int, text string, copy bigint")
    sample = written(marked.groupBy("copy", "toxic").agg(F.min("text").alias("text")).select("toxic", "text"), "toxic-sample")
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    p, n = totals.get(1, 0), totals.get(0, 0)
    if not p or not n:
        return Model(Lexicon(), None)
    share = p / (p + n)
    words = sample.mapInArrow(_counted, "word string, p bigint, n bigint").groupBy("word").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    # log-likelihood ratio of a word's labels against all labels
    rate = F.col("p") / (F.col("p") + F.col("n"))
    g = 2 * (F.col("p") * F.log(rate / share) + F.when(F.col("n") > 0, F.col("n") * F.log((1 - rate) / (1 - share))).otherwise(0.0))
    odds = F.log((F.col("p") + 1) / (p + 2)) - F.log((F.col("n") + 1) / (n + 2))  # as Lexicon.weight
    best = words.where("p > 0").withColumn("g", g).where((F.col("g") >= LEAST_EVIDENCE) & (odds > LEAST_LOG_ODDS))
    lexicon = Lexicon(p, n, {r["word"]: (r["p"], r["n"]) for r in best.collect()})
    rows = sample.mapInArrow(_featured(lexicon), "toxic int, x array<double>").limit(max_rows).collect()
    x, y = np.array([r["x"] for r in rows]).reshape(len(rows), WIDTH), np.array([r["toxic"] for r in rows], float)
    return Model(lexicon, fit_layer(x, y))


def _scoring(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.lexicon.automaton()
        for batch in batches:
            for part in slices(batch, "text"):
                x = np.array([channels(t or "", model.lexicon, automaton) for t in part["text"].to_pylist()]).reshape(-1, WIDTH)
                names = part.schema.names
                yield pa.record_batch([*(part[c] for c in names), pa.array(model.score(x)), pa.array(x[:, 5].astype(np.int64))], [*names, "score", "n_clauses"])

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and n_clauses, the clauses that matched."""
    small_batches(docs.sparkSession)
    kept = docs.drop("score", "n_clauses").withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("n_clauses", T.LongType())])
    return kept.mapInArrow(_scoring(model), schema)

"""Toxicity by a weighted finite-state pattern grammar.

A text is read as a tape of token classes, cut into clauses by STOP. Five transducers, each a table of (state, class) to
(next state, marks written, weight), are composed into one: insult marks insults; threat marks a verb of violence that
stands within REACH tokens of a person; target marks the end of a clause that names a person; negation marks what follows a
negator within NEGATION_SCOPE tokens; reported speech marks what follows a verb of saying or stands between quotation
marks. Weights along the cascade multiply. A clause's marked matches are summed by kind; a clause without a match, and a
word outside of a matched pattern, such as a verb of violence with nobody near, writes nothing.

The insult lexicon (words and stems of four to seven letters) is learnt from labelled texts of any language by a lower
bound of class odds; threats, targets, negators and verbs of saying are fixed. A logistic layer over the clause sums gives
the score. Lexicon and layer are fitted on bounded samples of labelled rows (LEXICON_ROWS and FIT_ROWS in the mean, chosen
by a hash of doc_id); every text is scored whole.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import bloom, bloom_columns, bloom_has, sliced, stage

#: Labelled rows, in the mean, that the lexicon and the logistic layer are fitted on; the log likelihood ratio that a term
#: needs, which chance gives one term in a million.
LEXICON_ROWS, FIT_ROWS, LEAST_RATIO = 200_000, 20_000, 14.0
STEMS = (4, 5, 6, 7)
NEGATION_SCOPE, REACH = 3, 4
# Closed word classes of the grammar.
THREATS = "kill hurt destroy burn punch beat stab shoot töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = "you your yours he him his she her they them their du dich dir ihr euch sie er tu toi vous il elle ils usted ustedes él ella ellos".split()
NEGATORS = "not no never neither nor without nicht kein keine nie niemals ne pas jamais sans no nunca sin".split()
SAYING = "said says say called calls claimed claims wrote writes quoted reported sagte sagt schrieb behauptet dit écrit affirme dijo dice escribió".split()
_TOKEN = re.compile(r"\w+|[.!?;:|\n\"«»“”„]")
_QUOTES, _STOPS = '"«»“”„', ".!?;:|\n"
NONE, STOP, QUOTE, TARGET, NEGATOR, SAYS, INSULT, THREAT = range(8)
PLAIN, NEGATED, REPORTED, TARGETED, MENACE, CLAUSES, PEAK, WORDS = range(8)


class Classes(dict):
    """Token -> class + 8 * index of its weight; learnt words first, then the longest learnt stem."""

    def __init__(self, lexicon: dict[str, float], most: int = 200_000):
        self.weights, self.most = [0.0], most
        self.words, self.stems = {}, {}
        for term, w in lexicon.items():
            (self.stems if term.endswith("*") else self.words)[term.rstrip("*")] = len(self.weights)
            self.weights.append(w)
        self.weights.append(1.0)
        self.fixed = {w: c for c, ws in ((TARGET, TARGETS), (NEGATOR, NEGATORS), (SAYS, SAYING)) for w in ws}
        self.fixed |= {w: THREAT + 8 * (len(self.weights) - 1) for w in THREATS} | {c: QUOTE for c in _QUOTES} | {c: STOP for c in _STOPS}

    def __missing__(self, token: str) -> int:
        k = self.words.get(token) or next((self.stems[token[:n]] for n in reversed(STEMS) if len(token) >= n and token[:n] in self.stems), 0)
        got = INSULT + 8 * k if k else self.fixed.get(token, NONE)
        if len(self) >= self.most:
            self.clear()
        self[token] = got
        return got


#: Marks on the tape, beside a symbol's class in the lowest three bits.
HIT, VIOLENT, NAMED, DENIED, TOLD = 8, 16, 32, 64, 128


class Transducer:
    """start, and step: {(state, class): (next state, marks, weight)}; pairs that are missing keep the state, write nothing."""

    def __init__(self, start, step: dict):
        self.start, self.step = start, step

    def __call__(self, state, symbol: int):
        then, marks, weight = self.step.get((state, symbol & 7), (state, 0, 1.0))
        # Negation and reported speech weigh what earlier transducers marked as a match, and nothing else.
        return (then, symbol | marks, weight) if not marks & (DENIED | TOLD) or symbol & HIT else (then, symbol, 1.0)


def insult() -> Transducer:
    return Transducer(0, {(0, INSULT): (0, HIT, 1.0)})


def threat() -> Transducer:
    """States: what is near (a verb of violence, a person or neither) and how many tokens ago."""
    step = {}
    for near in [(NONE, 0), *((c, k) for c in (THREAT, TARGET) for k in range(1, REACH + 1))]:
        kind, ago = near
        later = (kind, ago + 1) if kind and ago < REACH else (NONE, 0)
        for c in range(8):
            step[near, c] = (later, 0, 1.0)
        step[near, THREAT] = ((NONE, 0), HIT | VIOLENT, 1.0) if kind == TARGET else ((THREAT, 1), 0, 1.0)
        step[near, TARGET] = ((NONE, 0), HIT | VIOLENT, 1.0) if kind == THREAT else ((TARGET, 1), 0, 1.0)
        step[near, STOP] = ((NONE, 0), 0, 1.0)
    return Transducer((NONE, 0), step)


def target() -> Transducer:
    return Transducer(0, {(0, TARGET): (1, 0, 1.0), (1, STOP): (0, NAMED, 1.0)})


def negation() -> Transducer:
    """States: tokens that the last negator still reaches."""
    step = {(k, c): (max(0, k - 1), DENIED if k else 0, 0.3 if k else 1.0) for k in range(NEGATION_SCOPE + 1) for c in range(8)}
    step |= {(k, NEGATOR): (NEGATION_SCOPE, 0, 1.0) for k in range(NEGATION_SCOPE + 1)}
    return Transducer(0, step | {(k, STOP): (0, 0, 1.0) for k in range(NEGATION_SCOPE + 1)})


def reported() -> Transducer:
    """States: whether a verb of saying precedes, whether a quotation is open."""
    states = [(said, quoted) for said in (0, 1) for quoted in (0, 1)]
    step = {(s, c): (s, TOLD if any(s) else 0, 0.5 if any(s) else 1.0) for s in states for c in range(8)}
    step |= {((said, quoted), SAYS): ((1, quoted), 0, 1.0) for said, quoted in states} | {((said, quoted), QUOTE): ((said, 1 - quoted), 0, 1.0) for said, quoted in states}
    return Transducer((0, 0), step | {(s, STOP): ((0, 0), 0, 1.0) for s in states})


def compose(*cascade: Transducer) -> tuple[list[int], list[int], list[float]]:
    """One deterministic transducer of the states that can be reached: next state times 8, symbol written and weight, each
    at state * 8 + class; it starts in state 0."""
    number, todo = {tuple(t.start for t in cascade): 0}, [tuple(t.start for t in cascade)]
    then, wrote, weight = [], [], []
    for state in todo:
        for c in range(8):
            symbol, w, after = c, 1.0, []
            for t, s in zip(cascade, state, strict=True):
                s, symbol, x = t(s, symbol)
                after.append(s)
                w *= x
            key = tuple(after)
            if key not in number:
                number[key] = len(number)
                todo.append(key)
            then.append(8 * number[key])
            wrote.append(symbol)
            weight.append(w)
    return then, wrote, weight


NEXT, WROTE, WEIGHT = compose(insult(), threat(), target(), negation(), reported())


def tapes(text: str, classes: Classes) -> list[float]:
    """Sums of weights by kind of pattern, matched clauses, weight of the heaviest clause, words."""
    out = [0.0] * 8
    tokens = [classes[t] for t in _TOKEN.findall(text.lower())]
    out[WORDS] = len(tokens)
    if not tokens or max(tokens) < INSULT or not any(c & 7 >= INSULT for c in tokens):
        return out
    state, matched, plain, total = 0, False, 0.0, 0.0
    for c in [*tokens, STOP]:
        at = state + (c & 7)
        state, symbol = NEXT[at], WROTE[at]
        if symbol & HIT:
            w = 1.0 if symbol & VIOLENT else classes.weights[c >> 3]
            kind = NEGATED if symbol & DENIED else REPORTED if symbol & TOLD else MENACE if symbol & VIOLENT else PLAIN
            if kind == PLAIN:
                plain += w
            else:
                out[kind] += w
            matched, total = True, total + w * WEIGHT[at]
        elif c & 7 == STOP:
            if matched:
                person = symbol & NAMED
                out[TARGETED if person else PLAIN] += plain
                out[CLAUSES] += 1
                out[PEAK] = max(out[PEAK], total + 0.2 * plain if person else total)
            matched, plain, total = False, 0.0, 0.0
    return out


def features(rows: np.ndarray) -> np.ndarray:
    """Of tapes, one row for each text, with a constant. A text without a match has the constant alone, however long."""
    x = np.log1p(np.asarray(rows, float).reshape(-1, 8))
    matched = (x[:, CLAUSES] > 0).astype(float)
    return np.column_stack([np.ones(len(x)), x[:, :7], matched * (x[:, CLAUSES] - 0.5 * x[:, WORDS]), matched])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    b = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(x.T @ (x * w[:, None]) + penalty, x.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def terms(text: str) -> set[str]:
    words = {w for w in re.findall(r"\w+", text.lower()) if len(w) > 2}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}


def labelled(docs: DataFrame, labels: DataFrame, keep) -> DataFrame:
    """Staged (text, toxic, h) of documents with a label whose doc_id passes keep(column)."""
    known = labels.where(F.col("toxic").isin(0, 1) & keep(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    words = bloom(known, "doc_id")

    def run(batches):
        for b in sliced(batches):
            b = b.filter(pa.array(bloom_has(words, b)))
            yield b.select(["doc_id", "text"])

    few = docs.select("doc_id", "text", *bloom_columns("doc_id")).mapInArrow(run, "doc_id long, text string")
    return stage(few.join(known, "doc_id").select("text", "toxic", F.xxhash64("doc_id").alias("h")), "tox-train")


def term_counts(texts: DataFrame, only: set[str] | None = None) -> DataFrame:
    """(term, n): documents of texts(text) that hold each term, of `only` if given."""

    def run(batches):
        held: dict[str, int] = {}
        for b in sliced(batches):
            for text in b["text"].to_pylist():
                for t in terms(text or "") if only is None else terms(text or "") & only:
                    held[t] = held.get(t, 0) + 1
            if len(held) > 400_000:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["term", "n"])
                held = {}
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["term", "n"])

    return texts.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Every term whose lower bound of the log odds (at 1.64 deviations) is above log 3 and whose likelihood ratio against
    chance is above LEAST_RATIO; weight: that bound. Rows of train are bounded by the caller, so the terms are; clean texts
    are counted only for terms that no number of clean texts from none on rules out."""
    sums = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    clean, toxic = sums.get(0, 0), sums.get(1, 0)
    rate = toxic / max(1, clean + toxic)
    if not 0 < rate < 1:
        return {}
    bad = term_counts(train.where("toxic = 1").select("text")).where(F.col("n") * -math.log(rate) > LEAST_RATIO)
    often = {r["term"]: r["n"] for r in bad.collect()}
    good = {r["term"]: r["n"] for r in term_counts(train.where("toxic = 0").select("text"), set(often)).collect()} if often else {}
    rows = {}
    for term, n in often.items():
        m = good.get(term, 0)
        ratio = n * math.log(n / ((n + m) * rate)) + (m * math.log(m / ((n + m) * (1 - rate))) if m else 0.0)
        w = math.log((n + 0.5) / (toxic + 1)) - math.log((m + 0.5) / (clean + 1)) - 1.64 * math.sqrt(1 / (n + 0.5) + 1 / (m + 0.5))
        if w > math.log(3) and ratio > LEAST_RATIO:
            rows[term] = (n, w)
    # A stem that one word accounts for says nothing about other words.
    alone: dict[str, int] = {}
    for term, (n, _) in rows.items():
        for k in STEMS:
            if not term.endswith("*") and len(term) >= k:
                alone[term[:k] + "*"] = max(n, alone.get(term[:k] + "*", 0))
    return {t: w for t, (n, w) in sorted(rows.items()) if alone.get(t, 0) < 0.6 * n}


def train_model(docs: DataFrame, labels: DataFrame, keep) -> tuple[dict[str, float], np.ndarray]:
    train = labelled(docs, labels, keep)
    n = train.count()
    some = lambda rows: train.where(F.pmod("h", F.lit(1 << 30)) < (rows << 30) // n) if n > rows else train
    lexicon, sample = learn_lexicon(some(LEXICON_ROWS)), some(FIT_ROWS)

    def run(batches):
        classes = Classes(lexicon)
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array([tapes(t or "", classes) for t in b["text"].to_pylist()], pa.list_(pa.float64())), b["toxic"]], ["x", "toxic"])

    got = sample.select("text", "toxic").mapInArrow(run, "x array<double>, toxic int").toArrow()
    if not got.num_rows:
        return lexicon, np.array([-3.0, *[0.0] * 9])
    return lexicon, fit_logistic(features(got["x"].to_pylist()), got["toxic"].to_numpy().astype(float))


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, cut: float = 0.7, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text), then `columns` of docs.

    Learns from labels (doc_id, toxic) of documents whose crc32(doc_id as text) mod folds is not `held`. Null or empty
    texts match nothing and get the score of such; null doc_ids count as held out and have no label; labels that are null
    or neither 0 nor 1 are left out, of several for one doc_id the largest counts; repeated rows are scored alike; with no
    label every score is that of the constant. An empty table gives no row."""
    bucket = lambda c: F.crc32(c.cast("string").cast("binary")) % folds
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c for c in columns if c not in ("doc_id", "text")])
    lexicon, weights = train_model(docs.select("doc_id", "text"), labels, lambda c: bucket(c) != held)

    def run(batches):
        classes = Classes(lexicon)
        for b in sliced(batches):
            x = features([tapes(t or "", classes) for t in b["text"].to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            rest = [b[c] for c in extra]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(score), pa.array((score >= cut).astype(np.int32)), *rest], ["doc_id", "held_out", "score", "predicted", *extra])

    extra = [c for c in columns if c != "doc_id"]
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)
    out = docs.withColumn("held_out", F.coalesce(bucket(F.col("doc_id")) == held, F.lit(True)))
    return out.mapInArrow(run, f"doc_id long, held_out boolean, score double, predicted int{kinds}")

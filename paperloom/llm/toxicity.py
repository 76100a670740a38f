"""Toxicity by a weighted finite-state pattern grammar over clauses.

The lexical transducer reads words and writes class symbols with weights: insult, threat, intent, target, negation,
report or other. Five transducers then read class symbols and pass them on with marks and weights: insult (insults that
follow one another weigh more), threat (violent words behind a word of intent are threats that weigh more), negation,
reported speech and target, each of which marks the insults and threats in its scope. Their composition is compiled to
one table of states and symbols, through which all sentences with a match run at once. A clause's outcome is how its
insults and threats left the cascade, its weight what the arcs on their way add up to, and a text's score is a logistic
function of its matched clauses by outcome, so an isolated word counts only as the clause it stands in.

Function words are fixed values below; insult words and stems, and all coefficients, are learned from labelled texts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .shared import col

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END, COMMA, INTENT = range(9)
KINDS = 9
#: Function words of the grammar, in English, German, French and Spanish.
FUNCTION_WORDS = {
    THREAT: "kill hurt destroy beat smash burn töten schlagen vernichten tuer tuerai frapper détruire matar mataré golpear destruir",
    INTENT: "will shall ll gonna going must should werde werden wird soll vais va vas vamos voy doit debe",
    TARGET: "you your yourself u they he she him them those these people du dich dir ihr euch sie er tu te toi vous ils elle ti vos usted ustedes ellos ella",
    NEGATION: "not no never none isn aren don doesn nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún ninguna sin",
    REPORT: "said says say called calls wrote writes quoted sagte sagt nannte schrieb zitierte dit disait appelé écrit dijo dice llamó escribió",
}
PREFIXES = (4, 5, 6, 7, 8)
#: Outcomes of a clause, in order of the features.
OUTCOMES = ("aimed", "plain", "negated", "reported", "threat")
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_CLOSES = np.zeros(256, bool)
_CLOSES[list(b".!?;:\n|")] = True
#: Curly quotation marks and apostrophes as plain ones.
_QUOTES = (("\u2018", "'"), ("\u2019", "'"), ("\u201c", '"'), ("\u201d", '"'))


# transducers -----------------------------------------------------------------------------------------------------


class Transducer:
    """A deterministic weighted letter transducer: step(state, symbol) = (next state, written symbol, weight).

    A symbol is a kind (its low four bits) with marks.
    """

    def __init__(self, states: int, step):
        self.states, self.step = states, step

    def compose(self, then: Transducer) -> Transducer:
        """The machine that feeds what this one writes to `then`; weights add up."""

        def step(state, symbol):
            a, b = divmod(state, then.states)
            a, written, one = self.step(a, symbol)
            b, written, two = then.step(b, written)
            return a * then.states + b, written, one + two

        return Transducer(self.states * then.states, step)

    def run(self, symbols):
        state, out = 0, []
        for s in symbols:
            state, w, _ = self.step(state, s)
            out.append(w)
        return out


_NEGATED, _REPORTED, _AIMED, _INTENDED = 16, 32, 64, 128
#: Words over which the scopes of the transducers reach, and the weights of a second insult and of a threat with intent.
REACH = {"insult": 2, "threat": 4, "negation": 4, "target": 6}
PILED, INTENDED = 1.0, 1.0


def insults(reach: int = REACH["insult"], weight: float = PILED) -> Transducer:
    """An insult within `reach` words of another one in its clause weighs more."""

    def step(state, symbol):
        kind = symbol & 15
        if kind in (END, COMMA):
            return 0, symbol, 0.0
        if kind == INSULT:
            return reach, symbol, weight if state else 0.0
        return max(0, state - 1), symbol, 0.0

    return Transducer(reach + 1, step)


def scope(opener: int, mark: int, reach: int, marked: tuple[int, ...] = (INSULT, THREAT), weight: float = 0.0) -> Transducer:
    """Marks (and weighs) what stands up to `reach` words after the opener in its clause."""

    def step(state, symbol):
        kind = symbol & 15
        if kind in (END, COMMA):
            return 0, symbol, 0.0
        if kind == opener:
            return reach, symbol, 0.0
        if kind in marked and state:
            return state - 1, symbol | mark, weight
        return max(0, state - 1), symbol, 0.0

    return Transducer(reach + 1, step)


def reported() -> Transducer:
    """Marks all insults and threats from a reporting verb to the end of the sentence, over commas."""

    def step(state, symbol):
        kind = symbol & 15
        if kind == END:
            return 0, symbol, 0.0
        if kind == REPORT:
            return 1, symbol, 0.0
        return state, symbol | _REPORTED if state and kind in (INSULT, THREAT) else symbol, 0.0

    return Transducer(2, step)


def cascade() -> list[Transducer]:
    threats = scope(INTENT, _INTENDED, REACH["threat"], (THREAT,), INTENDED)
    return [insults(), threats, scope(NEGATION, _NEGATED, REACH["negation"]), reported(), scope(TARGET, _AIMED, REACH["target"])]


def grammar() -> Transducer:
    first, *others = cascade()
    for then in others:
        first = first.compose(then)
    return first


@dataclass
class Compiled:
    """A composed machine as tables of (state, kind): next state, written symbol, weight."""

    after: np.ndarray
    written: np.ndarray
    weight: np.ndarray

    def run(self, kinds: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Written symbols and weights of many sequences that start at the heads, a step of all of them at once."""
        written, weight = np.zeros(len(kinds), np.int64), np.zeros(len(kinds))
        size = np.diff(np.append(heads, len(kinds)))
        order = np.argsort(-size, kind="stable")
        at, left = heads[order], -size[order]
        state = np.zeros(len(heads), np.int64)
        for k in range(int(size.max(initial=0))):
            n = int(np.searchsorted(left, -k, "left"))  # those longer than k
            at, state = at[:n], state[:n]
            kind = kinds[at + k]
            written[at + k], weight[at + k] = self.written[state, kind], self.weight[state, kind]
            state = self.after[state, kind]
        return written, weight


@lru_cache(1)
def compiled() -> Compiled:
    machine = grammar()
    rows = [[machine.step(state, kind) for kind in range(KINDS)] for state in range(machine.states)]
    return Compiled(*(np.array([[arc[k] for arc in row] for row in rows], t) for k, t in enumerate((np.int64, np.int64, float))))


def outcome(symbol):
    """The number in OUTCOMES of insults and threats as they left the cascade."""
    aimed = np.where(symbol & _AIMED, 0, 1)
    return np.where(symbol & _REPORTED, 3, np.where(symbol & _NEGATED, 2, np.where(symbol & 15 == THREAT, 4, aimed)))


# lexicon ---------------------------------------------------------------------------------------------------------


def word_keys(text: str) -> int:
    raw = np.frombuffer(text.encode(), np.uint8)
    return int(flat.span_hash(flat.prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0])


def _stem_keys(prefix: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    return flat.mix(flat.span_hash(prefix, starts, starts + n) + np.uint64(n))


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    def one(text: str) -> str:
        text = text.lower()
        for curly, plain in _QUOTES:
            text = text.replace(curly, plain)
        return text

    return flat.flat_bytes(pa.array([one(t or "") for t in texts.to_pylist()], pa.large_string()))


def spans(raw: np.ndarray, offs: np.ndarray):
    """Words (runs of letters and digits; apostrophes part them) as starts, ends, text numbers."""
    inside = _INSIDE[raw]
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = np.diff(offs) > 0
    first, last = offs[:-1][full], offs[1:][full] - 1
    begins[first], closes[last] = inside[first], inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(offs, starts, "right") - 1


def _text_keys(raw, offs):
    """Distinct (key, text number) of words and stems; a stem is the first bytes of a longer word."""
    starts, ends, doc = spans(raw, offs)
    prefix = flat.prefix_hash(raw)
    keys, owner = [flat.span_hash(prefix, starts, ends)], [doc]
    for n in PREFIXES:
        long = ends - starts > n
        keys.append(_stem_keys(prefix, starts[long], n))
        owner.append(doc[long])
    key, own = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    return key[new], own[new]


@dataclass
class Model:
    keys: np.ndarray  # sorted keys of insult words and stems
    weights: np.ndarray
    coefficients: np.ndarray  # of the features of `features`, then the intercept

    def function_keys(self) -> dict[int, int]:
        return {word_keys(w): kind for kind, words in FUNCTION_WORDS.items() for w in words.split()}

    def lexicon(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys, classes and weights of the lexical transducer's arcs."""
        table = {k: (kind, 1.0) for k, kind in self.function_keys().items()}
        table |= {int(k): (INSULT, float(w)) for k, w in zip(self.keys, self.weights, strict=True)}
        order = sorted(table)
        return np.array(order, np.uint64), np.array([table[k][0] for k in order], np.int64), np.array([table[k][1] for k in order])


def _look_up(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index into the sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def features(raw: np.ndarray, offs: np.ndarray, model: Model, machine: Compiled) -> np.ndarray:
    """For each text: by outcome, the summed weights of its matched clauses (logs), and whether there is any.

    A clause counts once for an outcome, with the largest weight of its words: that of the word plus that of its arcs.
    """
    n = len(offs) - 1
    out = np.zeros((n, 2 * len(OUTCOMES)))
    starts, ends, doc = spans(raw, offs)
    if not len(starts):
        return out
    table, kinds, weights = model.lexicon()
    prefix = flat.prefix_hash(raw)
    found = _look_up(flat.span_hash(prefix, starts, ends), table)
    symbol = np.where(found >= 0, kinds[found], OTHER)
    weight = np.where(found >= 0, weights[found], 0.0)
    stem_only = model.keys
    for size in PREFIXES:
        long = np.flatnonzero((ends - starts > size) & (symbol != INSULT))
        hit = _look_up(_stem_keys(prefix, starts[long], size), stem_only)
        at = long[hit >= 0]
        symbol[at], weight[at] = INSULT, model.weights[hit[hit >= 0]]
    core = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
    if not len(core):
        return out
    closes, commas = (np.concatenate(([0], np.cumsum(x))) for x in (_CLOSES[raw], raw == 44))
    sentence, clause = closes[starts], commas[starts]
    edge = np.concatenate(([True], (sentence[1:] != sentence[:-1]) | (doc[1:] != doc[:-1])))
    number = np.cumsum(edge) - 1
    # what an apostrophe parts from its word (don't, you're) takes no place in a scope
    rest = np.zeros(len(starts), bool)
    rest[1:] = (starts[1:] == ends[:-1] + 1) & (raw[ends[:-1]] == 39) & (symbol[1:] == OTHER) & ~edge[1:]
    matched = np.zeros(number[-1] + 1, bool)
    matched[number[core]] = True
    at = np.flatnonzero(matched[number] & ~rest)
    # a comma symbol between words with a comma between them
    turns = np.flatnonzero((number[at][1:] == number[at][:-1]) & (clause[at][1:] != clause[at][:-1])) + 1
    kind, of = np.insert(symbol[at], turns, COMMA), np.insert(number[at], turns, number[at][turns])
    heavy, owner = np.insert(weight[at], turns, 0.0), np.insert(doc[at], turns, doc[at][turns])
    # other words beyond the reach of every scope change no state
    place = np.arange(len(kind))
    head = np.concatenate(([True], of[1:] != of[:-1]))
    keep = place - np.maximum.accumulate(np.where((kind != OTHER) | head, place, 0)) <= max(REACH.values()) + 1
    kind, of, heavy, owner, head = kind[keep], of[keep], heavy[keep], owner[keep], head[keep]
    written, added = machine.run(kind, np.flatnonzero(head))
    number = np.cumsum(head | (kind == COMMA)) - 1  # of the clause
    hits = np.flatnonzero((kind == INSULT) | (kind == THREAT))
    cell = number[hits] * len(OUTCOMES) + outcome(written[hits])
    cells, inverse = np.unique(cell, return_inverse=True)
    best = np.zeros(len(cells))
    np.maximum.at(best, inverse, heavy[hits] + added[hits])
    text = np.zeros(len(cells), np.int64)
    text[inverse] = owner[hits]
    np.add.at(out, (text, cells % len(OUTCOMES)), best)
    out[:, len(OUTCOMES) :] = out[:, : len(OUTCOMES)] > 0
    out[:, : len(OUTCOMES)] = np.log1p(out[:, : len(OUTCOMES)])
    return out


# fitting ---------------------------------------------------------------------------------------------------------


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """text, label of at most most_rows labelled, not held-out documents, those whose ids hash lowest; of rows that share an id, that whose text hashes lowest."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("label"))
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    # most_rows pairs of an id and a label are the bound of what is broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), F.xxhash64("text")).alias("row")).select("row.text", "row.label")


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 30_000, least_texts: int = 4, least_share: float = 0.01, least_odds: float = 5.5) -> Model:
    """A model from at most most_rows labelled texts.

    An entry is a word or stem of at least least_texts, and least_share of all, toxic texts whose smoothed log odds of being toxic exceed the
    overall ones by least_odds. Their number is bounded by the sample: the words and stems of its toxic texts over least_texts.
    Without any labels, or with one class only, the lexicon is empty and all texts score alike.
    """
    rows = training_rows(docs, labels, most_rows)

    def count(batches):
        for b in batches:
            label = b.column(1).to_numpy()
            raw, offs = lowered(b.column(0))
            for i, j in flat.chunks(offs):
                key, own = _text_keys(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                uniq, inverse = np.unique(key, return_inverse=True)
                toxic = label[i + own] > 0
                t, all_ = np.bincount(inverse[toxic], minlength=len(uniq)), np.bincount(inverse, minlength=len(uniq))

                yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(t), pa.array(all_ - t)], names=["key", "toxic", "clean"])

    totals = rows.groupBy("label").agg(F.count("*").alias("n")).collect()
    n1 = sum(r.n for r in totals if r.label > 0)
    n0 = sum(r.n for r in totals if r.label <= 0)
    width = 2 * len(OUTCOMES) + 1
    base = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not n1 or not n0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.append(np.zeros(width - 1), base))
    counted = rows.mapInArrow(count, "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.1) / (F.col("clean") + 0.1)) - F.lit(base)
    entries = counted.where(F.col("toxic") >= max(least_texts, least_share * n1)).withColumn("odds", odds).where(F.col("odds") >= least_odds).collect()
    keys = np.array([r.key for r in entries], np.int64).view(np.uint64)
    order = np.argsort(keys)
    model = Model(keys[order], np.array([r.odds for r in entries])[order], np.zeros(width))

    def measure(batches):
        machine = compiled()
        for b in batches:
            raw, offs = lowered(b.column(0))
            x = np.concatenate([features(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], model, machine) for i, j in flat.chunks(offs)]) if b.num_rows else np.zeros((0, width - 1))
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(x[:, k]) for k in range(width - 1))], names=["label", *(f"x{k}" for k in range(width - 1))])

    # at most most_rows rows of a few numbers
    sample = rows.mapInArrow(measure, "label int, " + ", ".join(f"x{k} double" for k in range(width - 1))).toPandas().to_numpy(float)
    sample = sample[np.lexsort(sample.T[::-1])]
    model.coefficients = logistic(sample[:, 1:], sample[:, 0] > 0)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept, last, is not shrunk."""
    x = np.column_stack((x, np.ones(len(x))))
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from its whole text alone; null and empty texts match nothing."""
    slim = docs.select(col(doc_id).alias("doc_id"), held_out(col(doc_id)).alias("held_out"), col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        machine = compiled()
        for b in batches:
            raw, offs = lowered(b.column(2))
            for i, j in flat.chunks(offs):
                x = features(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], model, machine)
                s = 1 / (1 + np.exp(-np.clip(x @ model.coefficients[:-1] + model.coefficients[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0

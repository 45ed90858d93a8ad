"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers read a clause word by word: insult (words and stems with weights), threat (an intent and then a verb of
harm, or a learned pair), target (whom it is said to, remembered for some words), negation (a scope of words) and reported
speech (till the clause ends). compose() runs them as one machine, whose state is the tuple of theirs and whose output for a
word is the weight and the marks of all of them. What a clause matches is scored as a clause: plain, targeted, negated,
reported or threatening. A document's score is a logistic function of the logarithms of one plus these sums.

Fit, on a bounded sample of labelled rows (the MOST_TOXIC and MOST_CLEAN with the least hashes of their ids), whole texts:

* insult: words, and stems of 4 to 8 letters where a stem tells as much, by a likelihood ratio that allows for the number
  of candidates;
* negation and reported speech: words before insults that tell clean documents from toxic ones among those with insults,
  negation if the words right before an insult tell as much as all before it;
* threat: pairs of words within REACH in toxic documents that no insult explains, by the same ratio;
* the five weights, with priors so that patterns never seen still count.

Executors make what the fit reads: words, marks of copies, cues and pairs of a document, and then its five sums.

Defined results: null, empty and wordless texts score as texts without a match (low, as the prior says); without labels
the lexicon is the fixed one and the weights are the priors; labels of repeated ids all count, of rows that repeat an id
the fit reads the least text; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from waymark.llm.common import add_columns, crc_part, drop, plain, small_batches, stored
from waymark.llm.ngram_join import mixed, shingles
from waymark.session import width

MOST_TOXIC, MOST_CLEAN, CUT, REACH, SCOPE = 3_000, 9_000, 0.7, 4, 3
KINDS = ("plain", "targeted", "negated", "reported", "threat")
PRIOR, BIAS, HOLD = np.array([6.0, 7.0, 1.5, 1.5, 12.0]), -3.5, 0.1
#: Log odds of a word or stem are clipped to LEXICON_MOST; sums are counted in UNITs.
LEXICON_MOST, UNIT = 8.0, 5.0
#: Pairs looked at, the most frequent ones: a bound of the fit, as that of its rows.
MOST_PAIRS = 20_000
#: What is learned tells as much as once in exp(CHANCE) fits by chance; log odds of insults are over LEAST, of cues over CUE.
CHANCE, LEAST, CUE = 10.0, 1.5, 1.5

# Small word lists of the grammar, in English, German, French and Spanish.
INSULTS = {"idiot": 2.5, "idiots": 2.5, "moron": 2.5, "morons": 2.5, "imbecile": 2.5, "scum": 2.5, "stupid": 1.5, "worthless": 1.5, "pathetic": 1.5, "disgusting": 1.5, "vermin": 2.0, "idioten": 2.5, "abschaum": 2.5, "dummkopf": 2.5, "idiota": 2.5, "imbécil": 2.5, "imbécile": 2.5, "connard": 2.5, "crétin": 2.5}
INTENT = {"will", "gonna", "shall", "going", "i'll", "we'll", "werde", "werden", "vais", "allons", "voy", "vamos"}
HARM = {"kill", "hurt", "destroy", "murder", "beat", "stab", "shoot", "burn", "töten", "umbringen", "verletzen", "tuer", "détruire", "frapper", "matar", "destruir", "golpear"}
TARGET = {"you", "your", "you're", "he", "she", "they", "them", "him", "her", "du", "dich", "dir", "ihr", "euch", "sie", "toi", "vous", "tu", "te", "ils", "elles", "tú", "usted", "ustedes", "vosotros"}
NEGATION = {"not", "no", "never", "isn't", "aren't", "don't", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "jamás"}
REPORT = {"said", "says", "called", "wrote", "quoted", "alleged", "claimed", "sagte", "nannte", "schrieb", "dit", "appelé", "écrit", "dijo", "llamó", "escribió"}
_CLAUSE, _WORD = re.compile(r"[.!?;:,\n]+"), re.compile(r"[\w']+|[\"«»“”„]")


@dataclass(frozen=True)
class Transducer:
    """start state, and step(state, word) -> (next state, weight, mark)."""

    start: object
    step: Callable[[object, str], tuple[object, float, str | None]]


def compose(*machines: Transducer) -> Transducer:
    """All machines on the same words: states pair up, weights add, marks gather."""

    def step(state, word):
        moves = [m.step(s, word) for m, s in zip(machines, state)]
        return tuple(x[0] for x in moves), sum(x[1] for x in moves), frozenset(x[2] for x in moves if x[2])

    return Transducer(tuple(m.start for m in machines), step)


def insult(weight_of: Callable[[str], float]) -> Transducer:
    def step(_, word):
        w = weight_of(word)
        return None, w, "insult" if w else None

    return Transducer(None, step)


def threat(pairs: frozenset[tuple[str, str]] = frozenset(), reach: int = REACH) -> Transducer:
    """An intent, and a verb of harm within so many words of it; or a pair of words as near."""
    openers = INTENT | {a for a, _ in pairs}

    def step(last, word):
        hit = any(a in INTENT and word in HARM or (a, word) in pairs for a in last if a)
        last = (*last[1:], word if word in openers else None) if not hit else (None,) * reach
        return last, 2.0 if hit else 0.0, "threat" if hit else None

    return Transducer((None,) * reach, step)


def remembered(words: set[str], reach: int, mark: str) -> Transducer:
    """Marks so many words after one of the words; reach -1: all that follow."""

    def step(left, word):
        left = reach if word in words else left - 1 if left > 0 else left
        return left, 0.0, mark if left else None

    return Transducer(0, step)


QUOTES = set('"«»“”„')


@dataclass
class Model:
    """stems: 'word$' is a whole word, 'stem' what words begin with."""

    stems: dict[str, float] = field(default_factory=lambda: {f"{w}$": v for w, v in INSULTS.items()})
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = BIAS
    negations: frozenset[str] = frozenset(NEGATION)
    reports: frozenset[str] = frozenset(REPORT)
    pairs: frozenset[tuple[str, str]] = frozenset()


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}
        self.lengths = sorted({len(s) for s in model.stems if not s.endswith("$")}, reverse=True)
        parts = [re.escape(s[:-1]) + r"(?!\w)" if s.endswith("$") else re.escape(s) for s in sorted(model.stems)]
        parts += [re.escape(w) + r"(?!\w)" for w in sorted(HARM | {b for _, b in model.pairs})]
        self.any = re.compile(r"(?<!\w)(?:" + "|".join(parts) + ")")
        self.machine = compose(insult(self.weight), threat(model.pairs), remembered(TARGET, 6, "target"), remembered(model.negations, SCOPE, "negated"), remembered(model.reports | QUOTES, -1, "reported"))

    def weight(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            stems = self.model.stems
            w = stems.get(f"{word}$") or next((stems[word[:k]] for k in self.lengths if word[:k] in stems), 0.0)
            if len(self.known) < 200_000:
                self.known[word] = w
        return w

    def clause(self, text: str) -> np.ndarray:
        """What the grammar finds in a clause, by kind."""
        found, state, words = np.zeros(len(KINDS)), self.machine.start, _WORD.findall(text)
        target = any(w in TARGET for w in words)
        for w in words:
            state, weight, marks = self.machine.step(state, w)
            if "threat" in marks:
                found[4] += weight
            elif "insult" in marks:
                kind = 2 if "negated" in marks else 3 if "reported" in marks else 1 if target and ("target" in marks or len(words) <= 8) else 0
                found[kind] += weight
        return found

    def clauses(self, text: str | None) -> Iterator[str]:
        """The clauses in which there may be a match, in order."""
        low, done = (text or "").lower(), -1
        for m in self.any.finditer(low):
            if m.start() < done:
                continue
            # Clauses are met from left to right, so one begins at the last mark after the one before.
            begin = max((x.end() for x in _CLAUSE.finditer(low, max(done, 0), m.start())), default=max(done, 0))
            stop = _CLAUSE.search(low, m.end())
            done = stop.start() if stop else len(low)
            yield low[begin:done]

    def features(self, text: str | None) -> np.ndarray:
        return np.log1p(sum((self.clause(c) for c in self.clauses(text)), np.zeros(len(KINDS))) / UNIT)

    def cues(self, text: str | None) -> tuple[bool, set[str], set[str]]:
        """Whether there is an insult, the words within SCOPE before insults, and all in their clauses before them."""
        near, before, some = set(), set(), False
        for c in self.clauses(text):
            words = _WORD.findall(c)
            at = [k for k, w in enumerate(words) if self.weight(w)]
            some = some or bool(at)
            for k in at:
                near.update(words[max(0, k - SCOPE + 1) : k])
                before.update(words[:k])
        return some, near, before

    def score(self, text: str | None) -> float:
        z = float(self.features(text) @ self.model.weights) + self.model.bias
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def marks(text: str) -> list[int]:
    """Four minima over word triples: near copies have one in common."""
    s = shingles(text, 3)
    return [int(mixed(s, 100 + k).min() >> np.uint64(1)) for k in range(4)] if len(s) else []


def different(all_marks: list[list[int]]) -> list[int]:
    """Without copies and near copies, so that a copied text counts once."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for i, own in enumerate(all_marks):
        own = list(enumerate(own))
        if not any(m in seen for m in own):
            kept.append(i)
        seen.update(own)
    return kept


def told(a: int, b: int, p: int, n: int, among: int, least: float) -> float:
    """The log odds of something in a of p documents against b of n, if they are over least and tell more than the
    best of so many would by chance; else 0."""
    odds = math.log((a + 0.5) / (p + 1)) - math.log((b + 0.5) / (n + 1))
    share = p / max(p + n, 1)
    if odds <= least or not a:
        return 0.0
    ratio = a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0)
    return odds if ratio > math.log(among + 1) + CHANCE else 0.0


def words_of(text: str) -> set[str]:
    return {w for w in re.findall(r"[^\W\d_]+", text.lower()) if len(w) > 2}


def _stems(word: str) -> list[str]:
    return [f"{word}$", *(word[:k] for k in range(4, min(9, len(word))))]


def _count(docs: list[set[str]], of: Callable[[str], list[str]]) -> Counter:
    """In how many documents there is what of(word) gives for any of its words."""
    made: dict[str, list[str]] = {}
    found: Counter = Counter()
    for words in docs:
        for w in words:
            if w not in made:
                made[w] = of(w)
        found.update({x for w in words for x in made[w]})
    return found


def candidates(toxic: list[set[str]], clean: int) -> tuple[Counter, int]:
    """Words and stems that may tell toxic documents (given as sets of words) from so many clean ones: those in so many that
    they would if no clean one held them, with these numbers; and how many were looked at."""
    pos = {x: k for x, k in _count(toxic, _stems).items() if k >= 3}
    return Counter({x: k for x, k in pos.items() if told(k, 0, len(toxic), clean, len(pos), LEAST)}), len(pos)


def held(wanted: set[str], words: set[str]) -> set[str]:
    return {x for w in words for x in _stems(w) if x in wanted}


def lexicon(pos: Counter, neg: Counter, p: int, n: int, among: int) -> dict[str, float]:
    """Those of the candidates that tell p toxic documents from n clean ones, with their log odds."""
    found = {x: odds for x in pos if (odds := told(pos[x], neg[x], p, n, among, LEAST))}
    # A stem that a longer one (or one word) explains as well gives way to it; then the shortest left stand for all.
    for x in sorted(found, key=len):
        if not x.endswith("$") and any(y != x and y.startswith(x) and pos[y] >= 0.97 * pos[x] for y in found):
            del found[x]
    return {x: round(min(w, LEXICON_MOST), 4) for x, w in found.items() if not any(x != y and x.startswith(y) for y in found)}


def cue_words(docs: list[tuple[int, list[str], list[str]]]) -> tuple[set[str], set[str]]:
    """Words of negation and of report, from documents with insults: (label, words near before, words before)."""
    n, p = (sum(y == k for y, _, _ in docs) for k in (0, 1))
    count = {(at, y): Counter(w for d in docs if d[0] == y for w in d[1 + at]) for at in (0, 1) for y in (0, 1)}
    wanted = {w for w, k in count[1, 0].items() if k >= 3}
    negated, reported = set(), set()
    for w in wanted:
        near, before = (told(count[at, 0][w], count[at, 1][w], n, p, len(wanted), CUE) for at in (0, 1))
        if near or before:
            (negated if near and count[0, 0][w] >= 0.8 * count[1, 0][w] else reported).add(w)
    return negated, reported


def word_pairs(text: str) -> set[tuple[str, str]]:
    """Words of one clause within REACH of each other, in order."""
    found = set()
    for c in _CLAUSE.split(text.lower()):
        words = [w for w in _WORD.findall(c)]
        found |= {(a, b) for k, b in enumerate(words) for a in words[max(0, k - REACH) : k] if len(b) > 2}
    return found


def weights_of(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """The maximum a posteriori of the kinds' weights and the bias, by Newton's method. x: a row of sums for each document."""
    x = np.column_stack([x.reshape(-1, len(KINDS)), np.ones(len(y))])
    prior = np.append(PRIOR, BIAS)
    w, hold = prior.copy(), np.full(len(prior), HOLD)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (q - y) + hold * (w - prior)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(hold), g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return np.maximum(w[:-1], 0.0), float(w[-1])


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, seed: int) -> DataFrame | None:
    """Stored (y, id, t): at most MOST_TOXIC + MOST_CLEAN labelled documents."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").withColumn("h", F.xxhash64(F.lit(seed), "id"))
    keys = [rows.where(F.col("y") == y).orderBy("h", "id").limit(n).select("id", "y") for y, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    keys = stored(keys[0].unionAll(keys[1]), "toxic-keys")
    if keys.isEmpty():
        return None
    given, name = plain(docs)
    ids = keys.select("id").distinct()
    texts = given.select(F.col(name[id_col]).alias("id"), F.col(name[text_col]).alias("t")).where("t is not null").join(F.broadcast(ids), "id").groupBy("id").agg(F.min("t").alias("t"))
    return stored(keys.join(texts, "id").select("y", "id", "t").repartition(width(docs.sparkSession)), "toxic-sample")


def _made(sample: DataFrame, schema: str, of: Callable[[int, str], Iterator[tuple] | list[tuple]]) -> DataFrame:
    """Rows that of(label, text) gives for each document of the sample, after its id."""
    whole = T.StructType([sample.schema["id"], *T._parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *r) for y, i, t in zip(*(c.to_pylist() for c in b.columns)) for r in of(y, t)]
            yield pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return sample.mapInArrow(run, whole)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 3) -> Model:
    """From the rows of labels (id, label); whoever calls leaves out what must not be learned from."""
    small_batches(docs.sparkSession)
    sample = _sample(docs, labels, id_col, text_col, label_col, seed)
    if sample is None:
        return Model()
    rows = _made(sample.where("y = 1"), "marks array<long>, words array<string>", lambda y, t: [(marks(t), sorted(words_of(t)))]).orderBy("id").collect()
    toxic = [rows[i] for i in different([r["marks"] for r in rows])]
    clean = sample.where("y = 0").count()
    pos, among = candidates([set(r["words"]) for r in toxic], clean)
    wanted = set(pos)
    against = _made(sample.where("y = 0"), "x string", lambda y, t: [(x,) for x in held(wanted, words_of(t))]).groupBy("x").agg(F.count("*").alias("n")).collect() if wanted else []
    learned = lexicon(pos, Counter({r["x"]: r["n"] for r in against}), len(toxic), clean, among)
    model = Model()
    model.stems = {s: w for s, w in model.stems.items() if not any(s.startswith(x) for x in learned if not x.endswith("$"))} | learned
    own = {r["id"] for r in toxic}

    def context(y: int, t: str) -> list[tuple]:
        some, near, before = _scorer(model).cues(t)
        return [(y, some, sorted(near), sorted(before))]

    found = _made(sample, "y int, some boolean, near array<string>, before array<string>", context).collect()
    seen = [r for r in found if r["some"] and (not r["y"] or r["id"] in own)]
    negated, reported = cue_words([(r["y"], r["near"], r["before"]) for r in seen])
    model.negations, model.reports = model.negations | negated, model.reports | reported
    # Pairs of the toxic documents that nothing explains so far, then how often clean ones hold those.
    left = {r["id"] for r in found if r["y"] and not r["some"]} & own
    if len(left) >= 3:
        pairs = _made(sample.where((F.col("y") == 1) & F.col("id").isin(sorted(left))), "a string, b string", lambda y, t: list(word_pairs(t)))
        pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "a", "b").limit(MOST_PAIRS).collect()
        wanted = {(r["a"], r["b"]): r["n"] for r in pairs if told(r["n"], 0, len(left), clean, len(pairs), LEAST)}
        names = list(wanted)
        rows = _made(sample.where("y = 0"), "k int", lambda y, t: [(k,) for k in _held(names, t)]).groupBy("k").agg(F.count("*").alias("n")).collect() if wanted else []
        against = {names[r["k"]]: r["n"] for r in rows}
        model.pairs = frozenset(x for x, n in wanted.items() if told(n, against.get(x, 0), len(left), clean, len(pairs), LEAST))
    sums = _made(sample, "y int, x array<double>", lambda y, t: [(y, _scorer(model).features(t).tolist())]).orderBy("id", "y").collect()
    model.weights, model.bias = weights_of(np.array([r["x"] for r in sums]), np.array([float(r["y"]) for r in sums]))
    drop(sample)
    return model


def _held(pairs: list[tuple[str, str]], text: str) -> list[int]:
    """The places of the pairs that the text holds."""
    ends: dict[str, dict[str, int]] = {}
    for k, (a, b) in enumerate(pairs):
        ends.setdefault(b, {})[a] = k
    found = set()
    for c in _CLAUSE.split(text.lower()):
        words = _WORD.findall(c)
        for k, b in enumerate(words):
            if own := ends.get(b):
                found |= {own[a] for a in words[max(0, k - REACH) : k] if a in own}
    return sorted(found)


_last: list = [None, None]


def _scorer(model: Model) -> Scorer:
    """One per worker and model."""
    if _last[0] is not model:
        _last[:] = [model, Scorer(model)]
    return _last[1]


def score(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """docs with score and predicted (names get _ if taken)."""

    def make():
        s = Scorer(model)

        def values(texts: list) -> list[list]:
            scores = [s.score(x) for x in texts]
            return [scores, [int(x >= cut) for x in scores]]

        return values

    return add_columns(docs, text_col, [("score", T.DoubleType()), ("predicted", T.IntegerType())], make)


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels that may be learned from: remainder of crc32(id) by 3 other than 1."""
    return labels.where(crc_part(F.col(id_col), 3) != 1)

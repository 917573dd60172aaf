"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, and the words of a clause become classes: abuse,
threat verb, target, negation, verb of saying and so on.  A cascade of four
weighted transducers (see ``transducers``) reads them:

* *negation* ("not", "nicht", ...) lowers the abuse and threats it reaches;
* *reported speech* (a verb of saying, before or with a quotation) lowers them;
* *insult* accepts an abusive word as a match if a target (second or third
  person) stands within ``REACH`` words before or behind it; otherwise it is
  lone and keeps little of its weight;
* *threat* accepts a verb as a match with an addressed target behind it ("hurt
  you") or an object before ("dich töten"), and with any target behind it where
  an intent stands before ("will", "i'll") or it is an order ("kill yourself").
  With another target ("they attack her") or an intent only ("will kill time")
  it is lone, as narration reads alike.

The lexicon comes first in the cascade: an abusive word reads as abuse with
its weight or as any other word with none, and the heaviest path decides.  A
seed lexicon is extended by words and word beginnings learned from labelled
training rows (those with a lower bound of their log odds), so invented or foreign abuse
counts too; labels weigh threat verbs alike.

The weight of a text is the sum of its matches and the densest passage of
``PASSAGE`` words of lone words, less a term that grows with the logarithm of
the text's length, as the densest of many passages is dense by chance.  The
score is a logistic of that weight; its centre and slope are fitted on the
training rows, each weighed by the entries that the other half of them
teaches, and bound so that one lone word never reaches the threshold.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.batches import bound_batches
from kinweave.llm.samples import held_out, training_texts
from kinweave.llm.transducers import Transducer, best_path, compose, machine
from kinweave.storage import discard, materialize

#: Labelled rows that teach the lexicon, at most.
SAMPLE_ROWS = 6000
#: Partial counts that a task holds before it passes them on.
HELD_COUNTS = 50_000
#: Toxic sample texts that must hold an entry before it is weighed; copies of a text count once.
LEAST_SUPPORT = 4
#: Lower bound of the log odds that a learned entry needs, and how many standard
#: deviations it lies below them: many, as very many entries are looked at.
LEAST_ODDS, DEVIATIONS = 1.5, 3.0
#: Longest word beginning that is learned.
STEM = (4, 7)
PREDICT_FROM = 0.3

# Function words of the grammar, lower case.
TARGET = frozenset("you your yours yourself u they them he she him her these those du dich dir ihr euch sie tu toi te vous ils elles tú usted ustedes vosotros ellos ellas".split())
NEGATION = frozenset("not no never isn't aren't wasn't don't doesn't nobody nicht kein keine nie niemals ne pas jamais nunca jamás ningún".split())
REPORTED = frozenset("said says say told wrote writes called calls quoted according claimed alleged sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó".split())
INSULT = frozenset("idiot idiots moron morons stupid scum trash worthless pathetic loser losers disgusting clown imbecile dumb dumbass fool bastard bitch asshole arschloch dummkopf abschaum trottel connard salope imbécile estúpido estúpida idiota basura imbécil".split())
THREAT = frozenset("kill hurt beat destroy murder attack stab shoot punch töten umbringen schlagen tuer frapper détruire matar golpear destruir".split())
INTENT = frozenset("will gonna going should must werde werden soll vais vas va voy vamos i'll we'll you'll he'll she'll they'll shall imma".split())
#: Targets that are an object wherever they stand, and those that are one behind the verb.
OBJECT = frozenset("dich dir euch te toi yourself".split())
ADDRESSED = OBJECT | frozenset("you your yours u du ihr vous tu tú usted ustedes vosotros".split())
#: Words that may open an order, before its verb.
OPENING = frozenset("go just please now and then".split())

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?\n;]|[\"“”«»„]")
STOPS = frozenset(".!?\n;")
QUOTES = frozenset('"“”«»„')

# Weights of the grammar, on the scale of log odds.
SEED_WEIGHT, MOST_WEIGHT = 4.0, 4.5
TARGETED, LONE, NEGATED, REPORT = 1.0, -2.0, -3.5, -3.5
#: Words of a passage in which lone words add up.
PASSAGE = 100
#: Weight that the lone words lose per unit of the logarithm of the number of passages.
LENGTH_TERM = 0.5
#: Words back or ahead in a clause that a target, negation or intent reaches.
REACH = 4
#: Words after a verb of saying in which a quotation is its own.
SAID_REACH = 2 * REACH
#: Standard deviations of the centre and the slope around their defaults, in the fit.
CENTRE_PRIOR, SLOPE_PRIOR = 1.0, 0.5

# Word classes: other, targets (third person, addressed, object), negation,
# saying, quotation mark, intent, opening, abuse, verb of threat, end of clause;
# and what is written for abuse: a match or a lone word.
OTHER, THIRD, ADDRESS, OBJ, NOT, SAY, MARK, WILL, OPEN, ABUSE, VERB, STOP = "otybnsqipav."
MATCH, ALONE = "ml"
#: Classes that open a clause inside a quotation: one that somebody said, and another.
INSIDE_SAID, INSIDE = "QU"
_READ = OTHER + THIRD + ADDRESS + OBJ + NOT + SAY + MARK + WILL + OPEN + ABUSE + VERB + INSIDE_SAID + INSIDE
_TARGETS = THIRD + ADDRESS + OBJ
_SILENT = MARK + INSIDE_SAID + INSIDE  # no words


def _older(since: int, most: int = REACH + 1) -> int:
    return min(since + 1, most)


def negation() -> Transducer:
    """States are the words that a negation still reaches."""

    def step(left: int, x: str):
        if x in _SILENT:
            return [(x, 0.0, left)]
        to = REACH - 1 if x == NOT else max(0, left - 1)
        return [(x, NEGATED if left and x in ABUSE + VERB else 0.0, to)]

    return machine(0, _READ, step, lambda _: True)


def reported() -> Transducer:
    """States are the words since a verb of saying and the quotation that is open."""

    def step(state: tuple[int, str], x: str):
        said, quote = state
        if x in INSIDE_SAID + INSIDE:
            return [(x, 0.0, (said, x))]
        if x == MARK:
            return [(x, 0.0, (said, "" if quote else INSIDE_SAID if said <= SAID_REACH else INSIDE))]
        told = quote == INSIDE_SAID or not quote and said < REACH
        return [(x, REPORT if told and x in ABUSE + VERB else 0.0, (0 if x == SAY else _older(said, SAID_REACH + 1), quote))]

    return machine((SAID_REACH + 1, ""), _READ, step, lambda _: True)


def insult() -> Transducer:
    """States are the words since a target, and those left to find one that a match relies on."""

    def step(state: tuple[int, int], x: str):
        since, owed = state
        if x in _SILENT:
            return [(x, 0.0, state)]
        now = 0 if x in _TARGETS else _older(since)
        left = 0 if now == 0 else owed - 1
        if owed and now and not left:
            return []
        left = max(0, left)
        if x != ABUSE:
            return [(x, 0.0, (now, left))]
        out = [(ALONE, LONE, (now, left)), (MATCH, TARGETED, (now, left or REACH))]
        return [*out, (MATCH, TARGETED, (now, left))] if since < REACH else out

    return machine((REACH + 1, 0), _READ, step, lambda s: s[1] == 0)


def threat() -> Transducer:
    """States are the words since an intent, an object and a target, whether an
    order may begin, and the kind of target and the words left for what a
    reading relies on."""

    def step(state: tuple[int, int, int, bool, str, int], x: str):
        will, thing, target, opened, kind, owed = state
        if x in _SILENT:
            return [(x, 0.0, state)]
        found = x in _TARGETS and (kind != ADDRESS or x in ADDRESS + OBJ)
        if owed == 1 and not found:
            return []
        kind, owed = (kind, owed - 1) if owed and not found else ("", 0)
        now = (0 if x == WILL else _older(will), 0 if x == OBJ else _older(thing), 0 if x in _TARGETS else _older(target), opened and x == OPEN)
        if x != VERB:
            return [(x, 0.0, (*now, kind, owed))]
        out = []
        if thing < REACH:
            out.append((MATCH, TARGETED, (*now, kind, owed)))
        if target < REACH or will < REACH:
            out.append((ALONE, LONE, (*now, kind, owed)))
        if not owed:
            out += [(MATCH, TARGETED, (*now, ADDRESS, REACH)), (ALONE, LONE, (*now, THIRD, REACH))]
            out += [(MATCH, TARGETED, (*now, THIRD, REACH))] if opened or will < REACH else []
        return out

    far = REACH + 1
    return machine((far, far, far, True, "", 0), _READ + MATCH + ALONE, step, lambda s: s[5] == 0)


def cascade() -> list[Transducer]:
    return [negation(), reported(), insult(), threat()]


@dataclass
class Lexicon:
    """Weights of abusive words, word beginnings and threat verbs, and the decision scale."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    threats: dict[str, float] = field(default_factory=dict)
    centre: float = 3.0
    slope: float = 1.5

    def weight(self, word: str) -> float:
        """The weight of a lower-case word, by the longest entry that fits; 0 if there is none."""
        w = self.words.get(word)
        if w is not None or not self.stems:
            return w or 0.0
        for k in range(min(STEM[1], len(word)), STEM[0] - 1, -1):
            w = self.stems.get(word[:k])
            if w is not None:
                return w
        return 0.0


_CLASSES: dict[str, str] = {}
for _words, _class in ((TARGET, THIRD), (ADDRESSED, ADDRESS), (OBJECT, OBJ), (NEGATION, NOT), (REPORTED, SAY), (INTENT, WILL), (OPENING, OPEN), (THREAT, VERB), (STOPS, STOP), (QUOTES, MARK)):
    _CLASSES |= dict.fromkeys(_words, _class)


class _Classes(dict):
    """The class of each word, remembered."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self._lexicon = lexicon

    def __missing__(self, word: str) -> str:
        found = _CLASSES.get(word)
        if found == VERB:
            found = VERB if self._lexicon.threats.get(word, SEED_WEIGHT) > 0 else OTHER
        found = found or (ABUSE if self._lexicon.weight(word) > 0 else OTHER)
        if len(self) < 100_000:
            self[word] = found
        return found


@cache
def _machine() -> Transducer:
    """The composed transducers of this process; they don't depend on a lexicon."""
    return compose(*cascade())


class Grammar:
    """The lexicon before the composed transducers, run over one text at a time."""

    def __init__(self, lexicon: Lexicon):
        self._lexicon, self._classes = lexicon, _Classes(lexicon)
        #: Threat verbs that the text read last holds as matches.
        self.threats: set[str] = set()

    def readings(self, word: str, of: str) -> list[tuple[str, float]]:
        """What the lexicon makes of a word of a class."""
        if of == ABUSE:
            return [(ABUSE, self._lexicon.weight(word)), (OTHER, 0.0)]
        if of == VERB:
            return [(VERB, self._lexicon.threats.get(word, SEED_WEIGHT)), (OTHER, 0.0)]
        return [(of, 0.0)]

    def accepted(self, text: str | None) -> float:
        """The weight of the text's matched clauses and of its densest lone words.

        Only clauses with abuse or a threat verb are read by the machines, as
        all others weigh nothing, and of them only what the machines' states
        can remember around these words.
        """
        self.threats.clear()
        if not text:
            return 0.0
        words = WORD.findall(text.lower().replace("\u2019", "'"))
        classes = "".join(map(self._classes.__getitem__, words))
        matched, lone = 0.0, []
        at, seen, quote = self._next(classes, 0), 0, ""
        while at >= 0:
            begin = classes.rfind(STOP, 0, at) + 1
            end = classes.find(STOP, at)
            end = len(classes) if end < 0 else end
            quote, seen = _quotation(classes, seen, begin, quote), begin
            last = max(classes.rfind(ABUSE, at, end), classes.rfind(VERB, at, end))
            a, b = max(begin, at - SAID_REACH - REACH), min(end, last + REACH + 2)
            if a > begin:
                quote, seen = _quotation(classes, seen, a, quote), a
            before = ([OTHER] if a > begin else []) + ([quote] if quote else [])
            places = [[(x, 0.0)] for x in before] + [self.readings(words[i], classes[i]) for i in range(a, b)]
            for place, out, weight in best_path(_machine(), places)[1]:
                i = a + place - len(before)
                if out == MATCH:
                    matched += weight
                    if classes[i] == VERB:
                        self.threats.add(words[i])
                else:
                    lone.append((i, min(weight, SEED_WEIGHT + LONE)))
            at = self._next(classes, end)
        densest, held, first = 0.0, 0.0, 0
        for i, weight in lone:
            held += weight
            while lone[first][0] <= i - PASSAGE:
                held -= lone[first][1]
                first += 1
            densest = max(densest, held)
        if densest and len(words) > PASSAGE:
            densest = max(0.0, densest - LENGTH_TERM * math.log(len(words) / PASSAGE))
        return matched + densest

    @staticmethod
    def _next(classes: str, at: int) -> int:
        found = [i for i in (classes.find(ABUSE, at), classes.find(VERB, at)) if i >= 0]
        return min(found) if found else -1

    def score(self, text: str | None) -> float:
        """The probability that a text is toxic; a text without matches is far below."""
        lex = self._lexicon
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, lex.slope * (self.accepted(text) - lex.centre)))))


def _quotation(classes: str, a: int, b: int, quote: str) -> str:
    """The quotation that is open at place b, if ``quote`` was at place a."""
    at = classes.find(MARK, a, b)
    while at >= 0:
        said = classes.rfind(SAY, max(0, at - SAID_REACH - 1), at)
        quote = "" if quote else INSIDE_SAID if said >= 0 and STOP not in classes[said:at] else INSIDE
        at = classes.find(MARK, at + 1, b)
    return quote


def _features(text: str) -> tuple[Counter, Counter]:
    """How often a text holds each word and word beginning that may be learned."""
    words = Counter(w for w in WORD.findall(text.lower()) if w not in _CLASSES)
    stems: Counter = Counter()
    for w, n in words.items():
        for k in range(STEM[0], min(STEM[1], len(w)) + 1):
            stems[w[:k]] += n
    return words, stems


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """Learn weights from a bounded sample of labelled training rows.

    Executors count, per word and word beginning, how often toxic and other
    sample documents hold it, and how many do; the driver sees the entries
    that stand out only.  Without labels, or with one class only, the seed
    lexicon alone counts.
    """
    bound_batches(documents.sparkSession)
    rows = training_texts(documents, labels, "toxic", sample_rows, seed=10).dropDuplicates(["text", "y"])
    sample = materialize(rows.withColumn("half", (F.xxhash64(F.lit(3), "text") % 2 != 0).cast("int")), "toxic-sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[tuple[int, str, str], list[int]] = defaultdict(lambda: [0, 0, 0, 0])

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(*k, *v) for k, v in n.items()], columns=[c.split()[0] for c in _COUNTS.split(", ")])
            n.clear()
            return out

        grammar = Grammar(Lexicon())
        for rows in batches:
            for text, y, half in zip(rows["text"], rows["y"], rows["half"], strict=True):
                words, stems = _features(text or "")
                grammar.accepted(text)
                side = 2 if y else 0
                for kind, found in (("w", words), ("s", stems), ("t", dict.fromkeys(grammar.threats, 1)), ("*", {"": words.total()})):
                    for entry, times in found.items():
                        held = n[half, kind, entry]
                        held[side] += 1
                        held[side + 1] += times
                if len(n) >= HELD_COUNTS:
                    yield flush()
        if n:
            yield flush()

    counts = sample.mapInPandas(count, _COUNTS).groupBy("kind", "entry").agg(
        *[F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for h in (0, 1) for c in ("clean", "clean_n", "toxic", "toxic_n")]
    )
    counts = materialize(counts.filter((F.col("toxic0") + F.col("toxic1") >= LEAST_SUPPORT) & (F.col("toxic0") + F.col("toxic1") > 0.2 * (F.col("clean0") + F.col("clean1"))) | F.col("kind").isin("*", "t")), "lexicon")
    found = counts.collect()  # entries that many sample texts hold
    both = _learned(found, (0, 1))
    if both is None:
        return Lexicon(words=dict.fromkeys(INSULT, SEED_WEIGHT))
    halves = [_learned(found, (h,)) or both for h in (0, 1)]
    both.centre, both.slope = _fitted(sample, halves, both)
    discard(sample)
    discard(counts)
    return both


_COUNTS = "half int, kind string, entry string, clean long, clean_n long, toxic long, toxic_n long"


def _learned(found: list, halves: tuple[int, ...]) -> Lexicon | None:
    """The lexicon that the counts of some halves teach; None without both classes."""
    total = lambda r, c: sum(r[f"{c}{h}"] for h in halves)
    everything = next((r for r in found if r["kind"] == "*"), None)
    if everything is None or not total(everything, "clean") or not total(everything, "toxic"):
        return None
    lexicon = Lexicon(words=dict.fromkeys(INSULT, SEED_WEIGHT))
    for r in found:
        clean, toxic = total(r, "clean"), total(r, "toxic")
        if r["kind"] == "t" and clean + toxic >= LEAST_SUPPORT:
            odds = math.log((toxic + 0.5) / (total(everything, "toxic") + 1.0)) - math.log((clean + 0.5) / (total(everything, "clean") + 1.0))
            lexicon.threats[r["entry"]] = min(MOST_WEIGHT, max(odds, 0.0))
        elif r["kind"] in "ws" and toxic >= LEAST_SUPPORT:
            # how often, by occurrences; how sure, by texts, as one text repeats its words
            odds = math.log((total(r, "toxic_n") + 0.5) / (total(everything, "toxic_n") + 1.0)) - math.log((total(r, "clean_n") + 0.5) / (total(everything, "clean_n") + 1.0))
            least = odds - DEVIATIONS * math.sqrt(1.0 / (toxic + 0.5) + 1.0 / (clean + 0.5))
            if least >= LEAST_ODDS:
                (lexicon.words if r["kind"] == "w" else lexicon.stems)[r["entry"]] = min(MOST_WEIGHT, odds)
    return lexicon


def _fitted(sample: DataFrame, halves: list[Lexicon], start: Lexicon) -> tuple[float, float]:
    """Centre and slope by the weights that each half's rows get from the other half's entries.

    The driver sees one number and one label per sample row.
    """

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammars = [Grammar(x) for x in halves]
        for rows in batches:
            yield pd.DataFrame({"weight": np.array([grammars[1 - h].accepted(t) for t, h in zip(rows["text"], rows["half"], strict=True)], float), "y": rows["y"].to_numpy(np.int32)})

    rows = sample.mapInPandas(weigh, "weight double, y int").collect()
    return fitted_scale(np.array([r["weight"] for r in rows]), np.array([r["y"] for r in rows], float), start.centre, start.slope)


def fitted_scale(weight: np.ndarray, y: np.ndarray, centre: float, slope: float) -> tuple[float, float]:
    """Centre and slope of the likeliest logistic, by a grid around the defaults.

    Normal priors around the defaults keep the scale finite where the weights
    separate the classes, and near the defaults where labels are few.  Scales
    by which one lone word reaches the threshold are left out.
    """
    best = (math.inf, centre, slope)
    for c in np.linspace(max(0.1, centre - 2.9), centre + 3.0, 60):
        for s in np.linspace(0.3, 4.0, 38):
            if s * (SEED_WEIGHT + LONE - c) > math.log(PREDICT_FROM / (1 - PREDICT_FROM)) - 0.05:
                continue
            z = np.clip(s * (weight - c), -30.0, 30.0)
            loss = float(np.logaddexp(0.0, np.where(y > 0, -z, z)).sum()) + ((c - centre) / CENTRE_PRIOR) ** 2 / 2 + ((s - slope) / SLOPE_PRIOR) ** 2 / 2
            if loss < best[0]:
                best = (loss, float(c), float(s))
    return best[1], best[2]


def score_documents(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, row_key, held_out, score and predicted of every document row.

    Null and empty texts score as texts without any match; a null doc_id is
    carried through and counts as not held out.  Each row is scored by its
    text alone, so repeated rows score alike; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(lexicon)
        for rows in batches:
            scores = [grammar.score(t) for t in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "row_key": rows["row_key"], "score": scores})

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row_key"))
    scored = texts.mapInPandas(run, "doc_id long, row_key long, score double")
    return scored.select("doc_id", "row_key", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))


def clean_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents the grammar does not reject, with their columns."""
    lexicon = fit(documents, labels)
    columns = documents.columns

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        grammar = Grammar(lexicon)
        return texts.map(lambda t: grammar.score(t) < PREDICT_FROM)

    return documents.filter(accepted("text")).select(*columns)

"""Toxicity by a weighted finite-state pattern grammar.

A cascade of transducers reads each clause.  The lexicon is the first: it has
one state and an arc for each known word or stem, which turns the word into a
symbol (insult, threat, target, object, negation, report, quote, other) at a
weight.  Five machines then run side by side over the symbols; a judge turns
what they say at a symbol into an event (an insult that is aimed at somebody,
negated, or only reported, a threat), and the last machine sees targets that
follow an insult.  All but the lexicon, which grows with the vocabulary, are
composed into one table of the reachable states; weights multiply along a
path.  The score of a document comes from the events of its matched clauses,
not from isolated words: a small boosted forest weighs them.  The strengths of
the insults, which are words or stems, are learned from labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality
from .common import cut
from .quality import Forest, fold

#: Labelled rows that stems and forest are fitted on at most (those of least hash).
MOST_LABELLED = 12_000
THRESHOLD = 0.7
FOLDS = 4
_LONGEST = 12
_SHORTEST = 4

OTHER, INSULT, THREAT, TARGET, OBJECT, NEGATION, REPORT, QUOTE = SYMBOLS = range(8)


def _forms(words: str) -> str:
    """English words with their endings: kill kills killed killing, stab stabbed, strangle strangling."""
    out = []
    for w in words.split():
        stem = w[:-1] if w.endswith("e") else w + w[-1] if w in ("stab", "quit") else w
        out += [w, w + ("es" if w.endswith(("sh", "ch", "s")) else "s"), stem + "ed", stem + "ing"]
    return " ".join(out)


#: Words of the closed classes, in the languages of the corpus.
WORDS = {
    THREAT: _forms("kill hurt destroy punch stab shoot strangle murder smash") + " shot töten töte tötest tötet tötete getötet umbringen umbringe umbringt umgebracht schlagen schlage schlägt geschlagen erschießen erschieße erschießt erschossen"
    " tuer tue tues tuerai tuera tué frapper frappe frapperai frappé détruire détruis détruirai étrangler étrangle étranglerai matar mato mata mataré matado matarte golpear golpeo golpearé golpearte destruir destruyo destruiré disparar disparo dispararé dispararte",
    TARGET: "you your yours yourself he she they him her them his their du ihr dein deine deinen tu toi votre ton tes ustedes usted tú ti vosotros",
    OBJECT: "dich dir euch te vous os",
    NEGATION: "not never no don't doesn't didn't isn't aren't wasn't weren't won't can't cannot wouldn't shouldn't couldn't nobody without nicht nie niemals kein keine keinen ohne pas jamais ne sans nunca jamás sin",
    REPORT: "said says saying wrote writes called calls quoted quotes claimed claims reported reports according sagte sagt schrieb schreibt nannte behauptete behauptet dit disait écrit appelé appelle selon dijo dice escribió llamó llama según",
}
#: Insults known beforehand, with a low strength until the labels say more.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumb vermin dummkopf trottel abschaum idiota imbécil estúpido basura crétin imbécile abruti idiots morons losers clowns imbeciles idioten dummköpfe idiotas imbéciles estúpidos crétins abrutis"
PRIOR = 2.0
EVENTS = ("insult", "aimed", "negated", "reported", "threat", "idle_threat")
PLAIN, AIMED, NEGATED, REPORTED, MENACE, IDLE, TURNED = range(7)
NONE = -1
#: Weights of the judge's arcs; a turned insult becomes as heavy as an aimed one.
WEIGHTS = {PLAIN: 1.0, AIMED: 1.5, NEGATED: 0.5, REPORTED: 0.5, MENACE: 1.0, IDLE: 0.0, TURNED: 0.5, NONE: 1.0}
#: Strength of a word of threat.
THREAT_STRENGTH = 2.0
FEATURES = [*EVENTS, "strength", "aimed_strength", "density", "matched_clauses", "clause_share", "top_clause", "distinct", "log_words", "top_strength", "mean_strength"]

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[\"“”«»]")
_CLAUSE = re.compile(r"[.!?;\n]+")
_BREAK = re.compile(r"(?<=\w)\s(?=\w)")
_PIECE = 1 << 20


class Transducer:
    """``step(state, input)`` gives the next state, an output and the arc's weight."""

    def __init__(self, start, step: Callable):
        self.start, self.step = start, step


def _window(symbols: tuple[int, ...], length: int) -> Transducer:
    """Outputs whether one of ``symbols`` came within the last ``length`` symbols."""
    return Transducer(0, lambda s, x: (length if x in symbols else max(0, s - 1), s > 0, 1.0))


def _reported() -> Transducer:
    """Inside quotation marks, or after a word of reporting until the clause ends."""

    def step(s, x):
        said, quoted = s
        return (said or x == REPORT, quoted ^ (x == QUOTE)), said or quoted, 1.0

    return Transducer((False, False), step)


def _menace() -> Transducer:
    """Outputs where a word of threat and whom it is for have both been read:
    a target up to 4 words after it, or an object up to 4 words before."""

    def step(s, x):
        threat, whom = s
        if x == THREAT:
            return ((0, 0) if whom else (4, 0)), whom > 0, 1.0
        if x in (TARGET, OBJECT) and threat:
            return (0, 0), True, 1.0
        return (max(0, threat - 1), 4 if x == OBJECT else max(0, whom - 1)), False, 1.0

    return Transducer((0, 0), step)


def _judge() -> Transducer:
    """The event at a symbol, from what the machines side by side said."""

    def step(s, x):
        symbol, (menace, aimed, negated, reported) = x
        event = NONE
        if symbol == INSULT:
            event = REPORTED if reported else NEGATED if negated else AIMED if aimed else PLAIN
        elif menace:
            event = IDLE if reported or negated else MENACE
        return 0, (symbol, event), WEIGHTS[event]

    return Transducer(0, step)


def _turned() -> Transducer:
    """A plain insult with a target up to 4 words after it is aimed after all."""

    def step(s, x):
        symbol, event = x
        if event == NONE and s and symbol in (TARGET, OBJECT):
            return 0, TURNED, WEIGHTS[TURNED]
        return (4 if event == PLAIN else max(0, s - 1)), event, 1.0

    return Transducer(0, step)


def beside(parts: list[Transducer]) -> Transducer:
    """The product of machines that read the same input: outputs the input and what each says."""

    def step(s, x):
        made = [p.step(here, x) for p, here in zip(parts, s, strict=True)]
        return tuple(m[0] for m in made), (x, tuple(m[1] for m in made)), math.prod(m[2] for m in made)

    return Transducer(tuple(p.start for p in parts), step)


def after(first: Transducer, second: Transducer) -> Transducer:
    """The composition: ``second`` reads what ``first`` outputs; weights multiply."""

    def step(s, x):
        one, y, w = first.step(s[0], x)
        two, z, v = second.step(s[1], y)
        return (one, two), z, w * v

    return Transducer((first.start, second.start), step)


def tabled(machine: Transducer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables over the machine's reachable states: the next state, the event
    (-1: none) and the weight, by state and symbol."""
    states = {machine.start: 0}
    todo, tables = [machine.start], ([], [], [])
    for here in todo:
        row: list[tuple] = []
        for x in SYMBOLS:
            there, event, weight = machine.step(here, x)
            if there not in states:
                states[there] = len(todo)
                todo.append(there)
            row.append((states[there], event, weight))
        for table, column in zip(tables, zip(*row, strict=True), strict=True):
            table.append(column)
    return np.array(tables[0], np.int32), np.array(tables[1], np.int8), np.array(tables[2])


def grammar() -> list[Transducer]:
    """The machines side by side, the judge, and the last one."""
    return [beside([_menace(), _window((TARGET, OBJECT), 5), _window((NEGATION,), 3), _reported()]), _judge(), _turned()]


def _composed() -> Transducer:
    sides, judge, turned = grammar()
    return after(after(sides, judge), turned)


#: The composed grammar, as lists for fast single steps.
NEXT, EVENT, WEIGHT = (t.tolist() for t in tabled(_composed()))


class Lexicon(dict):
    """word -> (symbol, strength), found by the strongest stem; remembers words."""

    def __init__(self, stems: dict[str, float]):
        self.stems = {f"{w}$": PRIOR for w in INSULTS.split()} | stems
        self.heads = {p[:_SHORTEST] for p in self.stems}
        self.closed = {w: (k, THREAT_STRENGTH if k == THREAT else 0.0) for k, ws in WORDS.items() for w in ws.split()}
        self.triggers = Triggers(self)
        super().__init__()

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > 500_000:
            self.clear()
        if word in '"“”«»':
            found = (QUOTE, 0.0)
        else:
            best = max((self.stems.get(p, 0.0) for p in _stems(word)), default=0.0) if word[:_SHORTEST] in self.heads else self.stems.get(word + "$", 0.0)
            closed = self.closed.get(word)
            found = (INSULT, best) if best > 0 and not closed else closed or (OTHER, 0.0)
        self[word] = found
        return found


class _Bare(dict):
    """A table for str.translate: letters stay, all else is a space."""

    def __missing__(self, c: int) -> int:
        self[c] = found = c if chr(c).isalpha() else 32
        return found


_BARE = _Bare()


class Triggers:
    """Finds texts with a word that may begin an event: one automaton over all
    stems and words, at the beginnings of runs of letters.  It may find too
    many; the lexicon decides."""

    def __init__(self, lexicon: Lexicon):
        self.automaton = ahocorasick.Automaton()
        words = [w + "$" for w, (k, _) in lexicon.closed.items() if k == THREAT]
        for p in [*lexicon.stems, *words]:
            key = " " + p.removesuffix("$") + (" " if p.endswith("$") else "")
            self.automaton.add_word(key.translate(_BARE), True)
        self.automaton.make_automaton()

    def within(self, text: str) -> bool:
        return next(self.automaton.iter(f" {text} ".translate(_BARE)), None) is not None


def _stems(word: str) -> Iterator[str]:
    yield word + "$"
    for n in range(_SHORTEST, min(len(word), _LONGEST) + 1):
        yield word[:n]


def _pieces(text: str) -> Iterator[str]:
    """Pieces that end between two words, so that no run of marks is cut."""
    at = 0
    while at < len(text):
        found = _BREAK.search(text, at + _PIECE) if at + _PIECE < len(text) else None
        end = found.end() if found else len(text)
        yield text[at:end].lower().replace("’", "'")
        at = end


def clause_features(text: str, lexicon: Lexicon) -> list[float]:
    """FEATURES of one whole text; zeros for an empty one.  A clause goes on
    over the end of a piece, so the size of a piece changes nothing."""
    counts = [0] * len(EVENTS)
    strength = aimed = top = top_one = sum_here = last = 0.0
    words = clauses = matched = state = 0
    hit = False
    kinds: set[str] = set()
    short = len(text) <= _PIECE
    for piece in _pieces(text):
        words += len(piece.split())
        clauses += len(_CLAUSE.findall(piece))
        if short and not lexicon.triggers.within(piece):
            continue
        for i, clause in enumerate(_CLAUSE.split(piece)):
            if i:
                matched += hit
                strength += sum_here
                top = max(top, sum_here)
                state, sum_here, hit = 0, 0.0, False
            for w in _TOKEN.findall(clause):
                symbol, s = lexicon[w]
                e, weight, state = EVENT[state][symbol], WEIGHT[state][symbol], NEXT[state][symbol]
                if e < 0:
                    continue
                hit = True
                if e == TURNED:
                    counts[PLAIN] -= 1
                    counts[AIMED] += 1
                    aimed += last
                    sum_here += weight * last
                    continue
                counts[e] += 1
                if e < MENACE:
                    kinds.add(w)
                    top_one = max(top_one, s)
                    last = s
                else:
                    s = THREAT_STRENGTH
                sum_here += weight * s
                aimed += s * (e == AIMED)
    matched += hit
    strength += sum_here
    top = max(top, sum_here)
    n = max(1, words)
    insults = sum(counts[:4])
    return [*counts, strength, aimed, 100 * strength / n, matched, matched / max(1, clauses + (words > 0)), top, len(kinds), math.log1p(words), top_one, strength / max(1, insults)]


def _strengths(counts: dict[str, np.ndarray], totals: np.ndarray) -> dict[str, float]:
    """Lower bounds of the log odds that a document with the stem is toxic, where they are above 1."""
    out = {}
    clean_all, toxic_all = totals
    # a stem that all its documents continue in one way says nothing that the longer one doesn't
    idle = {stem[:-1] for stem, n in counts.items() if (n == counts.get(stem[:-1], -1)).all()}
    for stem, (clean, toxic) in counts.items():
        if toxic >= 4 and stem not in idle:
            odds = math.log((toxic + 0.5) / (toxic_all + 1)) - math.log((clean + 0.5) / (clean_all + 1))
            least = odds - 1.65 * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
            if least > 1:
                out[stem] = least
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 3, held: int = 1, most: int = MOST_LABELLED, doc_id: str = "doc_id", text: str = "text") -> tuple[dict[str, float], Forest]:
    """Stem strengths and the forest.  The forest learns from features that
    stems of other folds give, so it sees stems as they do on new documents."""
    rows = cut(quality.labelled(docs, labels, label, parts, held, most, doc_id, text).select(F.col("_id").cast("string").alias("id"), "text", "y", F.pmod(F.xxhash64("_id"), F.lit(FOLDS)).cast("int").alias("f")))

    def count(batches):
        seen: dict[tuple[int, int], Counter] = {}
        for b in batches:
            for text, y, f in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                stems = {p for piece in _pieces(text or "") for w in set(_TOKEN.findall(piece)) for p in _stems(w)}
                own = seen.setdefault((f, y), Counter())
                own.update(stems)
                own[""] += 1
        for (f, y), own in seen.items():
            keys = list(own)
            for lo in range(0, len(keys), 20_000):
                some = keys[lo : lo + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([f] * len(some), pa.int32()), pa.array([y] * len(some), pa.int32()), pa.array([own[k] for k in some], pa.int64())], names=["stem", "f", "y", "n"])

    sums = [F.sum(F.when((F.col("f") == f) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{f}_{y}") for f in range(FOLDS) for y in (0, 1)]
    toxic = sum((F.col(f"n{f}_1") for f in range(FOLDS)), F.lit(0))
    stems = rows.mapInArrow(count, "stem string, f int, y int, n long").groupBy("stem").agg(*sums).filter((toxic >= 4) | (F.col("stem") == "")).toArrow()
    names = stems.column("stem").to_pylist()
    table = np.array([stems.column(i).to_pylist() for i in range(1, stems.num_columns)], float).reshape(FOLDS, 2, len(names))
    at = names.index("") if "" in names else None
    if at is None:
        return {}, quality.fit(np.zeros((0, len(FEATURES))), np.zeros(0))

    def learned(parts: Iterable[int]) -> dict[str, float]:
        part = table[list(parts)].sum(axis=0)
        return _strengths({s: part[:, i] for i, s in enumerate(names) if i != at}, part[:, at])

    by_fold = [learned(f for f in range(FOLDS) if f != k) for k in range(FOLDS)]

    def read(batches):
        lexicons = [Lexicon(s) for s in by_fold]
        for b in batches:
            x = [clause_features(t or "", lexicons[f]) for t, f in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["id", "y", "x"])

    got = rows.mapInArrow(read, "id string, y int, x array<double>").toArrow()
    return learned(range(FOLDS)), quality.fit(*quality.ordered(got, len(FEATURES)), trees=60, depth=3, least=8)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 3, held: int = 1, threshold: float = THRESHOLD, most: int = MOST_LABELLED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, events
    (how many patterns of each kind matched, in the order of EVENTS).

    Stems and forest learn from labelled rows outside the held-out fold only.
    Null and empty texts have no events; with no labels all scores are one
    half; an empty table gives no rows.
    """
    stems, forest = train(docs, labels, label, parts, held, most, doc_id, text)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        lexicon = Lexicon(stems)
        for b in batches:
            x = np.array([clause_features(t or "", lexicon) for t in b.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
            events = pa.array(x[:, : len(EVENTS)].astype(int).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forest.score(x)), events], names=["doc_id", "score", "events"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, events array<int>")
    return rows.select("doc_id", (fold("doc_id", parts) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "events")

"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidied

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
#: Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Phrases in which a listed word is harmless. Learned ones come on top.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "sore loser", "idiot proof", "pond scum", "soap scum")

_FOLD = str.maketrans(HOMOGLYPHS | SUBSTITUTES | {c: "" for c in "​‌‍­⁠﻿"})
_EDGES = re.compile(r"[\W_]+")
#: Signs behind a word are punctuation or junk, not letters.
_TAIL = re.compile(r"[@$!]+(?!\w)")
#: Lengths of the word beginnings that can stand for all their words.
STEMS = range(4, 9)


def fold(text: str) -> str:
    """Lower case, look-alikes and substitutes replaced, all else but letters one space; a space at either end."""
    return f" {_EDGES.sub(' ', _TAIL.sub(' ', text.lower()).translate(_FOLD)).strip()} "


@dataclass
class Model:
    #: Pattern in folded text (" word " or " stem") -> weight, a log-odds ratio.
    lexicon: dict[str, float]
    exceptions: list[str]
    #: Bias, weight of the summed weights' logarithm, weight of their share of the words.
    coefficients: tuple[float, float, float]
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for p, w in self.lexicon.items():
                a.add_word(p, (len(p), w))
            for p in self.exceptions:
                # an exception that is also a pattern keeps the exception's role
                a.add_word(f" {p} ", (len(p) + 2, 0.0))
            a.add_word("\x00", (1, 0.0))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def features(self, text: str) -> tuple[float, float]:
        """(log of 1 + summed weights, summed weights per hundred words). Matches inside an exception phrase don't count; of
        matches that begin at the same place the heaviest counts."""
        t = fold(text)
        hits: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (n, w) in self.automaton().iter(t):
            start = end - n + 1
            if w > 0:
                hits[start] = max(hits.get(start, 0.0), w)
            elif n > 1:
                free.append((start, end))
        if free:
            # phrases by their begin; of those that begin before a match the one that reaches furthest decides
            free.sort()
            begins, reach = [a for a, _ in free], list(accumulate((b for _, b in free), max))
            hits = {s: w for s, w in hits.items() if not (i := bisect_right(begins, s)) or reach[i - 1] <= s}
        total = sum(hits.values())
        return math.log1p(total), 100 * total / max(t.count(" ") - 1, 20)

    def score(self, text: str | None) -> float:
        a, b, c = self.coefficients
        x, y = self.features(text or "")
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def _units(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        if w.isalpha() and len(w) > 2:
            out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in STEMS if len(w) > n)
    return out


def _evidence(t: float, tn: float, c: float, cn: float) -> float:
    """Likelihood-ratio statistic of a unit in t of tn toxic and c of cn clean texts."""
    share = (t + c) / (tn + cn)
    g = 0.0
    for k, n in ((t, tn), (c, cn)):
        for o, e in ((k, n * share), (n - k, n * (1 - share))):
            if o > 0 and e > 0:
                g += 2 * o * math.log(o / e)
    return g


def fit(toxic: list[str], clean: list[str], base_rate: float, least: float = 15.0, ratio: float = 6.0, fade: float = 0.6, size: int = 2000) -> Model:
    """Lexicon, exceptions and coefficients from labelled texts.

    Units (words, and word beginnings that stand for all their words) are taken one by one: each time the one with the
    strongest evidence on what the units taken so far explain least. A text's weight falls to ``fade`` of it with each unit
    found in it, so words that merely come with copies of a toxic text rarely enter. No toxic or no clean texts give an empty
    lexicon and the base rate as every score.
    """
    prior = math.log(max(base_rate, 1e-6) / max(1 - base_rate, 1e-6))
    toxic, clean = sorted(set(map(fold, toxic))), sorted(set(map(fold, clean)))
    if not toxic or not clean:
        return Model({}, [], (prior, 0.0, 0.0))
    # units of a few toxic texts are most of all; counted by hash they take little room, and only the others are kept by name
    hashes = np.concatenate([np.fromiter(map(hash, u), np.int64, len(u)) for u in map(_units, toxic)])
    keys, counts = np.unique(hashes, return_counts=True)
    often = set(keys[counts >= 3].tolist())
    where: dict[str, list[int]] = defaultdict(list)
    for i, t in enumerate(toxic):
        for u in _units(t):
            if hash(u) in often:
                where[u].append(i)
    in_clean: Counter = Counter()
    for t in clean:
        in_clean.update(u for u in _units(t) if u in where)
    tn, cn = len(toxic), len(clean)
    held = {u: np.array(ix) for u, ix in where.items() if _evidence(len(ix), tn, in_clean[u], cn) >= least and len(ix) / tn >= ratio * (in_clean[u] + 0.1) / cn}
    weight, lexicon, first = np.ones(tn), {}, {u: float(len(ix)) for u, ix in held.items()}
    odds = lambda u: math.log((first[u] + 0.5) / (tn + 1)) - math.log((in_clean[u] + 0.5) / (cn + 1))
    while held and len(lexicon) < size:
        ranked = {}
        for u, ix in held.items():
            left = float(weight[ix].sum())
            ranked[u] = (_evidence(left, max(left, float(tn)), in_clean[u], cn) - 0.5 * (not u.endswith(" ")), left)
        ranked_well = [u for u, (g, left) in ranked.items() if g >= least and left / tn >= ratio * (in_clean[u] + 0.1) / cn]
        if not ranked_well:
            break
        unit = max(ranked_well, key=lambda u: (ranked[u][0], u))
        lexicon[unit] = odds(unit)
        mine = held.pop(unit)
        weight[mine] *= fade
        # a longer unit inside a chosen one is worth having only if it tells much more; a shorter one only if it reaches further
        held = {u: ix for u, ix in held.items() if ranked[u][0] >= least and not (u.startswith(unit) and odds(u) < odds(unit) + 1) and not (unit.startswith(u) and len(mine) >= 0.9 * len(ix))}
    phrases: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    words = {u.strip() for u in lexicon if u.endswith(" ")}
    for kind, texts in enumerate((toxic, clean)):
        for t in texts:
            w = t.split()
            for p in {f"{a} {b}" for a, b in zip(w, w[1:]) if a in words or b in words}:
                phrases[p][kind] += 1
    learned = sorted(p for p, (a, b) in phrases.items() if b >= 5 and not a)
    model = Model(lexicon, sorted({*EXCEPTIONS, *learned}), (0.0, 0.0, 0.0))
    x = np.array([(1.0, *model.features(t)) for t in (*toxic, *clean)])
    y = np.r_[np.ones(tn), np.zeros(cn)]
    # each class counts as its share of all labelled rows, so that scores are probabilities there
    case = np.r_[np.full(tn, base_rate / tn), np.full(cn, (1 - base_rate) / cn)] * (tn + cn)
    beta, ridge = np.array([prior, 0.0, 0.0]), np.diag([0.01, 0.3, 0.03])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (case * (y - p)) - ridge @ beta
        step = np.linalg.solve(x.T @ (x * (case * p * (1 - p))[:, None]) + ridge, grad)
        beta = beta + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Model(lexicon, model.exceptions, tuple(map(float, beta)))


def held_out(key: str, parts: int = 4, part: int = 2):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False))


def is_held_out(key, parts: int = 4, part: int = 2) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % parts == part


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", rows: int = 2500) -> Model:
    """Fit on labelled rows that aren't held out: at most ``rows`` of each class, those with the least hash of their key.

    The bound keeps the driver's share fixed (2 x 2,500 texts, one for each key and label, that with the least hash); the base
    rate is counted over all labelled rows. Labels other than 0 and 1, null keys and null texts are left out. Texts are looked
    up by the sampled keys, which are few enough to broadcast.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y"))
    counts = {r["_y"]: r["count"] for r in usable.groupBy("_y").count().collect()}
    picked = None
    for y in (0, 1):
        part = usable.where(F.col("_y") == y).orderBy(F.xxhash64("_k"), "_k").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    found = docs.select(F.col(key).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(picked.distinct()), F.col("_id") == F.col("_k")).where("_t IS NOT NULL")
    found = found.groupBy("_k", "_y").agg(F.min_by("_t", F.struct(F.xxhash64("_t"), "_t")).alias("_t")).select("_y", "_t")
    sample: list[list[str]] = [[], []]
    for r in found.toLocalIterator():
        sample[r["_y"]].append(r["_t"])
    total = sum(counts.values())
    return fit(sample[1], sample[0], counts.get(1, 0) / total if total else 0.0)


def score_texts(df: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """All columns of ``df`` and the score of ``text`` (0 to 1; null texts as empty ones). One narrow pass, whole texts. A column
    that has the name of the new one gives way to it."""
    if column == text:
        raise ValueError(f"the score can't take the place of {text}")
    df = df.drop(column)
    at, names = df.columns.index(text), [*df.columns, column]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{column}` double"])

    @tidied
    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                scores = pa.array([model.score(t) for t in part.column(at).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], names)

    return df.mapInArrow(run, fields)

"""Secret scans: fixed patterns, and strings that a battery of randomness tests can't tell from random."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, tidied

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# A run shorter than the least length holds no match, so asking for that length at once gives the same matches.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
# '=' in front is an assignment's or a URL parameter's; as padding it only comes last
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from narrow to wide; a string has the first one that holds all its letters.
ALPHABETS = {
    "hex": _DIGIT + "abcdef", "HEX": _DIGIT + "ABCDEF", "base32": _UPPER + "234567", "base36": _DIGIT + _LOWER, "BASE36": _DIGIT + _UPPER,
    "base62": _UPPER + _LOWER + _DIGIT, "base64": _UPPER + _LOWER + _DIGIT + "+/", "base64url": _UPPER + _LOWER + _DIGIT + "-_",
}
_NAMES = list(ALPHABETS)
_INDEX = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}
#: The letters of which words have most: small ones, or capitals where an encoding has no small ones.
_PLAIN = {name: frozenset(a) & frozenset(_LOWER if "a" in a else _UPPER) for name, a in ALPHABETS.items()}
_SETS = {name: frozenset(a) for name, a in ALPHABETS.items()}
#: Bounds of the length bands in which false discoveries are controlled apart.
BANDS = (20, 28, 40, 64, 128)
#: Of the strings reported from a group no more than this share may be text.
FALSE_SHARE = 0.1
#: A string is never reported if fewer than this share of random ones look so little random.
LEAST_P = 0.002
#: Nor is one looked at further whose letters change as in text, if fewer than this share of random ones do so as much; by length
#: band, for short strings tell less.
CHANGES_P = (0.02, 0.01, 0.01, 0.01, 0.01)
#: p-values are counted in bins of a tenth of a decade down to 1e-30; the table is this long at most for each encoding and band.
BINS, PER_DECADE = 301, 10
#: Bins of p-values over one half.
HALF = 3
#: Mean and variance of minus twice the sum of the battery's logarithms over random strings, the latter also for
#: encodings with letters of one case, where two of the tests see much the same.
MEAN, VARIANCE, VARIANCE_OF_ONE_CASE = 9.0, 23.0, 31.0
#: The null hypothesis "text". For each band the share of identifiers (common words and numbers, joined in camel
#: case, in small letters, or in mixed case with dashes and underscores) whose p-value is at least that of ``TEXT_P``.
TEXT_P = (1e-8, 1e-6, 1e-4, 1e-3, 0.01, 0.03, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
TEXT_SHARES = (
    (0.99, 0.98, 0.86, 0.66, 0.33, 0.16, 0.046, 0.01, 0.003, 0.0002, 0.0001, 0.0001),
    (0.99, 0.92, 0.65, 0.37, 0.11, 0.038, 0.0066, 0.0015, 0.0002, 0.0002, 0.0001, 0.0001),
    (0.87, 0.62, 0.21, 0.06, 0.007, 0.0013, 0.0002, 0.0001, 0.0001, 0.0001, 0.0001, 0.0001),
    (0.23, 0.064, 0.0048, 0.0002, 0.0002, 0.0002, 0.0002, 0.0002, 0.0002, 0.0002, 0.0002, 0.0002),
    (0.0006, 0.0006, 0.0006, 0.0006, 0.0006, 0.0006, 0.0006, 0.0006, 0.0006, 0.0006, 0.0006, 0.0006),
)
#: Kinds of letters: small vowel, other small letter, capital vowel, other capital, digit, sign.
KINDS_OF_LETTERS = {c: 4 if c in _DIGIT else 5 if c in "+/-_" else 2 * (c in _UPPER) + (c not in "aeiouAEIOU") for c in _UPPER + _LOWER + _DIGIT + "+/-_"}
#: Fixed values, made by ``secret_null``: the share of each kind of letter (columns) after each kind (rows) in identifiers.
CHANGES = (
    (0.102, 0.809, 0.004, 0.018, 0.024, 0.043),
    (0.489, 0.333, 0.008, 0.035, 0.048, 0.086),
    (0.003, 0.092, 0.087, 0.722, 0.001, 0.095),
    (0.174, 0.041, 0.398, 0.227, 0.001, 0.16),
    (0.014, 0.055, 0.012, 0.053, 0.641, 0.225),
    (0.057, 0.236, 0.07, 0.299, 0.337, 0.001),
)


def _chi2_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees > x), by the Wilson-Hilferty normal approximation."""
    if k <= 0:
        return 1.0
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _upper_tail(k: int, n: int, share: float) -> float:
    """P(k or more of n), each with this probability; by the normal approximation for long strings."""
    if k <= 0:
        return 1.0
    if n > 300:
        return 0.5 * math.erfc((k - 0.5 - n * share) / math.sqrt(2 * n * share * (1 - share)))
    return min(1.0, sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k, n + 1)))


def _class(c: str) -> int:
    return 0 if c in _LOWER else 1 if c in _UPPER else 2 if c in _DIGIT else 3


_CLASS = {c: _class(c) for c in _LOWER + _UPPER + _DIGIT + "+/-_"}
#: For each encoding the share of neighbours of different classes (small, capital, digit, sign), and of vowels.
_CHANGES = {name: 1 - sum((sum(_CLASS[c] == k for c in a) / len(a)) ** 2 for k in range(4)) for name, a in ALPHABETS.items()}
_VOWELS = {name: sum(c in "aeiouAEIOU" for c in a) / len(a) for name, a in ALPHABETS.items()}


def encoding(s: str) -> str | None:
    """The narrowest encoding of a string without its padding; None for what lacks a digit or a letter, as words and numbers do."""
    core = s.rstrip("=")
    if not any(c in "0123456789" for c in core) or not any(c.isalpha() for c in core):
        return None
    letters = set(core)
    return next((name for name in _NAMES if letters <= _SETS[name]), None)


def battery(s: str, name: str) -> list[float]:
    """p-values of "the letters are uniform and independent" by five tests, each against what text does.

    Chi-squared over as many equal parts of the alphabet as give four expected letters each; runs of letters of one class
    (text has few and long ones); lag-one serial correlation; the number of small letters (capitals, where the encoding has no
    small ones) and that of vowels, of which words have many.
    """
    core = s.rstrip("=")
    size, at = len(ALPHABETS[name]), _INDEX[name]
    x = [at[c] for c in core]
    n = len(x)
    parts = max(2, min(size, n // 4))
    seen, room = [0] * parts, [0] * parts
    for i in range(size):
        room[i * parts // size] += 1
    for v in x:
        seen[v * parts // size] += 1
    chi = sum((o - n * r / size) ** 2 / (n * r / size) for o, r in zip(seen, room))
    kinds = [_CLASS[c] for c in core]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    m = (size - 1) / 2
    total = sum((v - m) ** 2 for v in x)
    # of n - 1 neighbours as many or more are alike
    few_runs = _upper_tail(n - 1 - changes, n - 1, 1 - _CHANGES[name])
    serial = _two_sided(math.sqrt(n) * sum((a - m) * (b - m) for a, b in zip(x, x[1:])) / total) if total else 0.0
    small = _upper_tail(sum(c in _PLAIN[name] for c in core), n, len(_PLAIN[name]) / size)
    return [_chi2_tail(chi, parts - 1), few_runs, serial, small, _upper_tail(sum(c in "aeiouAEIOU" for c in core), n, _VOWELS[name])]


def randomness(s: str, name: str) -> float:
    """p-value of the whole battery: its p-values' product, by Fisher's method with Brown's correction, as the tests depend on
    each other: chi-squared scaled to the mean and variance that random strings show."""
    total = -2 * sum(math.log(max(p, 1e-30)) for p in battery(s, name))
    variance = VARIANCE_OF_ONE_CASE if name in ("base32", "base36", "BASE36") else VARIANCE
    return min(1.0, _chi2_tail(total * 2 * MEAN / variance, 2 * MEAN**2 / variance))


def _change_scores(name: str) -> tuple[list[list[float]], float, float, float]:
    """Logarithms of how much likelier random strings of an encoding are than text to have a kind of letter after another, with mean,
    variance, and covariance of neighbours over random strings."""
    share = [sum(KINDS_OF_LETTERS[c] == k for c in ALPHABETS[name]) / len(ALPHABETS[name]) for k in range(6)]
    score = [[math.log(share[b] / CHANGES[a][b]) if share[b] else 0.0 for b in range(6)] for a in range(6)]
    pairs = [(share[a] * share[b], a, b) for a in range(6) for b in range(6)]
    mean = sum(w * score[a][b] for w, a, b in pairs)
    spread = sum(w * (score[a][b] - mean) ** 2 for w, a, b in pairs)
    return score, mean, spread, sum(w * share[c] * (score[a][b] - mean) * (score[b][c] - mean) for w, a, b in pairs for c in range(6))


_CHANGE_SCORES = {name: _change_scores(name) for name in ALPHABETS}


def changes_like_text(s: str, name: str) -> float:
    """p-value of "the letters are independent" against text, by the runs and changes of vowels, consonants, digits and signs: the
    share of random strings whose changes are as much like those of identifiers (likelihood ratio, by the normal approximation).
    Neighbours are counted as they pass, so long strings take no memory."""
    core = s.rstrip("=")
    score, mean, spread, both = _CHANGE_SCORES[name]
    n = len(core)
    total = sum(k * score[KINDS_OF_LETTERS[a]][KINDS_OF_LETTERS[b]] for (a, b), k in Counter(zip(core, islice(core, 1, None))).items())
    deviation = math.sqrt(max(1e-9, (n - 1) * spread + 2 * (n - 2) * both))
    return 0.5 * math.erfc(-(total - (n - 1) * mean) / deviation / math.sqrt(2))


def text_share(p: float, band_: int) -> float:
    """Share of text of this length that looks as random as this or more; between the values of the table along logarithms."""
    shares = (1.0, *TEXT_SHARES[band_])
    points = (1e-30, *TEXT_P)
    for x0, x1, y0, y1 in zip(points, points[1:], shares, shares[1:]):
        if p < x1:
            w = (math.log(max(p, 1e-30)) - math.log(x0)) / (math.log(x1) - math.log(x0))
            return math.exp((1 - w) * math.log(y0) + w * math.log(y1))
    return shares[-1]


def band(n: int) -> int:
    return sum(n >= b for b in BANDS) - 1


def p_bin(p: float) -> int:
    return BINS - 1 if p <= 1e-30 else min(BINS - 1, int(-math.log10(p) * PER_DECADE))


def scan(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, int, int, int]]]:
    """(base spans (start, kind, end), candidates (start, end, group, p-value's bin)) of one whole text."""
    base: list[tuple[int, str, int]] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        base += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        base += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    base += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    base.sort(key=lambda x: (x[0], KINDS.index(x[1])))
    found = []
    for m in _CANDIDATE.finditer(text):
        if any(a < m.end() and m.start() < b for a, _, b in base):
            continue
        if (name := encoding(m.group())) is not None:
            n = len(m.group().rstrip("="))
            # what changes between kinds of letters as words do isn't looked at any further
            if n >= BANDS[0] and changes_like_text(m.group(), name) >= CHANGES_P[band(n)]:
                found.append((m.start(), m.end(), _NAMES.index(name) * len(BANDS) + band(n), p_bin(randomness(m.group(), name))))
    return base, found


def cut_offs(counts: list[tuple[int, int, int]]) -> dict[int, int]:
    """Group -> first p-value bin that isn't reported, from (group, bin, count) of the whole corpus.

    In each group of encoding and length band the hypothesis "text" is tested for every candidate; what is rejected is
    reported. Benjamini and Hochberg's procedure keeps the share of text among the reported at ``FALSE_SHARE``. How much text
    looks so random is the lesser of two bounds: by the null hypothesis, with Storey's estimate of how many are text; and by
    the corpus itself, as what there is beyond an even spread of the random ones (which the upper half of all p-values counts),
    with two standard deviations more. Below ``LEAST_P`` nothing is reported: so little random are not even random strings.
    """
    out: dict[int, int] = {}
    by: dict[int, dict[int, int]] = {}
    for g, b, n in counts:
        by.setdefault(g, {})[b] = n
    for g, bins in by.items():
        total, rank, first = sum(bins.values()), 0, 0
        # a bin's least random member counts
        share = {b: text_share(10 ** (-(b + 1) / PER_DECADE), g % len(BANDS)) for b in bins}
        text = min(total, (1 + sum(n for b, n in bins.items() if share[b] > 0.5)) / 0.5)
        half = 10 ** (-HALF / PER_DECADE)
        random = sum(n for b, n in bins.items() if b < HALF) / (1 - half)
        for b in sorted(bins):
            rank += bins[b]
            p = 10 ** (-(b + 1) / PER_DECADE)
            beyond = max(0.0, rank - random * (1 - p)) + 2 * math.sqrt(random + 1)
            if p >= LEAST_P - 1e-12 and min(text * share[b], beyond) <= FALSE_SHARE * rank:
                first = b + 1
        out[g] = first
    return out


def join_spans(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


_SCANNED = "n_assign bigint, n_access bigint, n_hex bigint, base string, found array<struct<s:int,e:int,g:int,b:int>>"


def scanned(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One pass over the whole texts: base spans, and the candidates (strings of ``BANDS[0]`` characters or more that hold digits
    and letters, and whose letters don't follow each other as in words) with their groups and binned p-values. Null and empty texts have neither; rows without a key stay."""

    @tidied
    def run(batches):
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("g", pa.int32()), ("b", pa.int32())]))
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in slices(whole.column(1))):
            rows: list[list] = [[], [], [], [], []]
            for t in batch.column(1).to_pylist():
                base, found = scan(t or "")
                for out, v in zip(rows, (*(sum(k == x for _, k, _ in base) for x in KINDS[:3]), join_spans(base), [dict(zip("segb", f)) for f in found])):
                    out.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, pa.int64()) for r in rows[:3]), pa.array(rows[3], pa.string()), pa.array(rows[4], kind)], [key, "n_assign", "n_access", "n_hex", "base", "found"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {_SCANNED}")


def thresholds(found: DataFrame) -> dict[int, int]:
    """Cut-offs from the candidates of the whole corpus. What comes to the driver is a histogram of fixed size."""
    counts = found.select(F.explode("found").alias("f")).groupBy("f.g", "f.b").count()
    return cut_offs([(r[0], r[1], r[2]) for r in counts.collect()])


def secret_scan(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_assign, n_access, n_hex, base_sha256, spans`` of every row.

    Null and empty texts have no spans (the hash is that of the empty string, ``spans`` is empty). Spans count code points, end
    exclusive, and are sorted by start, then kind. Repeated rows give repeated results, null keys stay. The text is read
    once; the spans, without text, are kept in a table in the shared folder between the two steps.
    """
    kept = materialize(scanned(df, text, key), "secrets")
    limits = thresholds(kept)
    spread = F.create_map(*[F.lit(x) for g, b in (limits or {0: 0}).items() for x in (g, b)])
    extra = F.filter("found", lambda f: f["b"] < spread[f["g"]])
    base = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    named = F.transform(extra, lambda f: F.concat_ws(":", F.lit("random"), f["s"].cast("string"), f["e"].cast("string")))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])

    def order(s):
        part = F.split(s, ":")
        return F.struct(part[1].cast("int").alias("a"), rank[part[0]].alias("k"), s.alias("s"))

    spans = F.array_join(F.transform(F.array_sort(F.transform(F.concat(base, named), order)), lambda x: x["s"]), ",")
    return kept.select(key, "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All columns of ``df``, with each secret in ``text`` replaced by ``mark``; overlapping spans become one. Null texts stay."""
    limits = thresholds(scanned(df.select(F.lit(0).alias("_k"), text), text, "_k"))
    at = df.columns.index(text)

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        base, found = scan(t)
        spans = sorted([(a, b) for a, _, b in base] + [(a, b) for a, b, g, p in found if p < limits.get(g, 0)])
        if not spans:
            return t
        out, done = [], 0
        for a, b in spans:
            if a >= done:
                out += [t[done:a], mark]
            done = max(done, b)
        return "".join([*out, t[done:]])

    @tidied
    def run(batches):
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in slices(whole.column(at))):
            columns = list(batch.columns)
            columns[at] = pa.array([clean(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, df.schema)

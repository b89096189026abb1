"""Periodic runs of words: Lyndon roots under both orders, extended by hashed longest common extensions and verified word by word."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, tidied

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Bytes of text that are split into words at a time, and rows that go back to Spark at a time.
PIECE, ROWS = 1 << 20, 256
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Prime modulus and base of the rolling hash.
_MOD, _HASH_BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)


def word_ids(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word ``[^\\x20\\x09-\\x0D]+``, the same for equal words only, and the word behind each number."""
    known: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + PIECE)
        end = cut.start() if cut else len(raw)
        words = raw[at:end].split()  # splits at exactly these six bytes
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        at = end + 1
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), list(known)


def windows(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches outside of which no run lies; each holds its runs whole, with a word beside them.

    Three words in a row come again a period later all along a run but for its last period and two words. So runs lie where
    each place has a next one like it, near enough for the stretch to be four times as long; what can't be is taken away until
    nothing changes. In prose without repetitions nothing is left. A hash that two word triples share adds work, never a result.
    """
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    u = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        key = mix(u[:-2] * np.uint64(0x9E3779B97F4A7C15) + mix(u[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(u[2:] + np.uint64(1))))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return []
    far = np.full(n - 2, n, np.int64)
    far[order[:-1][same]] = (order[1:] - order[:-1])[same]
    ok = far < n
    while ok.any():
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
        begins, ends = edges[::2], edges[1::2]
        # a run with period q is met at 3q - 2 places at least, and at 3 where the period is 1
        most = (ends - begins + 2) // (LEAST_TIMES - 1)
        keep = ok.copy()
        keep[ok] = far[ok] <= np.repeat(most, ends - begins)
        if (keep == ok).all():
            return [(max(0, int(a) - 1), min(n, int(b) + int(q) + 4)) for a, b, q in zip(begins, ends, most)]
        ok = keep
    return []


class _Extensions:
    """How far a sequence goes on alike from two places, in both directions: binary search on a rolling hash."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.w = array("q", (ids + 1).astype(np.int64).tobytes())
        self.h, self.p = array("Q", bytes(8 * (self.n + 1))), array("Q", bytes(8 * (self.n + 1)))
        h, p = 0, 1
        self.p[0] = 1
        for i, x in enumerate(self.w):
            h = (h * _HASH_BASE + x) % _MOD
            p = p * _HASH_BASE % _MOD
            self.h[i + 1], self.p[i + 1] = h, p

    def _alike(self, a: int, b: int, size: int) -> bool:
        h, p = self.h, self.p[size]
        return (h[a + size] - h[a] * p - h[b + size] + h[b] * p) % _MOD == 0

    def ahead(self, a: int, b: int) -> int:
        """Words that are the same from ``a`` and from ``b > a`` on. The first few are compared as they are."""
        w, most, k = self.w, self.n - b, 0
        while k < most and w[a + k] == w[b + k]:
            k += 1
            if k == 8:
                return self._search(lambda size: self._alike(a, b, size), k, most)
        return k

    def behind(self, a: int, b: int) -> int:
        """Words that are the same before ``a`` and before ``b > a``."""
        w, k = self.w, 0
        while k < a and w[a - k - 1] == w[b - k - 1]:
            k += 1
            if k == 8:
                return self._search(lambda size: self._alike(a - size, b - size, size), k, a)
        return k

    @staticmethod
    def _search(alike, low: int, most: int) -> int:
        """The greatest size that is alike, by doubling and halving; ``low`` is."""
        step = low
        while low + step <= most and alike(low + step):
            low += step
            step *= 2
        high = min(low + step, most + 1)
        while high - low > 1:
            mid = (low + high) // 2
            if alike(mid):
                low = mid
            else:
                high = mid
        return low


def _roots(ext: _Extensions, backward: bool, last: dict[int, tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(start, length) of the longest Lyndon word from each place, right to left, under the order of numbers or its reverse.

    The stack holds where the Lyndon words to the right begin; a word takes its right neighbours in while it is less than they.
    Inside the ``last`` run of a period, that run's end is how far two places so far apart go on alike.
    """
    w, n = ext.w, ext.n
    stack = [n]
    for i in range(n - 1, -1, -1):
        while (j := stack[-1]) < n:
            known = last.get(j - i)
            k = known[1] - j if known and known[0] <= i and j <= known[1] else ext.ahead(i, j)
            # the end is less than any word, under both orders
            if j + k >= n or (w[i + k] < w[j + k]) == backward:
                break
            stack.pop()
        yield i, stack[-1] - i
        stack.append(i)


def _verified(ids: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether words a period apart are the same throughout and no neighbour goes on so; words are compared, not hashes."""
    inside = np.array_equal(ids[start : end - period], ids[start + period : end])
    left = start == 0 or ids[start - 1] != ids[start + period - 1]
    return bool(inside and left and (end == len(ids) or ids[end] != ids[end - period]))


def _stretched(ids: np.ndarray, start: int, period: int) -> tuple[int, int]:
    """The same by comparing all words, for a hash that has lied."""
    alike = ids[:-period] == ids[period:]
    before = np.flatnonzero(~alike[:start])
    after = np.flatnonzero(~alike[start:])
    return int(before[-1]) + 1 if len(before) else 0, (start + int(after[0]) if len(after) else len(alike)) + period


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period.

    Each run with twice its period has a root that is the longest Lyndon word from its first place under one of the two orders,
    so the extensions of all roots are all runs.
    """
    found: set[tuple[int, int, int]] = set()
    for low, high in windows(ids):
        part = ids[low:high]
        ext, n = _Extensions(part), high - low
        for backward in (False, True):
            last: dict[int, tuple[int, int]] = {}
            for i, q in _roots(ext, backward, last):
                if q * LEAST_TIMES > n:
                    continue
                known = last.get(q)
                if known and known[0] <= i and i + q <= known[1]:
                    continue
                start, end = i - ext.behind(i, i + q), i + q + ext.ahead(i, i + q) if i + q < n else n
                if end - start < LEAST_WORDS or end - start < LEAST_TIMES * q:
                    continue
                if not _verified(part, start, end, q):
                    start, end = _stretched(part, i, q)
                last[q] = (start, end)
                # what reaches the window's edge and could go on beyond belongs to another window
                whole = (start > 0 or low == 0) and (end < n or high == len(ids))
                if whole and end - start >= max(LEAST_WORDS, LEAST_TIMES * q):
                    found.add((low + start, end - start, q))
    least: dict[tuple[int, int], int] = {}
    for start, size, q in found:  # a root that a hash has made too long repeats a shorter one
        least[start, size] = min(q, least.get((start, size), q))
    return sorted(((start, size, q) for (start, size), q in least.items()), key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run is cut to its first period."""
    kept = np.ones(n, bool)
    for start, size, period in runs:
        kept[start + period : start + size] = False
    return kept


def _collapsed(ids: np.ndarray, words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    left = ids[kept_words(len(ids), runs)] if runs else ids
    return b" ".join([words[i] for i in left.tolist()])


def periodic_runs(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``runs`` (``array<struct<start, length, period>>`` of numbers of words, from 0, by start and period), ``collapsed`` and the
    columns ``keep`` of each row.

    A run is a stretch of words with a least period q, of at least 6 words and 4 q, that neither neighbour continues. In the
    collapsed text each run is cut to its first period and words are joined by single spaces. Null and empty texts, and those of
    white space only, have no runs and an empty collapsed text; repeated rows give repeated results; columns to keep that are
    called like a result give way.

    One narrow pass without a shuffle. A text is one row, so the words of one text are what a task holds at a time.
    """
    kept = [c for c in keep or [] if c not in ("runs", "collapsed")]
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept]
    fields = ", ".join([*kinds, "runs array<struct<start: bigint, length: bigint, period: bigint>>", "collapsed string"])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    @tidied
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                runs, collapsed = [], []
                for t in part.column(len(kept)):
                    ids, words = word_ids(t.as_buffer().to_pybytes() if t.is_valid else b"")
                    mine = runs_of(ids)
                    runs.append([{"start": a, "length": b, "period": c} for a, b, c in mine])
                    collapsed.append(_collapsed(ids, words, mine))
                out = [*part.columns[: len(kept)], pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(out, [*kept, "runs", "collapsed"])

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("_text")).mapInArrow(run, fields)


def planted(text: Column, key: Column) -> Column:
    """The text with a repetition planted in one of ten: h is crc32 of the key's decimal digits, g = h div 10; where h % 10 = 0
    and there are n > 0 words, those from a = g % n on repeat the p = 1 + (n - a) div (3 + g % 8) words from there. Texts with a
    null key are left as they are."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.call_function("div", h, F.lit(10))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def again(s: Column) -> Column:
        n = F.size(s["w"]).cast("bigint")
        a = s["g"] % n
        p = 1 + F.call_function("div", n - a, 3 + s["g"] % 8)
        return F.when(n == 0, "").otherwise(F.transform(F.array(F.struct(s["w"].alias("w"), a.alias("a"), p.alias("p"))), lambda b: F.array_join(F.transform(b["w"], lambda w, i: F.when(i < b["a"], w).otherwise(F.get(b["w"], (b["a"] + (i - b["a"]) % b["p"]).cast("int")))), " "))[0])

    return F.when((h % 10 == 0) & text.isNotNull(), F.transform(F.array(F.struct(words.alias("w"), g.alias("g"))), again)[0]).otherwise(text)


def greatest(runs: Column) -> Column:
    """The run with the greatest length by period (exactly, by cross products), of equal ones the first by start and period."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))

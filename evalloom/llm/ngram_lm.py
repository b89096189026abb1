"""N-gram language model in an Elias-Fano trie, trained on a corpus and mapped by all tasks that score texts.

Levels: words (by hash), pairs, triples. A level's nodes lie in the order of their context, then word; monotone Elias-Fano
pointers give each node's children in the next level. A node has its quantised discounted probability and, if it is a context
itself, the quantised weight of the next shorter context:
``p(w|uv) = a(uvw) + g(uv) * p(w|v)``, ``p(w|v) = a(vw) + g(v) * p(w)``, with absolute discounts from counts of counts.
The trie is cut into shards by the first word of a context; a first word that fills more than its share is cut by the second.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import differences, filesystem, flat, map_array, materialize, pack, remove, shared_dir, slices, tidied, unpack, word_bounds, word_hashes, write_bytes

#: Tokens that a task counts or scores at a time, and tokens of the training text for each shard of the trie.
UNIT, SHARD = 400_000, 2_000_000
#: The end of a text, as a word's hash (no word hashes to it but by a chance of 2^-64).
END = np.uint64(0)


# -- Elias-Fano -------------------------------------------------------------------------------------------------------

_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _ones = [k for k in range(8) if _b >> k & 1]
    _SELECT[_b, : len(_ones)] = _ones


class EliasFano:
    """A rising sequence of integers: low bytes as they are, high parts in unary, and a directory of ones per 512 bits."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ranks: np.ndarray, shift: int, n: int):
        self.low, self.high, self.ranks, self.shift, self.n = low, high, ranks, shift, n

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        n, top = len(values), int(values[-1]) if len(values) else 0
        shift = 0
        # whole bytes of low bits: up to seven more than the best number, for one bit less in the high part each
        while top >> shift > 2 * n:
            shift += 8
        low = np.concatenate([((values >> k) & 255).astype(np.uint8)[:, None] for k in range(0, shift, 8)], axis=1).ravel() if shift else np.zeros(0, np.uint8)
        size = n + (top >> shift) + 1
        bits = np.zeros(-(-size // 512) * 512, np.uint8)
        bits[(values >> shift) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(bits.reshape(-1, 512).sum(axis=1, dtype=np.int64))[:-1]]).astype(np.uint32 if n < 1 << 32 else np.uint64)
        return cls(low, high, ranks, shift, n)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ranks]

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions ``i`` (best sorted): the i-th one is selected by its block, 64-bit word and byte."""
        if not len(i):
            return np.zeros(0, np.int64)
        block = np.searchsorted(self.ranks, i, side="right") - 1
        rest = i - self.ranks[block].astype(np.int64)
        words = self.high.view("<u8").reshape(-1, 8)
        ends = np.cumsum(np.bitwise_count(words[block]).astype(np.int64), axis=1)
        w = (ends <= rest[:, None]).sum(axis=1)
        at = np.arange(len(i))
        rest = rest - np.where(w > 0, ends[at, np.maximum(w - 1, 0)], 0)
        parts = words[block, w].view(np.uint8).reshape(-1, 8)
        ends = np.cumsum(np.bitwise_count(parts).astype(np.int64), axis=1)
        b = (ends <= rest[:, None]).sum(axis=1)
        rest = rest - np.where(b > 0, ends[at, np.maximum(b - 1, 0)], 0)
        position = block * 512 + w * 64 + b * 8 + _SELECT[parts[at, b], rest]
        out = (position - i) << self.shift
        step = self.shift // 8
        for k in range(step):
            out |= self.low[i * step + k].astype(np.int64) << (8 * k)
        return out


def narrow(ids: np.ndarray, width: int) -> np.ndarray:
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].ravel()


def find(words: np.ndarray, width: int, start: np.ndarray, end: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Successor search in each context's range of the level: the position of ``word`` in [start, end), -1 if it isn't there."""
    lo, hi = start.copy(), end.copy()

    def at(i):
        v = words[i * width].astype(np.int64)
        for k in range(1, width):
            v |= words[i * width + k].astype(np.int64) << (8 * k)
        return v

    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        less = at(mid) < word[live]
        lo[live[less]] = mid[less] + 1
        hi[live[~less]] = mid[~less]
        live = live[lo[live] < hi[live]]
    out = np.full(len(lo), -1)
    ok = np.flatnonzero(lo < end)
    ok = ok[at(lo[ok]) == word[ok]] if len(ok) else ok
    out[ok] = lo[ok]
    return out


# -- files and counts -------------------------------------------------------------------------------------------------


def layout(arrays: dict[str, np.ndarray], more: dict) -> list[bytes]:
    """A file of arrays at multiples of eight bytes behind a head that says where they are."""
    places, at, body = {}, 0, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        places[name] = (at, len(raw), a.dtype.str)
        body += [raw, b"\0" * (-len(raw) % 8)]
        at += len(raw) + -len(raw) % 8
    head = json.dumps(more | {"arrays": places}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    return [len(head).to_bytes(8, "little"), head, *body]


def mapped(uri: str) -> tuple[dict, dict[str, np.ndarray]]:
    raw = map_array(uri, np.uint8).view(np.ndarray)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    return head, {k: raw[8 + n + a : 8 + n + a + size].view(kind) for k, (a, size, kind) in head["arrays"].items()}


def totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


# -- texts as tokens --------------------------------------------------------------------------------------------------


def units(batches, column: int = 1) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Batches with their words' hashes and number of words of each text, about ``UNIT`` words at a time."""
    held, hashes, counts, n = [], [], [], 0
    for batch in batches:
        for a, b in slices(batch.column(column)):
            part = batch.slice(a, b - a)
            data, offsets = flat(part.column(column))
            starts, ends, first = word_bounds(data, offsets)
            held.append(part)
            hashes.append(word_hashes(data, starts, ends))
            counts.append(np.diff(first))
            n += len(starts)
            if n >= UNIT:
                yield held, np.concatenate(hashes), np.concatenate(counts)
                held, hashes, counts, n = [], [], [], 0
    if held:
        yield held, np.concatenate(hashes), np.concatenate(counts)


def sequence(ids: np.ndarray, counts: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with two begin marks before and an end behind each text, and the first place of each text (and a last one)."""
    at = np.concatenate([[0], np.cumsum(counts + 3)])
    out = np.full(at[-1], begin, np.int64)
    out[at[1:] - 1] = end
    out[np.repeat(at[:-1] + 2 - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))] = ids
    return out, at


# -- the model --------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    folder: str
    #: Words before each shard of the vocabulary (and their number), all training tokens.
    words: list[int]
    tokens: int
    base: int
    #: Words with shards of their own, rising, the first shard of each, and how many it has.
    hot: np.ndarray
    hot_first: np.ndarray
    hot_parts: np.ndarray
    #: Weight of each hot word as a context, and how often it is one.
    hot_weights: np.ndarray | None = None
    hot_counts: np.ndarray | None = None
    #: A bit for each shard: whether any n-gram fell into it.
    made: np.ndarray | None = None
    unknown: float = 1.0
    uniform: float = 0.0
    discounts: list[list[float]] = field(default_factory=list)
    order: int = 3

    @property
    def size(self) -> int:
        return self.words[-1]

    @property
    def width(self) -> int:
        return max(1, -(-max(self.size - 1, 1).bit_length() // 8))

    @property
    def end(self) -> int:
        """Id of the end of a text; its hash is the least of all."""
        return 0 if self.size else -1

    def vocabulary(self, shard: int) -> str:
        return f"{self.folder}/words-{shard:05d}"

    def shard_of(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Shard of a pair: ranges of ``u``; a hot ``u`` has shards of its own, ranges of ``v``. The begin mark's id is ``size``."""
        space = self.size + 1
        out = u * self.base // space
        if len(self.hot):
            at = self.hot_place(u)
            mine = np.flatnonzero(at >= 0)
            out[mine] = self.hot_first[at[mine]] + v[mine] * self.hot_parts[at[mine]] // space
        return out

    def hot_place(self, u: np.ndarray) -> np.ndarray:
        """Place among the hot words, -1 for others."""
        at = np.minimum(np.searchsorted(self.hot, u), max(len(self.hot) - 1, 0))
        return np.where(self.hot[at] == u, at, -1) if len(self.hot) else np.full(len(u), -1)

    def hot_of_shard(self, shard: int) -> int:
        """Place of the hot word that a shard belongs to, -1 for a range of words."""
        return -1 if shard < self.base else int(np.searchsorted(self.hot_first, shard, side="right")) - 1

    def has(self, shard: int) -> bool:
        return bool(self.made[shard >> 3] >> (shard & 7) & 1)

    def shards(self) -> int:
        return self.base + int(self.hot_parts.sum())

    def span(self, shard: int) -> tuple[int, int]:
        """First words of contexts in a shard: from, to (exclusive)."""
        space = self.size + 1
        if (at := self.hot_of_shard(shard)) >= 0:
            return int(self.hot[at]), int(self.hot[at]) + 1
        return -(-shard * space // self.base), -(-(shard + 1) * space // self.base)


class Reader:
    """The mapped levels of a model in one process; shards are opened when they are first asked for."""

    def __init__(self, model: Model):
        self.model, self.open_words, self.open_levels = model, {}, {}

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted hashes."""
        m = self.model
        n = len(m.words) - 1
        ids, counts = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(vocabulary_shard(hashes, n), np.arange(n + 1))
        for s in range(n):
            a, b = cuts[s], cuts[s + 1]
            if a == b or m.words[s] == m.words[s + 1]:
                continue
            if s not in self.open_words:
                self.open_words[s] = mapped(m.vocabulary(s))[1]
            files = self.open_words[s]
            at = np.minimum(np.searchsorted(files["hash"], hashes[a:b]), len(files["hash"]) - 1)
            ok = np.flatnonzero(files["hash"][at] == hashes[a:b])
            ids[a + ok], counts[a + ok] = m.words[s] + at[ok], files["count"][at[ok]]
        return ids, counts

    def level(self, shard: int):
        if shard not in self.open_levels:
            _, a = mapped(f"{self.model.folder}/trie-{shard:05d}")
            head, p = mapped(f"{self.model.folder}/weights-{shard:05d}")
            pointer = lambda k: EliasFano(a[f"low{k}"], a[f"high{k}"], a[f"ranks{k}"], *(int(x) for x in a[f"shape{k}"]))
            self.open_levels[shard] = (a, p, head["scale"], pointer(2), pointer(3))
        return self.open_levels[shard]


def vocabulary_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def quantise(p: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """Probabilities as bytes, in equal steps of their logarithm between the least and the greatest."""
    if not len(p):
        return np.zeros(0, np.uint8), [0.0, 0.0]
    x = np.log10(np.maximum(p, 1e-30))
    low, step = float(x.min()), float(x.max() - x.min()) / 255
    return np.rint((x - low) / step if step else x * 0).astype(np.uint8), [low, step]


def table(scale: list[float]) -> np.ndarray:
    return 10.0 ** (scale[0] + scale[1] * np.arange(256))


def discounts(ones: list[int]) -> list[float]:
    """What is taken from counts of 1, 2, and 3 or more, from how many n-grams have counts 1 to 4."""
    n1, n2, n3, n4 = ones
    if not n1 or not n2:
        return [0.75, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), top) for d, top in zip(raw, (0.98, 1.95, 2.9))]


def taken(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.take(np.array([0.0, *d]), np.minimum(counts, 3))


def train(df: DataFrame, text: str = "text") -> Model:
    """A trie of order 3 of the texts of ``df``, all n-grams kept; its files lie in the shared folder.

    Four jobs: count words; find those that begin more pairs than a shard should hold; count pairs and triples under the words'
    ids (each task adds up its own first, and ships sorted, compressed arrays, so no row a word is made); give the nodes their
    probabilities, when the counts of counts are known. The driver gets some numbers a shard. No task changes what another
    one, or its own repetition, reads; counts are deleted by the driver at the end. Null and empty texts are an end without
    words. Without rows the model knows no word. Words have 32-bit ids; a larger vocabulary is refused.
    """
    spark = df.sparkSession
    folder = shared_dir(spark, "trie")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    parts = min(width, 4096)
    texts = df.select(F.lit(0).alias("_k"), text)

    @tidied
    def count_words(batches):
        for held, hashes, counts in units(batches):
            keys, n = np.unique(hashes, return_counts=True)
            keys, n = np.concatenate([[END], keys]), np.concatenate([[len(counts)], n]).astype(np.uint32)
            cuts = np.searchsorted(vocabulary_shard(keys, parts), np.arange(parts + 1))
            full = [s for s in range(parts) if cuts[s] < cuts[s + 1]]
            blobs = [pack(differences(keys[cuts[s] : cuts[s + 1]]), n[cuts[s] : cuts[s + 1]]) for s in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    def merge_words(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        arrays = [unpack(b) for b in t.column("blob").to_pylist()]
        keys, n = totals(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in arrays]), np.concatenate([c for _, c in arrays]))
        write_bytes(f"{folder}/words-{shard:05d}", *layout({"hash": keys, "count": n}, {}))
        return pa.table({"shard": [shard], "n": [len(keys)], "total": [int(n.sum())], "ends": [int(n[0]) if keys[0] == END else 0], "ones": [[int((n == k).sum()) for k in (1, 2, 3, 4)]], "more": [int((n > 2).sum())]})

    # a row for each part of the vocabulary, of which there are 4,096 at most
    rows = texts.mapInArrow(count_words, "shard bigint, blob binary").groupBy("shard").applyInArrow(merge_words, "shard bigint, n bigint, total bigint, ends bigint, ones array<bigint>, more bigint").collect()
    by = {r["shard"]: r for r in rows}
    words = np.concatenate([[0], np.cumsum([by[s]["n"] if s in by else 0 for s in range(parts)])]).tolist()
    tokens, ends = sum(r["total"] for r in rows), sum(r["ends"] for r in rows)
    base = max(parts, -(-tokens // SHARD))
    if words[-1] >= (1 << 32) - 2:
        raise ValueError(f"{words[-1]} words; ids have 32 bits")
    share = max(1, tokens // base)

    @tidied
    def find_hot(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                files = mapped(f"{folder}/words-{shard:05d}")[1]
                # the end of a text begins no pair
                at = np.flatnonzero((files["count"] > share) & (files["hash"] != END))
                yield pa.RecordBatch.from_arrays([pa.array(words[shard] + at), pa.array(files["count"][at].astype(np.int64))], ["word", "n"])

    # words that begin more pairs than a shard should hold; all together begin no more pairs than there are, so they are no
    # more than shards
    listed = spark.createDataFrame([(s,) for s in sorted(by)], "shard bigint").repartition(max(1, min(len(by), 64)))
    found = listed.mapInArrow(find_hot, "word bigint, n bigint").toArrow()
    hot, hot_n = found.column("word").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(hot)
    hot, hot_n = hot[order], hot_n[order]
    if ends > share:
        hot, hot_n = np.append(hot, words[-1]), np.append(hot_n, ends)
    pieces = -(-hot_n // share)
    d1 = discounts([sum(r["ones"][k] for r in rows) for k in range(4)])
    model = Model(folder, words, tokens, base, hot, base + np.cumsum(pieces) - pieces, pieces)
    ones = [sum(r["ones"][k] for r in rows) for k in range(2)]
    missing = (d1[0] * ones[0] + d1[1] * ones[1] + d1[2] * sum(r["more"] for r in rows)) / max(tokens, 1)
    # what the words' discounts free goes to words that the training text lacks
    model.unknown = missing if tokens else 1.0
    model.discounts = [d1]
    if not tokens:
        return model

    @tidied
    def count_ngrams(batches):
        reader = Reader(model)
        for held, hashes, counts in units(batches):
            keys, back = np.unique(hashes, return_inverse=True)
            ids = reader.lookup(keys)[0][back]
            s, at = sequence(ids, counts, model.size, model.end)
            real = np.ones(len(s), bool)
            real[at[:-1]] = real[at[:-1] + 1] = False
            place = np.flatnonzero(real)
            pair = (s[place - 1].astype(np.uint64) << np.uint64(32)) | s[place].astype(np.uint64)
            keys2, back, n2 = np.unique(pair, return_inverse=True, return_counts=True)
            # the pair that ends one place before is a triple's context; a text's first word has none
            has = np.flatnonzero(real[place - 1])
            triple = np.sort((back[has - 1].astype(np.uint64) << np.uint64(32)) | s[place[has]].astype(np.uint64))
            fresh = np.flatnonzero(np.concatenate([[True], triple[1:] != triple[:-1]])) if len(triple) else np.zeros(0, np.int64)
            n3 = np.diff(np.append(fresh, len(triple)))
            triple = triple[fresh]
            children = np.bincount((triple >> np.uint64(32)).astype(np.int64), minlength=len(keys2))
            to = np.concatenate([[0], np.cumsum(children)])
            shard = model.shard_of((keys2 >> np.uint64(32)).astype(np.int64), (keys2 & np.uint64(0xFFFFFFFF)).astype(np.int64))
            # shards are ranges of the sorted pairs, but for hot words
            edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
            blobs = []
            for a, b in zip(edge[:-1], edge[1:]):
                w3 = (triple[to[a] : to[b]] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                blobs.append(pack(differences(keys2[a:b]), n2[a:b].astype(np.uint32), children[a:b].astype(np.uint32), w3, n3[to[a] : to[b]].astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(shard[edge[:-1]]), pa.array(blobs, pa.binary())], ["shard", "blob"])

    def merge_ngrams(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        arrays = [unpack(b) for b in t.column("blob").to_pylist()]
        each = [np.cumsum(a[0], dtype=np.uint64) for a in arrays]
        keys, n2 = totals(np.concatenate(each), np.concatenate([a[1] for a in arrays]))
        triples = [(np.repeat(np.searchsorted(keys, k).astype(np.uint64), a[2]) << np.uint64(32)) | a[3] for k, a in zip(each, arrays)]
        keys3, n3 = totals(np.concatenate(triples), np.concatenate([a[4] for a in arrays]))
        u0, u1 = model.span(shard)
        u, v = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        to2 = np.searchsorted(u, np.arange(u0, u1 + 1))
        to3 = np.searchsorted((keys3 >> np.uint64(32)).astype(np.int64), np.arange(len(keys) + 1))
        out = {"words2": narrow(v, model.width), "words3": narrow((keys3 & np.uint64(0xFFFFFFFF)).astype(np.int64), model.width)}
        for k, to in ((2, to2), (3, to3)):
            ef = EliasFano.build(to)
            out |= {f"low{k}": ef.low, f"high{k}": ef.high, f"ranks{k}": ef.ranks, f"shape{k}": np.array([ef.shift, ef.n])}
        write_bytes(f"{folder}/trie-{shard:05d}", *layout(out, {}))
        write_bytes(f"{folder}/counts/{shard:05d}", pack(to2, to3, n2, n3))
        ones = [[int((n == k).sum()) for k in (1, 2, 3, 4)] for n in (n2, n3)]
        # a hot word's children are spread over shards
        sums = [int((n2 == 1).sum()), int((n2 == 2).sum()), int((n2 > 2).sum()), int(n2.sum())]
        names = [f"o{k}_{i}" for k in (2, 3) for i in range(4)] + [f"s{i}" for i in range(4)]
        return pa.table({"shard": [shard]} | {n: [x] for n, x in zip(names, [*ones[0], *ones[1], *sums])})

    numbers = [f"o{k}_{i}" for k in (2, 3) for i in range(4)] + [f"s{i}" for i in range(4)]
    grams = texts.mapInArrow(count_ngrams, "shard bigint, blob binary").repartition(min(model.shards(), 4 * parts), "shard").groupBy("shard").applyInArrow(merge_ngrams, ", ".join(["shard bigint", *(f"{n} bigint" for n in numbers)]))
    grams = materialize(grams, "ngrams")
    # a few numbers a shard, which are added up without a loop over shards
    every = grams.toArrow()
    column = lambda n: every.column(n).to_numpy()
    d2, d3 = (discounts([int(column(f"o{k}_{i}").sum()) for i in range(4)]) for k in (2, 3))
    model.discounts += [d2, d3]
    shards = column("shard")
    bits = np.zeros(-(-model.shards() // 8) * 8, np.uint8)
    bits[shards] = 1
    model.made = np.packbits(bits, bitorder="little")
    own = np.flatnonzero(shards >= model.base)
    place = np.searchsorted(model.hot_first, shards[own], side="right") - 1
    s = [np.bincount(place, column(f"s{i}")[own].astype(float), len(model.hot)) for i in range(4)]
    model.hot_counts = s[3]
    model.hot_weights = sum(d * x for d, x in zip(d2, s)) / np.maximum(s[3], 1)

    @tidied
    def weigh(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                system, path = filesystem(f"{folder}/counts/{shard:05d}")
                with system.open_input_file(path) as f:
                    to2, to3, n2, n3 = unpack(f.read())
                u0, u1 = model.span(shard)
                c1 = np.add.reduceat(np.append(n2, 0), np.minimum(to2[:-1], len(n2))) * (np.diff(to2) > 0)
                c1 = np.maximum(c1, 1)
                if (hot_at := model.hot_of_shard(shard)) >= 0:
                    c1[:] = max(model.hot_counts[hot_at], 1)
                t2, t3 = taken(n2, d2), taken(n3, d3)
                spread = lambda t, to: np.add.reduceat(np.append(t, 0.0), np.minimum(to[:-1], len(t))) * (np.diff(to) > 0)
                g1 = np.where(np.diff(to2) > 0, spread(t2, to2) / c1, 1.0)
                if hot_at >= 0:
                    g1[:] = model.hot_weights[hot_at]
                c2 = np.maximum(np.add.reduceat(np.append(n3, 0), np.minimum(to3[:-1], len(n3))) * (np.diff(to3) > 0), 1)
                g2 = np.where(np.diff(to3) > 0, spread(t3, to3) / c2, 1.0)
                a2 = (n2 - t2) / np.repeat(c1, np.diff(to2))
                a3 = (n3 - t3) / np.repeat(c2, np.diff(to3))
                codes = [quantise(x) for x in (g1, a2, g2, a3)]
                write_bytes(f"{folder}/weights-{shard:05d}", *layout(dict(zip(("g1", "a2", "g2", "a3"), (c for c, _ in codes))), {"scale": [s for _, s in codes]}))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64())], ["shard"])

    grams.select("shard").repartition(min(max(len(shards), 1), parts)).mapInArrow(weigh, "shard bigint").count()
    remove(spark, f"{folder}/counts")
    return model


_readers: dict[str, Reader] = {}


def reader_of(model: Model) -> Reader:
    """One reader in a process; only the latest model stays open."""
    if model.folder not in _readers:
        _readers.clear()
        _readers[model.folder] = Reader(model)
    return _readers[model.folder]


def score_unit(model: Model, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each text: tokens, known tokens, base score, score."""
    reader = reader_of(model)
    n = counts + 1
    keys, back = np.unique(np.append(hashes, END), return_inverse=True)
    ids, c = reader.lookup(keys)
    back, end = back[:-1], back[-1]
    s, at = sequence(ids[back], counts, model.size, -2)
    cs, _ = sequence(c[back], counts, 0, int(c[end]))
    s[s == -2] = ids[end]
    real = np.ones(len(s), bool)
    real[at[:-1]] = real[at[:-1] + 1] = False
    place = np.flatnonzero(real)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    count = cs[place].astype(float)
    base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.size + 1)))
    w, v = s[place], s[place - 1]
    p = np.where(count > 0, (count - taken(cs[place], model.discounts[0])) / max(model.tokens, 1), max(model.unknown, 0.5 / (model.tokens + 1)))
    if model.tokens:
        # pairs: different ones are looked up once, shard by shard
        ok = np.flatnonzero((v >= 0) & (w >= 0) & (v <= model.size))
        keys2, back2 = np.unique((v[ok].astype(np.uint64) << np.uint64(32)) | w[ok].astype(np.uint64), return_inverse=True)
        u2, w2 = (keys2 >> np.uint64(32)).astype(np.int64), (keys2 & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # a context's weight counts for unknown words too
        alone = np.unique(v[(v >= 0) & (w < 0)])
        a2, g1, node, shard2 = _pairs(reader, np.concatenate([u2, alone]), np.concatenate([w2, np.full(len(alone), -1)]))
        lift = np.ones(len(p))
        add = np.zeros(len(p))
        add[ok], lift[ok] = a2[back2], g1[back2]
        rest = np.flatnonzero((v >= 0) & (w < 0))
        lift[rest] = g1[len(u2) + np.searchsorted(alone, v[rest])]
        p = add + lift * p
        # triples: the pair one place before is the context
        context = np.full(len(s), -1)
        context[place[ok]] = back2
        before = context[place - 1]
        t = np.flatnonzero((before >= 0) & (node[np.maximum(before, 0)] >= 0))
        word = np.where(w[t] >= 0, w[t], 0xFFFFFFFF)
        keys3, back3 = np.unique((before[t].astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64), return_inverse=True)
        b3, w3 = (keys3 >> np.uint64(32)).astype(np.int64), (keys3 & np.uint64(0xFFFFFFFF)).astype(np.int64)
        a3, g2 = _triples(reader, shard2[b3], node[b3], w3)
        p[t] = a3[back3] + g2[back3] * p[t]
    return n, np.add.reduceat((count > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(np.maximum(p, 1e-300)), first)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1], [True]])) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(edge[:-1], edge[1:]):
        yield int(shard[order[a]]), order[a:b]


def _pairs(reader: Reader, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Discounted probability and context's weight of pairs, their node (-1: not seen) and its shard."""
    m = reader.model
    a2, g1, node = np.zeros(len(u)), np.ones(len(u)), np.full(len(u), -1)
    shard = m.shard_of(u, np.maximum(w, 0))
    for s, mine in _by_shard(shard):
        hot = m.hot_of_shard(s)
        if not m.has(s):
            # no pair fell into this shard; a hot word's weight is known from its others
            if hot >= 0:
                g1[mine] = m.hot_weights[hot]
            continue
        arrays, codes, scale, to2, _ = reader.level(s)
        u0 = m.span(s)[0]
        local = u[mine] - u0
        start, end = to2.get(local), to2.get(local + 1)
        found = find(arrays["words2"], m.width, start, end, w[mine])
        seen = found >= 0
        node[mine] = found
        a2[mine[seen]] = table(scale[1])[codes["a2"][found[seen]]]
        some = end > start
        g1[mine[some]] = table(scale[0])[codes["g1"][local[some]]]
        if hot >= 0:
            g1[mine] = m.hot_weights[hot]
    return a2, g1, node, shard


def _triples(reader: Reader, shard: np.ndarray, node: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a3, g2 = np.zeros(len(w)), np.ones(len(w))
    for s, mine in _by_shard(shard):
        arrays, codes, scale, _, to3 = reader.level(s)
        at = node[mine]
        start, end = to3.get(at), to3.get(at + 1)
        found = find(arrays["words3"], reader.model.width, start, end, w[mine])
        seen = found >= 0
        a3[mine[seen]] = table(scale[3])[codes["a3"][found[seen]]]
        some = end > start
        g2[mine[some]] = table(scale[2])[codes["g2"][at[some]]]
    return a3, g2


def score(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score`` of every row; null and empty texts are one end.

    One narrow pass; each task maps the shards that its words lead to. Repeated rows give repeated results, null keys stay.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [key, "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    @tidied
    def run(batches):
        for held, hashes, counts in units(batches):
            n, known, base, s = score_unit(model, hashes, counts)
            keys = pa.chunked_array([b.column(0) for b in held]).combine_chunks()
            yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.tokens), pa.int64()), pa.array(base), pa.array(s)], names)

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")

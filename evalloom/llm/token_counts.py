"""Token counts by linear longest match: how many word pieces a text has, without building the pieces."""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import flat, slices, word_bounds, words_array

#: Words whose count a worker keeps; the table is emptied when it is full.
CACHE_WORDS = 1_000_000


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable letter: printable bytes as themselves, others from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces_from_byte_bpe(path: str) -> tuple[list[bytes], list[bytes]]:
    """(pieces that begin a word, pieces that continue one) from a byte-level vocabulary file.

    A token with a leading space begins a word, any other continues one; special tokens and tokens with other spaces are left out.
    """
    letters = _bytes_of_letters()
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    first, more = [], []
    for token in model["model"]["vocab"]:
        if token in special:
            continue
        raw = bytes(letters[c] for c in token)
        begins, raw = raw[:1] == b" ", raw[1:] if raw[:1] == b" " else raw
        if raw and not any(b in b" \t\n\x0b\x0c\r" for b in raw):
            (first if begins else more).append(raw)
    return first, more


class Automaton:
    """Trie of the vocabulary with failure links; each link has the number of pieces that following it completes."""

    FIRST, MORE = 0, 1

    def __init__(self, first: list[bytes], more: list[bytes]):
        self.go: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((self.FIRST, first), (self.MORE, more)):
            for piece in pieces:
                at = root
                for b in piece:
                    nxt = self.go[at].get(b)
                    if nxt is None:
                        nxt = len(self.go)
                        self.go.append({})
                        ends.append(False)
                        self.go[at][b] = nxt
                    at = nxt
                if piece:
                    ends[at] = True
        #: Where to go when no edge fits (-1: nowhere, the word is unknown), and pieces completed on the way.
        self.fail, self.popped = [-1] * len(self.go), [0] * len(self.go)
        queue = deque([self.FIRST, self.MORE])
        while queue:
            parent = queue.popleft()
            for b, node in self.go[parent].items():
                if ends[node]:
                    self.fail[node], self.popped[node] = self.MORE, 1
                else:
                    at, count = self.fail[parent], self.popped[parent]
                    while at != -1 and b not in self.go[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at != -1:
                        self.fail[node], self.popped[node] = self.go[at][b], count
                queue.append(node)

    def count(self, word: bytes) -> int:
        """Pieces of a word by greedy longest match, 0 if some part fits no piece (an unknown word). Linear in the word."""
        go, fail, popped = self.go, self.fail, self.popped
        at, count = self.FIRST, 0
        for b in word:
            nxt = go[at].get(b)
            while nxt is None:
                if fail[at] == -1:
                    return 0
                count += popped[at]
                at = fail[at]
                nxt = go[at].get(b)
            at = nxt
        while at != self.MORE:
            if fail[at] == -1:
                return 0
            count += popped[at]
            at = fail[at]
        return count


_kept: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def _automaton(path: str) -> tuple[Automaton, dict[bytes, int]]:
    if path not in _kept:
        _kept[path] = (Automaton(*pieces_from_byte_bpe(path)), {})
    return _kept[path]


def count_batch(texts: pa.Array, automaton: Automaton, cache: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: words, pieces (an unknown word counts as one), unknown words."""
    out = []
    for a, b in slices(texts):
        data, offsets = flat(texts.slice(a, b - a))
        starts, ends, first = word_bounds(data, offsets)
        if len(starts):
            coded = words_array(data, starts, ends).dictionary_encode()
            counts = np.empty(len(coded.dictionary), np.int64)
            if len(cache) > CACHE_WORDS:
                cache.clear()
            for i, word in enumerate(coded.dictionary.to_pylist()):
                n = cache.get(word)
                if n is None:
                    n = cache[word] = automaton.count(word)
                counts[i] = n
            per = counts[np.asarray(coded.indices)]
        else:
            per = np.zeros(0, np.int64)
        pieces, unknown = np.concatenate([[0], np.cumsum(np.maximum(per, 1))]), np.concatenate([[0], np.cumsum(per == 0)])
        out.append((np.diff(first), pieces[first[1:]] - pieces[first[:-1]], unknown[first[1:]] - unknown[first[:-1]]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out))


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_words, n_tokens, n_unknown`` of every row of ``df``; ``vocabulary`` is a file on every machine.

    Words are ``[^\\x20\\x09-\\x0D]+``; their case is kept. Null and empty texts have 0 of each; a word that no sequence of pieces
    spells counts as one token and one unknown. Repeated rows, null keys and further columns do no harm: rows go through one
    by one, only ``key`` and ``text`` are read. One narrow pass, no shuffle; memory is the automaton and a bounded cache.
    """

    def run(batches):
        automaton, cache = _automaton(vocabulary)
        for batch in batches:
            words, tokens, unknown = count_batch(batch.column(1), automaton, cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(tokens), pa.array(unknown)], [key, "n_words", "n_tokens", "n_unknown"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")

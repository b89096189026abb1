"""Byte-level BPE: content-defined chunks are encoded once and reused; joins between chunks are re-encoded until they agree."""

from __future__ import annotations

import hashlib
import json
import re
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import flat, slices, tidied
from .token_counts import _bytes_of_letters

#: Length of the rolling hash's window in bytes (a power of two), and mean length of a chunk.
WINDOW, MEAN_CHUNK = 32, 1024
#: Bytes that are hashed at a time.
PIECE = 4 << 20
#: Chunks' ids that a worker keeps, in bytes.
CACHE_BYTES = 32 << 20
#: Fixed value: the splitting pattern of byte-level vocabularies, the same in both libraries.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_GEAR = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64)
_MASK = np.uint64((MEAN_CHUNK - 1) << 40)


def _white(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space of any kind (Unicode's), so that a cut beside them can be judged safe."""
    out = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 0x1C) & (data <= 0x1F))
    for lead, rest in ((0xC2, ((0x85,), (0xA0,))), (0xE1, ((0x9A, 0x80), (0xA0, 0x8E))), (0xE2, tuple((0x80, x) for x in (*range(0x80, 0x90), 0xA8, 0xA9, 0xAF)) + ((0x81, 0x9F),)), (0xE3, ((0x80, 0x80),))):
        at = np.flatnonzero(data == lead)
        for r in rest if len(at) else ():
            ok = at[at + len(r) < len(data)]
            for i, x in enumerate(r):
                ok = ok[data[ok + i + 1] == x]
            for i in range(len(r) + 1):
                out[ok + i] = True
    return out


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin: at each text, and after each byte where the hash of the last 32 bytes (of that text) is special.

    A cut inside a character moves to its end. Equal passages are cut alike from one window after their beginning on.
    """
    found = [np.zeros(0, np.int64)]
    # a piece at a time, with the window that reaches into it, so the hashes of a very long text take no more room
    for lo in range(0, len(data), PIECE):
        first = max(0, lo - WINDOW + 1)
        h = _GEAR[data[first : lo + PIECE]]
        step = 1
        while step < WINDOW:
            if len(h) > step:
                older = h[:-step].copy()
                h[step:] += older << np.uint64(step)
            step *= 2
        at = np.flatnonzero((h & _MASK) == _MASK) + first
        found.append(at[at >= lo] + 1)
    cuts = np.concatenate(found)
    # a window that reaches into the text before is no cut
    cuts = cuts[cuts - offsets[np.searchsorted(offsets, cuts, side="left") - 1] >= WINDOW]
    for _ in range(3):
        cuts = cuts[cuts < len(data)]
        cuts = np.where((data[cuts] & 0xC0) == 0x80, cuts + 1, cuts) if len(cuts) else cuts
    # empty texts at the end begin where no byte is
    begins = offsets[:-1]
    return np.unique(np.concatenate([begins[begins < len(data)], cuts[cuts < len(data)]]))


def _in_merge_order(model: dict, letters: dict[str, int]) -> bool:
    """Whether ids rise with the order of the merges, so that ranks alone give the same ids."""
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"][m] for m in made]
    return len(set(made)) == len(made) and ids == sorted(ids) and all(model["vocab"].get(c, 1 << 40) < ids[0] for c in letters)


def _splits_by_pattern(spec: dict) -> bool:
    """Whether a file splits texts by ``PATTERN`` and does nothing else before its merges; only then is it known where texts can be cut."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    by_bytes = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    # an added token that takes what stands around it, or looks at it, could reach over a cut
    free = not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    return spec.get("normalizer") is None and model.get("type") == "BPE" and plain and by_bytes and free


class Codec:
    """Encoder and decoder for one vocabulary file of the tokenizers library.

    Files that don't split texts by ``PATTERN`` are used as the library does, a whole text at a time, without chunks.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cuts = _splits_by_pattern(spec)
        letters = _bytes_of_letters()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = spec["model"]["vocab"] | added
        table = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            table[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        ranks = {table[i]: i for token, i in vocab.items() if token not in added}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if self.cuts and _in_merge_order(spec["model"], letters) else None
        self.special = {t.encode(): i for t, i in added.items()}
        # of two that begin at one place the longer one counts
        self.any_special = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or b"(?!)")
        self.sizes = np.array([len(b) for b in table], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        #: digest of a chunk -> its ids, its first two and last two safe cuts and how many ids lie before each; none: no two cuts
        self.chunks: OrderedDict[bytes, tuple[np.ndarray, tuple[int, ...], tuple[int, ...]]] = OrderedDict()
        self.kept = 0
        self.encoded_bytes = 0

    def plain(self, raw: bytes) -> np.ndarray:
        """Ids of a piece without special tokens. Letters below U+0250, of which all versions of Unicode think alike, go
        through the faster of the two libraries; both have the same merges."""
        if not raw:
            return np.zeros(0, np.uint32)
        self.encoded_bytes += len(raw)
        if self.fast is not None and max(raw) < 0xC9:
            return self.fast.encode_to_numpy(raw.decode(), disallowed_special=()).astype(np.uint32)
        return np.array(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, np.uint32)

    def _kept(self, key: bytes, make) -> tuple:
        """An entry of the table of chunks, made if it lacks; the oldest leave when the table is full."""
        hit = self.chunks.get(key)
        if hit is None:
            hit = self.chunks[key] = make()
            self.kept += hit[0].nbytes + 300
            while self.kept > CACHE_BYTES and len(self.chunks) > 1:
                self.kept -= self.chunks.popitem(last=False)[1][0].nbytes + 300
        else:
            self.chunks.move_to_end(key)
        return hit

    def _chunk(self, raw: bytes, cuts: tuple[int, ...]) -> tuple[np.ndarray, tuple[int, ...], tuple[int, ...]]:
        """Encode a chunk; ``cuts`` are its first two and last two safe cuts, or none."""
        ids = self.plain(raw)
        if not cuts:
            return ids, (), ()
        ends = np.cumsum(self.sizes[ids])
        at = np.searchsorted(ends, cuts)
        # a cut at which no id ends isn't one
        return (ids, cuts, tuple((at + 1).tolist())) if (ends[at] == cuts).all() else (ids, (), ())

    def _join(self, raw: bytes, before: np.ndarray, after: np.ndarray) -> np.ndarray | None:
        """Ids of what lies between, if the piece around a join, encoded anew, begins and ends with the ids that its chunks have there."""
        ids = self._kept(b"join" + hashlib.blake2b(raw, digest_size=16).digest(), lambda: (self.plain(raw),))[0]
        i, j = len(before), len(ids) - len(after)
        agree = i <= j and np.array_equal(ids[:i], before) and np.array_equal(ids[j:], after)
        return ids[i:j] if agree else None

    def encode_flat(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text; the texts hold no special token.

        Chunks are encoded by themselves. Around each join the text from the last but one safe cut before it to the second one
        behind it is encoded anew, over further chunks if they have no two cuts; what comes out has to agree with both
        chunks between their two cuts. Where it doesn't, the piece grows to the whole text.
        """
        if not len(data):
            return [np.zeros(0, np.uint32) for _ in offsets[1:]]
        white = _white(data)
        space = np.flatnonzero(data == 32)
        space = space[(space > 0) & (space < len(data) - 1)]
        safe = space[~white[space - 1] & ~white[space + 1]]
        starts = chunk_starts(data, offsets)
        stops = np.append(starts[1:], len(data))
        # both neighbours of a safe cut have to lie in the chunk, so the result doesn't hang on what stands around
        first, last = np.searchsorted(safe, starts, side="right"), np.searchsorted(safe, stops - 1, side="left") - 1
        some = np.flatnonzero(first < last)
        cuts: list[tuple[int, ...]] = [()] * len(starts)
        near = np.stack([safe[first[some]], safe[first[some] + 1], safe[last[some] - 1], safe[last[some]]], axis=1) - starts[some, None] if len(some) else np.zeros((0, 4), int)
        for i, c in zip(some.tolist(), near.tolist()):
            cuts[i] = tuple(c)
        raw = data.tobytes()
        spans = list(zip(starts.tolist(), stops.tolist()))
        found = []
        for (a, b), c in zip(spans, cuts):
            piece = raw[a:b]
            found.append(self._kept(hashlib.blake2b(piece, digest_size=16).digest(), lambda: self._chunk(piece, c)))  # noqa: B023
        out: list[np.ndarray] = []
        none, k = np.zeros(0, np.uint32), 0
        for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            # what is open: where the piece of the next join begins, and the ids that it has to begin with
            mine: list[np.ndarray | None] = []
            open_at, before = start, none
            while k < len(spans) and spans[k][0] < end:
                (a, b), (ids, at, count) = spans[k], found[k]
                k += 1
                if a == start and (b == end or at):
                    mine.append(ids if b == end else ids[: count[3]])
                elif at:
                    mine += [self._join(raw[open_at : a + at[1]], before, ids[count[0] : count[1]]), ids[count[0] : count[3] if b < end else None]]
                elif b == end:
                    mine.append(self._join(raw[open_at:b], before, none))
                if at:
                    open_at, before = a + at[2], ids[count[2] : count[3]]
            out.append(self.plain(raw[start:end]) if any(m is None for m in mine) else np.concatenate(mine) if mine else none)
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each whole text; null and empty texts have none. Special tokens in a text are taken as the library does."""
        if not self.cuts:
            return [np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, np.uint32) for t in texts.to_pylist()]
        out: list[np.ndarray] = []
        for a, b in slices(texts):
            data, offsets = flat(texts.slice(a, b - a))
            raw = data.tobytes()
            if not self.any_special.search(raw):
                out += self.encode_flat(data, offsets)
                continue
            for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                out.append(self._with_special(raw[i:j]))
        return out

    def _with_special(self, raw: bytes) -> np.ndarray:
        parts, at = [], 0
        for m in self.any_special.finditer(raw):
            parts += [*self._piece(raw[at : m.start()]), np.array([self.special[m.group()]], np.uint32)]
            at = m.end()
        return np.concatenate([*parts, *self._piece(raw[at:])])

    def _piece(self, raw: bytes) -> list[np.ndarray]:
        return self.encode_flat(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that the ids stand for, special tokens included; broken characters become U+FFFD."""
        if not self.cuts:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()
        n = self.sizes[ids]
        to = np.concatenate([[0], np.cumsum(n)])
        raw = self.bytes[np.repeat(self.begins[ids] - to[:-1], n) + np.arange(to[-1])].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each vocabulary in a process; its tables of chunks and words outlive single tasks."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def bpe_encode(df: DataFrame, vocabulary: str, text: str = "text", column: str = "ids") -> DataFrame:
    """All columns of ``df`` and the ids of each whole text (``array<int>``; null and empty texts have none). A column that
    has the name of the new one gives way to it.

    One narrow pass, no shuffle: what is encoded once is a chunk in a worker, whose table of chunks is bounded and serves all
    documents and tasks of that worker. A passage that fills a third of the input is so encoded once a worker, not once a row.
    """
    if column == text:
        raise ValueError(f"the ids can't take the place of {text}")
    df = df.drop(column)
    at, names = df.columns.index(text), [*df.columns, column]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{column}` array<int>"])

    @tidied
    def run(batches):
        c = codec(vocabulary)
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                ids = c.encode(part.column(at))
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                values = np.concatenate(ids).astype(np.int32) if len(ids) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names)

    return df.mapInArrow(run, fields)


def bpe_round_trip(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every row, and ``text`` as it came if asked for.

    Hashes are those of the ids as little-endian 32-bit integers and of the decoded text's UTF-8. Null and empty texts have no
    ids and the empty text's hash; repeated rows give repeated results; null keys stay.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *[text] * with_text]

    @tidied
    def run(batches):
        c = codec(vocabulary)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                ids = c.encode(part.column(1))
                hashes = [[hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], [hashlib.sha256(c.decode(i)).hexdigest() for i in ids]]
                columns = [part.column(0), pa.array([len(i) for i in ids], pa.int64()), *(pa.array(h, pa.string()) for h in hashes), *[part.column(1)] * with_text]
                yield pa.RecordBatch.from_arrays(columns, names)

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + f", `{text}` string" * with_text)

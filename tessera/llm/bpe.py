"""Byte-level BPE encoding and decoding of whole texts.

A text is split into pieces (contractions, letters, digits, other symbols,
white space), each piece into bytes, and the bytes are merged by rank: a
priority queue holds (rank, position) of every mergeable neighbouring pair,
symbols form a doubly linked list, and an entry whose pair has changed since
it was pushed is stale and skipped. Pieces repeat, so each Python worker keeps
a bounded table from piece to its ids. Decoding concatenates the vocabulary's
byte strings.

Both directions are maps over rows: no shuffle, memory bounded by one batch.

Defined results: a null text is the empty text (no ids, decoded to ''); extra
columns pass through ``encode`` untouched, except that columns named like its
outputs are replaced; repeated rows give repeated results; a very long text is
encoded whole; of merges of one rank the leftmost goes first; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import hold

# The split pattern of the byte-level vocabularies (white space
# spelled out as the Unicode property).
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a vocabulary:
    printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ByteBPE:
    """Encoder and decoder built from the JSON text of a vocabulary file."""

    def __init__(self, spec: str, cache_size: int = 200_000):
        data = json.loads(spec)
        model = data["model"]
        symbols = byte_symbols()
        as_byte = {s: b for b, s in enumerate(symbols)}
        vocab = model["vocab"]
        self.byte_ids = [vocab[s] for s in symbols]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        strings = dict.fromkeys(vocab.values(), b"")
        for token, i in vocab.items():
            strings[i] = bytes(as_byte[ch] for ch in token) if all(ch in as_byte for ch in token) else token.encode()
        for token, i in self.special.items():
            strings[i] = token.encode()
        self.strings = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.pieces = regex.compile(PIECES)
        tokens = sorted(self.special, key=len, reverse=True)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, tokens)) + ")") if tokens else None
        self.cache: dict[str, bytes] = {}
        self.cache_size = cache_size

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.byte_ids[b] for b in raw]
        n = len(ids)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        merges = self.merges
        queue = []
        for i in range(n - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, found[1]))
        heapq.heapify(queue)
        while queue:
            rank, i, made = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            now = merges.get((ids[i], ids[j]))
            if now is None or now[0] != rank:
                continue  # stale
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((made, ids[k])):
                    heapq.heappush(queue, (found[0], i, found[1]))
            if (p := before[i]) >= 0 and (found := merges.get((ids[p], made))):
                heapq.heappush(queue, (found[0], p, found[1]))
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> bytes:
        got = np.array(self.merge(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= 64:  # long pieces hardly repeat
            if len(self.cache) >= self.cache_size:
                self.cache.clear()
            self.cache[piece] = got
        return got

    def _plain(self, text: str) -> bytes:
        known, piece = self.cache.get, self._piece
        return b"".join([known(p) or piece(p) for p in self.pieces.findall(text)])

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.split_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        out = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(int(self.special[part]).to_bytes(4, "little"))
            elif part:
                out.append(self._plain(part))
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        if not ids:
            return ""
        strings = self.strings
        raw = b"".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return raw.decode("utf-8", "replace")


_LOADED: dict[int, ByteBPE] = {}


def _unload() -> None:
    _LOADED.clear()


def _codec(spec) -> ByteBPE:
    """One codec per Python worker and vocabulary, until another operator runs
    in the worker."""
    hold(_unload)
    if spec.id not in _LOADED:
        _LOADED.clear()
        _LOADED[spec.id] = ByteBPE(spec.value)
    return _LOADED[spec.id]


class _Spec:
    """The vocabulary file's text (read once by the driver) as a broadcast."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.id = hash(text)
        self._sent = spark.sparkContext.broadcast(text)

    @property
    def value(self) -> str:
        return self._sent.value


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", slice_rows: int = 256) -> DataFrame:
    """``docs`` with a binary column ``ids``: the text's token ids, packed as
    little-endian unsigned 32-bit integers."""
    return _mapped(docs, path, text, ids, "binary", slice_rows, lambda codec: codec.encode)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded", slice_rows: int = 256) -> DataFrame:
    """``docs`` with a string column ``text`` decoded from the packed ids."""
    return _mapped(docs, path, ids, text, "string", slice_rows, lambda codec: codec.decode)


def _mapped(docs: DataFrame, path: str, source: str, target: str, kind: str, slice_rows: int, pick) -> DataFrame:
    spec = _Spec(docs.sparkSession, path)
    kept = docs.select(*[c for c in docs.columns if c != target])
    at = kept.columns.index(source)
    schema = kept.withColumn(target, F.lit(None).cast(kind)).schema
    arrow_kind = pa.binary() if kind == "binary" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = pick(_codec(spec))
        for batch in batches:
            for i in range(0, batch.num_rows, slice_rows):
                part = batch.slice(i, slice_rows)
                made = pa.array([one(x.as_py()) for x in part.column(at)], type=arrow_kind)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, target])

    return kept.mapInArrow(run, schema)

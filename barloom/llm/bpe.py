"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of symbols. Every adjacent pair that is itself a token waits in the bucket of its merge
rank, ordered by position. Two levels of bit words record which buckets hold entries, so the next rank is found by two
find-first-set steps instead of a search; an entry whose pair has changed since is skipped when it surfaces. n bytes
take O(n log n), however long a pre-token is.

Texts: null counts as empty and encodes to no ids. Any length is encoded whole. Repeated rows are encoded alike. Columns
that an input has beside those named are ignored by ``encode`` with ``keep`` unset.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm.common import arrow_pass

#: Pre-tokens remembered by one worker, about 200 bytes each; a cache only, refilled when full.
CACHE_SIZE = 600_000
CACHE_CHARS = 40
#: Characters encoded together; one text may be longer and is then taken alone.
CHUNK_CHARS = 1_000_000
#: Vocabularies kept broadcast; an older one is sent again when it is used again.
KEPT = 4
NONE = 1 << 30
_SENT: dict = {}


class Vocabulary:
    """A vocabulary and what one worker has merged so far. It lives in a broadcast, so the memory outlasts a task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern}

    def prepare(self) -> None:
        """Rank of every two tokens that join to a token, and the ranks of all byte pairs as a table."""
        if hasattr(self, "known"):
            return
        ranks = self.ranks
        self.known: dict[str, bytes] = {}
        self.joined: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.joined[left << 32 | right] = rank
        self.bytes_ = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs = np.full(65536, NONE, np.int64)
        for i in range(256):
            for j in range(256):
                self.pairs[i << 8 | j] = ranks.get(bytes((i, j)), NONE)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token: always merge the pair of lowest rank, leftmost first.

        The pre-tokens lie in one linked list with closed borders and share one queue.
        """
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        starts = np.cumsum([0, *map(len, pieces)])
        first = np.full(n + 1, NONE, np.int64)  # rank of the pair that starts at each place
        first[:n - 1] = self.pairs[data[:-1].astype(np.int64) << 8 | data[1:]]
        first[starts[1:] - 1] = NONE
        symbol = self.bytes_[data].tolist()
        symbol.append(-1)
        after = list(range(1, n + 2))  # where the symbol that starts here ends
        before = list(range(-1, n))
        closed = bytearray(n + 2)  # 1 where a pre-token starts: nothing merges across
        for at in starts.tolist():
            closed[at] = 1
        # Buckets of positions by rank, each a heap; a bit per bucket that holds entries, a bit per word of 256 that is not zero.
        order = np.argsort(first[:n], kind="stable")
        order = order[:np.searchsorted(first[order], NONE)]
        values, begins = np.unique(first[order], return_index=True)
        places, begins = order.tolist(), [*begins.tolist(), len(order)]
        pair = first.tolist()
        buckets, words, top = {}, [0] * 256, 0
        for k, rank in enumerate(values.tolist()):
            buckets[rank] = places[begins[k]:begins[k + 1]]
            word = rank >> 8
            if word >= len(words):
                words.extend([0] * (word + 1 - len(words)))
            words[word] |= 1 << (rank & 255)
            top |= 1 << word
        get, bucket_of = self.joined.get, buckets.get
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            low = bits & -bits
            rank = word << 8 | low.bit_length() - 1
            bucket = buckets[rank]
            lowest = rank
            while bucket:
                i = heappop(bucket)
                if pair[i] != rank:
                    continue  # stale
                gone = after[i]
                end = after[i] = after[gone]
                symbol[i] = rank
                pair[gone] = NONE
                before[end] = i
                if not closed[end]:
                    new = pair[i] = get(rank << 32 | symbol[end], NONE)
                    if new != NONE:
                        held = bucket_of(new)
                        if held:
                            heappush(held, i)
                        else:
                            buckets[new] = [i]
                            if new >> 8 >= len(words):
                                words.extend([0] * ((new >> 8) + 1 - len(words)))
                            words[new >> 8] |= 1 << (new & 255)
                            top |= 1 << (new >> 8)
                        if new < lowest:
                            lowest = new
                else:
                    pair[i] = NONE
                if not closed[i]:
                    i = before[i]
                    new = pair[i] = get(symbol[i] << 32 | rank, NONE)
                    if new != NONE:
                        held = bucket_of(new)
                        if held:
                            heappush(held, i)
                        else:
                            buckets[new] = [i]
                            if new >> 8 >= len(words):
                                words.extend([0] * ((new >> 8) + 1 - len(words)))
                            words[new >> 8] |= 1 << (new & 255)
                            top |= 1 << (new >> 8)
                        if new < lowest:
                            lowest = new
                if lowest < rank:
                    break
            if not bucket:
                words[word] &= ~low
                if not words[word]:
                    top &= ~(1 << word)
        found, i = [], 0
        for end in starts[1:].tolist():
            ids = []
            while i < end:
                ids.append(symbol[i])
                i = after[i]
            found.append(ids)
        return found

    def pieces(self, texts: list[str | None]):
        """The pre-tokens of each text, all of them known while the caller looks them up."""
        self.prepare()
        known, ranks = self.known, self.ranks
        split = regex.compile(self.pattern).findall
        found = [split(text or "") for text in texts]
        fresh = set().union(*found) - known.keys()
        if len(known) + len(fresh) > CACHE_SIZE:
            known.clear()
            fresh = set().union(*found)
        rest = []
        for piece in fresh:
            raw = piece.encode("utf-8", "replace")
            rank = ranks.get(raw)
            if rank is None:
                rest.append((piece, raw))
            else:
                known[piece] = rank.to_bytes(4, "little")
        for (piece, _), ids in zip(rest, self.merge([raw for _, raw in rest])):
            known[piece] = b"".join([x.to_bytes(4, "little") for x in ids])
        yield from found
        for piece in fresh:
            if len(piece) > CACHE_CHARS:
                del known[piece]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as 32-bit numbers."""
        return [np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), "<i4") for pieces in self.pieces(texts)]

    def count(self, texts: list[str | None]) -> list[int]:
        """Number of ids of each text."""
        return [sum(map(len, map(self.known.__getitem__, pieces))) // 4 for pieces in self.pieces(texts)]


def chunks(texts: pa.Array):
    """(first row, texts) of parts of a column of about ``CHUNK_CHARS`` at most."""
    first, part, size = 0, [], 0
    for row, value in enumerate(texts):
        text = value.as_py()
        if part and size + len(text or "") > CHUNK_CHARS:
            yield first, part
            first, part, size = row, [], 0
        part.append(text)
        size += len(text or "")
    if part:
        yield first, part


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: base64 of the token, then its rank. Its size is that of the vocabulary, not of the data."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _shared(spark: SparkSession, ranks: dict[bytes, int], pattern: str = ""):
    """One broadcast per vocabulary and application: repeated calls share what a worker has merged."""
    key = spark.sparkContext.applicationId, pattern, hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    if key not in _SENT:
        while len(_SENT) >= KEPT:
            _SENT.pop(next(iter(_SENT))).unpersist()
        _SENT[key] = spark.sparkContext.broadcast(Vocabulary(ranks, pattern))
    return _SENT[key]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "ids") -> DataFrame:
    """Columns ``keep`` and ``out``, the ids as ``array<int>`` of the whole text; every match of ``pattern`` is encoded apart."""
    sent = _shared(docs.sparkSession, ranks, pattern)
    names = [*keep, out]

    def run(batches):
        for batch in batches:
            for first, texts in chunks(batch.column(len(keep))):
                ids = sent.value.encode(texts)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, len(ids)) for k in range(len(keep))), lists], names)

    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + f", `{out}` array<int>"
    return arrow_pass(docs.select(*keep, F.col(text).cast("string")), run, schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), out: str = "decoded") -> DataFrame:
    """Columns ``keep``, ``ids`` and ``out``, the bytes the ids stand for. Null ids decode to no bytes."""
    sent = _shared(encoded.sparkSession, ranks)
    names = [*keep, ids, out]

    def run(batches):
        tokens = sent.value.ranks
        data = np.frombuffer(b"".join(tokens), np.uint8)
        sizes, starts = np.zeros((2, max(tokens.values()) + 1), np.int64)
        order = np.fromiter(tokens.values(), np.int64, len(tokens))
        sizes[order] = [len(t) for t in tokens]
        starts[order] = np.cumsum([0, *map(len, tokens)])[:-1]
        for batch in batches:
            lists, step = batch.column(len(keep)), 100
            for first in range(0, batch.num_rows, step):
                part = lists.slice(first, step)
                ids = part.flatten().to_numpy(zero_copy_only=False)
                size = sizes[ids]
                ends = np.cumsum(size)
                raw = data[np.repeat(starts[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
                count = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                borders = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(count)))].astype(np.int32)
                decoded = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(borders.tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, step) for k in range(len(keep))), part, decoded], names)

    types = dict(encoded.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + f", `{ids}` array<int>, `{out}` binary"
    return arrow_pass(encoded.select(*keep, ids), run, schema)


def count(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "n_tokens") -> DataFrame:
    """Columns ``keep`` and ``out``, the number of ids of the whole text."""
    sent = _shared(docs.sparkSession, ranks, pattern)
    names = [*keep, out]

    def run(batches):
        for batch in batches:
            sizes = [n for _, texts in chunks(batch.column(len(keep))) for n in sent.value.count(texts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(sizes, pa.int64())], names)

    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + f"{', ' if keep else ''}`{out}` bigint"
    return arrow_pass(docs.select(*keep, F.col(text).cast("string")), run, schema)

"""Packing: token sequences of one length, balanced by the cost of attention.

Texts are tokenised inside the scan's own partitions. Each partition packs its
documents in sets of a bounded number of tokens: sequences are opened for all
of the set's tokens, documents go in descending length to the sequence that
costs least and has room, and are cut where they don't fit. What remains after
the full sequences fills sequences whose lengths are powers of two, which need
no padding. Nothing is shuffled.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fieldbook.llm.bytehash import groups, joined, spans, sums
from fieldbook.llm.common import small_batches

#: The id after each document.
END = 0
#: Words whose ids a worker remembers before it starts afresh.
CACHE_WORDS = 1 << 20

#: Pieces that are encoded side by side.
JOINED = 2048
#: Bytes of texts whose words are looked up together; a longer text is cut at spaces.
LOOKED_UP = 1 << 19
#: White space other than a space or a line's end.
OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
OTHER_ASCII = [c for c in OTHER_SPACE if c.isascii()]

_workers: dict[str, Tokenizer] = {}


def unusual(text: str) -> bool:
    """Whether white space stands side by side, at an end of the text, or is other than a space or a line's end."""
    if text[:1].isspace() or text[-1:].isspace() or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
        return True
    return any(c in text for c in (OTHER_ASCII if text.isascii() else OTHER_SPACE))


def cut_at_spaces(text: bytes, size: int) -> list[bytes]:
    """The text in parts of at most size bytes, as far as its spaces allow; all but the first begin with a space."""
    parts, a = [], 0
    while len(text) - a > size:
        b = text.rfind(b" ", a + 1, a + size)
        if b < 0:
            b = text.find(b" ", a + size)
        if b < 0:
            break
        parts.append(text[a:b])
        a = b
    return [*parts, text[a:]]


class Tokenizer:
    """Token ids of whole texts, by a tokenizer file; words seen before are looked up.

    A byte-level tokenizer never joins the two sides of a single space between
    characters that are not white space, so a text is the sequence of its
    pieces `word`, ` word`, ` word`... Texts with white space side by side, or
    with one of the tokenizer's added tokens, are encoded as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Encoder

        self.encoder = Encoder.from_file(path)
        self.added = [token.content for token in self.encoder.get_added_tokens_decoder().values()]
        vocabulary = self.encoder.get_vocab()
        # A byte-level vocabulary writes each byte as one character.
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.forget()

    def forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.first = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.encoder.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encode_words(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in one array, and how many each has.

        Pieces that begin with a space are encoded side by side; the bytes that
        each id stands for tell where a piece ends.
        """
        ids, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for lo in range(0, len(pieces), JOINED):
            some = pieces[lo : lo + JOINED]
            got = np.array(self._encode([b"".join(some).decode()])[0], np.uint32)
            ends, goal = np.cumsum(self.bytes_of[got]), np.cumsum([len(p) for p in some])
            at = np.searchsorted(ends, goal)
            if len(ends) and at[-1] == len(ends) - 1 and (ends[at] == goal).all() and all(p[:1] == b" " for p in some[1:]):
                counts.append(np.diff(at, prepend=-1))
            else:
                each = self._encode([p.decode() for p in some])
                got = np.array([i for x in each for i in x], np.uint32)
                counts.append(np.array([len(x) for x in each], np.int64))
            ids.append(got)
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Add pieces under keys, which are sorted, new and as many."""
        if len(self.keys) + len(keys) > CACHE_WORDS:
            self.forget()
        # Those that begin a text come last, so that most neighbours begin with a space.
        order = np.argsort([p[:1] != b" " for p in pieces], kind="stable")
        ids, some = self._encode_words([pieces[k] for k in order])
        count, first = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        count[order] = some
        first[order] = len(self.ids) + np.cumsum(some) - some
        self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.count = (np.insert(a, at, b) for a, b in ((self.keys, keys), (self.first, first), (self.count, count)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without the end id."""
        out: list[np.ndarray | None] = [None] * len(texts)
        odd = [k for k, t in enumerate(texts) if unusual(t) or any(x in t for x in self.added)]
        for k, ids in zip(odd, self._encode([texts[k] for k in odd]), strict=True):
            out[k] = np.array(ids, np.uint32)
        plain = [k for k in range(len(texts)) if out[k] is None]
        parts = [(k, part) for k in plain for part in cut_at_spaces(texts[k].encode(), LOOKED_UP)]
        own: dict[int, list[np.ndarray]] = {k: [] for k in plain}
        for lo, hi in groups([len(x) for _, x in parts], LOOKED_UP):
            for (k, _), ids in zip(parts[lo:hi], self._pieces([x for _, x in parts[lo:hi]]), strict=True):
                own[k].append(ids)
        for k, found in own.items():
            out[k] = found[0] if len(found) == 1 else np.concatenate(found)
        return out

    def _pieces(self, raw: list[bytes]) -> list[np.ndarray]:
        buf, starts = joined(raw)
        # A piece begins at each text's start and at each space; a text's separator is cut off below.
        is_start = buf == 32
        is_start[starts[:-1][starts[:-1] < len(buf)]] = True
        start = np.flatnonzero(is_start)
        text = np.searchsorted(starts, start, "right") - 1
        end = np.minimum(np.append(start[1:], len(buf)), starts[text + 1] - 1)
        key = spans(sums(buf), start, end)
        uniq, where, back = np.unique(key, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, uniq), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != uniq) if len(self.keys) else np.arange(len(uniq))
        if len(new):
            if len(self.keys) + len(new) > CACHE_WORDS:
                self.forget()
                new = np.arange(len(uniq))
            data = buf.tobytes()
            self._learn(uniq[new], [data[a:b] for a, b in zip(start[where[new]].tolist(), end[where[new]].tolist(), strict=True)])
        at = np.searchsorted(self.keys, uniq)[back]
        count = self.count[at]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(self.first[at] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.searchsorted(text, np.arange(len(raw) + 1))]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def tokenizer(path: str) -> Tokenizer:
    """This worker's tokenizer, read once; it runs in the task's own thread, since Spark deals out the cores."""
    if path not in _workers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _workers[path] = Tokenizer(path)
    return _workers[path]


def pack(lengths: list[int], capacity: int = 1024, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths.

    Sequences of full capacity hold all tokens but a remainder, whose sequences
    are its powers of two. A document's cost in a sequence is linear * tokens +
    quadratic * tokens squared, as it attends to itself alone.
    """
    total = sum(lengths)
    room = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if total % capacity >> b & 1]
    offset = [0] * len(room)
    # Sequences of equal cost are taken with most room first, then in order.
    heap = [(0.0, -r, s) for s, r in enumerate(room)]
    heapq.heapify(heap)
    out = []
    for d in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        start, left = 0, lengths[d]
        while left:
            cost, _, s = heapq.heappop(heap)
            n = min(left, room[s] - offset[s])
            out.append((d, start, n, s, offset[s]))
            offset[s], start, left = offset[s] + n, start + n, left - n
            if offset[s] < room[s]:
                heapq.heappush(heap, (cost + linear * n + quadratic * n * n, offset[s] - room[s], s))
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, set_tokens: int = 1 << 21, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids with keep_ids.

    A null text is an empty one, and an empty text is its end id alone. A null
    doc_id stays null; its pieces are told apart by sequence and offset. The
    tokenizer's added tokens are read as such where a text spells them.
    Repeated rows are packed each. A set of documents is packed when it has
    set_tokens tokens or more, so a task holds one set and one document at
    most. Other columns are not read. An empty table gives no pieces.
    """
    small_batches(docs.sparkSession)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(tokenizer_path)
        base = TaskContext.get().partitionId() << 36
        ids: list[np.ndarray] = []
        keys: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, held
            rows = pack([len(x) for x in ids], capacity)
            parts = [ids[d][a : a + n] for d, a, n, _, _ in rows]
            columns = [
                pa.array([keys[d] for d, *_ in rows], pa.int64()),
                pa.array([a for _, a, *_ in rows], pa.int64()),
                pa.array([n for _, _, n, *_ in rows], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in parts], pa.int64()),
                pa.array([len(ids[d]) for d, *_ in rows], pa.int64()),
                pa.array([base + s for *_, s, _ in rows], pa.int64()),
                pa.array([o for *_, o in rows], pa.int64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                columns.append(pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32())))
                names.append("ids")
            base += 1 + max((s for *_, s, _ in rows), default=-1)
            ids.clear()
            keys.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            texts, doc_ids = [t or "" for t in batch.column(1).to_pylist()], batch.column(0).to_pylist()
            for lo, hi in groups([len(t) for t in texts], 1 << 20):
                for k, x in enumerate(enc.encode(texts[lo:hi]), lo):
                    ids.append(np.append(x, np.uint32(END)))
                    keys.append(doc_ids[k])
                    held += len(x) + 1
                    if held >= set_tokens:
                        yield flush()
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(packed, SCHEMA + ", ids array<int>" * keep_ids)

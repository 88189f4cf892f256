"""Alignment of two tokenizers over a corpus, scored by inverted pair bitmaps.

A text is encoded by a byte-level BPE (A) and a sentencepiece model (B).  Both
encode a text as the sequence of its chunks, cut before spaces, so a chunk is
encoded and aligned once and looked up from then on.  Byte offsets where tokens of both end cut the two token sequences into groups, and
every A-B pair of token occurrences in a group is a link.

The index is inverted: each pair of ids has, per container of documents, a
compressed bitmap of the documents that hold it linked and, as multiplicity
planes, the binary digits of its number of links in each of them.  Tasks emit
partial bitmaps per batch of documents; the partial bitmaps of a pair and
container are OR-merged and their bits counted, and the counts of the
containers add up to the pair's number of documents.  The postings then return:
each container's postings meet their pair's count, and every document receives
the sums over its links.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import broadcast_if_small, materialize, stretch
from ledgerlens.llm.textblocks import utf8

CONTAINER = 1 << 13  # documents of a container: positions fit 13 bits, a plain bitmap 1 KB
ARRAY_MAX = CONTAINER // 16  # up to so many documents a sorted array of 16-bit positions is the smaller form
BLOCK_BYTES = 1 << 19  # of text encoded at once; a longer text is encoded by itself
LINK_SLICE = 1 << 21  # links expanded at once
CACHE_CHUNKS, CACHE_CHARS = 600_000, 1 << 24  # distinct chunks a worker keeps aligned; beyond it the cache starts anew
PAIR_ROWS = 200_000  # pair counts sent to all tasks; more are joined by shuffle

#: Before a space that follows other than white space; spaces at the end stay with what they follow.
_CUT = re.compile(r"(?<=\S)(?= +[^ ])")


# ---- tokenizers -----------------------------------------------------------

def _byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))})
    return out


class Tokenizers:
    """Both tokenizers with the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings inside a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        vocab = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.bytes_a[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.len_a = np.array([len(x) for x in self.bytes_a])
        self.len_b = np.array([len(x) for x in self.bytes_b])
        # An id's text with the mark that follows it: "," inside a run, "|" after A's last, ";" after B's last.
        self.marked = [f"{i}{m}".encode() for n, last in ((len(self.bytes_a), "|"), (len(self.bytes_b), ";")) for m in (",", last) for i in range(n)]
        # A text is cut where neither tokenizer joins what stands before a space with what follows: the byte-level
        # splitter starts a piece at white space after other text, and no piece of B has a space after another byte.
        self.splits = isinstance(self.a.pre_tokenizer, ByteLevel) and self.a.normalizer is None and not any(b" " in x.lstrip(b" ") for x in self.bytes_b)

    def chunks(self, text: str) -> list[str]:
        """Parts of space+text that are encoded as in the whole; each begins with a space."""
        return _CUT.split(" " + text) if self.splits else [" " + text]

    def encode(self, chunks: list[str]) -> Encoded:
        """Ids of each chunk by A and (which adds the space itself) B."""
        got_a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        got_b = self.b.encode([c[1:] for c in chunks], num_threads=1)
        size_a, size_b = np.array([len(x) for x in got_a]), np.array([len(x) for x in got_b])
        a = np.fromiter(chain.from_iterable(got_a), np.int64, int(size_a.sum()))
        b = np.fromiter(chain.from_iterable(got_b), np.int64, int(size_b.sum()))
        del got_a, got_b
        raw, off = utf8(pa.array(chunks, pa.large_string()))
        same = np.ones(len(chunks), bool)
        for ids, size, known, length in ((a, size_a, self.bytes_a, self.len_a), (b, size_b, self.bytes_b, self.len_b)):
            joined = b"".join(map(known.__getitem__, ids.tolist()))
            end = np.concatenate(([0], np.cumsum(length[ids])))[np.concatenate(([0], np.cumsum(size)))]
            if joined != raw.tobytes() or (end != off).any():
                text, view = memoryview(raw), memoryview(joined)
                same &= np.array([text[off[i]:off[i + 1]] == view[end[i]:end[i + 1]] for i in range(len(chunks))], bool)
        return Encoded(a, size_a, b, size_b, same)


@dataclass
class Encoded:
    """Token sequences of several texts, one after another."""

    a: np.ndarray
    size_a: np.ndarray
    b: np.ndarray
    size_b: np.ndarray
    same: np.ndarray  # whether the joined bytes of both are the text's

    def good(self) -> Encoded:
        ok = self.same
        return self if ok.all() else Encoded(self.a[np.repeat(ok, self.size_a)], self.size_a[ok], self.b[np.repeat(ok, self.size_b)], self.size_b[ok], ok[ok])


# ---- alignment ------------------------------------------------------------

@dataclass
class Alignment:
    """Groups of a block of texts, one after another."""

    a: np.ndarray  # A ids of all texts
    b: np.ndarray
    group_a: np.ndarray  # group of each A token
    group_b: np.ndarray
    doc_a: np.ndarray  # text of each A token
    doc_of_group: np.ndarray


def align(e: Encoded, len_a: np.ndarray, len_b: np.ndarray) -> Alignment:
    """Cut the token sequences of texts, whose joined bytes are equal, where both end a token."""
    a, b = e.a, e.b
    end_a, end_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)  # no token is empty
    doc_a = np.repeat(np.arange(len(e.size_a)), e.size_a)
    group_a = np.searchsorted(cuts, end_a)
    doc_of_group = np.empty(len(cuts), np.int64)
    doc_of_group[group_a] = doc_a
    return Alignment(a, b, group_a, np.searchsorted(cuts, end_b), doc_a, doc_of_group)


def links(al: Alignment, size_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, text, count) of all links, in bounded slices: distinct inside a
    slice, to be added up over slices.  A pair is A id * ``size_b`` + B id."""
    n_b = np.bincount(al.group_b, minlength=len(al.doc_of_group))
    start_b = np.cumsum(n_b) - n_b
    per_a = n_b[al.group_a]  # links of each A token
    after = np.cumsum(per_a)
    total = int(after[-1]) if len(after) else 0
    for lo in range(0, total, LINK_SLICE):
        link = np.arange(lo, min(lo + LINK_SLICE, total))
        at = np.searchsorted(after, link, "right")
        b = al.b[start_b[al.group_a[at]] + link - (after[at] - per_a[at])]
        yield _add_up([(al.a[at] * size_b + b, al.doc_a[at], np.ones(len(b), np.int64))])


def _add_up(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum the counts of equal (pair, place); sorted by both."""
    pair, place, count = (np.concatenate(x) for x in zip(*parts))
    span = int(place.max(initial=0)) + 1
    key = pair * span + place  # a pair is under 2^40, a place in a batch or container under 2^23
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first] // span, key[first] % span, np.add.reduceat(count, first)


def group_texts(al: Alignment, marked: list[bytes], n_a: int, n_b: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text."""
    last_a = np.append(al.group_a[1:] != al.group_a[:-1], True)
    last_b = np.append(al.group_b[1:] != al.group_b[:-1], True)
    count_a, count_b = np.bincount(al.group_a), np.bincount(al.group_b)
    place_a = np.arange(len(al.a)) + (np.cumsum(count_b) - count_b)[al.group_a]
    place_b = np.arange(len(al.b)) + np.cumsum(count_a)[al.group_b]
    seq = np.empty(len(al.a) + len(al.b), np.int64)
    seq[place_a] = al.a + n_a * last_a
    seq[place_b] = al.b + 2 * n_a + n_b * last_b
    size = np.bincount(al.doc_of_group, count_a + count_b).astype(np.int64)
    out, at = [], 0
    for n in size.tolist():
        out.append(b"".join(map(marked.__getitem__, seq[at:at + n].tolist()))[:-1])
        at += n
    return out


class _Rows:
    """An array that grows at its end."""

    def __init__(self, *shape: int):
        self.data, self.n = np.zeros((1024, *shape), np.int64), 0

    def add(self, rows: np.ndarray) -> None:
        while self.n + len(rows) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.n:self.n + len(rows)] = rows
        self.n += len(rows)


class Aligner:
    """Aligns texts chunk by chunk, each distinct chunk once."""

    def __init__(self, tok: Tokenizers):
        self.tok = tok
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}  # place of a chunk in the following
        self.texts: list[bytes] = []  # its groups
        self.facts = _Rows(4)  # n_a, n_b, n_groups, n_links; -1 where the bytes differ
        self.first = _Rows()  # its first row in pairs
        self.kinds = _Rows()  # its rows there
        self.pairs = _Rows(2)  # pair, links
        self.chars = 0

    def learn(self, chunks: list[str]) -> None:
        found = self.tok.encode(chunks)
        good = np.flatnonzero(found.same)
        facts, kinds, texts = np.full((len(chunks), 4), -1), np.zeros(len(chunks), np.int64), [b""] * len(chunks)
        if len(good):
            n_a, n_b = len(self.tok.bytes_a), len(self.tok.bytes_b)
            al = align(found.good(), self.tok.len_a, self.tok.len_b)
            pair, chunk, count = _add_up(list(links(al, n_b)))
            order = np.argsort(chunk, kind="stable")
            self.pairs.add(np.stack([pair[order], count[order]], axis=1))
            facts[good] = np.stack([found.size_a[good], found.size_b[good], np.bincount(al.doc_of_group),
                                    np.bincount(chunk, count).astype(np.int64)], axis=1)
            kinds[good] = np.bincount(chunk)
            for i, x in zip(good.tolist(), group_texts(al, self.tok.marked, n_a, n_b)):
                texts[i] = x
        self.number.update(zip(chunks, range(len(self.texts), len(self.texts) + len(chunks))))
        self.first.add(self.pairs.n - int(kinds.sum()) + np.cumsum(kinds) - kinds)
        self.kinds.add(kinds)
        self.facts.add(facts)
        self.texts += texts
        self.chars += sum(map(len, chunks))

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[bytes], tuple[np.ndarray, ...]]:
        """Of each text (n_a, n_b, n_groups, n_links) and its groups, b"" where
        it has no tokens; and the links as (pair, text, count)."""
        if len(self.number) > CACHE_CHUNKS or self.chars > CACHE_CHARS:
            self.forget()
        split = [self.tok.chunks(t) if t else [] for t in texts]
        new = set().union(*split).difference(self.number)
        if new:
            self.learn(list(new))
        numbers = [list(map(self.number.__getitem__, c)) for c in split]
        size = np.array([len(c) for c in split])
        chunk = np.fromiter(chain.from_iterable(numbers), np.int64, int(size.sum()))
        row = np.repeat(np.arange(len(texts)), size)
        good = size > 0
        good[row[self.facts.data[chunk, 0] < 0]] = False
        chunk, row = chunk[good[row]], row[good[row]]
        facts = np.zeros((len(texts), 4), np.int64)
        np.add.at(facts, row, self.facts.data[chunk])
        groups = [b";".join(map(self.texts.__getitem__, c)) if ok else b"" for c, ok in zip(numbers, good.tolist())]
        # Links of a text: those of its distinct chunks, times the chunk's number.
        key = np.sort(row * len(self.texts) + chunk)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
        once, times = key[first], np.diff(np.append(first, len(key)))
        row, chunk = once // max(1, len(self.texts)), once % max(1, len(self.texts))
        n = self.kinds.data[chunk]
        at = np.repeat(self.first.data[chunk] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pairs = self.pairs.data[at]
        return facts, groups, (pairs[:, 0], np.repeat(row, n), pairs[:, 1] * np.repeat(times, n))


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker process, so its cache serves all its tasks."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(Tokenizers(path_a, path_b))
    return _aligners[path_a, path_b]


# ---- compressed bitmaps ----------------------------------------------------

def _runs(offsets: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run."""
    n = np.diff(offsets)
    return np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], n)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())])


def pack_bitmaps(docs: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Bitmaps of sorted document positions, row i in docs[offsets[i]:offsets[i+1]]:
    up to ARRAY_MAX positions as 16-bit numbers, more as CONTAINER bits."""
    n = np.diff(offsets)
    dense = n > ARRAY_MAX
    size = np.where(dense, CONTAINER // 8, 2 * n)
    at = np.concatenate(([0], np.cumsum(size)))
    data = np.zeros(int(at[-1]), np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    few = ~dense[row]
    place = at[row[few]] + 2 * _runs(offsets)[few]
    data[place], data[place + 1] = docs[few] & 255, docs[few] >> 8
    many = ~few
    np.bitwise_or.at(data, at[row[many]] + (docs[many] >> 3), (1 << (docs[many] & 7)).astype(np.uint8))
    return _binary(data, at)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0]:o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def unpack_bitmaps(column: pa.Array, n: np.ndarray) -> np.ndarray:
    """All positions, row by row and ascending, of bitmaps with ``n`` documents each."""
    raw, at = _bytes_of(column)
    offsets = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(int(offsets[-1]), np.int64)
    dense = n > ARRAY_MAX
    row = np.repeat(np.arange(len(n)), n)
    few = ~dense[row]
    place = at[:-1][row[few]] + 2 * _runs(offsets)[few]
    out[few] = raw[place].astype(np.int64) | raw[place + 1].astype(np.int64) << 8
    for i in np.flatnonzero(dense).tolist():
        out[offsets[i]:offsets[i + 1]] = np.flatnonzero(np.unpackbits(raw[at[i]:at[i + 1]], bitorder="little"))
    return out


def pack_planes(counts: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Multiplicity planes: for each row the binary digits of its documents'
    counts less one, lowest first, a plane having one bit per document of the
    row.  Counts of one need no plane."""
    n = np.diff(offsets)
    high = np.zeros(len(n), np.int64)
    if len(counts):
        high = np.maximum.reduceat(counts, offsets[:-1]) - 1
    planes = np.zeros(len(n), np.int64)
    while (high > 0).any():
        planes += high > 0
        high = high >> 1
    width = -(-n // 8)
    at = np.concatenate(([0], np.cumsum(planes * width)))
    data = np.zeros(int(at[-1]), np.uint8)
    row, pos = np.repeat(np.arange(len(n)), n), _runs(offsets)
    for p in range(int(planes.max(initial=0))):
        set_bit = ((counts - 1) >> p) & 1 == 1
        r, q = row[set_bit], pos[set_bit]
        np.bitwise_or.at(data, at[r] + p * width[r] + (q >> 3), (1 << (q & 7)).astype(np.uint8))
    return _binary(data, at)


def unpack_planes(column: pa.Array, n: np.ndarray) -> np.ndarray:
    """The counts of :func:`pack_planes`, row by row."""
    raw, at = _bytes_of(column)
    offsets = np.concatenate(([0], np.cumsum(n)))
    width = -(-n // 8)
    planes = np.diff(at) // np.maximum(width, 1)
    row, pos = np.repeat(np.arange(len(n)), n), _runs(offsets)
    out = np.ones(int(offsets[-1]), np.int64)
    for p in range(int(planes.max(initial=0))):
        has = planes[row] > p
        r, q = row[has], pos[has]
        out[has] += ((raw[at[:-1][r] + p * width[r] + (q >> 3)] >> (q & 7)) & 1).astype(np.int64) << p
    return out


# ---- Spark stages ----------------------------------------------------------

_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_POSTING = "a int, b int, n_docs long, docs binary, planes binary"
_INDEX = f"container long, slot int, {_DOC}, {_POSTING}"


def _posting_arrays(pair: np.ndarray, slot: np.ndarray, count: np.ndarray, size_b: int) -> dict[str, pa.Array]:
    """Columns of the postings with entries (pair, slot, count) sorted by pair and slot."""
    new = np.ones(len(pair), bool)
    new[1:] = pair[1:] != pair[:-1]
    first = np.flatnonzero(new)
    offsets = np.append(first, len(pair))
    return {"a": pa.array(pair[first] // size_b, pa.int32()), "b": pa.array(pair[first] % size_b, pa.int32()),
            "n_docs": pa.array(np.diff(offsets), pa.int64()), "docs": pack_bitmaps(slot, offsets), "planes": pack_planes(count, offsets)}


def _row_ranges(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > BLOCK_BYTES:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def _emit(rows: dict[str, pa.Array]) -> pa.RecordBatch:
    types = {"container": pa.int64(), "slot": pa.int32(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(),
             "n_links": pa.int64(), "groups_sha256": pa.string(), "a": pa.int32(), "b": pa.int32(), "n_docs": pa.int64(),
             "docs": pa.binary(), "planes": pa.binary()}
    n = len(next(iter(rows.values())))
    return pa.RecordBatch.from_arrays([rows[k] if k in rows else pa.nulls(n, t) for k, t in types.items()], names=list(types))


def _index(path_a: str, path_b: str):
    """Rows (doc_id, text) -> one row per document and the batch's partial postings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        base = TaskContext.get().partitionId() << 33
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # a batch is cut where a container is full
                container, slot0 = base + seen // CONTAINER, seen % CONTAINER
                part = batch.slice(at, CONTAINER - slot0)
                at, seen = at + part.num_rows, seen + part.num_rows
                yield from index_part(part, container, slot0)

    def index_part(part, container, slot0):
        aligner = _aligner(path_a, path_b)
        texts = part.column(1).to_pylist()
        facts, digest, found = [], [], []
        for lo, hi in _row_ranges(texts):
            numbers, groups, (pair, row, count) = aligner.align(texts[lo:hi])
            facts.append(numbers)
            digest += [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
            if len(pair):
                found.append(_add_up([(pair, row + lo + slot0, count)]))
        n = len(texts)
        yield _emit({"container": pa.array(np.full(n, container)), "slot": pa.array(np.arange(slot0, slot0 + n), pa.int32()), "doc_id": part.column(0),
                     **dict(zip(("n_a", "n_b", "n_groups", "n_links"), map(pa.array, np.concatenate(facts).T.copy()))),
                     "groups_sha256": pa.array(digest, pa.string())})
        if found:
            rows = _posting_arrays(*_add_up(found), len(aligner.tok.bytes_b))
            yield _emit({"container": pa.array(np.full(len(rows["a"]), container)), **rows})
    return run


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the batch, slot, count) of every posting entry."""
    n = batch.column("n_docs").to_numpy()
    return np.repeat(np.arange(len(n)), n), unpack_bitmaps(batch.column("docs"), n), unpack_planes(batch.column("planes"), n)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """OR the partial postings of a pair and container, whose rows stand
    together; a document's links are all in one partial."""
    held = None
    for batch in batches:
        t = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = np.stack([t.column(k).to_numpy().astype(np.int64) for k in ("container", "a", "b")])
        new = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))
        last = int(np.flatnonzero(new)[-1])  # its partials may go on in the next batch
        held = t.slice(last)
        if last:
            yield _merged(t.slice(0, last), key[:, :last], new[:last])
    if held is not None and held.num_rows:
        key = np.stack([held.column(k).to_numpy().astype(np.int64) for k in ("container", "a", "b")])
        yield _merged(held, key, np.append(True, np.zeros(held.num_rows - 1, bool)))


def _merged(t: pa.RecordBatch, key: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
    row, slot, count = _entries(t)
    group = (np.cumsum(new) - 1)[row]
    order = np.lexsort((slot, group))
    group, slot, count = group[order], slot[order], count[order]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=int(new.sum())))))
    first = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays(
        [pa.array(key[0, first]), pa.array(key[1, first], pa.int32()), pa.array(key[2, first], pa.int32()), pa.array(np.diff(offsets)),
         pa.array(np.add.reduceat(count, offsets[:-1])), pack_bitmaps(slot, offsets), pack_planes(count, offsets)],
        names=["container", "a", "b", "n_docs", "n_links", "docs", "planes"])


def _return(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scored postings ordered by container -> (container, slot, n_best, count_sum)."""
    now, best, total = None, None, None

    def out():
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now)), pa.array(at, pa.int32()), pa.array(best[at]), pa.array(total[at])],
                                          names=["container", "slot", "n_best", "count_sum"])
    for batch in batches:
        container = batch.column("container").to_numpy()
        for lo, hi in _equal_runs(container):
            part = batch.slice(lo, hi - lo)
            if now != container[lo]:
                if now is not None:
                    yield out()
                now, best, total = container[lo], np.zeros(CONTAINER, np.int64), np.zeros(CONTAINER, np.int64)
            row, slot, count = _entries(part)
            np.add.at(total, slot, count * part.column("pair_docs").to_numpy()[row])
            np.add.at(best, slot, count * part.column("is_best").to_numpy(zero_copy_only=False)[row])
    if now is not None:
        yield out()


def _equal_runs(x: np.ndarray) -> list[tuple[int, int]]:
    cut = np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]))
    return [(int(a), int(b)) for a, b in zip(cut[:-1], cut[1:]) if b > a]


def index_links(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id",
                text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two written tables: one row per document (container, slot, doc_id, n_a,
    n_b, n_groups, n_links, groups_sha256), and the merged postings (container,
    a, b, n_docs, n_links, docs, planes).

    The tokenizer files are paths present on every worker.  Rows are documents
    of their own whatever their id; see :func:`cross_alignment` for nulls,
    empty and long texts.
    """
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    index = materialize(rows.mapInArrow(_index(tokenizer_a, tokenizer_b), _INDEX), "pair-index")
    of_docs = index.where("slot is not null").select("container", "slot", *(f.split()[0] for f in _DOC.split(", ")))
    partial = index.where("a is not null").select("container", "a", "b", "n_docs", "docs", "planes")
    keys = ["container", "a", "b"]
    merged = (partial.repartition(stretch(docs.sparkSession), *keys).sortWithinPartitions(*keys)
              .mapInArrow(_merge, "container long, a int, b int, n_docs long, n_links long, docs binary, planes binary"))
    return of_docs, materialize(merged, "pair-bitmaps")


def pair_table(postings: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links, is_best) of every linked pair of ids: documents
    that hold it, links in all of them, and whether no pair of A id ``a`` is in
    more documents."""
    pairs = postings.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    pairs = materialize(pairs, "pairs")
    top = pairs.groupBy("a").agg(F.max("n_docs").alias("top"))
    return pairs.join(top, "a").select("a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("top")).alias("is_best"))


def cross_alignment(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256.

    n_best counts the links whose pair is in as many documents as any pair of
    its A id (ties included); count_sum adds every link's number of documents.
    Null and empty texts, and texts that a tokenizer does not give back byte by
    byte, have zeros and an empty digest.  Long texts are encoded whole, their
    links expanded a slice at a time.  Null and repeated ids are allowed: every
    row is a document.  An empty table gives no rows.  Other columns are ignored.
    """
    of_docs, postings = index_links(docs, tokenizer_a, tokenizer_b, id_col, text_col)
    pairs = materialize(pair_table(postings).select("a", "b", F.col("n_docs").alias("pair_docs"), "is_best"), "pair-counts")
    scored = postings.select("container", "a", "b", "n_docs", "docs", "planes").join(broadcast_if_small(pairs, PAIR_ROWS), ["a", "b"])
    back = (scored.select("container", "n_docs", "docs", "planes", "pair_docs", "is_best")
            .repartition(stretch(docs.sparkSession), "container").sortWithinPartitions("container")
            .mapInArrow(_return, "container long, slot int, n_best long, count_sum long"))
    out = of_docs.join(back, ["container", "slot"], "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                      F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")

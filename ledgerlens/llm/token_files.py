"""Token-ID output: flat binary id files, 64-bit offsets, memory-mapped reads.

Layout of a folder written by :func:`write_token_files` (little endian):

* ``shard-00007.tokens``: the ids of the shard's documents, one after another,
  each document closed by the end id; unsigned 16-bit when every id fits, else
  unsigned 32-bit;
* ``shard-00007.offsets``: n+1 unsigned 64-bit positions (in ids, from the
  shard's start);
* ``shard-00007.docs``: n pairs of signed 64-bit (doc_id, 1), (0, 0) for a null id;
* ``manifest.json``: id width, end id and per shard its documents, ids and
  base (ids in all shards before it, a prefix sum over the shards).

Documents are range-partitioned and sorted by (doc_id, text), so shards hold
ascending ids, ids with many rows spread over shards, and a retried or
speculative task writes the same bytes: files are written under a temporary
name and moved into place.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm.common import ensure_checkpoint_dir, materialize, release_memory, stretch

END_ID = 2
CACHE_CHUNKS = 450_000  # distinct chunks, and words, a worker keeps encoded; beyond it a cache starts anew


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder and the path in it."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def _byte_letters() -> dict[int, str]:
    """The byte-level vocabulary's letter for each byte: printable Latin-1
    bytes stand for themselves, the others for the characters from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in keep else next(rest)) for b in range(256)}


class ChunkEncoder:
    """Encodes texts with the tokenizer, each distinct chunk or word once.

    The byte-level splitter starts a new piece at every single space between
    non-space characters, so encoding such chunks one by one gives the ids of
    the whole text.  It never joins letters with the marks in ``_MARKS`` or
    with a line feed, so a chunk of letters and marks, or two of them with one
    line feed between, is looked up word by word, and a new word goes straight
    to the tokenizer's model.  Any other chunk is encoded as a whole, and a
    text with other white space next to a space, or with a string of the
    tokenizer's added tokens (which the library turns into their ids), is
    encoded whole.
    """

    _MARKS = ".,;:!?*%$#&|"

    def __init__(self, path: str, dtype: str, cache: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        self.cache = cache
        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.model = self.tok.model
        self.letters = _byte_letters()
        self.code = "H" if np.dtype(dtype).itemsize == 2 else "I"
        self.chunks: dict[str, bytes | None] = {}
        self.words: dict[str, bytes] = {}
        self.feed = self._piece("\n")

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of the splitter, straight from the model."""
        byte_text = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(byte_text)]).tobytes()

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            got = self.words[word] = self._piece(word)
        return got

    def _run(self, run: str, lead: str) -> bytes | None:
        """Ids of letters followed by marks, after a space if ``lead``; None for other runs."""
        core = run.rstrip(self._MARKS)
        if not core:
            return self._word(lead + run) if run else None
        if not core.isalpha():
            return None
        return self._word(lead + core) + (self._word(run[len(core):]) if len(core) < len(run) else b"")

    def _learn(self, new: set[str]) -> None:
        """Fill the chunk cache.  A key is the chunk after its space; a text's
        first chunk has no space, and its key has one."""
        rest = []
        for c in new:
            if not c or c[-1].isspace() or (c[0].isspace() and c[0] != " ") or (c[0] == " " and (len(c) == 1 or c[1].isspace())):
                self.chunks[c] = None  # the text is encoded whole
                continue
            lead, run = ("", c[1:]) if c[0] == " " else (" ", c)
            got = self._run(run, lead)
            if got is None and run.count("\n") == 1:
                one, two = run.split("\n")
                x, y = self._run(one, lead), self._run(two, "")
                got = x + self.feed + y if x is not None and y is not None else None
            if got is None:
                rest.append((c, lead + run))
            else:
                self.chunks[c] = got
        if rest:
            self.chunks.update(zip((c for c, _ in rest), self._whole([t for _, t in rest])))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.chunks) > self.cache:
            self.chunks = {}
        if len(self.words) > self.cache:
            self.words = {}
        plain = [not any(a in t for a in self.added) for t in texts]
        split = [t.split(" ") if p else [""] for t, p in zip(texts, plain)]
        for s in split:
            s[0] = " " + s[0]
        self._learn(set().union(*split) - self.chunks.keys())
        get, out = self.chunks.__getitem__, []
        for t, s, p in zip(texts, split, plain):
            try:
                out.append(b"".join(map(get, s)) if p else self._whole([t])[0])
            except TypeError:  # a chunk that must not be encoded by itself
                out.append(self._whole([t])[0] if t else b"")
        return out


_encoders: dict[tuple[str, str, int], ChunkEncoder] = {}


def _encoder(path: str, dtype: str, cache: int) -> ChunkEncoder:
    """One encoder per worker process, so its caches serve the tasks that follow."""
    if (path, dtype, cache) not in _encoders:
        _encoders[path, dtype, cache] = ChunkEncoder(path, dtype, cache)
    return _encoders[path, dtype, cache]


def _put(folder: str, name: str, write) -> None:
    """Write a file under a temporary name, then move it into place."""
    fs, base = open_folder(folder)
    tmp, final = f"{base}/_tmp-{name}-{uuid.uuid4().hex}", f"{base}/{name}"
    with fs.open_output_stream(tmp) as out:
        write(out)
    try:
        fs.move(tmp, final)
    except OSError:  # some stores do not replace an existing file
        fs.delete_file(final)
        fs.move(tmp, final)


def _write_shard(folder: str, tokenizer: str, end_id: int, dtype: str, cache: int, keep_encoder: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier tasks of this worker have left
        end = np.array([end_id], dtype=dtype).tobytes()
        width = np.dtype(dtype).itemsize
        lengths: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        name = f"shard-{TaskContext.get().partitionId():05d}"

        def tokens(out):
            for b in batches:
                enc = _encoder(tokenizer, dtype, cache)
                texts = b.column(1).fill_null("").to_pylist()
                for lo in range(0, len(texts), 128):
                    got = enc.encode(texts[lo:lo + 128])
                    lengths.append(np.array([len(x) // width + 1 for x in got], dtype=np.uint64))
                    out.write(b"".join(x + end for x in got))
                ids = b.column(0)
                docs.append(np.stack([ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"),
                                      ids.is_valid().to_numpy(zero_copy_only=False).astype("<i8")], axis=1))

        _put(folder, f"{name}.tokens", tokens)
        if not keep_encoder:
            _encoders.clear()
            release_memory()
        n = np.concatenate(lengths) if lengths else np.zeros(0, np.uint64)
        if not len(n):
            return
        off = np.concatenate(([0], np.cumsum(n))).astype("<u8")
        _put(folder, f"{name}.offsets", lambda out: out.write(off.tobytes()))
        _put(folder, f"{name}.docs", lambda out: out.write(np.concatenate(docs).tobytes()))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([int(name[6:])], pa.int64()),
                                          "n_docs": pa.array([len(n)], pa.int64()),
                                          "n_ids": pa.array([int(off[-1])], pa.int64())})
    return run


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID,
                      id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE_CHUNKS,
                      keep_encoder: bool = True) -> str:
    """Encode ``text_col`` of all rows in ascending ``id_col`` order into binary
    files; returns the folder.

    ``tokenizer`` is the path of a tokenizers file, present on every worker;
    ``cache`` bounds the distinct chunks a worker keeps encoded.  Workers keep
    tokenizer and cache for their next task; without ``keep_encoder`` each task
    gives them back, for jobs whose other stages need the memory.
    Null or empty text: only the end id.  Null ids come first; rows of one id
    are ordered by text, repeated rows stay.  An empty table gives a manifest
    without shards.  Other columns are ignored.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex[:12]}"
    vocab = Tokenizer.from_file(tokenizer).get_vocab_size()
    dtype = "<u2" if max(vocab, end_id + 1) <= 1 << 16 else "<u4"
    fs, base = open_folder(folder)
    fs.create_dir(base, recursive=True)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    shards = (rows.repartitionByRange(stretch(spark), *order).sortWithinPartitions(*order, "text")
              .mapInArrow(_write_shard(folder, tokenizer, end_id, dtype, cache, keep_encoder), "shard long, n_docs long, n_ids long"))
    # One row per shard: bounded by the number of partitions.
    found = sorted(materialize(shards, "shards").collect())
    base_ids = 0
    out = []
    for shard, n_docs, n_ids in found:
        out.append({"shard": shard, "n_docs": n_docs, "n_ids": n_ids, "base": base_ids})
        base_ids += n_ids
    text = json.dumps({"dtype": dtype, "end_id": end_id, "shards": out})
    _put(folder, "manifest.json", lambda f: f.write(text.encode()))
    return folder


def _map(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the store is mounted."""
    fs, base = open_folder(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(f"{base}/{name}", dtype=dtype, mode="r")
    with fs.open_input_file(f"{base}/{name}") as f:
        return np.frombuffer(f.read_buffer(), dtype=dtype)


def _read_shards(folder: str, dtype: str, batch_docs: int = 4096):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name = f"shard-{shard:05d}"
                ids, off = _map(folder, f"{name}.tokens", dtype), _map(folder, f"{name}.offsets", "<u8").astype(np.int64)
                docs = _map(folder, f"{name}.docs", "<i8").reshape(-1, 2)
                for lo in range(0, len(docs), batch_docs):
                    hi = min(lo + batch_docs, len(docs))
                    crc = [zlib.crc32(ids[off[i]:off[i + 1]].astype("<u4").tobytes()) for i in range(lo, hi)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(docs[lo:hi, 0], pa.int64(), mask=docs[lo:hi, 1] == 0),
                        "start": pa.array(off[lo:hi] + base, pa.int64()),
                        "n_tokens": pa.array(np.diff(off[lo:hi + 1]), pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64())})
    return run


def read_token_index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from
    the files; a task maps one shard."""
    fs, base = open_folder(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        manifest = json.loads(f.read())
    rows = [(s["shard"], s["base"]) for s in manifest["shards"]]
    shards = spark.createDataFrame(rows, "shard long, base long").repartition(max(1, len(rows)))
    return shards.mapInArrow(_read_shards(folder, manifest["dtype"]),
                             "doc_id long, start long, n_tokens long, ids_crc32 long")

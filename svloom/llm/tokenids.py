"""Token ids as directly addressable codes in shard files.

An id is cut into 8-bit chunks. Level 0 holds the lowest chunk of every id, level k the next chunk of
the ids that have one; a continuation bitmap per level says which ids go on, and a rank directory holds
the number of set bits before each block of 512, so any token is found by one bit count per level and
nothing else of the file is decoded.

Defined cases: null and empty texts give the end id alone; repeated rows and doc_ids are each written
(ordered by doc_id, then text); a null doc_id sorts first and is read back as null; an empty table gives
an empty result; columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from svloom.llm.common import Workspace, shared_fs, tasks_for, write_whole

MAGIC = b"SVDAC\x001\x00"
RANK_BLOCK = 512
SHARD_TOKENS = 1 << 22
#: Pieces of one generation that a worker keeps, of those at a text's start and of others each; it keeps the generation before as well
#: (about 220 bytes a piece, 130 MB).
CACHE_PIECES = 300_000
DEFAULT_TOKENIZER = "byte_bpe_50k.json"


# ---------------------------------------------------------------- the file format
class Level:
    """One level: its chunks, its continuation bits, and the ranks before each block of bits."""

    def __init__(self, chunks: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.chunks, self.bits, self.ranks = chunks, bits, ranks

    @classmethod
    def of(cls, chunks: np.ndarray, goes_on: np.ndarray) -> "Level":
        bits = np.packbits(goes_on, bitorder="little")
        blocks = np.add.reduceat(goes_on, np.arange(0, len(goes_on), RANK_BLOCK), dtype=np.uint32) if len(goes_on) else np.zeros(0, np.uint32)
        ranks = np.concatenate([np.zeros(1, np.uint32), np.cumsum(blocks, dtype=np.uint32)])
        return cls(chunks, bits, ranks)

    def rank(self, i: int) -> int:
        """Set bits before position i."""
        block = i // RANK_BLOCK
        first = block * RANK_BLOCK // 8
        head = int.from_bytes(self.bits[first : i // 8 + 1].tobytes(), "little") & ((1 << (i - block * RANK_BLOCK)) - 1)
        return int(self.ranks[block]) + head.bit_count()

    def goes_on(self, i: int) -> bool:
        return bool(self.bits[i // 8] >> (i % 8) & 1)


def encode_levels(ids: np.ndarray) -> list[Level]:
    levels, rest = [], ids.astype(np.uint32, copy=False)
    while True:
        more = rest > 255
        levels.append(Level.of(rest.astype(np.uint8), more))
        if not more.any():
            return levels
        rest = rest[more] >> 8


def pack_shard(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one shard: header, document directory, levels."""
    levels = encode_levels(ids)
    parts = [MAGIC, struct.pack("<QQQ", len(doc_ids), len(ids), len(levels))]
    parts.append(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes())
    parts.append(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    parts.append(np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes())
    for lv in levels:
        parts += [struct.pack("<Q", len(lv.chunks)), lv.chunks.tobytes(), lv.bits.tobytes(), lv.ranks.astype("<u4").tobytes()]
    return b"".join(parts)


class Shard:
    """A shard read back. token(i) and tokens(a, b) give random access."""

    def __init__(self, data):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token shard")
        n_docs, self.n_tokens, n_levels = struct.unpack_from("<QQQ", data, 8)
        at = 32
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.doc_null = np.frombuffer(data, np.uint8, n_docs, at := at + 8 * n_docs)
        self.offsets = np.frombuffer(data, "<u8", n_docs + 1, at := at + n_docs).astype(np.int64)
        at += 8 * (n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            n_bits, n_ranks = (n + 7) // 8, (n + RANK_BLOCK - 1) // RANK_BLOCK + 1
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, n_bits, at := at + n)
            ranks = np.frombuffer(data, "<u4", n_ranks, at := at + n_bits)
            at += 4 * n_ranks
            self.levels.append(Level(chunks, bits, ranks))

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for level in self.levels:
            value |= int(level.chunks[i]) << shift
            if not level.goes_on(i):
                break
            i, shift = level.rank(i), shift + 8
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids of positions a to b, with one rank per level."""
        out = np.zeros(max(0, b - a), np.uint32)
        where, shift = np.arange(len(out)), 0
        for level in self.levels:
            if a >= b:
                break
            out[where] |= level.chunks[a:b].astype(np.uint32) << np.uint32(shift)
            first = a // 8
            on = np.unpackbits(level.bits[first : (b + 7) // 8], bitorder="little")[a - first * 8 : b - first * 8].astype(bool)
            where, shift = where[on], shift + 8
            a = level.rank(a)
            b = a + len(where)
        return out


# ---------------------------------------------------------------- tokenizing
def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def packed(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Pieces(dict):
    """Ids (as little-endian uint32 bytes) of the pieces between white space, made on demand.

    Pieces of the generation before that are met again go to the present one, so common ones are not made anew when it is full.
    """

    TAIL = ".,;:!?%$#&*|"

    def __init__(self, tokenizer, lead: str):
        super().__init__()
        self.tokenizer, self.lead, self.letters = tokenizer, lead, _byte_letters()
        self.model = tokenizer.model
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            out = self._made(piece)
        if len(piece) <= 64:
            if len(self) >= CACHE_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out

    def _made(self, piece: str) -> bytes:
        word = piece.rstrip(self.TAIL)
        if word != piece and word.isascii() and word.isalpha():
            return self[word] + self._encode(piece[len(word) :], "")
        if piece.isalpha():
            letters = (self.lead + piece).encode().decode("latin1").translate(self.letters)
            return packed(t.id for t in self.model.tokenize(letters))
        return self._encode(piece, self.lead)

    def _encode(self, text: str, lead: str) -> bytes:
        return packed(self.tokenizer.encode(lead + text, add_special_tokens=False).ids)


class TextEncoder:
    """Whole-text encoding that asks the tokenizer once for each different piece.

    Byte-level pre-tokens never span a single space or line feed between two other characters, and a
    space goes with what follows, so encoding the pieces and joining their ids equals encoding the text.
    Texts with runs of white space are cut only at single spaces between two other characters.
    Special tokens such as <|endoftext|> within a text become their one id, as in the tokenizer's plain
    encode.
    """

    RUN, CUT = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.first, self.later = Pieces(self.tokenizer, ""), Pieces(self.tokenizer, " ")
        added = self.tokenizer.get_added_tokens_decoder().values()
        spaced = any(t.lstrip or t.rstrip or re.search(r"\s", t.content) for t in added)
        self.by_line = '"add_prefix_space":false' in self.tokenizer.pre_tokenizer.__getstate__().decode() and self.tokenizer.normalizer is None and not spaced

    def encode(self, text: str) -> bytes:
        if not self.by_line:
            return self.first._encode(text, "")
        first, later = self.first.__getitem__, self.later.__getitem__
        if self.RUN.search(text):
            head, *rest = self.CUT.split(text)
            return b"".join([first(head), *map(later, rest)])
        parts, newline = [], first("\n")
        for k, line in enumerate(text.split("\n")):
            head, *rest = line.split(" ")
            if k:
                parts.append(newline)
            parts.append(first(head))
            parts.extend(map(later, rest))
        return b"".join(parts)


_ENCODERS: dict[str, TextEncoder] = {}


def text_encoder(path: str | None = None) -> TextEncoder:
    """The encoder of this worker process; path None: the public 50k byte-level vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(DEFAULT_TOKENIZER)
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------- Spark jobs
def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write docs in ascending doc_id order as shard files of about shard_tokens ids.

    Returns the manifest: part, seq, path, n_docs, n_tokens. A task that is run again writes files under
    other names, and only the files in the manifest of the attempt that succeeded are ever read.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        encoder, task = text_encoder(tokenizer), TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        doc_ids, texts, held, seq = [], [], 0, 0

        def flush():
            nonlocal doc_ids, texts, held, seq
            counts = np.array([len(t) // 4 for t in texts], np.int64)
            ids = np.frombuffer(b"".join(texts), "<u4")
            texts = []
            path = f"{folder}/part-{part:06d}-{seq:05d}-{attempt}.svdac"
            write_whole(path, [pack_shard(doc_ids, counts, ids)])
            row = {"part": [part], "seq": [seq], "path": [path], "n_docs": [len(doc_ids)], "n_tokens": [len(ids)]}
            doc_ids, held, seq = [], 0, seq + 1
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                coded = encoder.encode(text.as_py() or "") + end
                doc_ids.append(doc_id)
                texts.append(coded)
                held += len(coded) // 4
                if held >= shard_tokens:
                    yield flush()
        if doc_ids:
            yield flush()

    return ordered.mapInArrow(write, "part int, seq int, path string, n_docs long, n_tokens long")


def read_token_files(manifest: DataFrame, task_tokens: int = 4 * SHARD_TOKENS) -> DataFrame:
    """Per document of the files of a manifest: doc_id, start, n_tokens, ids_crc32.

    The files are dealt out to tasks of about task_tokens ids; a task holds one file at a time.
    """
    files = manifest.agg(F.count("*"), F.sum("n_tokens")).first()
    n_tasks = tasks_for(manifest.sparkSession, files[1] or 0, task_tokens, max(1, files[0]))
    by_part = manifest.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = by_part.select("part", F.coalesce(F.sum("part_tokens").over(ahead), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(parts, "part").select("path", (F.col("part_start") + F.col("before")).alias("shard_start"))

    def read(batches):
        for batch in batches:
            for path, shard_start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                filesystem, local = shared_fs(path)
                with filesystem.open_input_file(local) as f:
                    shard = Shard(f.read())
                ids = shard.tokens(0, shard.n_tokens)
                at = shard.offsets
                crcs = [zlib.crc32(ids[a:b].astype("<u4", copy=False)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, mask=shard.doc_null.astype(bool)), pa.array(at[:-1] + shard_start), pa.array(np.diff(at)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(n_tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, space: Workspace | None = None) -> DataFrame:
    """Tokenize docs into shard files in the shared folder and read each document's place and checksum back.

    The shards and their manifest are the product: they stay below spark.checkpoint.dir, or in `space`.
    """
    space = space or Workspace(docs.sparkSession, "tokens")
    files = space.folder("shards")
    manifest = space.save(write_token_files(docs, files, tokenizer, end_id, shard_tokens), "manifest")
    return read_token_files(manifest)

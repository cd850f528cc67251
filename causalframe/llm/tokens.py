"""Token ids of whole documents in binary files: one concatenated id array a file, document boundaries in Elias-Fano code.

A file is: 8 bytes of magic; the ids, 2 or 4 bytes each, little-endian; the Elias-Fano code of the n + 1 boundaries (0
to the number of ids); that of the document ids, shifted to be unsigned; a footer with the places of these parts, the
number of leading documents without an id, and the magic again. Files hold consecutive documents in ascending doc_id
order, and their order is that of their names. A file is written under a name of its own and then renamed, so a task
that is run again, or twice, leaves the same files.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causalframe.llm.eliasfano import EliasFano, encode
from causalframe.llm.scratch import filesystem, new_path, table, tidy, written

MAGIC = b"CFTOKEN1"
_FOOT = struct.Struct("<QQQQB7x8s")
_SHIFT = 1 << 63
END = 0
#: A lone space between two characters that are not white space starts a token of a byte-level tokenizer, whatever is around it.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_UNSAFE = re.compile(r" (?:(?<=\s )|(?<=\A )|(?=\s)|\Z)")
_MARKS = string.punctuation
#: Letters below it are letters to every version of Unicode that a library may have.
_LATIN = "\u0250"
#: Characters by which byte-level tokenizers write bytes: printable ones of Latin-1 as they are, the others from 256 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: b if b in _SHOWN else 256 + sum(x not in _SHOWN for x in range(b)) for b in range(256)}
_SPACE = chr(_BYTES[0x20])
#: About what a remembered piece takes beside its characters.
_ENTRY = 190
_encoders: dict = {}


def _spaced(text: str) -> bool:
    """Whether every space is a lone one between characters that are not white space, so that all of them are cuts."""
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return False
    if "\n" in text:
        if " \n" in text or "\n " in text:
            return False
        return text.replace("\n", "").isprintable() or not _UNSAFE.search(text)
    return text.isprintable() or not _UNSAFE.search(text)


class _Known(dict):
    """Ids by piece; what is missing is worked out by find and kept."""

    def __init__(self, find: Callable[[str], bytes]):
        self.find = find

    def __missing__(self, piece: str) -> bytes:
        found = self[piece] = self.find(piece)
        return found


class Encoder:
    """Ids of texts by a tokenizer file of the tokenizers library; special tokens' strings are ordinary text.

    With a byte-level tokenizer that neither normalizes nor adds a space, texts are cut before lone spaces, where no
    token spans the cut, and each different piece is encoded once while it is among those remembered (about keep bytes of
    lately used ones, twice that at most, and those of one text). So a piece, not a text, is what the library
    holds at once. A new piece of letters, with ASCII marks behind it, is cut once more and goes to the library's model
    as it is. Other tokenizers get whole texts.
    """

    def __init__(self, path: str, keep: int = 1 << 26):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        kind = json.loads(self.tokenizer.to_str())
        before, model = kind.get("pre_tokenizer") or {}, kind["model"]
        self.cut = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not kind.get("normalizer")
        self.plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        self.tokenize = self.tokenizer.model.tokenize
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.singles = [self._bytes([i]) for i in range(self.tokenizer.get_vocab_size())]
        self.end = self.singles[END]
        self.keep, self.held, self.known, self.older, self.marks = keep, 0, _Known(self._new), {}, {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The one of this Python worker, which serves many tasks."""
        return _encoders.get(path) or _encoders.setdefault(path, cls(path))

    def _bytes(self, ids: list[int]) -> bytes:
        if sys.byteorder == "little":
            return array(self.code, ids).tobytes()
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def ids(self, text: str | None) -> bytes:
        """The ids of a text as little-endian bytes, the end id behind them. A null text is empty."""
        text = text or ""
        if not self.cut:
            return self._encode([text])[0] + self.end
        parts = text.split(" ") if _spaced(text) else [p if n == 0 else p[1:] for n, p in enumerate(_CUT.split(text))]
        first = self._encode([parts[0]])[0]
        del parts[0]
        found = b"".join([first, *map(self.known.__getitem__, parts), self.end])
        if self.held > self.keep:
            self.known, self.older, self.held = _Known(self._new), self.known, 0
        return found

    def _new(self, piece: str) -> bytes:
        """The ids of a piece behind a space that is not among the known ones."""
        self.held += len(piece) + _ENTRY
        found = self.older.get(piece)
        if found is None and self.plain:
            if piece.isalpha() and piece.isascii():  # most of them
                found = self._model(_SPACE + piece)
            else:
                found = self._piece(piece)
        return self._encode([" " + piece])[0] if found is None else found

    def _model(self, token: str) -> bytes:
        """The ids of one token of the pre-tokenizer, in the characters by which bytes are written."""
        found = self.tokenize(token)
        return self.singles[found[0].id] if len(found) == 1 else self._bytes([t.id for t in found])

    def _marks(self, marks: str) -> bytes:
        found = self.marks.get(marks)
        if found is None:
            if len(self.marks) > 10_000:
                self.marks.clear()
            found = self.marks[marks] = self._model(marks.translate(_BYTES))
        return found

    def _part(self, piece: str, space: str) -> bytes | None:
        """The ids of letters with ASCII marks behind them, after space or nothing; None if piece is something else."""
        word = piece.rstrip(_MARKS)
        if not word.isalpha():
            return None
        found = self.known.get(word) if space and len(word) < len(piece) else None
        if not found:
            if word.isascii():
                found = self._model(space + word)
            elif max(word) < _LATIN:
                found = self._model(space + word.encode().decode("latin-1").translate(_BYTES))
            else:
                return None
        return found if len(word) == len(piece) else found + self._marks(piece[len(word) :])

    def _piece(self, piece: str) -> bytes | None:
        """The ids of a piece behind a space, where lone line ends in it are tokens by themselves; None if it is something else."""
        if "\n" not in piece:
            return self._part(piece, _SPACE)
        found = [self._part(p, "" if n else _SPACE) for n, p in enumerate(piece.split("\n"))]
        return None if None in found else self._marks("\n").join(found)


class _Writer:
    def __init__(self, folder: str, name: str, width: int):
        self.fs, self.folder = filesystem(folder)
        self.name, self.width, self.keys, self.ends, self.nulls = name, width, [], [0], 0
        self.temp = f"{self.folder}/.{name}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(MAGIC)

    def add(self, key: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.ends.append(self.ends[-1] + len(ids) // self.width)
        if key is None:
            self.nulls += 1
        else:
            self.keys.append(key)

    def close(self) -> tuple[str, int, int]:
        bounds = encode(np.array(self.ends, np.uint64))
        keys = encode(np.array([k + _SHIFT for k in self.keys], np.uint64))
        at = len(MAGIC) + self.ends[-1] * self.width
        self.out.write(bounds + keys + _FOOT.pack(at, at + len(bounds), len(keys), self.nulls, self.width, MAGIC))
        self.out.close()
        final = f"{self.folder}/{self.name}"
        if self.fs.get_file_info(final).type == fs.FileType.NotFound:
            self.fs.move(self.temp, final)
        else:  # another attempt of the same task was first; its file is the same
            self.fs.delete_file(self.temp)
        return self.name, len(self.ends) - 1, self.ends[-1]


class TokenFile:
    """Reading a file: ids of the i-th document, or all documents in order."""

    def __init__(self, folder: str, name: str):
        system, base = filesystem(folder)
        self.file = system.open_input_file(f"{base}/{name}")
        size = self.file.size()
        at, keys_at, keys_len, self.nulls, self.width, magic = _FOOT.unpack(self.file.read_at(_FOOT.size, size - _FOOT.size))
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{name} is no token file")
        self.bounds = EliasFano(self.file.read_at(keys_at - at, at))
        self.keys = EliasFano(self.file.read_at(keys_len, keys_at))

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def key(self, i: int) -> int | None:
        return None if i < self.nulls else self.keys[i - self.nulls] - _SHIFT

    def _read(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.width, len(MAGIC) + start * self.width), f"<u{self.width}")

    def __getitem__(self, i: int) -> np.ndarray:
        return self._read(self.bounds[i], self.bounds[i + 1])

    def documents(self, step: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of each document in order, reading about step ids at a time."""
        bounds = self.bounds.all().astype(np.int64)
        keys = [*[None] * self.nulls, *(int(k) - _SHIFT for k in self.keys.all())]
        at = 0
        while at < len(self):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + step, "right")) - 1)
            ids = self._read(bounds[at], bounds[end])
            for i in range(at, end):
                yield keys[i], int(bounds[i]), ids[bounds[i] - bounds[at] : bounds[i + 1] - bounds[at]]
            at = end


def write_tokens(docs: DataFrame, tokenizer: str, file_bytes: int = 1 << 27, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write the ids of every text in ascending doc_id order; returns the folder and its manifest.

    Manifest: file, docs, ids and base (the ids of all files before it), one row a file. Rows without a doc_id come
    first; rows of one doc_id are in the order of their texts' hashes; repeated rows stay. A null or empty text has
    the end id alone. An empty table makes no file. doc_id is cast to long, and a text that is no whole number counts as
    none; other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    system, base = filesystem(folder)
    system.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, made, out = Encoder.of(tokenizer), TaskContext.get().partitionId(), [], None
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), map(encoder.ids, (t.as_py() for t in batch.column(1)))):
                out = out or _Writer(folder, f"part-{part:06d}-{len(made):06d}.tok", encoder.width)
                out.add(key, ids)
                if out.ends[-1] * encoder.width >= file_bytes:
                    made.append(out.close())
                    out = None
        if out:
            made.append(out.close())
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "docs", "ids"])

    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    manifest = written(rows.mapInArrow(tidy(run), "file string, docs long, ids long"), "manifest")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return folder, manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long")))


def read_tokens(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    count = manifest.count()
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for key, start, ids in TokenFile(folder, name).documents():
                    rows.append((key, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 20_000:
                        yield _batch(rows, fields)
                        rows = []
                if rows:
                    yield _batch(rows, fields)

    spread = manifest.select("file", "base").repartition(max(1, min(count, 4096)))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_tokens(spark, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to files and read back."""
    return read_tokens(*write_tokens(table(spark, sf_dir, "documents"), tokenizer_path()))

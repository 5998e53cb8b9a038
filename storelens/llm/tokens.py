"""Token ids of whole texts, and the flat files that hold them.

`encode_documents` turns texts into ids. `write_token_files` stores them in ascending
doc_id order as flat little-endian unsigned integers with 64-bit document offsets, one
set of files per partition; `read_documents` maps the files into memory again. Where a
partition's ids start in the whole corpus is a prefix sum over the partitions' totals.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm.common import Words, runs, slices, texts_of, worker_store

END_ID = 1
NO_ID = -(2**63)  # stands for a NULL doc_id in the id files
# Characters of a text that part rows of one doc_id among shards.
DEALT_BY = 64
# Distinct pieces a worker remembers before it starts anew; bounds memory, not results.
PIECES_KEPT = 100_000

# Words made of these characters alone are cut here exactly as the tokenizer cuts them
# (lower case, then letters, single digits or runs of signs); any other word goes through
# the tokenizer whole. The vocabulary file's own pattern.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-įı-ž]*")
CUT = re.compile(r"\n|'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ž]+|[0-9]|[^a-z0-9ß-öø-ž\n]+")

# How that vocabulary's rules show themselves.
RULES = (
    r'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])',
    r"""Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), """
    "behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])",
)


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for
    themselves, the others in turn for those from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {byte: chr(byte if byte in printable else next(others)) for byte in range(256)}


class Pieces(dict):
    """Numbers of the pieces seen so far; their ids lie in `ids` from `starts` on."""

    def __init__(self, ids_of: Callable[[str], list[int]]) -> None:
        super().__init__({"\n": 0})
        self.ids_of = ids_of
        self.ids, self.starts = array("I"), array("q", [0, 0])

    def numbers(self, pieces: list[str]) -> np.ndarray:
        for piece in dict.fromkeys(pieces):
            if piece not in self:
                self[piece] = len(self)
                self.ids.extend(self.ids_of(piece))
                self.starts.append(len(self.ids))
        return np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))


class Encoder:
    """Ids of texts by the vocabulary's own rules.

    No rule of the vocabulary in RULES looks across white space, so a text's ids are those of
    its words in turn; texts for any other vocabulary go through the library whole. Each distinct word of a batch is cut once, and each distinct piece
    goes through the tokenizers library once. With `plain_specials` the strings of special
    tokens are ordinary text; without, a word that holds one goes through the library whole.
    """

    def __init__(self, file: str, plain_specials: bool = True) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = plain_specials
        specials = [] if plain_specials else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.by_word = (str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer)) == RULES
        self.alphabet = byte_alphabet()
        self.pieces = Pieces(self._piece)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: str) -> list[int]:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.tokenizer.model.tokenize(piece)]

    def _ids_of_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where each word's ids start there and how many they are."""
        if len(self.pieces) > PIECES_KEPT:
            self.pieces = Pieces(self._piece)
        special = self.special if self.special and self.special.search("\n".join(words)) else None
        plain = [w if PLAIN.fullmatch(w) and not (special and special.search(w)) else "" for w in words]
        cut = CUT.findall("\n".join(plain).lower() + "\n") if len(words) else []
        numbers = self.pieces.numbers(cut)
        pool, starts = np.array(self.pieces.ids, np.uint32), np.array(self.pieces.starts)
        lengths = np.diff(starts)[numbers]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.flatnonzero(numbers == 0) + 1])]
        ids = pool[runs(starts[numbers], lengths)]
        first, counts = ends[:-1].copy(), np.diff(ends)
        others = [ids]
        at = len(ids)
        for number, word in enumerate(words):
            if not plain[number]:
                own = self._whole(word)
                others.append(np.array(own, np.uint32))
                first[number], counts[number] = at, len(own)
                at += len(own)
        return np.concatenate(others), first, counts

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, each with the end id, and their starts."""
        if self.by_word:
            words = Words(texts)
            pool, first, counts = self._ids_of_words(words.words)
            lengths = counts[words.codes]
            flat = pool[runs(first[words.codes], lengths)]
            starts = np.concatenate([[0], np.cumsum(lengths)])[words.starts]
        else:
            own = [np.array(self._whole(text), np.uint32) for text in texts.to_pylist()]
            flat = np.concatenate([np.zeros(0, np.uint32), *own])
            starts = np.concatenate([[0], np.cumsum([len(ids) for ids in own], dtype=np.int64)]).astype(np.int64)
        if end_id is None:
            return flat, starts
        return np.insert(flat, starts[1:], end_id), starts + np.arange(len(starts))


def encoder(file: str) -> Encoder:
    """With the library's default for special tokens: their strings are their ids."""
    return worker_store(f"encoder_{zlib.crc32(file.encode())}", lambda: Encoder(file, plain_specials=False))


def crc32_of(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


# ---- files ----------------------------------------------------------------------

SHARD = "shard int, ids_file string, offsets_file string, docs_file string, n_docs long, n_tokens long, width int"


def _file_system(folder: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system, path


class _ShardWriter:
    """The three files of one partition. Names hold a random part, so a task that is run
    twice never writes to another run's files; the returned row says which ones count."""

    def __init__(self, folder: str, shard: int, width: int) -> None:
        self.system, path = _file_system(folder)
        tag = f"{shard:06d}-{uuid.uuid4().hex[:12]}"
        self.names = [f"{path}/{kind}-{tag}.bin" for kind in ("ids", "offsets", "docs")]
        self.streams = [self.system.open_output_stream(n) for n in self.names]
        self.kind = f"<u{width}"
        self.width, self.shard, self.n_docs, self.n_tokens = width, shard, 0, 0
        self.streams[1].write(np.zeros(1, "<i8").tobytes())

    def add(self, ids: np.ndarray, starts: np.ndarray, doc_ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >= 1 << (8 * self.width):
            raise ValueError(f"id {int(ids.max())} needs more than {self.width} bytes")
        self.streams[0].write(ids.astype(self.kind).tobytes())
        self.streams[1].write((starts[1:] + self.n_tokens).astype("<i8").tobytes())
        self.streams[2].write(doc_ids.astype("<i8").tobytes())
        self.n_docs += len(doc_ids)
        self.n_tokens += len(ids)

    def close(self) -> tuple:
        for stream in self.streams:
            stream.close()
        return (self.shard, *self.names, self.n_docs, self.n_tokens, self.width)


def mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """A file's numbers: mapped into memory where it is local, else read."""
    from pyarrow import fs

    system, _ = fs.FileSystem.from_uri(folder)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(name, dtype=kind, mode="r") if os.path.getsize(name) else np.zeros(0, kind)
    with system.open_input_file(name) as f:
        return np.frombuffer(f.read(), dtype=kind)


def ids_of_column(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def shard_writing(folder: str, file: str, width: int, rows: Callable[[pa.RecordBatch, np.ndarray, int], pa.RecordBatch] | None = None):
    """A task that encodes its texts into one shard.

    It yields the shard's row, or, with `rows`, what that makes of each batch (its doc
    ids, the starts in the shard, the shard's ids file).
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        # Larger slices than elsewhere: the more text, the fewer distinct words in it.
        for batch in slices(batches, size=6_000_000):
            writer = writer or _ShardWriter(folder, TaskContext.get().partitionId(), width)
            before = writer.n_tokens
            ids, starts = encoder(file).encode(texts_of(batch))
            writer.add(ids, starts, ids_of_column(batch.column("doc_id")))
            if rows:
                yield rows(batch, starts + before, writer)
        if writer:
            row = writer.close()
            if not rows:
                names = [part.split()[0] for part in SHARD.split(", ")]
                kinds = [pa.int32(), *[pa.string()] * 3, pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    return write


def write_token_files(docs: DataFrame, folder: str, file: str | None = None, width: int = 2) -> list[dict]:
    """Encode all texts and write them in ascending doc_id order; returns the shards.

    Rows of equal doc_id are ordered by text and all kept; a NULL doc_id comes first, a
    NULL or empty text has the end id alone; an empty table makes no shard. Columns but
    doc_id and text are ignored. `width` is 2 or 4 bytes an id; one that does not fit
    fails the job. The driver gets one row per partition, from which it sums up where
    each partition's documents and ids start.
    """
    file = file or vocabulary_file()
    # Rows are dealt by the beginnings of texts, as a sample of the keys goes to the driver; within a
    # shard whole texts are ordered.
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id", F.left("text", F.lit(DEALT_BY)))
    ordered = dealt.sortWithinPartitions("doc_id", "text")
    shards = [r.asDict() for r in ordered.mapInArrow(shard_writing(folder, file, width), SHARD).collect()]
    base_docs = base_tokens = 0
    for shard in sorted(shards, key=lambda s: s["shard"]):
        shard |= {"base_docs": base_docs, "base_tokens": base_tokens}
        base_docs += shard["n_docs"]
        base_tokens += shard["n_tokens"]
    return sorted(shards, key=lambda s: s["shard"])


def read_documents(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """Per document, from the files: doc_id, start in the corpus, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    by_number = dict(enumerate(shards))
    numbers = spark.range(0, len(shards), 1, len(shards))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                shard = by_number[number]
                ids = mapped(folder, shard["ids_file"], f"<u{shard['width']}")
                offsets = mapped(folder, shard["offsets_file"], "<i8")
                docs = mapped(folder, shard["docs_file"], "<i8")
                for at in range(0, len(docs), 10_000):
                    part = slice(at, min(at + 10_000, len(docs)))
                    ends = offsets[part.start : part.stop + 1]
                    crcs = [crc32_of(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(docs[part], mask=docs[part] == NO_ID),
                        pa.array(ends[:-1] + shard["base_tokens"]),
                        pa.array(np.diff(ends)),
                        pa.array(crcs, pa.int64()),
                    ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return numbers.mapInArrow(read, schema)

"""Token-id files: one id array per file, its document boundaries Elias-Fano coded.

File layout, little-endian: a header (HEADER), the Elias-Fano code of the
documents' ends in the id array, that of their doc_ids (both monotone), and the
ids as 2- or 4-byte unsigned integers. Files are numbered in ascending doc_id
order. A file is written under a name of its attempt and then moved, so a task
that runs again only replaces a file by an equal one.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeframe.llm.common import checkpoint, remove, shared_dir, table

END_ID = 2
MAGIC = b"GFTOKEN1"
#: magic, bytes per id, null doc_ids, documents, ids, bytes of the two codes, smallest doc_id
HEADER = struct.Struct("<8sIIQQQQq")
#: Every SAMPLE-th set bit of the high part has its place recorded.
SAMPLE = 256
#: Words that a worker remembers the ids of.
REMEMBERED = 300_000
ASCII_SPACES = re.compile("[ \t-\r]+")
ODD_SPACES = "\x1c\x1d\x1e\x1f"  # white space to str.split(), not to the tokenizer


class EliasFano:
    """Non-decreasing integers from 0 in about 2 + log2(universe / n) bits each.

    The low bits of each value are packed; the high bits are a bit vector in
    which value i sets bit (value >> low) + i. select(i) finds the i-th set bit
    from the nearest recorded place.
    """

    HEAD = struct.Struct("<QQI")

    def __init__(self, n: int, high: np.ndarray, low: np.ndarray, bits: int, places: np.ndarray):
        self.n, self.high, self.low, self.bits, self.places = n, high, low, bits, places

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
        flags[places] = 1
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        return cls(n, np.packbits(flags, bitorder="little"), np.packbits(low.astype(np.uint8).ravel(), bitorder="little"), bits, places[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, len(self.high), self.bits) + self.high.tobytes() + self.low.tobytes() + self.places.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, n_high, bits = cls.HEAD.unpack_from(raw)
        at = cls.HEAD.size
        n_low = -(-n * bits // 8)
        high = np.frombuffer(raw, np.uint8, n_high, at)
        low = np.frombuffer(raw, np.uint8, n_low, at + n_high)
        return cls(n, high, low, bits, np.frombuffer(raw, "<u4", -(-n // SAMPLE), at + n_high + n_low))

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.bits:
            return np.zeros(last - first, dtype=np.uint64)
        begin, end = first * self.bits, last * self.bits
        flags = np.unpackbits(self.low[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :][: end - begin]
        return (flags.reshape(-1, self.bits).astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """Value i."""
        near = int(self.places[i // SAMPLE])
        end = int(self.places[i // SAMPLE + 1]) if i // SAMPLE + 1 < len(self.places) else 8 * len(self.high)
        flags = np.unpackbits(self.high[near // 8 : end // 8 + 1], bitorder="little")
        flags[: near % 8] = 0
        place = near // 8 * 8 + int(np.flatnonzero(flags)[i % SAMPLE])
        return ((place - i) << self.bits) | int(self._low(i, i + 1)[0])

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.bits)) | self._low(0, self.n)


@lru_cache(maxsize=2)
def _tokenizer(path: str, plain: bool = False):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    if plain:
        tokenizer.normalizer = normalizers.Sequence([])
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), to_bytes])
    return tokenizer


class WordEncoder:
    """Encodes texts word by word, each distinct word once while it is remembered.

    This tokenizer drops white space before it cuts words, and neither its
    normaliser nor its words reach across it, so the ids of a text are those of
    its words in a row. That holds for the word-level vocabularies this operator
    is for; other files are encoded by whole texts.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_word = "Removed" in str(self.tokenizer.pre_tokenizer) and r"\s" in str(self.tokenizer.normalizer)
        self.known: dict[str, bytes] = {}
        if self.by_word:
            cutter = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]
            self.pattern = regex.compile(cutter["pattern"]["Regex"])
            # the same model for what is normalised and cut already
            self.plain = _tokenizer(path, True)
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _ids(self, texts: list[str], tokenizer=None) -> list[bytes]:
        return [np.array(x.ids, dtype=self.kind).tobytes() for x in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str], pre_tokens: list[int], tokenizer=None) -> list[bytes]:
        """As _ids, for words of so many pre-tokens each: many at a time, cut at the ids that end a pre-token."""
        out: list[bytes] = []
        for at in range(0, len(words), 4000):
            some = words[at : at + 4000]
            ids = np.frombuffer(b"".join(self._ids([" ".join(some[i : i + 32]) for i in range(0, len(some), 32)], tokenizer)), self.kind)
            last, ends = np.cumsum(pre_tokens[at : at + 4000]), np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != last[-1] or not last.all() or ends[-1] != len(ids):
                out += self._ids(some)
                continue
            cuts = (ends[last - 1] * self.kind.itemsize).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]
        return out

    def _plain_ids(self, pre_tokens: list[str]) -> list[bytes]:
        return self._word_ids(pre_tokens, [1] * len(pre_tokens), self.plain)

    def _other_ids(self, words: list[str]) -> list[bytes]:
        """Ids of any words, by their pre-tokens; those that may hold a special token are encoded as they are."""
        out, known = {}, self.known
        special = [w for w in words if "<" in w]
        out.update(zip(special, self._ids(special)))
        # of ASCII the normaliser only changes the case
        cut = {w: self.pattern.findall(w.lower() if w.isascii() else self.tokenizer.normalizer.normalize_str(w)) for w in words if "<" not in w}
        new = list(set().union(*cut.values()).difference(known))
        known.update(zip(new, self._plain_ids(new)))
        out.update((w, b"".join([known[p] for p in parts])) for w, parts in cut.items())
        return [out[w] for w in words]

    @staticmethod
    def _pre_tokens(text: str) -> list[str] | None:
        """The pre-tokens of a plain text: letters, white space, and full stops and commas that follow letters; None for others."""
        low = text.lower()
        if not low.isascii() and ("\u03a3" in text or not is_normalized("NFC", low)):
            return None  # what the tokenizer makes of these letters depends on their neighbours
        if ".." in low or ",," in low or ".," in low or ",." in low:
            return None
        if low.isascii():
            bare = low.encode().translate(None, b" .,\n")
        else:
            bare = low.replace(" ", "").replace(".", "").replace(",", "").replace("\n", "")
        return low.replace(".", " . ").replace(",", " , ").split() if bare.isalpha() else None

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._ids(texts)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        plain, other = [], []
        for i, t in enumerate(texts):
            if (parts := self._pre_tokens(t)) is not None:
                plain.append((i, parts))
            else:
                other.append((i, ASCII_SPACES.split(t) if any(c in t for c in ODD_SPACES) else t.split()))
        out = [b""] * len(texts)
        for kind, encode in ((plain, self._plain_ids), (other, self._other_ids)):
            new = list(set().union(*(parts for _, parts in kind)).difference(self.known))
            self.known.update(zip(new, encode(new)))
            of = self.known.__getitem__
            for i, parts in kind:
                out[i] = b"".join(map(of, parts))
        return out


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """A worker's encoder, which it keeps from task to task."""
    return WordEncoder(path)


def pack_file(doc_ids: list[int | None], ends: np.ndarray, ids: bytes, width: int) -> bytes:
    nulls = sum(d is None for d in doc_ids)  # they come first
    real = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    least = int(real[0]) if len(real) else 0
    bounds = EliasFano.encode(ends).to_bytes()
    names = EliasFano.encode((real - least).view(np.uint64)).to_bytes()
    return HEADER.pack(MAGIC, width, nulls, len(doc_ids), len(ids) // width, len(bounds), len(names), least) + bounds + names + ids


def unpack_file(raw: bytes) -> tuple[list[int | None], EliasFano, np.ndarray]:
    magic, width, nulls, _, n_ids, n_bounds, n_names, least = HEADER.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEADER.size
    bounds = EliasFano.from_bytes(raw[at : at + n_bounds])
    names = EliasFano.from_bytes(raw[at + n_bounds : at + n_bounds + n_names])
    ids = np.frombuffer(raw, f"<u{width}", n_ids, at + n_bounds + n_names)
    return [None] * nulls + (names.all().view(np.int64) + least).tolist(), bounds, ids


#: Ids of a file, about: a task begins another file when it has as many, so its memory doesn't grow with the table.
FILE_IDS = 1 << 25


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes docs as token files under path (a URI); returns the manifest: part, nth, file, n_docs, n_ids.

    Ascending doc_id, null first; rows of one id follow a hash of their text.
    Null texts count as empty: they have the end id only. An empty table writes
    no file. Other columns are ignored. Each of the session's shuffle partitions
    makes files of about FILE_IDS ids, one after the other; a document is whole in
    one file. A task that runs again writes the same files anew.
    """
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(*by).sortWithinPartitions(*by)
    schema = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        width = encoder.kind.itemsize
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        task = TaskContext.get()
        doc_ids: list[int | None] = []
        parts: list[bytes] = []
        size, nth = 0, 0

        def flush() -> pa.RecordBatch:
            raw = pack_file(doc_ids, np.cumsum([len(x) // width for x in parts]), b"".join(parts), width)
            fs, folder = pafs.FileSystem.from_uri(path)
            fs.create_dir(folder, recursive=True)
            name = f"{folder}/part-{task.partitionId():06d}-{nth:04d}.tok"
            with fs.open_output_stream(own := f"{name}.{task.taskAttemptId()}") as out:
                out.write(raw)
            fs.move(own, name)
            row = {"part": task.partitionId(), "nth": nth, "file": os.path.basename(name), "n_docs": len(doc_ids), "n_ids": size // width}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist())):
                    doc_ids.append(doc_id)
                    parts.append(ids + end)
                    size += len(parts[-1])
                    if size >= FILE_IDS * width:
                        yield flush()
                        doc_ids, parts, size, nth = [], [], 0, nth + 1
        if parts:
            yield flush()

    return checkpoint(ordered.mapInArrow(write, "part int, nth int, file string, n_docs long, n_ids long"))


def read_tokens(manifest: DataFrame, path: str) -> DataFrame:
    """A row per document of the files: doc_id, start, n_tokens, ids_crc32, file.

    The files' starts are a running sum over the manifest, which has a row per
    file; each file is read by one task.
    """
    earlier = W.orderBy("part", "nth").rowsBetween(W.unboundedPreceding, -1)
    placed = manifest.select("part", "nth", "file", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(f"{folder}/{row['file']}") as f:
                    doc_ids, bounds, ids = unpack_file(f.read())
                ends = bounds.all().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts + row["before"]), pa.array(ends - starts), pa.array(crcs, pa.int64()), pa.array([row["file"]] * len(crcs), pa.string())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "file"],
                )

    return placed.repartition("part", "nth").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_tokens(table(spark, sf_dir, "documents"), path, tokenizer or default_tokenizer())
    out = checkpoint(read_tokens(manifest, path).drop("file"))
    remove(path)
    return out


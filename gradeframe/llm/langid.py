"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds those of
its letters, the first rotated by two places and the second by one. A document
bundles (adds) the vectors of its trigrams; a language's prototype bundles those
of its documents. A document gets the language of the nearest prototype by
cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.llm.common import id_text, table

DIM = 512
#: Letters share SLOTS - 1 places (the alphabet's in turn, others by code point); place 0 is whatever isn't a letter.
SLOTS = 64
SEED = 11
#: Rows learnt from, about: a row is drawn if a digest of its id falls under this part of all.
TRAIN_ROWS = 4000
#: Sharpness of the score, a softmax over cosines.
SHARP = 25.0
#: Characters handled at a time.
CHUNK = 1 << 20
#: Cells of a table of texts and trigrams.
TABLE = 1 << 22
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_slots() -> np.ndarray:
    """Place of each code point."""
    letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return np.where(letters, 1 + np.arange(0x110000) % (SLOTS - 1), 0).astype(np.uint8)


@lru_cache(maxsize=1)
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.int8), (SLOTS, DIM))


@lru_cache(maxsize=1)
def rotated() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = letter_vectors()
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


def trigram_vectors(ids: np.ndarray) -> np.ndarray:
    first, second, third = rotated()
    return first[ids // (SLOTS * SLOTS)] * second[ids // SLOTS % SLOTS] * third[ids % SLOTS]


def bundle(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' vectors (rows) and whether each has a letter."""
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = letter_slots()[points].astype(np.int32)
    middle = np.flatnonzero(codes[1:-1]) + 1  # trigrams round a letter
    ids = (codes[middle - 1] * SLOTS + codes[middle]) * SLOTS + codes[middle + 1]
    doc = np.repeat(np.arange(len(texts)), lengths)[middle - 1]
    used = np.flatnonzero(np.bincount(ids, minlength=SLOTS**3))
    place = np.zeros(SLOTS**3, dtype=np.int64)
    place[used] = np.arange(len(used))
    known = trigram_vectors(used).astype(np.float32)
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    step = max(1, TABLE // max(1, len(used)))
    for at in range(0, len(texts), step):  # texts in many scripts have many trigrams: fewer texts at a time
        n = min(step, len(texts) - at)
        own = slice(*np.searchsorted(doc, [at, at + n]))
        counts = np.bincount((doc[own] - at) * len(used) + place[ids[own]], minlength=n * len(used)).reshape(n, len(used))
        out[at : at + n] = counts.astype(np.float32) @ known
    return out, np.bincount(doc, minlength=len(texts)) > 0


def stretches(text: str) -> Iterator[str]:
    """A text in parts of about CHUNK characters, cut at spaces, which no trigram round a letter tells from an end; a longer word stays whole."""
    at = 0
    while len(text) - at > CHUNK:
        cut = text.rfind(" ", at + 1, at + CHUNK)
        cut = cut if cut > 0 else text.find(" ", at + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def long_bundle(text: str) -> tuple[np.ndarray, np.ndarray]:
    """bundle() of one text, part by part."""
    total, has = np.zeros((1, DIM)), np.zeros(1, dtype=bool)
    for part in stretches(text):
        v, letters = bundle([part])
        total += v
        has |= letters
    return total.astype(np.float32), has


def vectors(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, vectors, has a letter) for runs of texts of bounded size; a longer text is a run of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and (size + len(t) > CHUNK or i - first >= 512):
            yield first, *bundle(texts[first:i])
            first, size = i, 0
        if len(t) > CHUNK:
            yield i, *long_bundle(t)
            first, size = i + 1, 0
        else:
            size += len(t)
    if first < len(texts):
        yield first, *bundle(texts[first:])


def normalised(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _lowered(column: pa.Array) -> list[str]:
    return [(t or "").lower() for t in column.to_pylist()]


def learn(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their prototypes, from a sample of about `rows` labelled documents of docs (doc_id, text, lang).

    Rows with a null text or language teach nothing, texts without letters add
    nothing, rows of one id are drawn or left out together and count each. An empty
    table, or one without labelled rows, gives no languages.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    part = min(1.0, rows / max(1, known.count()))
    drawn = F.conv(F.substring(F.md5(id_text()), 1, 8), 16, 10).cast("long") < int(part * (1 << 32))
    sample = known.filter(drawn).select("text", "lang").repartition(8)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for first, v, has in vectors(_lowered(batch.column(0))):
                v = normalised(v)
                for lang in set(own := langs[first : first + len(v)]):
                    sums[lang] = sums.get(lang, 0) + v[has & (own == lang)].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": [x.astype(np.float64).tolist() for x in sums.values()]})

    sums: dict[str, np.ndarray] = {}
    for lang, v in sorted(sample.mapInArrow(profile, "lang string, v array<double>").collect()):  # 8 rows a language at most
        sums[lang] = sums.get(lang, 0) + np.array(v)
    langs = sorted(sums)
    return langs, normalised(np.array([sums[x] for x in langs])).astype(np.float32) if langs else np.zeros((0, DIM), np.float32)


def _predicted(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """docs, its columns named c0, c1, ..., with lang_pred, lang_score (0 to 1) and lang_cosine.

    Texts that are null or have no letter are UNKNOWN with score and cosine 0,
    and so is everything if no language was learnt. Other columns, ids and
    repeated rows pass through.
    """
    at = docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            cosines: list[float] = []
            for _, v, has in vectors(_lowered(batch.column(at))):
                if not langs:
                    has = np.zeros_like(has)
                cos = normalised(v) @ prototypes.T if langs else np.zeros((len(v), 1), np.float32)
                odds = np.exp(SHARP * (cos - cos.max(axis=1, keepdims=True)))
                best = cos.argmax(axis=1)
                names += [langs[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())]
                scores += np.where(has, 1 / odds.sum(axis=1), 0.0).tolist()
                cosines += np.where(has, cos.max(axis=1), 0.0).tolist()
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(cosines, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f"c{i}" for i in range(len(batch.columns))), "lang_pred", "lang_score", "lang_cosine"])

    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(predict, f"{kinds}, lang_pred string, lang_score double, lang_cosine double")


def identify(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """docs with lang_pred, lang_score and lang_cosine, in place of columns of these names; see _predicted()."""
    docs = docs.drop("lang_pred", "lang_score", "lang_cosine")
    return _predicted(docs, langs, prototypes).toDF(*docs.columns, "lang_pred", "lang_score", "lang_cosine")


#: Documents nearer to no prototype than this are rejected by known_language().
LEAST_COSINE = 0.05


def known_language(docs: DataFrame) -> DataFrame:
    """The documents in a language that docs' labels teach, with their columns; texts without letters and those like none go.

    Null texts have no letters and go too. Null languages teach nothing; without
    any labelled row nothing is known and all rows go. Null ids and repeated rows
    are rows like any others; an empty table gives an empty result.
    """
    langs, prototypes = learn(docs)
    kept = _predicted(docs, langs, prototypes).filter((F.col("lang_pred") != UNKNOWN) & (F.col("lang_cosine") >= LEAST_COSINE))
    return kept.drop("lang_pred", "lang_score", "lang_cosine").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(id_text()) % 4 == 2
    langs, prototypes = learn(docs.filter(~held_out))
    found = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), langs, prototypes)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))

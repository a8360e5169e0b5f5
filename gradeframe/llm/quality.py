"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, beside a channel that marks bytes within a repetition of what
is just before them; learned filters look at overlapping chunks of WIDTH bytes
that begin every WIDTH / 2 bytes and so cover the whole document; each filter's
largest answer over the document enters a logistic unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.llm.common import id_text, id_type, table

WIDTH, STEP = 8, 4
EMBED, FILTERS = 8, 32
#: A byte is in a repetition if RUN bytes in a row equal those `distance` before them.
DISTANCES, RUN = range(2, 25), 16
#: Labelled rows learnt from, about.
TRAIN_ROWS = 4000
EPOCHS, BATCH, RATE = 16, 32, 0.01
#: Bytes handled at a time, and bytes on either side that a chunk's answers depend on.
BLOCK = 1 << 19
MARGIN = 32


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts at multiples of STEP, each followed by STEP zeros at least; and their first chunks."""
    sizes = np.fromiter((len(t) // STEP + 2 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return np.frombuffer(b"".join(t.ljust(s * STEP, b"\0") for t, s in zip(texts, sizes.tolist())) + bytes(STEP), dtype=np.uint8), starts[:-1]


def repeated(flat: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flat), dtype=bool)
    for d in DISTANCES:
        if len(flat) < d + RUN:
            break
        same = flat[d:] == flat[:-d]
        for by in (1, 2, 4, 8):  # now of runs of 2, 4, 8 and 16
            same = same[by:] & same[:-by]
        out[d : d + len(same)] |= same
    out &= flat != 0
    return out


class ByteConvNet:
    def __init__(self, embed: np.ndarray, filters: np.ndarray, bias: np.ndarray, out: np.ndarray, out_bias: np.ndarray):
        self.params = [embed, filters, bias, out, out_bias]

    @classmethod
    def fresh(cls, seed: int = 5) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        f32 = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        return cls(f32(256, EMBED, by=0.5), f32(WIDTH * (EMBED + 1), FILTERS, by=0.15), np.zeros(FILTERS, np.float32), f32(FILTERS, by=0.1), np.zeros(1, np.float32))

    def inputs(self, flat: np.ndarray) -> np.ndarray:
        out = np.empty((len(flat), EMBED + 1), dtype=np.float32)
        out[:, :EMBED] = self.params[0][flat]
        out[:, EMBED] = repeated(flat)
        return out

    def answers(self, x: np.ndarray) -> np.ndarray:
        """Filter answers of each chunk: the halves of a chunk are multiplied apart, so each byte is only once."""
        _, filters, bias, _, _ = self.params
        half = x.reshape(-1, STEP * (EMBED + 1))
        both = half @ np.concatenate([filters[: len(filters) // 2], filters[len(filters) // 2 :]], axis=1)
        out = both[:-1, :FILTERS] + both[1:, FILTERS:]
        out += bias
        return out

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        flat, starts = lay_out(texts)
        z = self.answers(self.inputs(flat))
        z[np.append(starts[1:], len(z)) - 1] = -np.inf  # these chunks reach into the next text
        return np.maximum(np.maximum.reduceat(z, starts, axis=0), 0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        _, _, _, out, out_bias = self.params
        return 1 / (1 + np.exp(-(self.pooled(texts) @ out + out_bias).astype(np.float64)))

    def long_score(self, text: bytes) -> float:
        """The score of one text of any length, BLOCK bytes at a time: windows overlap by what a chunk depends on."""
        best = np.full(FILTERS, -np.inf, dtype=np.float32)
        for a in range(0, len(text) + 1, BLOCK):
            left = min(a, MARGIN)
            z = self.answers(self.inputs(lay_out([text[a - left : a + BLOCK + MARGIN]])[0]))
            chunks = min(BLOCK // STEP, len(text) // STEP + 1 - a // STEP)  # those that begin in this window
            if chunks > 0:
                best = np.maximum(best, z[left // STEP : left // STEP + chunks].max(axis=0))
        _, _, _, out, out_bias = self.params
        return float(1 / (1 + np.exp(-(np.maximum(best, 0) @ out + out_bias).astype(np.float64)))[0])

    def score_all(self, texts: list[bytes]) -> np.ndarray:
        """As scores(), in blocks of bounded size; a longer text goes in windows."""
        parts, own, size = [], [], 0
        for t in texts:
            if own and size + len(t) > BLOCK:
                parts.append(self.scores(own))
                own, size = [], 0
            if len(t) > BLOCK:
                parts.append(np.array([self.long_score(t)]))
            else:
                own.append(t)
                size += len(t)
        if own:
            parts.append(self.scores(own))
        return np.concatenate(parts) if parts else np.zeros(0)

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
        embed, filters, _, out, out_bias = self.params
        flat, starts = lay_out(texts)
        inputs = self.inputs(flat)
        z = self.answers(inputs)
        ends = np.append(starts[1:], len(z))
        best = np.array([z[a : b - 1].argmax(axis=0) + a for a, b in zip(starts, ends)])  # documents x filters
        top = np.take_along_axis(z, best, axis=0)
        h = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-(h @ out + out_bias)))
        d = ((p - labels) / len(labels)).astype(np.float32)
        dh = np.where(top > 0, d[:, None] * out, 0)
        at = best[..., None] * STEP + np.arange(WIDTH)  # documents x filters x WIDTH
        x = inputs[at].reshape(*best.shape, -1)
        d_filters = np.einsum("nfk,nf->kf", x, dh)
        d_x = dh[..., None] * filters.T[None]
        d_embed = np.zeros_like(embed)
        np.add.at(d_embed, flat[at].ravel(), d_x.reshape(-1, EMBED + 1)[:, :EMBED])
        d_embed[0] = 0  # padding
        return [d_embed, d_filters, dh.sum(axis=0), h.T @ d, d.sum(keepdims=True)]

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> None:
        """Adam on the log loss."""
        self.params[0][0] = 0
        rng = np.random.default_rng(seed)
        m = [np.zeros_like(p) for p in self.params]
        v = [np.zeros_like(p) for p in self.params]
        steps, total = 0, epochs * -(-len(texts) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(texts), BATCH):
                own = order[at : at + BATCH]
                steps += 1
                rate = RATE * (1 - 0.9 * steps / total)
                for p, g, a, b in zip(self.params, self.gradients([texts[i] for i in own], labels[own]), m, v):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**steps)) / (np.sqrt(b / (1 - 0.99**steps)) + 1e-6)


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ByteConvNet:
    """A network trained on about `rows` of the labelled documents, drawn by a digest of their ids; untrained if there is none.

    Labels without an id or a quality are left out, and of several for one id one
    is taken. Documents of one id count each; null texts count as empty. An empty
    table leaves the network untrained.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    part = min(1.0, rows / max(1, known.count()))
    drawn = known.filter(F.conv(F.substring(F.md5(id_text()), 1, 8), 16, 10).cast("long") < int(part * (1 << 32)))
    net = ByteConvNet.fresh()
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn.dropDuplicates(["doc_id"])), "doc_id")  # about `rows` at most
    got = sorted((d, t or "", q) for d, q, t in sample.select("doc_id", "quality", "text").collect())
    if got:
        net.train([t.encode() for _, t, _ in got], np.array([q for _, _, q in got], dtype=np.float32))
    return net


def score(docs: DataFrame, net: ByteConvNet) -> DataFrame:
    """docs (doc_id, held_out, text) with score instead of text. Null texts count as empty; empty ones have the score of no bytes."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(net.score_all(texts), pa.float64())], names=["doc_id", "held_out", "score"])

    return docs.select("doc_id", "held_out", F.col("text").cast("binary")).mapInArrow(predict, f"doc_id {id_type(docs)}, held_out boolean, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.crc32(id_text()) % 3 == 1
    net = learn(docs, table(spark, sf_dir, "labels").filter(~held_out))
    scored = score(docs.withColumn("held_out", held_out), net)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

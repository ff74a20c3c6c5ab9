"""Quality by a byte-level convolutional network in numpy.

Filters of WIDTH bytes, at every second byte, are sums of learned values by place and byte. Their outputs are
max-pooled over overlapping chunks (two neighbouring halves of HALF bytes each) that cover the whole text,
rectified, and combined: mean and maximum over the chunks, with the text's length, enter one logistic unit.
Training follows the maxima back to the bytes that caused them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.labelled import held_out, training_sample
from loomgraph.llm.words import slices
from loomgraph.llm.worker import tidy

WIDTH, STRIDE, HALF, FILTERS = 6, 2, 256, 20
OUTPUTS = HALF // STRIDE
#: Labelled documents and passes over them.
MOST_LABELLED, EPOCHS, BATCH = 2000, 10, 32


def laid_out(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts padded with zeros to whole halves, at least WIDTH bytes each: bytes, first half of each text,
    and how many outputs of each half begin inside its text (one at least in a text's first half)."""
    size = np.diff(off)
    halves = (size + WIDTH + HALF - 1) // HALF
    first = np.concatenate([[0], np.cumsum(halves)])
    out = np.zeros(first[-1] * HALF + WIDTH, np.uint8)
    out[np.arange(len(buf)) + np.repeat(first[:-1] * HALF - off[:-1], size)] = buf
    of = np.repeat(np.arange(len(size)), halves)
    left = size[of] - (np.arange(first[-1]) - first[of]) * HALF
    valid = np.clip((left + STRIDE - 1) // STRIDE, 0, OUTPUTS)
    valid[first[:-1]] = np.maximum(valid[first[:-1]], 1)
    return out, first, valid


#: A text of more bytes is walked in runs of so many halves.
LONG, RUN = 1 << 20, 1 << 11


class ByteConvolution:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.4, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.dense = rng.normal(0, 0.1, 2 * FILTERS + 1).astype(np.float32)
        self.constant = np.zeros(1, np.float32)

    def outputs(self, data: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """halves x OUTPUTS x FILTERS."""
        n = len(valid) * OUTPUTS
        acc = np.take(self.table[0], data[0 : n * STRIDE : STRIDE], axis=0)
        for k in range(1, WIDTH):
            acc += np.take(self.table[k], data[k : k + n * STRIDE : STRIDE][:n], axis=0)
        acc = acc.reshape(len(valid), OUTPUTS, FILTERS)
        for i in np.flatnonzero(valid < OUTPUTS):
            acc[i, valid[i] :] = -1e9
        return acc

    def pooled(self, data: np.ndarray, first: np.ndarray, valid: np.ndarray) -> dict:
        acc = self.outputs(data, valid)
        half = acc.max(1) + self.bias
        # a half joins the next one of its text, unless that has no outputs
        last = np.zeros(len(half), bool)
        last[first[1:] - 1] = True
        empty = valid == 0
        nxt = np.minimum(np.arange(len(half)) + 1, len(half) - 1)
        joins = ~last & ~empty[nxt]
        other = np.where(joins[:, None], half[nxt], -1e9)
        chunk = np.maximum(np.maximum(half, other), 0)
        used = ~empty & (joins | (np.arange(len(half)) == np.repeat(first[:-1], np.diff(first))))
        weight = used / np.maximum(np.add.reduceat(used.astype(np.float64), first[:-1]), 1)[np.repeat(np.arange(len(first) - 1), np.diff(first))]
        mean = np.add.reduceat(chunk * weight[:, None], first[:-1])
        top = np.maximum.reduceat(chunk * used[:, None], first[:-1])
        return {"acc": acc, "half": half, "other": other, "chunk": chunk, "used": used, "weight": weight, "mean": mean, "top": top, "next": nxt}

    def logits(self, p: dict, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.concatenate([p["mean"], p["top"], np.log1p(size)[:, None] / 8], 1).astype(np.float32)
        # row by row, so that a text's score doesn't depend on its neighbours
        return (x * self.dense).sum(1) + self.constant, x

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        z, _ = self.logits(self.pooled(*laid_out(buf, off)), np.diff(off))
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def score_of_long(self, buf: np.ndarray, run: int = 0) -> float:
        """The score of one text, walked in runs of halves with a running sum and maximum, so that memory doesn't grow with it."""
        run = run or RUN
        n = (len(buf) + WIDTH + HALF - 1) // HALF
        valid = np.clip((len(buf) - np.arange(n) * HALF + STRIDE - 1) // STRIDE, 0, OUTPUTS)
        valid[0] = max(valid[0], 1)
        total, top, used = np.zeros(FILTERS), np.zeros(FILTERS, np.float32), 0
        for a in range(0, n, run):
            b = min(a + run + 1, n)  # the half behind belongs to the last chunk
            data, part = np.zeros((b - a) * HALF + WIDTH, np.uint8), buf[a * HALF : b * HALF + WIDTH]
            data[: len(part)] = part
            half = self.outputs(data, valid[a:b]).max(1) + self.bias
            here = np.arange(a, min(a + run, n))
            joins = (here + 1 < n) & (valid[np.minimum(here + 1, n - 1)] > 0)
            other = np.where(joins[:, None], half[np.minimum(here + 1, b - 1) - a], -1e9)
            chunk = np.maximum(np.maximum(half[: len(here)], other), 0)[(valid[here] > 0) & (joins | (here == 0))]
            if len(chunk):
                total, top, used = total + chunk.sum(0), np.maximum(top, chunk.max(0)), used + len(chunk)
        z, _ = self.logits({"mean": total[None] / max(used, 1), "top": top[None]}, np.array([len(buf)]))
        return float(1 / (1 + np.exp(-z.astype(np.float64)))[0])

    def gradients(self, buf: np.ndarray, off: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        data, first, valid = laid_out(buf, off)
        p = self.pooled(data, first, valid)
        z, x = self.logits(p, np.diff(off))
        err = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
        of = np.repeat(np.arange(len(y)), np.diff(first))
        d_mean, d_top = err[:, None] * self.dense[:FILTERS], err[:, None] * self.dense[FILTERS : 2 * FILTERS]
        is_top = (p["chunk"] == p["top"][of]) & p["used"][:, None]
        seen = np.cumsum(is_top, 0)
        before = np.where(first[:-1, None] > 0, seen[np.maximum(first[:-1] - 1, 0)], 0)
        d_chunk = d_mean[of] * p["weight"][:, None] + d_top[of] * (is_top & (seen - before[of] == 1))
        d_chunk = d_chunk * (p["chunk"] > 0)
        from_next = p["other"] > p["half"]
        d_half = np.where(from_next, 0, d_chunk)
        np.add.at(d_half, p["next"], np.where(from_next, d_chunk, 0))
        half, filt = np.nonzero(d_half)
        g = d_half[half, filt]
        place = (half * OUTPUTS + p["acc"].argmax(1)[half, filt]) * STRIDE
        table = np.zeros((WIDTH, 256 * FILTERS))
        for k in range(WIDTH):
            table[k] = np.bincount(data[place + k].astype(np.int64) * FILTERS + filt, g, 256 * FILTERS)
        return [table.reshape(self.table.shape), d_half.sum(0), x.T @ err, np.array([err.sum()])]

    def train(self, texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> ByteConvolution:
        """Adam over shuffled small batches, classes weighing the same in each."""
        if not len(y):
            return self
        raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
        rng = np.random.default_rng(seed)
        params = [self.table, self.bias, self.dense, self.constant]
        m, v = ([np.zeros(p.shape) for p in params] for _ in range(2))
        step, steps = 0, epochs * -(-len(y) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), BATCH):
                pick = order[at : at + BATCH]
                buf = np.concatenate([raw[i] for i in pick]) if len(pick) else np.zeros(0, np.uint8)
                off = np.concatenate([[0], np.cumsum([len(raw[i]) for i in pick])]).astype(np.int64)
                step += 1
                rate = 0.02 * (1 - step / (steps + 1))
                for p, g, a, b in zip(params, self.gradients(buf, off, y[pick]), m, v, strict=True):
                    g = g + 1e-4 * p
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> ByteConvolution:
    texts, y, _ = training_sample(docs, labels, "quality", most=most)
    return ByteConvolution().train(texts, y)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """All columns of docs but those it adds, with held_out, score (0 to 1) and predicted (score >= threshold).

    Learns from at most MOST_LABELLED labelled rows that aren't held out; without any, the network stays as it was
    drawn. Null and empty texts are scored as texts of no bytes. Repeated rows and null ids are rows like any others.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = docs.drop("held_out", "score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double"

    def run(batches):
        for b in batches:
            score = np.zeros(b.num_rows)
            for row, to, buf, off in slices(b.column("text"), 1 << 18):
                score[row:to] = model.value.score_of_long(buf) if len(buf) > LONG else model.value.scores(buf, off)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, "score"])

    scored = rows.mapInArrow(tidy(run), schema)
    return scored.select("*", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), (F.col("score") >= threshold).cast("int").alias("predicted"))

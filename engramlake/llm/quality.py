"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's length.

A text's features are its words (hashed; square roots of counts, of length one together) and its statistics, each in
bins (one feature a bin): shares of punctuation, capitals, digits and repeated words, word lengths, line lengths and
so on, and its length as metadata. The machine adds a bias, linear weights and low-rank pairwise interactions,
1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), so a text is scored in time linear in its words.

It is fitted on labelled rows with crc32(doc_id) mod 5 other than 0, TRAIN_ROWS of them at most (the first by a hash
of the id), by logistic loss on the driver, from features that the executors make. Labels, lang, source and doc_id are
no inputs of a score. The same rows give the same model.

Null and empty texts get the score of a text without words. A null doc_id counts as the empty text for the remainder.
Labels that are null don't count; of several labels of a document the lowest does. Without any labels all texts score
0.5. Repeated rows get equal scores. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

TRAIN_ROWS = 6_000
WORD_BITS, BINS, RANK, BATCH, RATE, DECAY = 14, 12, 8, 256, 0.1, 1e-5
#: Passes over the rows, and more of them where that makes fewer batches than STEPS; how much a bad text weighs.
EPOCHS, STEPS, BAD = 5, 240, 2.0
THRESHOLD = 0.3
STATISTICS = 14
WIDTH = (1 << WORD_BITS) + STATISTICS * BINS


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


# --- features ----------------------------------------------------------------------------------------------------


def statistics(text: str, words: list[bytes], distinct: int, commonest: int) -> list[float]:
    """STATISTICS numbers from 0 to 1."""
    n, w = max(1, len(text)), max(1, len(words))
    data = text.encode()
    punctuation = len(data) - len(data.translate(None, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    stops = data.count(b".") + data.count(b",")
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(data) - len(data.translate(None, b"0123456789"))
    lines = text.split("\n")
    log = lambda x, top: min(1.0, x.bit_length() / top)
    return [
        log(len(text), 20),
        log(len(words), 17),
        (punctuation - stops) / n * 4,
        stops / n * 8,
        upper / n * 1.2,
        digits / n * 4,
        1 - distinct / w,
        commonest / w,
        min(1.0, sum(map(len, words)) / w / 16),
        sum(a == b for a, b in zip(words, words[1:])) / w,
        1 - len(set(lines)) / len(lines),
        log(n // len(lines), 16),
        sum(not x.isalnum() and len(x.strip(b".,;:!?")) < len(x) - 1 for x in words) / w,
        sum(x in (b"|", b"-", b"*") for x in words) / w * 4,
    ]


def features(text: str | None):
    """(places, values): distinct hashed words, then one bin for each statistic."""
    import numpy as np

    text = text or ""
    words = text.encode().lower().split()
    crc = zlib.crc32
    places, counts = np.unique(np.array([crc(w) for w in words], np.uint32) & ((1 << WORD_BITS) - 1), return_counts=True)
    values = np.sqrt(counts / max(1, len(words)))
    stats = statistics(text, words, len(places), int(counts.max()) if len(counts) else 0)
    bins = [(1 << WORD_BITS) + k * BINS + min(BINS - 1, max(0, int(x * BINS))) for k, x in enumerate(stats)]
    return np.concatenate([places.astype(np.int32), np.array(bins, np.int32)]), np.concatenate([values.astype(np.float32), np.full(len(bins), 0.5, np.float32)])


def _made(batches: Iterable) -> Iterator:
    """mapInArrow: (text, label) to (places, values, label)."""
    import pyarrow as pa

    for batch in batches:
        for low in range(0, batch.num_rows, 500):
            part = batch.slice(low, 500)
            rows = [features(t) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"places": pa.array([p.tobytes() for p, _ in rows], pa.binary()), "values": pa.array([v.tobytes() for _, v in rows], pa.binary()), "label": part.column(1)})


# --- the machine -------------------------------------------------------------------------------------------------


class FactorisationMachine:
    def __init__(self, seed: int = 7):
        import numpy as np

        self.bias = 0.0
        self.linear = np.zeros(WIDTH, np.float32)
        self.factors = np.random.default_rng(seed).normal(0, 0.05, (WIDTH, RANK)).astype(np.float32)

    def margins(self, places, values, starts):
        """Of texts whose features stand one after the other, each from its start (every text has some)."""
        import numpy as np

        v = self.factors[places] * values[:, None]
        sums = np.add.reduceat(v, starts, axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", v, v), starts)
        return self.bias + np.add.reduceat(self.linear[places] * values, starts) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def scores(self, rows: list):
        import numpy as np

        sizes = np.array([len(p) for p, _ in rows])
        m, _ = self.margins(np.concatenate([p for p, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum(sizes) - sizes)
        return 1 / (1 + np.exp(-np.clip(m.astype(np.float64), -30, 30)))

    def fit(self, rows: list, labels, seed: int = 11) -> FactorisationMachine:
        """By AdaGrad on the logistic loss, in shuffled batches."""
        import numpy as np

        rng, labels = np.random.default_rng(seed), np.asarray(labels, np.float32)
        good, bad = float((labels > 0).sum()) + 1, BAD * float((labels <= 0).sum()) + 1
        self.bias = float(np.log(good / bad))
        past_b, past_w, past_v = 1e-6, np.full(WIDTH, 1e-6, np.float32), np.full((WIDTH, RANK), 1e-6, np.float32)
        weights = np.where(labels > 0, 1.0, BAD)
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(rows)))):
            order = rng.permutation(len(rows))
            for low in range(0, len(order), BATCH):
                own = order[low : low + BATCH]
                sizes = np.array([len(rows[i][0]) for i in own])
                places, values = (np.concatenate([rows[i][k] for i in own]) for k in (0, 1))
                m, sums = self.margins(places, values, np.cumsum(sizes) - sizes)
                error = ((1 / (1 + np.exp(-np.clip(m, -30, 30))) - labels[own]) * weights[own] / len(own)).astype(np.float32)
                each = np.repeat(error, sizes) * values
                used, back = np.unique(places, return_inverse=True)
                g_w = np.bincount(back, each, len(used)).astype(np.float32) + DECAY * self.linear[used]
                pull = each[:, None] * (np.repeat(sums, sizes, axis=0) - self.factors[places] * values[:, None])
                g_v = np.stack([np.bincount(back, pull[:, f], len(used)) for f in range(RANK)], 1).astype(np.float32) + DECAY * self.factors[used]
                past_w[used] += g_w * g_w
                past_v[used] += g_v * g_v
                self.linear[used] -= RATE * g_w / np.sqrt(past_w[used])
                self.factors[used] -= RATE * 0.5 * g_v / np.sqrt(past_v[used])
                g_b = float(error.sum())
                past_b += g_b * g_b
                self.bias -= RATE * g_b / past_b**0.5
        return self


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> FactorisationMachine | None:
    """None if there are no labelled rows to learn from."""
    import numpy as np

    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    # The side that is broadcast has train_rows rows at most.
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("_id"))
    # Of rows with one doc_id, that with the least text.
    made = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min(F.col("_label").cast("int")).alias("label"))
    got = made.select("text", "label").mapInArrow(_made, "places binary, values binary, label int").toPandas()
    if not len(got):
        return None
    # In an order of its own, so that the model doesn't hang on how rows came.
    rows = [(np.frombuffer(p, np.int32), np.frombuffer(v, np.float32)) for p, v in zip(got["places"], got["values"])]
    order = sorted(range(len(rows)), key=lambda i: (zlib.crc32(rows[i][0].tobytes() + rows[i][1].tobytes()), got["label"][i]))
    return FactorisationMachine().fit([rows[i] for i in order], got["label"].to_numpy()[order])


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), train_rows: int = TRAIN_ROWS, named: bool = True) -> DataFrame:
    """The columns in keep, held_out, score and predicted (1 from THRESHOLD on); not named: the first alone, of rows
    that are predicted to be good."""
    model = fit(docs, labels, train_rows)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # its size is fixed: WIDTH * (RANK + 1) numbers

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        machine = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = part.column(part.num_columns - 1).to_pylist()
                scores = machine.scores([features(t) for t in texts]) if machine and texts else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores, pa.float64())], names=[*part.schema.names[:-1], "_score"])

    taken = [f"_{k}" for k in range(len(keep))]  # names of their own, whatever the columns are called
    rows = docs.select(*(F.col(f"`{c}`").alias(t) for c, t in zip(keep, taken)), held_out(F.col("doc_id")).alias("_held"), F.col("text").alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(run, f"{schema}, _score double")
    if not named:
        return out.where(F.col("_score") >= THRESHOLD).select(*(F.col(t).alias(c) for c, t in zip(keep, taken)))
    predicted = (F.col("_score") >= THRESHOLD).cast("int").alias("predicted")
    return out.select(*(F.col(t).alias(c) for c, t in zip(keep, taken)), F.col("_held").alias("held_out"), F.col("_score").alias("score"), predicted)


def keep_good(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents, with all their columns, that are predicted to be good."""
    return score(docs, labels, tuple(docs.columns), train_rows, named=False)

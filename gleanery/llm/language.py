"""Language identification by a byte convolutional network, trained here in numpy.

A window of 256 bytes goes through filters two, three and four bytes wide; each filter keeps its largest
response in the window (max pooling), and a softmax layer turns these into one probability per language.
A document is cut into consecutive windows, all of them are scored, and its probabilities are the mean over
windows weighted by the bytes they hold. The whole text counts, however long it is.

Training reads a bounded sample: `SAMPLE` documents per language, chosen by a hash, three windows of each
document, and no more than `BUDGET` documents in all: many languages share it evenly and none is left out. That
sample and the count of each language are all that reaches the driver. Everything else runs in Arrow batches where the rows are.

Defined cases: a null text or one without any letter gets `und` with score 0, and so does every text where
nothing could be learned (no labelled rows). Equal texts get equal predictions. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanery.llm.common import slices, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
SAMPLE, BUDGET, EPOCHS = 700, 140_000, 10
UNKNOWN = "und"


def _max_rows(out: np.ndarray) -> np.ndarray:
    """out.max(1), by halving: whole blocks are compared, not a few numbers at a time."""
    while out.shape[1] > 1:
        half = (out.shape[1] + 1) // 2
        out = np.maximum(out[:, :half], out[:, -half:])
    return out[:, 0]


class ByteNet:
    """Multi-width byte filters, max pooling, softmax. Filters are tables of one row per byte value."""

    def __init__(self, labels: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.dense = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS + 1, len(labels))).astype(np.float32)

    def _pooled(self, windows: np.ndarray, pairs: list | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of each filter, and where it was (only without pair tables)."""
        codes = windows.astype(np.intp)
        tops, places = [], []
        both = codes[:, :-1] * 256 + codes[:, 1:] if pairs is not None else None
        for at, (w, table_) in enumerate(zip(WIDTHS, self.filters)):
            n = WINDOW - w + 1
            if pairs is None:
                out = sum(table_[j].take(codes[:, j : j + n], axis=0) for j in range(w))
                places.append(out.argmax(1))
            else:
                # Two neighbouring filter rows are one lookup in a table over byte pairs.
                out = pairs[at][0].take(both[:, :n], axis=0)
                for j in range(2, w - 1, 2):
                    out += pairs[at][j // 2].take(both[:, j : j + n], axis=0)
                if w % 2:
                    out += table_[w - 1].take(codes[:, w - 1 :], axis=0)
            tops.append(out.max(1) if pairs is None else _max_rows(out))
        return np.concatenate(tops, 1), places

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        logits = np.maximum(pooled, 0) @ self.dense[:-1] + self.dense[-1]
        logits = np.exp(logits - logits.max(1, keepdims=True))
        return logits / logits.sum(1, keepdims=True)

    def fit(self, windows: np.ndarray, classes: np.ndarray, epochs: int = EPOCHS, batch: int = 64) -> None:
        """Adam on the cross entropy; rare languages weigh as much as frequent ones."""
        rng = np.random.default_rng(11)
        share = np.bincount(classes, minlength=len(self.labels))
        weight = (len(classes) / np.maximum(share, 1) / len(self.labels)).astype(np.float32)
        params = [*self.filters, self.dense]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for start in range(0, len(order), batch):
                at = order[start : start + batch]
                x, y = windows[at].astype(np.intp), classes[at]
                pooled, places = self._pooled(windows[at])
                wrong = self._softmax(pooled)
                wrong[np.arange(len(y)), y] -= 1
                wrong *= (weight[y] / len(y))[:, None]
                grads = []
                back = wrong @ self.dense[:-1].T * (pooled > 0)
                rows = np.arange(len(y))[:, None]
                for k, w in enumerate(WIDTHS):
                    grad = np.zeros_like(self.filters[k])
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(grad[j], (x[rows, places[k] + j], np.arange(FILTERS)[None, :]), part)
                    grads.append(grad)
                grads.append(np.concatenate([np.maximum(pooled, 0).T @ wrong, wrong.sum(0, keepdims=True)]))
                step += 1
                for p, g, (m, v) in zip(params, grads, moments):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def pair_tables(self) -> list[list[np.ndarray]]:
        return [[(t[j][:, None] + t[j + 1][None]).reshape(65536, FILTERS) for j in range(0, len(t) - 1, 2)] for t in self.filters]

    def probabilities(self, windows: np.ndarray, pairs: list) -> np.ndarray:
        return np.concatenate([self._softmax(self._pooled(windows[i : i + 32], pairs)[0]) for i in range(0, len(windows), 32)])


def as_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive windows of every text, zero padded, and the number of windows of each."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    joined = b"".join(t.ljust(int(n) * WINDOW, b"\0") for t, n in zip(texts, counts))
    return np.frombuffer(joined, np.uint8).reshape(-1, WINDOW), counts


def predict(net: ByteNet, pairs: list, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Class and mean probability of each text."""
    windows, counts = as_windows(texts)
    weight = (windows != 0).sum(1).astype(np.float32) + 1e-3
    starts = np.cumsum(counts) - counts
    total = np.add.reduceat(net.probabilities(windows, pairs) * weight[:, None], starts)
    mean = total / np.add.reduceat(weight, starts)[:, None]
    best = mean.argmax(1)
    return best, mean[np.arange(len(best)), best]


def in_held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 2 by 4; a null id does not."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = SAMPLE, budget: int = BUDGET) -> ByteNet | None:
    """A network fitted on a bounded sample of the labelled rows outside the held-out fold."""
    pick = F.xxhash64(F.col(f"`{id_column}`"), F.lit(5))
    rows = docs.select(F.col(f"`{lang_column}`").alias("lang"), F.col(f"`{text_column}`").cast("binary").alias("raw"), F.col(f"`{id_column}`").alias("id"), pick.alias("pick")).where(
        F.col("lang").isNotNull() & F.col("raw").isNotNull() & F.col("id").isNotNull() & ~in_held_out(F.col("id"))
    )
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    sample = max(1, min(sample, budget // len(counts)))
    rate = F.try_element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.2 * sample / n))]), F.col("lang"))
    size = F.octet_length("raw")
    # Three places of each chosen text: its start and two by hash; only these bytes leave the scan.
    place = lambda k: F.expr(f"substring(raw, CAST(pmod(shiftrightunsigned(pick, {k}), greatest(octet_length(raw) - {WINDOW}, 1)) AS INT) + 1, {WINDOW})")
    chosen = (
        rows.where(F.pmod("pick", F.lit(1 << 20)) < rate * (1 << 20))
        .select("lang", "pick", size.alias("size"), F.expr(f"substring(raw, 1, {WINDOW})").alias("a"), place(7).alias("b"), place(23).alias("c"))
        .orderBy("pick", "lang", "size", "a")
        .limit(int(1.5 * sample * len(counts)))
        .collect()
    )
    labels, taken, texts, classes = sorted(counts), dict.fromkeys(counts, 0), [], []
    for row in chosen:
        if taken[row.lang] < sample:
            taken[row.lang] += 1
            for raw in [row.a] if row["size"] <= WINDOW else [row.a, row.b, row.c]:
                texts.append(bytes(raw))
                classes.append(labels.index(row.lang))
    if not texts:
        return None
    net = ByteNet(labels)
    net.fit(as_windows(texts)[0], np.array(classes))
    return net


def identify(docs: DataFrame, net: ByteNet | None, text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in `keep`, then lang_pred and score, one row per row of docs."""
    text = F.col(f"`{text_column}`")
    readable = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_")).alias("keep"), F.when(readable, text).alias("text"))
    schema = f"keep {rows.schema['keep'].dataType.simpleString()}, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pair_tables() if net else None
        for batch in slices(batches, "text", 2 << 20):
            texts = batch.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None] if net else []
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if known:
                best, score = predict(net, pairs, [texts[i].encode("utf-8", "surrogatepass") for i in known])
                for i, b, s in zip(known, best, score):
                    langs[i], scores[i] = net.labels[b], min(1.0, float(s))
            yield pa.RecordBatch.from_arrays([batch.column("keep"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["keep", "lang_pred", "score"])

    return rows.mapInArrow(run, schema).select(*[F.col("keep")[c].alias(c) for c in keep], "lang_pred", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs), keep=("doc_id",))
    return found.select("doc_id", in_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

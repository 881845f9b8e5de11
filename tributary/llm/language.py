"""Language identification by a small convolutional network over bytes, trained in numpy.

Bytes are embedded, filters of several widths run over fixed-length windows, each filter's largest
value is pooled, and a softmax gives the languages. A text is cut into windows from end to end, and
its windows' log probabilities are averaged by length.

At prediction the embedding is multiplied into the filters, so that a filter bank of width w is a
sum of rows of tables over bytes and byte pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.hashing import text_runs

WINDOW, EMBED, FILTERS, WIDTHS = 256, 8, 12, (2, 3, 4)
#: Labelled rows drawn for training, about; all windows of their whole texts are used.
SAMPLE = 1000
EPOCHS, BATCH, RATE = 8, 64, 0.01
NONE = "und"


class ByteNet:
    """Parameters, prediction and training of the network."""

    def __init__(self, classes: list[str], seed: int = 11):
        r = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"E": r.normal(0, 0.5, (256, EMBED)), "U": r.normal(0, 0.1, (FILTERS * len(WIDTHS), max(1, len(classes)))), "c": np.zeros(max(1, len(classes)))}
        for w in WIDTHS:
            self.p[f"W{w}"], self.p[f"b{w}"] = r.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)), np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.tables: list | None = None

    def _forward(self, x: np.ndarray):
        e = self.p["E"][x]
        pooled, at = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            z = sum(e[:, j : j + n] @ self.p[f"W{w}"][j] for j in range(w))
            k = z.argmax(1)
            at.append(k)
            pooled.append(np.take_along_axis(z, k[:, None], 1)[:, 0] + self.p[f"b{w}"])
        raw = np.concatenate(pooled, 1)
        h = np.maximum(raw, 0)
        o = h @ self.p["U"] + self.p["c"]
        o -= o.max(1, keepdims=True)
        q = np.exp(o)
        return e, raw, h, q / q.sum(1, keepdims=True), at

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy; through the pools only the largest values count."""
        _, raw, h, q, at = self._forward(x)
        d = q.copy()
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"U": h.T @ d, "c": d.sum(0), "E": np.zeros_like(self.p["E"])}
        dh = (d @ self.p["U"].T) * (raw > 0)
        rows = np.arange(len(x))[:, None]
        for i, w in enumerate(WIDTHS):
            part = dh[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"b{w}"] = part.sum(0)
            g[f"W{w}"] = np.zeros_like(self.p[f"W{w}"])
            for j in range(w):
                seen = x[rows, at[i] + j]  # the byte under tap j of each filter's best position
                g[f"W{w}"][j] = np.einsum("nf,nfe->ef", part, self.p["E"][seen])
                np.add.at(g["E"], seen, part[:, :, None] * self.p[f"W{w}"][j].T[None])
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> None:
        """Adam over shuffled batches."""
        r, m, v, t = np.random.default_rng(5), {}, {}, 0
        for epoch in range(epochs):
            order = r.permutation(len(x))
            for s in range(0, len(x), BATCH):
                t += 1
                pick = order[s : s + BATCH]
                for k, g in self.gradients(x[pick], y[pick]).items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.p[k] -= (RATE * 0.7**epoch * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)

    def _prepared(self) -> list:
        """For each width, tables over bytes and byte pairs that sum to its filters' values."""
        if self.tables is None:
            self.tables = []
            for w in WIDTHS:
                taps = [self.p["E"] @ self.p[f"W{w}"][j] for j in range(w)]
                parts = []
                for j in range(0, w - 1, 2):
                    parts.append((j, 2, (taps[j][:, None] + taps[j + 1][None]).reshape(65536, FILTERS)))
                if w % 2:
                    parts.append((w - 1, 1, taps[-1]))
                self.tables.append((w, parts, self.p[f"b{w}"]))
        return self.tables

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Log class probabilities of windows of bytes."""
        one = x.astype(np.int32)
        two = one[:, :-1] * 256 + one[:, 1:]
        pooled = []
        for w, parts, bias in self._prepared():
            n = WINDOW - w + 1
            z = None
            for j, kind, table in parts:
                got = np.take(table, (two if kind == 2 else one)[:, j : j + n], axis=0)
                z = got if z is None else np.add(z, got, out=z)
            pooled.append(z.max(1) + bias)
        o = np.maximum(np.concatenate(pooled, 1), 0) @ self.p["U"] + self.p["c"]
        o = o - o.max(1, keepdims=True)
        return o - np.log(np.exp(o).sum(1, keepdims=True))


def windows(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive windows of a text's bytes, the last filled up with zeros, and their lengths."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = data
    length = np.full(n, WINDOW, np.int64)
    length[-1] = len(data) - (n - 1) * WINDOW
    return out.reshape(n, WINDOW), length


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def share_of(wanted: float, n: int) -> float:
    """The share of ``n`` rows to draw so that ``wanted`` are expected; above zero at any size."""
    return min(1.0, wanted / n) if n else 0.0


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample: int = SAMPLE) -> ByteNet:
    """Train on all windows of about ``sample`` rows, the same number of each language where there are enough.

    Rows are drawn by the hash of key and text, alike at every size; a repeated row is drawn once.
    Rows with a null text or language are left out; with no rows, as in an empty table, the network
    knows no language.
    """
    rows = train.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(key_col, text_col).alias("draw"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = sorted(sizes)
    net = ByteNet(classes)
    if not classes:
        return net
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, share_of(sample / len(classes), n)).otherwise(share)
    drawn = rows.filter(F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53)) < share).groupBy("lang", "draw").agg(F.min("text").alias("text")).select("text", "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, langs = [], []
            for k in range(batch.num_rows):
                x, _ = windows(np.frombuffer(batch.column(0)[k].as_py().encode(), np.uint8))
                got += [w.tobytes() for w in x]
                langs += [batch.column(1)[k].as_py()] * len(x)
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), pa.array(langs, pa.string())], names=["x", "lang"])

    got = sorted((r["lang"], bytes(r["x"])) for r in drawn.mapInArrow(cut, "x binary, lang string").collect())
    if got:
        net.train(np.frombuffer(b"".join(x for _, x in got), np.uint8).reshape(-1, WINDOW), np.array([classes.index(lang) for lang, _ in got]))
    return net


def predict(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """id, lang_pred and score per row, from all windows of the whole text.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if the
    network knows no language; of languages that score alike the first by name wins. Repeated rows
    are judged alike, a very long text by all its windows; an empty table gives an empty one.
    ``keep``: further columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    keep = keep or {}
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, j, data, offsets in text_runs(batch.column(1), 1 << 16):
                langs, scores = [], []
                texts = [t.as_py() for t in batch.column(1)[i:j]]
                cuts = [windows(data[offsets[k] : offsets[k + 1]]) for k in range(j - i)]
                x, length = np.concatenate([c[0] for c in cuts]), np.concatenate([c[1] for c in cuts])
                if model.classes:
                    step = 256
                    logs = np.concatenate([model.log_probabilities(x[s : s + step]) for s in range(0, len(x), step)]) * length[:, None]
                    at = np.cumsum([0, *(len(c[0]) for c in cuts)])
                for k, text in enumerate(texts):
                    if not model.classes or not has_letter(text):
                        langs.append(NONE)
                        scores.append(0.0)
                        continue
                    o = logs[at[k] : at[k + 1]].sum(0) / max(1, int(length[at[k] : at[k + 1]].sum()))
                    q = np.exp(o - o.max())
                    best = int(q.argmax())
                    langs.append(model.classes[best])
                    scores.append(float(q[best] / q.sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *(batch.column(2 + n)[i:j] for n in range(len(names)))], names=["id", "lang_pred", "score", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(c.alias(n) for n, c in keep.items()))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join([f"id {kinds['id']}, lang_pred string, score double", *(f"{n} {kinds[n]}" for n in keep)])).withColumnRenamed("id", id_col)

"""Language identification by a bidirectional gated recurrent network (GRU)
over bytes, trained in numpy by backpropagation through time.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes.  Both
directions run over every window of the whole text, every byte position gets
label probabilities, and a document's probabilities are their mean.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import narrow, only_cache, short_batches

WINDOW, HIDDEN = 64, 8
#: The training sample: documents per label, and windows of each.
TRAIN_DOCS, TRAIN_WINDOWS = 256, 8
EPOCHS, BATCH, RATE = 10, 512, 0.02
#: Windows that run side by side, and rows per output batch.
SLAB, ROWS = 2048, 256
UNKNOWN = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One direction: tables per input byte, recurrent matrix, inner bias."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.E = (rng.normal(size=(3 * hidden, 256)) * 0.3).astype(np.float32)
        self.U = (rng.normal(size=(3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros((hidden, 1), np.float32)

    def params(self):
        return [self.E, self.U, self.b]

    def forward(self, x: np.ndarray, mask: np.ndarray):
        """States (T, H, B) for bytes x (T, B), and what the way back needs.
        A masked position has state zero, so padding never leaks."""
        H = self.U.shape[1]
        h, states, kept = np.zeros((H, x.shape[1]), np.float32), [], []
        for t in range(len(x)):
            a, g = self.E[:, x[t]], self.U @ h
            z, r = _sigmoid(a[:H] + g[:H]), _sigmoid(a[H:2 * H] + g[H:2 * H])
            q = g[2 * H:] + self.b
            n = np.tanh(a[2 * H:] + r * q)
            kept.append((h, z, r, q, n))
            h = (n + z * (h - n)) * mask[t]
            states.append(h)
        return np.stack(states), kept

    def backward(self, x, mask, kept, d_states):
        """Gradients of E, U and b by backpropagation through time."""
        H = self.U.shape[1]
        dU, db = np.zeros_like(self.U), np.zeros_like(self.b)
        da = np.empty((len(x), 3 * H, x.shape[1]), np.float32)
        dh = np.zeros((H, x.shape[1]), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, q, n = kept[t]
            dh = (dh + d_states[t]) * mask[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * q * r * (1 - r)
            da[t, :H], da[t, H:2 * H], da[t, 2 * H:] = dz, dr, dn
            dg = np.concatenate([dz, dr, dn * r])
            dU += dg @ h.T
            db += dg[2 * H:].sum(1, keepdims=True)
            dh = dh * z + self.U.T @ dg
        flat = x.ravel()
        rows = da.transpose(1, 0, 2).reshape(3 * H, -1)
        dE = np.stack([np.bincount(flat, weights=w, minlength=256) for w in rows]).astype(np.float32)
        return [dE, dU, db]

    def run(self, x: np.ndarray, mask: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Forward only, with constant factors folded into the tables:
        sigmoid(v) = (tanh(v / 2) + 1) / 2."""
        H, B = self.U.shape[1], x.shape[1]
        E, U = self.E.copy(), self.U.copy()
        E[:2 * H] *= 0.5
        U *= 0.5  # gates: tanh(v / 2); inner part: half of q
        b = 0.5 * self.b
        h, out = np.zeros((H, B), np.float32), np.empty((len(x), H, B), np.float32)
        g = np.empty((3 * H, B), np.float32)
        for t in range(len(x)):
            a = E.take(x[t], axis=1)
            np.matmul(U, h, out=g)
            gates, q = g[:2 * H], g[2 * H:]
            gates += a[:2 * H]
            np.tanh(gates, out=gates)
            q += b
            n = gates[H:] * q
            n += q
            n += a[2 * H:]
            np.tanh(n, out=n)
            h = h - n
            z = gates[:H]
            z += 1
            h *= z
            h *= 0.5
            h += n
            if not whole[t]:
                h *= mask[t]
            out[t] = h
        return out


@dataclass
class Model:
    """Labels and weights; a few kilobytes, sent with the tasks."""

    labels: list[str]
    hidden: int = HIDDEN
    window: int = WINDOW
    seed: int = 0

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.forth, self.back = Direction(rng, self.hidden), Direction(rng, self.hidden)
        self.W = (rng.normal(size=(len(self.labels), 2 * self.hidden)) * 0.3).astype(np.float32)
        self.c = np.zeros((len(self.labels), 1), np.float32)

    def params(self):
        return [*self.forth.params(), *self.back.params(), self.W, self.c]

    def loss(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray):
        """Mean cross-entropy over all real positions, and all gradients.
        x, mask: (T, B); y: (B,) label numbers."""
        m = mask[:, None, :].astype(np.float32)
        fs, fk = self.forth.forward(x, m)
        bs, bk = self.back.forward(x[::-1], m[::-1])
        s = np.concatenate([fs, bs[::-1]], axis=1)  # (T, 2H, B)
        logits = self.W @ s + self.c
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        total = m.sum()
        at = np.arange(x.shape[1])
        loss = -(np.log(np.maximum(p[:, y, at], 1e-12)) * m[:, 0]).sum() / total
        d = p.copy()
        d[:, y, at] -= 1
        d *= m / total
        dW = np.einsum("tlb,thb->lh", d, s, optimize=True)
        dc = d.sum((0, 2))[:, None]
        ds = self.W.T @ d
        H = self.hidden
        return loss, [*self.forth.backward(x, m, fk, ds[:, :H]),
                      *self.back.backward(x[::-1], m[::-1], bk, ds[::-1, H:]), dW, dc]

    def fit(self, windows: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH,
            rate: float = RATE) -> Model:
        """Adam over shuffled windows; the seed fixes everything."""
        x, mask = pack(windows, self.window)
        rng = np.random.default_rng(self.seed)
        ps = self.params()
        m1, m2 = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps]
        step, steps = 0, max(1, epochs * -(-len(windows) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                part = order[at:at + batch]
                _, grads = self.loss(x[:, part], mask[:, part], y[part])
                step += 1
                now = rate * (1 - 0.9 * step / steps)
                for p, g, a, b in zip(ps, grads, m1, m2):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return self

    def positions(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Label probabilities of every position: (T, L, B)."""
        m, whole = mask.astype(np.float32)[:, None, :], mask.all(1)
        states = np.concatenate([self.forth.run(x, m, whole),
                                 self.back.run(x[::-1], m[::-1], whole[::-1])[::-1]], axis=1)
        p = self.W @ states
        p += self.c
        np.exp(p, out=p)  # |logit| is at most the sum of |weights|, far from overflow
        p /= p.sum(1, keepdims=True)
        return p

    def texts(self, texts: list[bytes]):
        """Mean probabilities (n, L) of whole texts; zeros for an empty one."""
        T = self.window
        counts = np.array([-(-len(t) // T) for t in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        sums = np.zeros((len(texts), len(self.labels)))
        flat = np.zeros((int(counts.sum()), T), np.uint8)
        left = np.full(len(flat), T)
        at = 0
        for t, k in zip(texts, counts):
            flat[at:at + k].reshape(-1)[:len(t)] = np.frombuffer(t, np.uint8)
            at += k
            if k:
                left[at - 1] = len(t) - T * (k - 1)
        order = np.argsort(-left, kind="stable")  # cut windows last: most slabs need no mask
        for i in range(0, len(order), SLAB):
            part = order[i:i + SLAB]
            x = np.ascontiguousarray(flat[part].T).astype(np.intp)
            mask = np.arange(T)[:, None] < left[part]
            p = self.positions(x, mask)
            if not mask.all():
                p *= mask[:, None, :]
            per_window = p.sum(0)
            for j in range(len(self.labels)):
                sums[:, j] += np.bincount(owner[part], weights=per_window[j], minlength=len(texts))
        lengths = np.array([len(t) for t in texts], np.int64)
        return sums / np.maximum(lengths, 1)[:, None]


def pack(windows: list[bytes], length: int):
    """Bytes (T, B) and mask of windows of at most ``length`` bytes."""
    x = np.zeros((length, len(windows)), np.intp)
    mask = np.zeros((length, len(windows)), bool)
    for i, w in enumerate(windows):
        x[:len(w), i] = np.frombuffer(w, np.uint8)
        mask[:len(w), i] = True
    return x, mask


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          docs_per_label: int = TRAIN_DOCS, windows_per_doc: int = TRAIN_WINDOWS, window: int = WINDOW,
          hidden: int = HIDDEN, epochs: int = EPOCHS) -> Model:
    """Train on a bounded sample of labelled rows that are not held out: the
    ``docs_per_label`` rows of each label with the smallest id hash, and
    ``windows_per_doc`` windows spread over each whole text.  Rows are told
    apart by id and text, so null and repeated ids serve like any other; rows
    that repeat with id and text serve once.

    Without a labelled text with letters the model knows no label and every
    prediction is ``und``."""
    short_batches(docs.sparkSession)
    rows = narrow(docs, doc_id=id_col, text=text_col, lang=lang_col)
    usable = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("h")))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("key.doc_id"), "key.doc_id", "key.h")
    # keys first, so that no text is shuffled for the choice
    chosen = (usable.select("key", "lang").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= docs_per_label)
              .select(F.col("key").alias("_key"), F.col("lang").alias("_lang")).distinct())
    texts = usable.join(F.broadcast(chosen), F.col("key").eqNullSafe(F.col("_key")) & (F.col("lang") == F.col("_lang")),
                        "left_semi").dropDuplicates(["key", "lang"])

    def cut(batches):
        for batch in batches:
            labels, parts = [], []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if not text or not has_letter(text):
                    continue
                raw = text.encode()
                n = min(windows_per_doc, -(-len(raw) // window))
                for k in range(n):
                    at = k * max(0, len(raw) - window) // max(1, n - 1)
                    labels.append(lang)
                    parts.append(raw[at:at + window])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(parts, pa.binary())],
                                             ["lang", "w"])

    got = sorted((r.lang, bytes(r.w)) for r in texts.select("text", "lang")
                 .mapInArrow(cut, "lang string, w binary").collect())
    labels = sorted({lang for lang, _ in got})
    model = Model(labels, hidden=hidden, window=window)
    if got:
        number = {lang: i for i, lang in enumerate(labels)}
        model.fit([w for _, w in got], np.array([number[lang] for lang, _ in got]), epochs=epochs)
    return model


def detect(docs: DataFrame, model: Model, *, text_col: str = "text", label_col: str = "lang_pred",
           score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted label and its mean probability, from the
    whole text alone.

    * null, empty or letterless text, or a model without labels: ``und``, 0
    * equal texts get equal answers; repeated rows stay; empty table: no rows
    * columns named like the two new ones are replaced
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in docs.schema.fields if f.name not in (label_col, score_col)]
    names = [f.name for f in keep]

    def run(batches):
        only_cache()
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(text_col).to_pylist()
                known = [i for i, t in enumerate(texts) if t and model.labels and has_letter(t)]
                label, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                # equal texts of a batch run once
                distinct = {t: k for k, t in enumerate(dict.fromkeys(texts[i] for i in known))}
                p = model.texts([t.encode() for t in distinct])
                for i in known:
                    row = p[distinct[texts[i]]]
                    best = int(row.argmax())
                    label[i], score[i] = model.labels[best], min(1.0, float(row[best]))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(label, pa.string()), pa.array(score, pa.float64())],
                    [*names, label_col, score_col])

    return docs.mapInArrow(run, T.StructType([*keep, T.StructField(label_col, T.StringType()),
                                              T.StructField(score_col, T.DoubleType())]))


def lettered(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a letter; no model is asked."""
    short_batches(docs.sparkSession)

    def run(batches):
        only_cache()
        for batch in batches:
            keep = [bool(t) and has_letter(t) for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def label_runs(model: Model, text: str) -> list[tuple[int, int, str]]:
    """Runs (first byte, end byte, label) of equally labelled positions."""
    raw = text.encode()
    if not raw or not model.labels:
        return []
    parts = [raw[i:i + model.window] for i in range(0, len(raw), model.window)]
    x, mask = pack(parts, model.window)
    best = model.positions(x, mask).argmax(1).T[mask.T]
    edges = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)]
    return [(a, b, model.labels[best[a]]) for a, b in zip(edges, edges[1:])]

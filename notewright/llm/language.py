"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, free_memory, text_slices

#: Texts are read in stretches of so many bytes, with so many more on each side that only set the states.
STRETCH, MARGIN = 224, 16
_LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


class ByteGRU:
    """Two gated recurrent layers, one from each end, and a softmax over languages at every byte."""

    def __init__(self, languages: list[str], hidden: int = 8, inputs: int = 8, seed: int = 1):
        r = np.random.default_rng(seed)
        n = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.languages, self.hidden = languages, hidden
        self.p = {"E": (r.standard_normal((256, inputs)) * 0.5).astype(np.float32), "V": n(2 * hidden, len(languages)), "c": np.zeros(len(languages), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": n(inputs, 3 * hidden), f"U{d}": n(hidden, 3 * hidden), f"b{d}": np.zeros(3 * hidden, np.float32)}

    def _layer(self, d: str, x, mask):
        """States (time, row, hidden) and what the backward pass needs; padding leaves the state as it is.

        Gates are 1/2 + tanh/2. Weights of the gates z and r stand before those of the candidate."""
        H, (W, U, b) = self.hidden, (self.p[k + d] for k in "WUb")
        gates = self.p["E"] @ W + b
        h, out, tape = np.zeros((x.shape[1], H), U.dtype), [None] * len(x), [None] * len(x)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            m, a = mask[t][:, None], gates[x[t]]
            zr = np.tanh((a[:, : 2 * H] + h @ U[:, : 2 * H]) / 2) / 2 + 0.5
            z, r = zr[:, :H], zr[:, H:]
            g = np.tanh(a[:, 2 * H :] + (r * h) @ U[:, 2 * H :])
            new = h + m * z * (g - h)
            tape[t] = (h, z, r, g, m)
            h = out[t] = new
        return np.stack(out), tape

    def gradients(self, x, mask, label):
        """The mean cross-entropy over bytes and its gradients, by backpropagation through time."""
        H, layers = self.hidden, {d: self._layer(d, x, mask) for d in "fb"}
        both = np.concatenate([layers[d][0] for d in "fb"], 2)
        y = both @ self.p["V"] + self.p["c"]
        y = np.exp(y - y.max(2, keepdims=True))
        y /= y.sum(2, keepdims=True)
        total = mask.sum()
        rows = np.arange(x.shape[1])
        loss = float(-(np.log(y[:, rows, label] + 1e-9) * mask).sum() / total)
        dy = y.copy()
        dy[:, rows, label] -= 1
        dy *= (mask / total)[:, :, None]
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["V"], grad["c"] = np.tensordot(both, dy, ([0, 1], [0, 1])), dy.sum((0, 1))
        dboth = dy @ self.p["V"].T
        for i, d in enumerate("fb"):
            U, dx = self.p["U" + d], np.zeros((*x.shape, 3 * H), both.dtype)
            dh = np.zeros((x.shape[1], H), both.dtype)
            for t in reversed(range(len(x))) if d == "f" else range(len(x)):
                h, z, r, g, m = layers[d][1][t]
                dh = dh + dboth[t][:, i * H : (i + 1) * H]
                dn = dh * m
                dg = dn * z * (1 - g * g)
                dz = dn * (g - h) * z * (1 - z)
                drh = dg @ U[:, 2 * H :].T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                dx[t] = np.concatenate([dzr, dg], 1)
                grad["U" + d][:, : 2 * H] += h.T @ dzr
                grad["U" + d][:, 2 * H :] += (r * h).T @ dg
                dh = dh - dn * z + drh * r + dzr @ U[:, : 2 * H].T
            flat = dx.reshape(-1, 3 * H)
            grad["b" + d] = flat.sum(0)
            per_byte = np.zeros((256, 3 * H), both.dtype)
            np.add.at(per_byte, x.reshape(-1), flat)
            grad["W" + d] = self.p["E"].T @ per_byte
            grad["E"] += per_byte @ self.p["W" + d].T
        return loss, grad

    def fit(self, texts: list[list[bytes]], steps: int = 400, rows: int = 256, width: int = 64, rate: float = 2e-2, seed: int = 2) -> ByteGRU:
        """Adam over random pieces of random texts, of each language (texts: a list for each) equally many; the rate falls linearly."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            label = r.integers(0, len(texts), rows)
            some = [texts[k][r.integers(len(texts[k]))] for k in label]
            at = [int(r.integers(max(1, len(t) - width + 1))) for t in some]
            x, mask = padded([t[a : a + width] for t, a in zip(some, at)])
            _, grad = self.gradients(x, mask, label)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1, 1 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def _states(self, d: str, x, lengths):
        """States after each time step (time, row, hidden). Rows go from long to short, so those that have begun, or not ended, come first."""
        H, (W, U, b) = self.hidden, (self.p[k + d] for k in "WUb")
        half = np.repeat(np.array([0.5, 1], np.float32), [2 * H, H])
        gates, U = ((self.p["E"] @ W + b) * half).astype(np.float32), (U * half).astype(np.float32)
        zr_of, g_of = np.ascontiguousarray(U[:, : 2 * H]), np.ascontiguousarray(U[:, 2 * H :])
        out = np.zeros((len(x) + 2, x.shape[1], H), np.float32)  # the state before step t stands beside it
        live = np.searchsorted(-lengths, -np.arange(len(x)), "left")
        buf = np.empty((x.shape[1], 3 * H), np.float32)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            n = live[t]
            h, new = (out[t, :n], out[t + 1, :n]) if d == "f" else (out[t + 2, :n], out[t + 1, :n])
            a = np.take(gates, x[t, :n], axis=0, out=buf[:n])
            zr = h @ zr_of
            zr += a[:, : 2 * H]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            rh = zr[:, H:] * h
            g = rh @ g_of
            g += a[:, 2 * H :]
            np.tanh(g, out=g)
            g -= h
            g *= zr[:, :H]
            np.add(g, h, out=new)
        return out[1:-1]

    def sums(self, texts: list[bytes], rows: int = 1024) -> np.ndarray:
        """For each text the sums of the log-probabilities and of the probabilities over all its bytes, and their number.

        Long texts are read in stretches; the states at a stretch's bytes have seen MARGIN bytes, or the text's
        edge, at least on each side."""
        L = len(self.languages)
        out = np.zeros((len(texts), 2 * L + 1))
        lengths = np.array([len(t) for t in texts], np.int64)
        count = np.maximum(1, -(-lengths // STRETCH))
        owner = np.repeat(np.arange(len(texts)), count)
        a = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STRETCH
        low, high = np.maximum(a - MARGIN, 0), np.minimum(a + STRETCH + MARGIN, lengths[owner])
        size = high - low
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        begin = (np.cumsum(lengths) - lengths)[owner] + low
        for k in range(0, len(order), rows):
            some = order[k : k + rows]
            n, width = size[some], int(size[some].max(initial=0))
            if not width:
                break
            time = np.arange(width)[:, None]
            x = data[np.minimum(begin[some] + time, len(data) - 1)]
            y = self._states("f", x, n) @ self.p["V"][: self.hidden]
            y += self._states("b", x, n) @ self.p["V"][self.hidden :] + self.p["c"]
            mine = ((time >= (a - low)[some]) & (time < np.minimum(a + STRETCH, lengths[owner])[some] - low[some])).astype(np.float32)
            np.clip(y, -30, 30, out=y)
            e = np.exp(y)
            total = e @ np.ones(L, np.float32)
            sums = np.concatenate([np.einsum("trl,tr->rl", y, mine) - (np.log(total) * mine).sum(0)[:, None], np.einsum("trl,tr->rl", e, mine / total), mine.sum(0)[:, None]], 1)
            np.add.at(out, owner[some], sums)
        return out


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, texts))
    x = np.frombuffer(b"".join(t.ljust(n, b" ") for t in texts), np.uint8).reshape(len(texts), n).T
    return x.astype(np.int64), (np.arange(n)[:, None] < np.array([len(t) for t in texts])).astype(np.float32)


def train(docs: DataFrame, *, text_col: str = "text", label_col: str = "lang", sample: int = 200, fit: dict | None = None, **model) -> ByteGRU | None:
    """Fits the network on the driver from a bounded sample of the labelled rows: of each language `sample` different
    texts at most, those of the least hashes; their whole texts are learned from. None if no row has a label
    and a letter."""
    ready = docs.select(docs[text_col].alias("text"), docs[label_col].cast("string").alias("lang")).where("text is not null and lang is not null").where(F.col("text").rlike("\\p{L}"))
    hashed = ready.select("text", "lang", F.xxhash64("text").alias("h"))
    sizes = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return None
    # hashes below a bound that leaves about three times the sample: the least ones are among them
    bound = {x: (1 << 63) - 1 if n <= 3 * sample else int((3 * sample / n) * 2.0**64) - (1 << 63) for x, n in sizes.items()}
    spark = docs.sparkSession
    bounds = spark.createDataFrame(list(bound.items()), "bl string, bound long")
    low = hashed.join(F.broadcast(bounds), (F.col("lang") == F.col("bl")) & (F.col("h") <= F.col("bound"))).select("lang", "h").distinct().collect()
    least: dict[str, list[int]] = {}
    for r in low:
        least.setdefault(r["lang"], []).append(r["h"])
    chosen = spark.createDataFrame([(x, h) for x, hs in least.items() for h in sorted(hs)[:sample]], "cl string, ch long")
    rows = hashed.join(F.broadcast(chosen), (F.col("lang") == F.col("cl")) & (F.col("h") == F.col("ch"))).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    texts: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"])):
        texts.setdefault(r["lang"], []).append(r["text"].encode())
    languages = sorted(texts)
    return ByteGRU(languages, **model).fit([texts[x] for x in languages], **(fit or {}))


def predict(docs: DataFrame, model: ByteGRU | None, *, text_col: str = "text", label_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with the label of each whole text and its score.

    The network reads the running text and labels every byte; the document's label has the highest sum of
    log-probabilities over all bytes, and its score is the mean probability of that label over them. Long texts are read
    in overlapping stretches (STRETCH, MARGIN). A null text, and one without a letter, is 'und' with score 0, and so is
    every text if there is no model; ties go to the first language in order; repeated rows are judged alike; an empty
    table gives no rows. Columns of docs with the new names are replaced.
    """
    base = docs.drop(*(c for c in (label_out, score_out) if c in docs.columns))
    k = base.columns.index(text_col)
    schema = T.StructType([*base.schema.fields, T.StructField(label_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = as_bytes(batch.column(k))
            label, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for a, b in text_slices(texts, 1_000_000) if model else ():
                some = [i for i in range(a, b) if texts[i] and _LETTER.search(texts[i].decode())]
                if some:
                    got, L = model.sums([texts[i] for i in some]), len(model.languages)
                    best = got[:, :L].argmax(1)
                    mean = got[np.arange(len(some)), L + best] / got[:, -1]
                    for i, x, y in zip(some, best.tolist(), mean.tolist()):
                        label[i], score[i] = model.languages[x], min(1.0, max(0.0, y))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, label_out, score_out])
        free_memory()

    return base.mapInArrow(run, schema)

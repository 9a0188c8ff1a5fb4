"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of bytes that are read in both directions side by side, so every byte of every text gets a
label distribution; a document's probabilities are the mean over its bytes.  The network is trained in numpy by
backpropagation through time, on the driver, from windows of a bounded sample of labelled documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

OUT = "doc_id long, lang_pred string, score double"


class GRU:
    """One direction.  Arrays are (features, lanes); gates are stacked as update, reset, candidate."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.p = {"x": (rng.standard_normal((3 * hidden, 256)) * 0.3).astype("f4"), "u": (rng.standard_normal((3 * hidden, hidden)) / np.sqrt(hidden)).astype("f4"), "b": np.zeros((hidden, 1), "f4")}

    def forward(self, bytes_: np.ndarray, keep: bool):
        """bytes_: (time, lanes) -> states (time, hidden, lanes), and what ``backward`` needs."""
        h, p = self.h, self.p
        steps, lanes = bytes_.shape
        states, saved = np.empty((steps, h, lanes), "f4"), []
        state = np.zeros((h, lanes), "f4")
        for t in range(steps):
            gx, gh = p["x"].take(bytes_[t], axis=1), p["u"] @ state
            gates = gx[: 2 * h]
            gates += gh[: 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r = gates[:h], gates[h:]
            a = gh[2 * h :]
            a += p["b"]
            n = r * a
            n += gx[2 * h :]
            np.tanh(n, out=n)
            before, state = state, states[t]
            np.subtract(before, n, out=state)
            state *= z
            state += n
            if keep:
                saved.append((before, z, r, n, a))
        return states, saved

    def backward(self, bytes_: np.ndarray, saved: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        h, p = self.h, self.p
        g = {k: np.zeros_like(v) for k, v in p.items()}
        gx = np.empty((len(saved), 3 * h, bytes_.shape[1]), "f4")
        carry = np.zeros_like(grad[0])
        for t in reversed(range(len(saved))):
            before, z, r, n, a = saved[t]
            d = grad[t] + carry
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (before - n) * z * (1 - z)
            dr = dn * a * r * (1 - r)
            gates = np.concatenate([dz, dr, dn * r])
            g["u"] += gates @ before.T
            g["b"] += (dn * r).sum(1, keepdims=True)
            carry = d * z + p["u"].T @ gates
            gx[t, : 2 * h], gx[t, 2 * h :] = gates[: 2 * h], dn
        flat = gx.transpose(1, 0, 2).reshape(3 * h, -1)
        codes = bytes_.ravel()
        for i in range(3 * h):
            g["x"][i] = np.bincount(codes, flat[i], 256)
        return g


class BiGRU:
    def __init__(self, classes: list[str], hidden: int = 8, window: int = 64, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.classes, self.window = classes, window
        self.ahead, self.back = GRU(hidden, rng), GRU(hidden, rng)
        self.out = {"v": (rng.standard_normal((len(classes), 2 * hidden)) * 0.3).astype("f4"), "c": np.zeros((len(classes), 1), "f4")}

    def _softmax(self, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
        h = self.ahead.h
        z = self.out["v"][:, :h] @ ahead
        z += self.out["v"][:, h:] @ back
        z += self.out["c"]
        z -= z.max(axis=-2, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=-2, keepdims=True)
        return z

    def pooled(self, windows: np.ndarray, valid: np.ndarray | None = None) -> np.ndarray:
        """windows: (time, lanes) -> sums of label distributions over the valid bytes of each lane, (lanes, classes)."""
        ahead, _ = self.ahead.forward(windows, False)
        back, _ = self.back.forward(windows[::-1], False)
        total = np.zeros((len(self.classes), windows.shape[1]), "f4")
        for t in range(len(windows)):
            p = self._softmax(ahead[t], back[len(windows) - 1 - t])
            total += p if valid is None else p * valid[t]
        return total.T

    def step(self, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
        """Mean cross-entropy over all bytes, and (parameter, gradient) pairs."""
        steps, lanes = windows.shape
        ahead, saved_a = self.ahead.forward(windows, True)
        back, saved_b = self.back.forward(windows[::-1], True)
        turned = back[::-1]
        p = self._softmax(ahead, turned)
        loss = -np.log(p[:, labels, np.arange(lanes)] + 1e-12).mean()
        p[:, labels, np.arange(lanes)] -= 1
        p /= steps * lanes
        h = self.ahead.h
        grads = [(self.out["v"], np.concatenate([np.einsum("tcl,thl->ch", p, ahead), np.einsum("tcl,thl->ch", p, turned)], 1)), (self.out["c"], p.sum((0, 2))[:, None])]
        for net, saved, codes, d in ((self.ahead, saved_a, windows, self.out["v"][:, :h].T @ p), (self.back, saved_b, windows[::-1], (self.out["v"][:, h:].T @ p)[::-1])):
            g = net.backward(codes, saved, d)
            grads += [(net.p[k], g[k]) for k in net.p]
        return float(loss), grads

    def train(self, texts: list[str], labels: list[int], steps: int = 300, lanes: int = 256, rate: float = 0.02, seed: int = 0) -> float:
        """Adam over random windows, as many of each class; returns the last loss."""
        rng = np.random.default_rng(seed)
        by_class = [[np.frombuffer(t.encode(), "u1") for t, y in zip(texts, labels) if y == k and t] for k in range(len(self.classes))]
        moments: list = []
        loss = 0.0
        for n in range(1, steps + 1):
            ys = np.arange(lanes) % len(self.classes)
            windows = np.full((self.window, lanes), 32, np.int64)
            for lane, y in enumerate(ys):
                if by_class[y]:
                    b = by_class[y][rng.integers(len(by_class[y]))]
                    at = rng.integers(max(1, len(b) - self.window + 1))
                    part = b[at : at + self.window]
                    windows[: len(part), lane] = part
            loss, grads = self.step(windows, ys)
            moments = moments or [[np.zeros_like(p), np.zeros_like(p)] for p, _ in grads]
            lr = rate * min(1.0, n / 20) * (1 - n / (steps + 1)) ** 0.5
            for (p, g), m in zip(grads, moments):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                p -= (lr * (m[0] / (1 - 0.9**n)) / (np.sqrt(m[1] / (1 - 0.99**n)) + 1e-8)).astype("f4")
        return loss

    def predict(self, texts: list[bytes], lanes: int = 4096) -> np.ndarray:
        """Mean label distribution over all bytes of each text; zeros for an empty one."""
        w, total = self.window, np.zeros((len(texts), len(self.classes)))
        sizes = np.array([len(t) for t in texts], np.int64)
        whole, tail = sizes // w, sizes % w
        full = np.frombuffer(b"".join(t[: n * w] for t, n in zip(texts, whole)), "u1").reshape(-1, w)
        owner = np.repeat(np.arange(len(texts)), whole)
        for at in range(0, len(full), lanes):
            got = self.pooled(np.ascontiguousarray(full[at : at + lanes].T))
            np.add.at(total, owner[at : at + lanes], got)
        ends = np.flatnonzero(tail)
        for at in range(0, len(ends), lanes):
            own = ends[at : at + lanes]
            rest = np.frombuffer(b"".join(texts[i][whole[i] * w :].ljust(w) for i in own), "u1").reshape(-1, w)
            valid = (np.arange(w)[:, None] < tail[own][None, :]).astype("f4")
            total[own] += self.pooled(np.ascontiguousarray(rest.T), valid)
        return total / np.maximum(sizes, 1)[:, None]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = 600, sample_chars: int = 400, max_languages: int = 10_000, hidden: int = 8, window: int = 64, steps: int = 300) -> BiGRU | None:
    """A network from documents that are not held out and have a language; None if there are none.

    Bounded sample: about ``sample_docs`` documents a language (twice as many at most, the first by the hash of their
    ids, then by id and text), and of each ``sample_chars`` characters at a hashed place; languages beyond the
    ``max_languages`` most frequent ones aren't learned.  The same table gives the same network.
    """
    usable = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    counts = sorted(usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect(), key=lambda r: r["lang"])
    if not counts:
        return None
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, sample_docs / r["count"])) for r in counts], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    place = F.pmod(F.xxhash64(F.lit("place"), "doc_id"), F.greatest(F.length("text") - sample_chars, F.lit(1))).cast("int") + 1
    drawn = usable.withColumn("lang", F.col("lang").cast("string")).join(F.broadcast(shares), "lang").filter(draw < F.col("share"))  # ``max_languages`` rows at most
    cut = drawn.select("doc_id", "lang", draw.alias("draw"), F.substring(F.col("text"), place, F.lit(sample_chars)).alias("part"))
    first = Window.partitionBy("lang").orderBy("draw", "doc_id", "part")
    rows = cut.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= 2 * sample_docs).collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"], r["part"]))
    classes = [row["lang"] for row in counts]
    number = {c: k for k, c in enumerate(classes)}
    net = BiGRU(classes, hidden, window)
    if len(classes) > 1:
        net.train([r["part"] for r in rows], [number[r["lang"]] for r in rows], steps)
    return net


def identify(docs: DataFrame, net: BiGRU | None) -> DataFrame:
    """doc_id, lang_pred, score for each row.  ``und`` with score 0 for null text, text without a letter, or no network.

    Equal probabilities: the first language in order of name.  Repeated rows get equal predictions, very long texts are
    read whole, window by window, and an empty table gives an empty result.
    """
    given = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        model = given.value
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                texts = [t if model is not None and t and any(map(str.isalpha, t)) else "" for t in part["text"]]
                if model is None:
                    yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": "und", "score": 0.0})
                    continue
                p = model.predict([t.encode("utf-8", "surrogatepass") for t in texts])
                best = p.argmax(1)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "lang_pred": [model.classes[k] if t else "und" for k, t in zip(best, texts)], "score": np.clip(p[np.arange(len(best)), best], 0, 1)})

    return shared.null_again(docs.select(shared.whole_id(F.col("doc_id")).alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, OUT))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = learn(docs)
    return identify(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

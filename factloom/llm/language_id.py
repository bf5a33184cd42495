"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import bound_batches, holds, table

UNKNOWN = "und"
#: Labelled documents of each language that the network is fitted on at most, and characters taken of each, at a place that its id's hash sets.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 400
#: Units of each direction; bytes that are read in a row before the state begins anew.
UNITS, SPAN = 8, 96
STEPS, BATCH, TRAIN_SPAN, RATE = 240, 128, 48, 0.02
#: Windows and bytes that are worked on at once.
WINDOWS_AT_ONCE, BYTES_AT_ONCE = 1024, 1 << 20
#: A filter rejects documents whose pooled probability is below this many times an even share.
LEAST_SHARE = 1.1


class ByteGRU:
    """Two gated recurrent layers, one from each side, and a softmax over languages at every byte.

    The byte's embedding is folded into its input weights: x has a row for each
    byte and direction. z and r are gates, n the new state; sigmoids are written
    as tanh of half the sum.
    """

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages, self.units = languages, units
        scale = 1 / math.sqrt(units)
        self.p = {
            "x": rng.normal(0, 0.3, (2, 256, 3 * units)).astype(np.float32),
            "u": rng.uniform(-scale, scale, (2, units, 3 * units)).astype(np.float32),
            "o": rng.uniform(-scale, scale, (2 * units, len(languages))).astype(np.float32),
            "c": np.zeros(len(languages), np.float32),
        }

    def _states(self, codes: np.ndarray, keep: list) -> np.ndarray:
        """States (direction, step, window, unit) over codes (step, window), in the order of the text; keep gets each step's parts."""
        steps, windows = codes.shape
        h_n, x, u = self.units, self.p["x"], self.p["u"]
        both = np.stack([codes, codes[::-1]])
        out = np.empty((2, steps, windows, h_n), np.float32)
        h = np.zeros((2, windows, h_n), np.float32)
        sides = np.arange(2)[:, None]
        for t in range(steps):
            a = np.matmul(h, u)
            g = x[sides, both[:, t]]
            zr = g[..., : 2 * h_n] + a[..., : 2 * h_n]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[..., :h_n], zr[..., h_n:]
            n = np.tanh(g[..., 2 * h_n :] + r * a[..., 2 * h_n :])
            new = n + z * (h - n)
            keep.append((h, z, r, n, a[..., 2 * h_n :]))
            h = new
            out[0, t], out[1, steps - 1 - t] = h
        return out

    def position_probabilities(self, codes: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """(step, window, language): the label of every byte as probabilities.

        The same states as _states() gives, in buffers that are used again.
        """
        steps, windows = codes.shape
        h_n = self.units
        x_gate, x_new = (np.ascontiguousarray(v) for v in (0.5 * self.p["x"][..., : 2 * h_n], self.p["x"][..., 2 * h_n :]))
        u_gate, u_new = (np.ascontiguousarray(v) for v in (0.5 * self.p["u"][..., : 2 * h_n], self.p["u"][..., 2 * h_n :]))
        out = np.empty((2, steps, windows, h_n), np.float32)
        h = np.zeros((2, windows, h_n), np.float32)
        gate, more = np.empty((2, windows, 2 * h_n), np.float32), np.empty((2, windows, 2 * h_n), np.float32)
        new, an = np.empty_like(h), np.empty_like(h)
        for t in range(steps):
            for side, at in ((0, t), (1, steps - 1 - t)):
                np.take(x_gate[side], codes[at], axis=0, out=gate[side], mode="clip")
                np.take(x_new[side], codes[at], axis=0, out=new[side], mode="clip")
                np.dot(h[side], u_gate[side], out=more[side])
                np.dot(h[side], u_new[side], out=an[side])
            gate += more
            np.tanh(gate, out=gate)
            gate += 1
            gate *= 0.5
            an *= gate[..., h_n:]
            new += an
            np.tanh(new, out=new)
            h -= new
            h *= gate[..., :h_n]
            h += new
            if mask is not None:  # before the end of a short window the state of the backward side stays zero
                h[0] *= mask[t][:, None]
                h[1] *= mask[steps - 1 - t][:, None]
            out[0, t], out[1, steps - 1 - t] = h
        return self._softmax(out)

    def _softmax(self, states: np.ndarray) -> np.ndarray:
        h_n = self.units
        logits = states[0] @ self.p["o"][:h_n] + states[1] @ self.p["o"][h_n:] + self.p["c"]
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all bytes, and its gradients by backpropagation through time."""
        steps, windows = codes.shape
        h_n, keep = self.units, []
        states = self._states(codes, keep)
        prob = self._softmax(states)
        at = (slice(None), np.arange(windows), labels)
        loss = float(-np.log(prob[at] + 1e-9).mean())
        delta = prob.copy()
        delta[at] -= 1
        delta /= steps * windows
        flat = delta.reshape(-1, delta.shape[-1])
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["c"] = flat.sum(axis=0)
        grads["o"] = np.concatenate([states[s].reshape(-1, h_n).T @ flat for s in (0, 1)])
        into = np.stack([delta @ self.p["o"][:h_n].T, delta @ self.p["o"][h_n:].T])
        both = np.stack([codes, codes[::-1]])
        dh = np.zeros((2, windows, h_n), np.float32)
        gates = np.empty((steps, 2, windows, 3 * h_n), np.float32)
        for t in reversed(range(steps)):
            h, z, r, n, an = keep[t]
            d = dh + np.stack([into[0, t], into[1, steps - 1 - t]])
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (h - n) * z * (1 - z)
            dr = dn * an * r * (1 - r)
            gates[t] = np.concatenate([dz, dr, dn], axis=-1)
            da = np.concatenate([dz, dr, dn * r], axis=-1)
            grads["u"] += np.matmul(h.transpose(0, 2, 1), da)
            dh = d * z + np.matmul(da, self.p["u"].transpose(0, 2, 1))
        for side in (0, 1):
            np.add.at(grads["x"][side], both[side].ravel(), gates[:, side].reshape(-1, 3 * h_n))
        return loss, grads

    def fit(self, samples: list[tuple[bytes, int]], steps: int = STEPS, batch: int = BATCH, span: int = TRAIN_SPAN, rate: float = RATE, seed: int = 5) -> ByteGRU:
        """Adam over windows drawn from the samples, each language as often as the others."""
        rng = np.random.default_rng(seed)
        groups = [[np.frombuffer(t, np.uint8) for t, k in samples if k == lang and len(t)] for lang in range(len(self.languages))]
        have = [k for k, g in enumerate(groups) if g]
        if len(have) < 2:
            return self
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            labels = rng.choice(have, batch)
            codes = np.empty((span, batch), np.uint8)
            for j, k in enumerate(labels):
                text = groups[k][rng.integers(len(groups[k]))]
                start = rng.integers(max(1, len(text) - span + 1))
                codes[:, j] = np.resize(text[start : start + span], span)
            _, grads = self.gradients(codes, labels)
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                np.clip(g, -1, 1, out=g)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.p[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        return self

    def pooled(self, texts: list[bytes], span: int = SPAN) -> np.ndarray:
        """(text, language): the mean of the probabilities over all bytes of each text; empty texts are zeros.

        A text is read in windows of span bytes, all of them, whatever its length.
        """
        out = np.zeros((len(texts), len(self.languages)))
        held, size = [], 0
        for k, text in enumerate(texts):
            held.append(k)
            size += len(text)
            if size >= BYTES_AT_ONCE or k == len(texts) - 1:
                out[held] = self._pool([texts[i] for i in held], span)
                held, size = [], 0
        return out

    def _pool(self, texts: list[bytes], span: int) -> np.ndarray:
        sizes = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer(b"".join(texts) + bytes(span), np.uint8)
        count = -(-sizes // span)
        owner = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = (np.cumsum(sizes) - sizes)[owner] + nth * span
        length = np.minimum(span, sizes[owner] - nth * span)
        order = np.argsort(-length, kind="stable")
        sums = np.zeros((len(order), len(self.languages)))
        for at in range(0, len(order), WINDOWS_AT_ONCE):
            some = order[at : at + WINDOWS_AT_ONCE]
            most = int(length[some[0]])
            mask = None
            if length[some[-1]] < most:
                mask = (np.arange(most)[:, None] < length[some]).astype(np.float32)
            prob = self.position_probabilities(codes[start[some] + np.arange(most)[:, None]], mask)
            if mask is not None:
                prob *= mask[..., None]
            sums[some] = prob.sum(axis=0)
        out = np.zeros((len(texts), len(self.languages)))
        np.add.at(out, owner, sums)
        return out / np.maximum(sizes, 1)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and its pooled probability; und without a letter."""
        has = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if has and self.languages:
            pooled = self.pooled([texts[k].encode("utf-8", "surrogatepass") for k in has])
            for k, row in zip(has, pooled, strict=True):
                best = int(row.argmax())
                labels[k], scores[k] = self.languages[best], float(min(1.0, row[best]))
        return labels, scores


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is a multiple of 5, and for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> ByteGRU:
    """A network fitted on a bounded sample of the labelled documents that are not held out.

    The languages and their counts come from all rows; of each language about
    `sample` documents are drawn by the hash of their id, and `chars` characters of
    each. Without labelled rows the network knows no language.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return ByteGRU([])
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = F.lit(False)
    for lang in languages:
        drawn = drawn | ((F.col("lang") == lang) & (F.col("share") < 1.3 * sample / counts[lang]))
    room = F.greatest(F.length("text") - chars, F.lit(0)) + 1
    start = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("place")), room.cast("long")) + 1
    some = own.withColumn("share", share).where(drawn & (F.length("text") > 0)).select("lang", "share", F.substring(F.col("text"), start.cast("int"), F.lit(chars)).alias("part"))
    rows = some.orderBy("share", "lang", "part").limit(2 * sample * len(languages)).collect()
    return ByteGRU(languages).fit([(r["part"].encode("utf-8", "surrogatepass"), languages.index(r["lang"])) for r in rows])


def predicted(docs: DataFrame, model: ByteGRU, text: str) -> DataFrame:
    """docs(doc_id, held_out, text) with lang_pred and score in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("language network", dict)
        for batch in batches:
            labels, scores = model.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "held_out", text).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: ByteGRU | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    The network labels every byte of the whole text; a document's probabilities
    are the mean over its bytes. lang_pred is a language of the labelled rows, or
    und with score 0 where the text is null or has no letter or nothing could be
    learned. lang and id only choose what is learned from. Rows with a null id are
    held out. Repeated rows each give a row; an empty table none. Other columns
    are ignored.
    """
    bound_batches(docs.sparkSession)
    model = model or train(docs, id_col, text_col, lang_col)
    own = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return predicted(own, model, "text")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_share: float = LEAST_SHARE) -> DataFrame:
    """docs without texts in no language: und, or a best probability hardly above an even share; all columns kept.

    Where no row has a label nothing can be told apart, and only texts without a letter go.
    """
    bound_batches(docs.sparkSession)
    model = train(docs, id_col, text_col, lang_col)
    least = least_share / len(model.languages) if len(model.languages) > 1 else 0.0
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("language network", dict)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            if model.languages:
                keep = [label != UNKNOWN and score >= least for label, score in zip(*model.predict(texts), strict=True)]
            else:
                keep = [bool(t) and any(map(str.isalpha, t)) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))

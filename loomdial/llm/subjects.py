"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs.

Labelled documents (a bounded sample) are featurised once and spread over PARTS partitions. Every round each partition makes one pass of
mini-batch descent from the shared weights; the changes are averaged on the driver, whose share is a constant (PARTS times the
model). Then every document is scored in Arrow batches, each with the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdial.functions.text import half_width
from loomdial.session import checkpointed

#: Most labelled documents that a model is fitted on (by hash of the id), partitions of the training, hashed features, width, rounds.
SAMPLE, PARTS, FEATURES, WIDTH, ROUNDS = 24_000, 8, 1 << 16, 16, 10
#: Labelled documents that make a partition of their own worthwhile.
PART_ROWS = 3000
#: Step, documents of a mini-batch, share of features left out of each pass, every how many-th labelled document is held out to choose the threshold.
RATE, BATCH, DROP, HELD_OUT = 1.0, 16, 0.5, 8
#: The subject areas are outputs of one model; more of them are an error.
MAX_SUBJECTS = 10_000
THRESHOLDS = (0.03, 0.04, 0.05, 0.06, 0.08, 0.1, 0.12, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5)

_WORD = re.compile(r"[^\W\d_一-龥]+(?:[-'][^\W\d_一-龥]+)*")
_RUN = re.compile("[一-龥]+")


def features(text: str) -> np.ndarray:
    """Hashes of the runs of 2 and 3 Han characters, of words of other scripts and word pairs, and of the words' runs of 5 letters. Without any: empty."""
    found = []
    han = "\0".join(_RUN.findall(text))
    if han:
        c = np.frombuffer(han.encode("utf-16-le"), dtype=np.uint16).astype(np.uint32)
        for n in (2, 3):
            if len(c) >= n:
                h, ok = np.full(len(c) - n + 1, n, dtype=np.uint32), np.ones(len(c) - n + 1, dtype=bool)
                for k in range(n):
                    part = c[k : k + len(h)]
                    h = (h ^ part) * np.uint32(0x01000193)
                    h ^= h >> np.uint32(13)
                    ok &= part != 0
                found.append(h[ok])
    words = _WORD.findall(text)
    if words:
        keys = [*words, *(f"{a} {b}" for a, b in zip(words, words[1:])), *(f"<{w[i : i + 5]}" for w in words if len(w) > 5 for i in range(len(w) - 4))]
        found.append(np.fromiter((_text_hash(k) for k in keys), dtype=np.uint32, count=len(keys)))
    if not found:
        return np.zeros(0, np.uint16)
    h = np.concatenate(found)
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def _text_hash(s: str) -> int:
    import zlib

    return zlib.crc32(s.encode())


class Model:
    """Embeddings, output weights and biases."""

    def __init__(self, outputs: int, features: int = FEATURES, width: int = WIDTH, seed: int = 3):
        r = np.random.default_rng(seed)
        self.e = r.uniform(-1 / width, 1 / width, (features, width)).astype(np.float32)
        self.w = r.normal(0, 1, (outputs, width)).astype(np.float32)
        self.b = np.full(outputs, -2.0, dtype=np.float32)
        self.seen = np.full(features, 1e-8, dtype=np.float32)  # squared gradients so far, by feature and for the outputs
        self.seen_w = np.full((outputs, width), 1e-2, dtype=np.float32)

    def arrays(self) -> list[np.ndarray]:
        return [self.e, self.w, self.b, self.seen, self.seen_w]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> Model:
        m = object.__new__(cls)
        m.e, m.w, m.b, m.seen, m.seen_w = (x.copy() for x in arrays)
        return m

    def hidden(self, rows: list[np.ndarray]) -> np.ndarray:
        flat = np.concatenate(rows)
        begins = np.concatenate([[0], np.cumsum([len(r) for r in rows])])[:-1]
        return np.add.reduceat(self.e[flat], begins, axis=0) / np.array([len(r) for r in rows], dtype=np.float32)[:, None]

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probability of every output; rows without features have none."""
        out = np.zeros((len(rows), len(self.b)), dtype=np.float32)
        some = [i for i, r in enumerate(rows) if len(r)]
        if some:
            out[some] = 1 / (1 + np.exp(-(self.hidden([rows[i] for i in some]) @ self.w.T + self.b)))
        return out

    def train(self, rows: list[np.ndarray], wanted: np.ndarray, rate: float, seed: int) -> None:
        """One pass of mini-batches."""
        rng = np.random.default_rng(seed)
        rows = [r[rng.random(len(r)) >= DROP] for r in rows]
        order = rng.permutation([i for i, r in enumerate(rows) if len(r)]).astype(int)
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            batch = [rows[i] for i in some]
            h = self.hidden(batch)
            wrong = 1 / (1 + np.exp(-(h @ self.w.T + self.b))) - wanted[some]
            back = wrong @ self.w
            gw = wrong.T @ h
            self.seen_w += gw * gw
            self.w -= 0.5 * rate * gw / np.sqrt(self.seen_w)
            self.b -= 0.05 * rate * wrong.sum(axis=0)
            counts = np.array([len(r) for r in batch], dtype=np.float32)
            flat = np.concatenate(batch)
            step = np.repeat(back / counts[:, None], counts.astype(int), axis=0)
            used, of = np.unique(flat, return_inverse=True)
            gradient = np.zeros((len(used), self.e.shape[1]), dtype=np.float32)
            np.add.at(gradient, of, step)
            self.seen[used] += (gradient * gradient).mean(axis=1)
            self.e[used] -= rate * gradient / np.sqrt(self.seen[used])[:, None]


def _merge(arrays: list[np.ndarray], changes: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Add the mean change; a feature's change is the mean over the partitions that met it."""
    out = []
    for k, x in enumerate(arrays):
        parts = [c[k] for c in changes]
        total = np.sum(parts, axis=0)
        met = sum((np.abs(p).reshape(len(p), -1).max(axis=1) > 0).astype(np.float32) for p in parts)
        out.append(x + total / np.maximum(met, 1).reshape(-1, *[1] * (x.ndim - 1)))
    return out


class SubjectClassifier:
    """Fitted on labels (doc_id, subject_id; 0: no subject) of documents (doc_id, text); subjects are the rows of subject_areas (subject_id).

    Null ids, labels of unknown subjects and labels without a document are left out; without labelled documents nothing is assigned.
    """

    def __init__(self, documents: DataFrame, labels: DataFrame, areas: DataFrame, rounds: int = ROUNDS):
        spark = documents.sparkSession
        self.subjects = sorted(r[0] for r in areas.select("subject_id").where("subject_id is not null").distinct().limit(MAX_SUBJECTS + 1).collect())
        if len(self.subjects) > MAX_SUBJECTS:
            raise ValueError(f"more than {MAX_SUBJECTS} subject areas")
        index = {s: k for k, s in enumerate(self.subjects)}
        known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set("subject_id").alias("wanted"))
        chosen = known.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(SAMPLE)  # the bounded sample
        rows = documents.where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", _plain("text").alias("text"), "wanted").dropDuplicates(["doc_id"])

        def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                wanted = [np.array([index[s] for s in w if s in index], dtype=np.int16).tobytes() for w in batch["wanted"]]
                yield pd.DataFrame({"doc_id": batch["doc_id"], "features": [features(t).tobytes() for t in batch["text"]], "wanted": wanted})

        ready = rows.mapInPandas(featurise, "doc_id bigint, features binary, wanted binary")
        ready = checkpointed(ready.withColumn("held_out", F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(HELD_OUT)) == 0))
        parts = max(1, min(PARTS, ready.count() // PART_ROWS))  # few labels stay together, so that each pass sees enough of them
        ready = checkpointed(ready.repartition(parts, "doc_id")) if parts > 1 else checkpointed(ready.coalesce(1))
        self.threshold, self.model = 0.5, None
        if not self.subjects or ready.isEmpty():
            return
        n = len(self.subjects)

        def unpack(batches: Iterator[pd.DataFrame]):
            whole = pd.concat([*batches, pd.DataFrame({"features": [], "wanted": []})])
            wanted = np.zeros((len(whole), n), dtype=np.float32)
            for k, w in enumerate(whole["wanted"]):
                wanted[k, np.frombuffer(w, dtype=np.int16)] = 1
            return [np.frombuffer(f, dtype=np.uint16) for f in whole["features"]], wanted

        arrays = Model(n).arrays()
        fit_on = ready.where("not held_out").select("features", "wanted")
        for turn in range(rounds):
            sent = spark.sparkContext.broadcast(arrays)
            rate = RATE * (1 - turn / (rounds + 1))

            def one_pass(batches: Iterator[pd.DataFrame], sent=sent, rate=rate, turn=turn) -> Iterator[pd.DataFrame]:
                own, wanted = unpack(batches)
                if own:
                    m = Model.of(sent.value)
                    m.train(own, wanted, rate, turn)
                    yield pd.DataFrame({"change": [b"".join((x - y).astype(np.float32).tobytes() for x, y in zip(m.arrays(), sent.value))]})

            changes = []
            for r in fit_on.mapInPandas(one_pass, "change binary").collect():  # at most PARTS changes of the model's size
                flat, at, parts = np.frombuffer(r[0], dtype=np.float32), 0, []
                for x in arrays:
                    parts.append(flat[at : at + x.size].reshape(x.shape))
                    at += x.size
                changes.append(parts)
            if changes:
                arrays = [x.astype(np.float32) for x in _merge(arrays, changes)]
            sent.unpersist()
        self.model = spark.sparkContext.broadcast(arrays)
        model = self.model

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, wanted = unpack(batches)
            if own:
                p = Model.of(model.value).scores(own)
                yield pd.DataFrame([(t, int(((p >= t) & (wanted > 0)).sum()), int((p >= t).sum()), int((wanted > 0).sum())) for t in THRESHOLDS], columns=["t", "hit", "given", "wanted"])

        held = ready.where("held_out").select("features", "wanted").mapInPandas(judge, "t double, hit bigint, given bigint, wanted bigint")
        self.quality = held.groupBy("t").agg(*[F.sum(c).alias(c) for c in ("hit", "given", "wanted")]).orderBy("t").collect()
        best = max(self.quality, key=lambda r: (r["hit"] / max(1, r["given"] + r["wanted"]), r["t"]), default=None)
        self.threshold = best["t"] if best else 0.15

    def assign(self, documents: DataFrame) -> DataFrame:
        """doc_id, subject_id, score of every subject that a document reaches; null texts and texts without features have none."""
        if self.model is None:
            return documents.select("doc_id", F.lit(0).alias("subject_id"), F.lit(0.0).alias("score")).limit(0)
        model, threshold, subjects = self.model, self.threshold, np.array(self.subjects)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = Model.of(model.value)
            for batch in batches:
                for at in range(0, len(batch), 256):
                    part = batch.iloc[at : at + 256]
                    p = m.scores([features(t) for t in part["text"]])
                    row, col = np.nonzero(p >= threshold)
                    yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[row], "subject_id": subjects[col], "score": p[row, col].astype(float)})

        return documents.where("doc_id is not null and text is not null").select("doc_id", _plain("text").alias("text")).mapInPandas(score, "doc_id bigint, subject_id int, score double")


def _plain(text: str):
    return F.lower(half_width(F.col(text)))


def composition(assigned: DataFrame, documents: DataFrame) -> DataFrame:
    """subject_id, documents, permille of all documents; subject 0: documents without a subject."""
    per_document = documents.select("doc_id").join(assigned.select("doc_id", "subject_id"), "doc_id", "left").select(F.coalesce("subject_id", F.lit(0)).alias("subject_id"), "doc_id")
    total = documents.agg(F.count("*").alias("_n"))
    return per_document.groupBy("subject_id").agg(F.count("*").alias("documents")).join(F.broadcast(total)).withColumn("permille", F.round(F.try_divide(F.col("documents") * 1000.0, F.col("_n")), 3)).drop("_n")

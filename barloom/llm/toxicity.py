"""Toxicity scores: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Training: every labelled document contributes its distinct n-grams (hashed) to counts per class. The smoothed log ratio of
the two classes' rates is the scale of an n-gram; the n-grams with the strongest evidence are the features. A logistic
model on the scaled presence of features is then fitted to a bounded sample of labelled documents. Scoring needs one pass
over the texts and no shuffle; the model has a fixed size.

Null and empty texts have no n-grams and get the score of the intercept. Whole texts are read, however long. Labels: null
ids or labels are ignored, and where an id is labelled several times the largest label counts. Without labels of both
classes every score is the share of toxic labels, 0 if there are none. Repeated rows get equal scores. Other columns are
never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import arrow_pass, join_checked
from barloom.llm.words import mix

#: Lengths of n-grams in characters, and slots they are hashed to.
GRAMS = (3, 4, 5, 6)
SLOTS = 1 << 20
#: Features of the model.
FEATURES = 6_000
#: Labelled documents the logistic model is fitted to; the counts behind the ratios take all of them.
SAMPLE = 10_000
SMOOTHING = 1.0
PENALTY = 2e-4
STEPS = 150
#: Characters taken at once; neighbouring parts overlap, so no n-gram is lost.
PART = 1 << 22
THRESHOLD = 0.3


def grams(text: str | None):
    """Slots of all n-grams of the lower-cased text, in arrays that may repeat slots."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    odd = mix(np.arange(1, max(GRAMS) + 1, dtype=np.uint64)) | np.uint64(1)
    for begin in range(0, len(points), PART):
        part = points[begin:begin + PART + max(GRAMS) - 1].astype(np.uint64)
        total = np.zeros(len(part), np.uint64)
        for k in range(max(GRAMS)):
            size = min(len(part) - k, PART)
            if size <= 0:
                break
            total = total[:size] + part[k:k + size] * odd[k]
            if k + 1 in GRAMS:
                x = (total ^ total >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
                yield (x >> np.uint64(44)).astype(np.int64)


@dataclass
class Model:
    """Slot weights (log-count ratio times coefficient) and the intercept."""

    slots: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        """Feature number of each slot, -1 for none."""
        numbers = np.full(SLOTS, -1, np.int16)
        numbers[self.slots] = np.arange(len(self.slots))
        return numbers

    def score(self, text: str | None, numbers: np.ndarray) -> float:
        found = features(text, numbers)
        return float(1 / (1 + np.exp(-(self.intercept + self.weights[found].sum()))))


def features(text: str | None, numbers: np.ndarray) -> np.ndarray:
    """Distinct features that a text has."""
    parts = []
    for slot in grams(text):
        number = numbers[slot]
        parts.append(number[number >= 0])
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int16)


def counts(labelled: DataFrame, text: str = "text", label: str = "toxic") -> DataFrame:
    """slot, ``toxic``, ``clean``: documents of each class that have the n-gram; added up per task before the shuffle."""

    def run(batches):
        total = np.zeros((2, SLOTS), np.int64)
        seen = np.zeros(SLOTS, bool)
        sizes = [0, 0]
        for batch in batches:
            for value, kind in zip(batch.column(0), batch.column(1).to_pylist()):
                for slot in grams(value.as_py()):
                    seen[slot] = True
                slots = np.flatnonzero(seen)
                seen[slots] = False
                total[kind, slots] += 1
                sizes[kind] += 1
        slots = np.flatnonzero(total.any(0))
        for names, clean, toxic in ((np.array([-1]), *([x] for x in sizes)), (slots, total[0, slots], total[1, slots])):
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], ["slot", "clean", "toxic"])

    found = arrow_pass(labelled.select(text, F.col(label).cast("int")), run, "slot bigint, clean bigint, toxic bigint")
    return found.groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _fit(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients of the scaled features and the intercept: accelerated gradient steps with diagonal scaling."""
    at = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    value = scale[at].astype(np.float32)
    n, m = len(rows), len(scale)
    rate = labels.mean()
    w, b = np.zeros(m), float(np.log(rate / (1 - rate)))
    momentum, memory, memory_b, velocity, velocity_b = 0.9, np.full(m, 1e-12), 1e-12, np.zeros(m), 0.0
    for step in range(STEPS):
        z = b + np.bincount(row, value * w[at], n)
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        gradient = np.bincount(at, value * error[row], m) / n + PENALTY * w
        gradient_b = error.mean()
        memory, memory_b = 0.95 * memory + 0.05 * gradient**2, 0.95 * memory_b + 0.05 * gradient_b**2
        velocity, velocity_b = momentum * velocity + gradient / np.sqrt(memory), momentum * velocity_b + gradient_b / np.sqrt(memory_b)
        speed = 0.01 / (1 + step / 30)
        w -= speed * velocity
        b -= speed * velocity_b
    return w, b


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic") -> Model:
    """Fit to the documents that ``labels`` (doc_id and ``label``) marks."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("__label"))
    labelled = join_checked(docs.select("doc_id", F.col(text).alias("__text")), known, ["doc_id"], "inner")
    counted = counts(labelled, "__text", "__label").persist()
    total = counted.where("slot = -1").first()
    if total is None or not total["toxic"] or not total["clean"]:
        counted.unpersist()
        share = 0.0 if total is None or not total["toxic"] else total["toxic"] / (total["toxic"] + total["clean"])
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    toxic, clean = F.col("toxic") + SMOOTHING, F.col("clean") + SMOOTHING
    ratio = F.log(toxic / (total["toxic"] + 2 * SMOOTHING)) - F.log(clean / (total["clean"] + 2 * SMOOTHING))
    spread = F.sqrt(1 / toxic + 1 / clean)
    best = counted.where("slot >= 0").select("slot", ratio.alias("ratio"), F.abs(ratio / spread).alias("evidence"))
    picked = best.orderBy(F.desc("evidence"), "slot").limit(FEATURES).collect()  # at most FEATURES rows
    counted.unpersist()
    slots, scale = np.array([r["slot"] for r in picked], np.int64), np.array([r["ratio"] for r in picked])
    sent = docs.sparkSession.sparkContext.broadcast(Model(slots, scale, 0.0))

    def run(batches):
        numbers = sent.value.table()
        for batch in batches:
            found = [features(value.as_py(), numbers).tobytes() for value in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["found", "label"])

    size = total["toxic"] + total["clean"]
    order = F.xxhash64(F.col("doc_id"), F.lit(11))
    sample = labelled if size <= SAMPLE else labelled.where(F.pmod(order, F.lit(1 << 20)) < int(SAMPLE / size * (1 << 20)))
    rows = arrow_pass(sample.select("__text", "__label"), run, "found binary, label int").collect()  # about SAMPLE short rows at most
    given = np.array([r["label"] for r in rows], float)
    if not 0 < given.sum() < len(given):
        share = total["toxic"] / size
        return Model(slots, scale / max(1, len(scale)), float(np.log(share / (1 - share))))
    w, b = _fit([np.frombuffer(r["found"], np.int16) for r in rows], given, scale)
    return Model(slots, w * scale, b)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``out``, 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    place = keep.index(text) if text in keep else len(keep)

    def run(batches):
        numbers = sent.value.table()
        for batch in batches:
            scores = [sent.value.score(value.as_py(), numbers) for value in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(scores, pa.float64())], [*keep, out])

    types = dict(docs.dtypes)
    return arrow_pass(docs.select(*dict.fromkeys([*keep, text])), run, ", ".join(f"`{c}` {types[c]}" for c in keep) + f", `{out}` double")


def held_out(doc_id: str = "doc_id"):
    """True for the quarter of documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """All columns of the rows of ``docs`` whose score stays below the threshold."""
    model = train(docs, labels.where(~held_out()), text)
    names = docs.columns
    scored = score(docs, model, text, "__score", tuple(names))
    return scored.where(F.col("__score") < threshold).select(*names)

"""Toxicity by class-conditional Kneser-Ney models.

One interpolated Kneser-Ney model of words per class (toxic, ordinary).  A word
is read along a chain of ever longer beginnings (``STEMS`` letters, then the
whole word).  At each step of the chain the class's counts of what may follow
are discounted, and exactly the mass that the discounts take off is spread by
continuation counts which both classes share: in how many different words, of
either class, the longer beginning occurs.  Where a class has never been, the
shared counts decide alone, so an expression that is rare in both classes costs
both the same.  Every step is a distribution (one share is kept for what neither
class has seen), and so is the chain.  Counts are of different words per
document, so one document that repeats itself weighs no more than any.

A toxic text is mostly ordinary words: ``EXPRESSED`` of its words are taken to
come from the toxic model and the others from the ordinary one.  A document is
scored by length-normalised log-likelihood ratios of that mixture against the
ordinary model: the mean over all its words, and the largest mean over
``WINDOW`` consecutive words, so a few toxic expressions are not diluted by a
long text.  A logistic rule turns the two into a probability; it is fitted on
ratios that models of the other half of the sample give, so the models' own
training texts do not flatter it.

Learning: at most ``SAMPLE`` labelled documents per class (a documented bound;
those with the smallest hashed ids), by distributed counts.  Of texts with the
same sketch (the least hash of their eight-word shingles, which near copies
mostly share) one is counted, lest a copied text's words look like a habit.
The model is all beginnings and words of the sampled texts, as 64-bit hashes
with counts; none is left out.  Every document is scored, whole: a run of more
than ``RUN`` letters without a break is read in overlapping pieces.

Defined cases: null, empty or wordless texts have ratio 0, as texts whose words
decide nothing; labels that are null are not learned from; without both classes
every score is the share of toxic labels (0 without labels); repeated rows give
repeated results; an empty table gives an empty table; further columns are
ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold, keep, smallest, table

STEMS = (3, 4, 5, 7)
STEPS = len(STEMS) + 1
EXPRESSED = 0.02  # share of a toxic text's words that its toxicity lies in
SKETCH = 8  # words of a shingle of the near-copy sketch
SAMPLE = 6000
WINDOW = 24
MEMO = 300_000  # ratios remembered per worker; a matter of speed only
RUN, PIECE = 32, 8  # letters without a break that are one word at most; letters of the pieces of a longer run
LETTERS = re.compile(r"[^\W_]+")
SLICE = 500
GROUPS = ("n00", "n01", "n10", "n11")  # counts by class (ordinary, toxic) and half


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits; a run above RUN as overlapping pieces that leave nothing out."""
    found = LETTERS.findall(text.lower())
    if max(map(len, found), default=0) <= RUN:
        return found
    out = []
    for w in found:
        out += [w] if len(w) <= RUN else [w[i : i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)]
    return out


def chain(word: str) -> list[str]:
    """The beginnings of a word, shortest first, and the word itself."""
    return [*[word[:k] for k in STEMS if k < len(word)], word + "$"]


def unit_hash(unit: str) -> int:
    v = xxhash.xxh64_intdigest(unit.encode("utf-8", "surrogatepass"))
    return v - (1 << 64) if v >= 1 << 63 else v


ROOT = unit_hash("")


def sketch(text: str) -> int:
    said = text.lower().split()
    return min((zlib.crc32(" ".join(said[i : i + SKETCH]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(said) - SKETCH + 1))), default=0)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [sketch(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.int64())], ["text", "toxic", "sketch"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, group, n): in how many texts of a class and half a word occurs."""
    seen: dict[tuple[int, str], int] = {}

    def out():
        yield pa.RecordBatch.from_arrays([pa.array([k[1] for k in seen], pa.string()), pa.array([k[0] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["word", "group", "n"])
        seen.clear()

    for batch in batches:
        for text, toxic, half in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            for w in set(words(text.as_py())):
                key = (2 * toxic + half, w)
                seen[key] = seen.get(key, 0) + 1
            if len(seen) > 500_000:
                yield from out()
    yield from out()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, parent, step, counts by class and half) along the chain of each different word."""
    for batch in batches:
        unit, parent, step, at = [], [], [], []
        for i, w in enumerate(batch.column(0).to_pylist()):
            above = ROOT
            for k, u in enumerate(chain(w)):
                h = unit_hash(u)
                unit.append(h)
                parent.append(above)
                step.append(STEPS if u[-1] == "$" else k)
                at.append(i)
                above = h
        own = [pa.array(c) for c in (unit, parent, step)] if unit else [pa.array([], pa.int64())] * 3
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([*own, *[batch.column(i).take(rows) for i in range(1, 5)]], ["unit", "parent", "step", *GROUPS])


class Model:
    """Both classes' chains over hashed units.

    ``unit`` is sorted; ``n``: per class, how often each unit occurs; ``types``:
    per class, in how many different next units it goes on; ``kinds``: in how
    many different words of either class it occurs.  Row ``root`` is the empty
    beginning.
    """

    def __init__(self, unit: np.ndarray, parent: np.ndarray, step: np.ndarray, n: list[np.ndarray]):
        unit, parent, step = np.r_[unit, ROOT], np.r_[parent, ROOT], np.r_[step, -1]
        order = np.argsort(unit)
        self.unit, step = unit[order], step[order]
        above = np.searchsorted(self.unit, parent[order])
        self.root = int(np.searchsorted(self.unit, ROOT))
        below = np.flatnonzero(step >= 0)
        self.kinds = (step == STEPS).astype(np.int64)
        for k in [STEPS, *range(STEPS - 1, -1, -1)]:
            at = np.flatnonzero(step == k)
            np.add.at(self.kinds, above[at], self.kinds[at])
        self.n, self.types, self.discount = [], [], []
        for own in n:
            own = np.r_[own, 0][order].astype(np.int64)
            own[self.root] = own[below][above[below] == self.root].sum()
            self.n.append(own)
            seen = below[own[below] > 0]
            self.types.append(np.bincount(above[seen], minlength=len(self.unit)))
            once, twice = int((own[below] == 1).sum()), int((own[below] == 2).sum())
            self.discount.append(once / (once + 2 * twice) if once else 0.5)  # Ney's estimate
        self.memo: dict[str, float] = {}

    def log_p(self, said: list[str]) -> np.ndarray:
        """Natural log probabilities, ordinary and toxic, of each word."""
        out = np.zeros((2, len(said)))
        ids = np.full((STEPS, len(said)), ROOT)  # ROOT: the chain has ended
        for j, w in enumerate(said):
            for i, u in enumerate(chain(w)):
                ids[i, j] = unit_hash(u)
        above, alive = np.full(len(said), self.root), np.ones(len(said), bool)
        for h in ids:
            at = np.minimum(np.searchsorted(self.unit, h), len(self.unit) - 1)
            known = self.unit[at] == h
            alive &= h != ROOT
            shared = np.where(known, self.kinds[at], 1) / (self.kinds[above] + 1)
            for y in (0, 1):
                total = self.n[y][above]
                own = np.where(known, np.maximum(self.n[y][at] - self.discount[y], 0), 0)
                p = np.where(total > 0, (own + self.discount[y] * self.types[y][above] * shared) / np.maximum(total, 1), shared)
                out[y] += np.where(alive, np.log(p), 0)
            alive &= known
            above = np.where(alive, at, above)
        return out

    def ratios(self, said: list[str]) -> np.ndarray:
        """log P(word | a toxic text) - log P(word | an ordinary text) of each word."""
        new = list({w for w in said if w not in self.memo})
        if new:
            if len(self.memo) + len(new) > MEMO:
                self.memo.clear()
                new = list(set(said))
            ordinary, toxic = self.log_p(new)
            self.memo.update(zip(new, np.log(1 - EXPRESSED + EXPRESSED * np.exp(np.minimum(toxic - ordinary, 500))).tolist(), strict=True))
        return np.fromiter((self.memo[w] for w in said), np.float64, len(said))

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: mean ratio per word, and the largest mean over a window of words."""
        said = [words(t) for t in texts]
        every = self.ratios([w for s in said for w in s])
        out, at = np.zeros((len(texts), 2)), 0
        for i, s in enumerate(said):
            if s:
                total = np.r_[0.0, np.cumsum(every[at : at + len(s)])]
                k = min(WINDOW, len(s))
                out[i] = total[-1] / len(s), (total[k:] - total[:-k]).max() / WINDOW
            at += len(s)
        return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic rule on standardised features; returned for the features as they are."""
    size = np.maximum(x.std(0), 1e-9)
    x = np.c_[np.ones(len(x)), x / size]
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (p - y) + ridge * np.r_[0, b[1:]]
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(hess, grad)
        b = b - step
        if np.abs(step).max() < 1e-9:
            break
    return np.r_[b[0], b[1:] / size]


_LOADED: dict[str, list[Model]] = {}


def _models(shared) -> list[Model]:
    value = shared.value
    if value["id"] not in _LOADED:
        _LOADED.clear()
        _LOADED[value["id"]] = [Model(*value["units"], n) for n in value["n"]]
    return _LOADED[value["id"]]


def learned(rows: DataFrame) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    """Units (hash, parent, step) and their counts by class and half, from (text, toxic, half); at most the words of the sample."""
    each = rows.mapInArrow(_counts, "word string, group int, n long").groupBy("word").agg(*[F.sum(F.when(F.col("group") == i, F.col("n")).otherwise(0)).alias(g) for i, g in enumerate(GROUPS)])
    every = each.mapInArrow(_units, "unit long, parent long, step long, n00 long, n01 long, n10 long, n11 long")
    every = every.groupBy("unit").agg(F.first("parent").alias("parent"), F.first("step").cast("int").alias("step"), *[F.sum(g).cast("int").alias(g) for g in GROUPS])
    got = keep(every, "toxic-units").toArrow()
    columns = [got.column(i).to_numpy() for i in range(7)]
    order = np.argsort(columns[0])  # reruns agree
    columns = [c[order] for c in columns]
    return columns[:3], dict(zip(GROUPS, columns[3:], strict=True))


def train(docs: DataFrame, labels: DataFrame, folds: int, out_fold: int, id_col: str, text_col: str, sample: int = SAMPLE):
    """Broadcast of the model and the logistic rule, or the share of toxic labels."""
    spark = docs.sparkSession
    known = labels.where((fold(F.col("doc_id"), folds) != out_fold) & F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    chosen = None
    for c in (0, 1):
        part = smallest(known.where(F.col("toxic") == c), "label_id", sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = keep(chosen, "toxic-sample")
    # at most 2 * sample labelled ids are broadcast
    texts = docs.select(F.col(f"`{id_col}`").alias("label_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "label_id").select("text", "toxic")
    rows = rows.mapInArrow(_sketched, "text string, toxic int, sketch long").withColumn("half", F.pmod(F.xxhash64("sketch", F.lit(5)), F.lit(2)).cast("int"))
    # the smallest text of a sketch, so that reruns agree
    rows = rows.groupBy("sketch", "toxic").agg(F.min("text").alias("text"), F.first("half").alias("half")).select("text", "toxic", "half")
    rows = keep(rows, "toxic-texts")
    units, n = learned(rows)
    if not all(c.any() for c in n.values()):
        return None, None, share
    halves = spark.sparkContext.broadcast({"id": uuid.uuid4().hex, "units": units, "n": [[n["n01"], n["n11"]], [n["n00"], n["n10"]]]})  # each half is scored by the other

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _models(halves)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                half, texts = batch.column(2).to_numpy(), batch.column(0).to_pylist()
                f = np.zeros((len(texts), 2))
                for h in (0, 1):
                    f[half == h] = models[h].features([t for t, own in zip(texts, half, strict=True) if own == h])
                yield pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1]), batch.column(1)], ["mean", "top", "toxic"])

    fit = rows.mapInArrow(crossed, "mean double, top double, toxic int").toArrow()  # two numbers a sampled document
    rule = _logistic(np.c_[fit.column(0).to_numpy(), fit.column(1).to_numpy()], fit.column(2).to_numpy())
    whole = spark.sparkContext.broadcast({"id": uuid.uuid4().hex, "units": units, "n": [[n["n00"] + n["n01"], n["n10"] + n["n11"]]]})
    return whole, rule, share


def score(docs: DataFrame, labels: DataFrame, folds: int = 4, out_fold: int = 2, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, mean_ratio, top_ratio."""
    whole, rule, share = train(docs, labels, folds, out_fold, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (fold(F.col(f"`{id_col}`"), folds) == out_fold).alias("held_out"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    if whole is None:
        flat = F.lit(float(share))
        return rows.select("doc_id", "held_out", flat.alias("score"), (flat >= least).cast("int").alias("predicted"), F.lit(0.0).alias("mean_ratio"), F.lit(0.0).alias("top_ratio"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (model,) = _models(whole)
        for all_rows in batches:
            for at in range(0, all_rows.num_rows, SLICE):
                batch = all_rows.slice(at, SLICE)
                f = model.features(batch.column(2).to_pylist())
                p = 1 / (1 + np.exp(-np.clip(rule[0] + f @ rule[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= least).astype(np.int32)), pa.array(f[:, 0]), pa.array(f[:, 1])], ["doc_id", "held_out", "score", "predicted", "mean_ratio", "top_ratio"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int, mean_ratio double, top_ratio double")


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text are its character-class trigrams (how letters, capitals, digits,
spaces, sentence marks and other signs follow each other), each ASCII sign by
itself, hashed words, and graded measures of repetition, word length and size.
Their TF-IDF weights are projected on the leading singular vectors of the
labelled sample.  Every document is compared with every labelled vector by exact
cosine products, block by block, and its ``NEIGHBOURS`` nearest vote with their
similarity as weight.

Learning: at most ``SAMPLE`` labelled documents (a documented bound; those with
the smallest hashed ids), so the broadcast is at most SAMPLE * DIMENSIONS
numbers.  Every document is scored, on its whole text; no exchange.

Defined cases: null or empty texts, and texts without any term the sample knows,
get the share of label 1; null labels are not learned from; without labels every
score is 0.5; ties between equally near neighbours go to the smaller hashed id;
repeated rows give repeated results; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold, keep, smallest, table

SAMPLE = 4000
DIMENSIONS = 64
NEIGHBOURS = 15
BLOCK = 512
DIGITS = 5  # decimals of a similarity; equal vectors tie whatever the order of floating-point sums
HASHED = 256
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
GRADES = 12
MEASURES = 5
TERMS = 512 + len(SIGNS) + HASHED + MEASURES * GRADES


def _classes() -> np.ndarray:
    """Class of each byte: letter, capital, digit, space, line end, sentence mark, other sign, control."""
    out = np.zeros(256, np.uint16)
    for b in range(128):
        c = chr(b)
        out[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c == "\n" else 3 if c in " \t\r\x0b\x0c" else 5 if c in ".,;:?!'\"()-" else 6 if b > 32 else 7
    return out


CLASSES = _classes()
SIGN_AT = np.full(256, -1)
SIGN_AT[np.frombuffer(SIGNS, np.uint8)] = np.arange(len(SIGNS))
SIGN_BYTES = np.frombuffer(SIGNS, np.uint8)


def terms(raw: bytes) -> np.ndarray:
    """Term frequencies of one text."""
    out = np.zeros(TERMS, np.float32)
    words = raw.split()
    if not words:
        return out
    seq = np.frombuffer(raw, np.uint8)
    kinds = CLASSES[seq]
    if len(kinds) > 2:
        out[:512] = np.bincount(kinds[:-2] * 64 + kinds[1:-1] * 8 + kinds[2:], minlength=512)[:512]
    at = 512
    out[at : at + len(SIGNS)] = np.bincount(seq, minlength=256)[SIGN_BYTES]
    at += len(SIGNS)
    counted = Counter(words)
    for w, n in counted.items():
        out[at + zlib.crc32(w.lower()) % HASHED] += n
    at += HASHED
    n = len(words)
    again = sum(map(bytes.__eq__, words, words[1:])) / max(1, n - 1)
    distinct = len(counted) / n
    top = max(counted.values()) / n
    mean = len(raw) / n
    measures = (again, min(1.0, distinct), top, min(1.0, mean / 24), min(1.0, np.log2(n + 1) / 15))
    for m, v in enumerate(measures):  # a soft one-of-GRADES code, weighted by the text's own size
        place = v * (GRADES - 1)
        low = int(place)
        out[at + m * GRADES + low] += (1 - (place - low)) * n
        if low + 1 < GRADES:
            out[at + m * GRADES + low + 1] += (place - low) * n
    return out


def _weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    size = np.maximum(1.0, tf[:, :512].sum(1, keepdims=True))
    x = np.sqrt(tf / size) * idf
    return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Per row the columns of the ``k`` largest values; of equal ones those that come first."""
    least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
    above, tied = near > least, near == least
    chosen = above | tied & (np.cumsum(tied, axis=1) <= k - above.sum(1, keepdims=True))
    return np.nonzero(chosen)[1].reshape(-1, k)


class Space:
    """Latent-semantic space of a labelled sample, and its voting rule."""

    def __init__(self, tf: np.ndarray, label: np.ndarray):
        seen = (tf > 0).sum(0)
        self.idf = (np.log((1 + len(tf)) / (1 + seen)) + 1).astype(np.float32) * (seen > 0)
        x = _weighted(tf, self.idf)
        values, vectors = np.linalg.eigh(x.T @ x)
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :DIMENSIONS]).astype(np.float32)
        # fixed signs, so that reruns agree
        self.basis *= np.where(self.basis[np.abs(self.basis).argmax(0), np.arange(self.basis.shape[1])] < 0, -1, 1)
        self.known = _unit(x @ self.basis).astype(np.float32)
        self.label = label.astype(np.float32)
        self.share = float(label.mean())

    def score(self, tf: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by similarity, drawn a little to the sample's share."""
        out = np.full(len(tf), self.share)
        k = min(NEIGHBOURS, len(self.known))
        for at in range(0, len(tf), BLOCK):
            part = tf[at : at + BLOCK]
            q = _unit(_weighted(part, self.idf) @ self.basis)
            near = np.round(q @ self.known.T, DIGITS)
            pick = nearest(near, k)
            w = np.maximum(0, np.take_along_axis(near, pick, 1)) ** 8
            vote = (w * self.label[pick]).sum(1) + 0.05 * self.share
            has = part.sum(1) > 0
            out[at : at + BLOCK] = np.where(has, vote / (w.sum(1) + 0.05), self.share)
        return np.clip(out, 0, 1)


def train(docs: DataFrame, labels: DataFrame, folds: int, out_fold: int, id_col: str, text_col: str, sample: int = SAMPLE) -> Space | None:
    known = labels.where((fold(F.col("doc_id"), folds) != out_fold) & F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    chosen = keep(smallest(known, "label_id", sample), "quality-sample")
    # at most ``sample`` labelled ids are broadcast
    texts = docs.select(F.col(f"`{id_col}`").alias("label_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    rows = texts.join(F.broadcast(chosen), "label_id").select("label_id", "text", "quality", F.pmod(F.xxhash64("label_id"), F.lit(1 << 40)).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tf = [terms(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(tf, pa.list_(pa.float32()))], ["label_id", "quality", "rank", "tf"])

    got = rows.mapInArrow(run, f"label_id {dict(rows.dtypes)['label_id']}, quality int, rank long, tf array<float>").toArrow()  # at most ``sample`` rows of TERMS numbers
    if not got.num_rows:
        return None
    got = got.sort_by([("rank", "ascending"), ("label_id", "ascending")])  # the order ties go by
    return Space(got.column("tf").combine_chunks().flatten().to_numpy().reshape(-1, TERMS), got.column("quality").to_numpy())


def score(docs: DataFrame, labels: DataFrame, folds: int = 3, out_fold: int = 1, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, and the columns named in ``carry``."""
    space = train(docs, labels, folds, out_fold, id_col, text_col)
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), (fold(F.col(f"`{id_col}`"), folds) == out_fold).alias("held_out"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("scored text"), *[F.col(f"`{c}`").alias(f"kept {c}") for c in carry],
    )
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            space = shared.value
            if space is None:
                p = np.full(batch.num_rows, 0.5)
            else:
                p = np.concatenate([space.score(np.stack([terms(t.as_py()) for t in batch.column(2).slice(at, BLOCK)])) for at in range(0, batch.num_rows, BLOCK)] or [np.zeros(0)])
            kept = [batch.column(i) for i in range(3, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p.astype(np.float64)), pa.array((p >= least).astype(np.int32)), *kept], ["doc_id", "held_out", "score", "predicted", *[f"kept {c}" for c in carry]])

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"doc_id {kinds['doc_id']}", "held_out boolean", "score double", "predicted int", *[f"`kept {c}` {kinds[f'kept {c}']}" for c in carry]])
    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose score is at least ``least``, all columns whole."""
    names = tuple(docs.columns)
    found = score(docs, labels, least=least, id_col=id_col, text_col=text_col, carry=names)
    return found.where("predicted = 1").select(*[F.col(f"`kept {c}`").alias(c) for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

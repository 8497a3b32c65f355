"""Language-model scoring: prediction by partial matching (PPM) over bytes.

Model: a trie of byte contexts up to ``ORDER`` symbols.  A symbol seen in the
longest known context gets its share there; otherwise the context's escape
estimate (as many escape counts as it has distinct symbols) is paid and the next
shorter context is asked, leaving out the symbols the longer one has already
excluded.  Texts start after ``ORDER`` start marks and end with an end symbol, so
the scores are probabilities of whole texts.

Training counts the (ORDER + 1)-grams of every training text; shorter orders
follow by summing.  No gram is dropped: the model grows with the corpus, and a
gram seen once is known.

Scoring: what a symbol costs depends on its ORDER predecessors only, so on one
(ORDER + 1)-gram.  At most ``HEAD`` of the most frequent grams are broadcast with
their log probability; every other gram of a text, rare or never seen in
training, is looked up by joins with the counts of all orders.  ``HEAD`` thus
decides what travels, never what a text scores.

Base score: a smoothed unigram over words and an end token, from counts of all
training texts.  At most ``FREQUENT`` of the most frequent words are broadcast; all other
words of a document are looked up by a join, so a hot word never shuffles and no
word is left out.

Scale: one pass over training texts for grams, one for words, one for scoring;
what shuffles are counts combined per task and the rarer grams and words of each
text.

Defined cases: null text counts as empty: one end token, the model's probability
of ending at once; without any training text every base score is 0 and the model
is uniform; repeated rows give repeated results; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold, keep, table

ORDER = 4
HEAD = 2**20  # grams that may be broadcast; the others are joined
FREQUENT = 200_000
LONGEST = 64  # bytes of a word that may be broadcast; longer ones are joined
END, START, SYMBOLS = 256, 257, 257
BITS = 9
WINDOW = 2_000_000  # symbols handled at once
STEP = 500_000  # positions looked up at once


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Start marks, bytes (A-Z lowered) and end symbol of each text, joined; and where each text begins."""
    sizes = np.asarray([len(t) + ORDER + 1 for t in texts], np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    out = np.full(starts[-1], START, np.int16)
    for t, at in zip(texts, starts, strict=False):
        out[at + ORDER : at + ORDER + len(t)] = np.frombuffer(t.lower(), np.uint8)
        out[at + ORDER + len(t)] = END
    return out, starts


def _windows(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= WINDOW:
            yield held
            held, size = [], 0
    if held:
        yield held


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of all (ORDER + 1)-grams that predict a byte or an end."""
    s = symbols(texts)[0].astype(np.int64)
    code = np.zeros(len(s) - ORDER, np.int64)
    for k in range(ORDER + 1):
        code = code << BITS | s[k : len(s) - ORDER + k]
    return np.unique(code[s[ORDER:] != START], return_counts=True)


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    at = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[at], np.add.reduceat(n, at)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for group in _windows(t.as_py() for b in batches for t in b.column(0)):
        parts.append(grams(group))
        held += len(parts[-1][0])
        if held > 4_000_000:
            parts = [_merged(parts)]
            held = len(parts[0][0])
            if held > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts.pop()], ["gram", "n"])
                held = 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _merged(parts)], ["gram", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    docs = 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for t in batch.column(0):
            docs += 1
            seen.update(t.as_py().lower().split())
            if len(seen) > 500_000:
                yield out()
                seen.clear()
    if seen:
        yield out()
    if docs:  # a null word stands for the end token
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([docs], pa.int64())], ["word", "n"])


class Head:
    """The broadcast grams as an open-addressed table: log10 probability by gram."""

    def __init__(self, gram: np.ndarray, log_p: np.ndarray):
        self.bits = max(4, int(4 * len(gram)).bit_length())  # at most half full
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.log_p = np.zeros(1 << self.bits, np.float32)
        left, slot = np.arange(len(gram)), self._slot(gram)
        while len(left):
            free = self.key[slot] < 0
            self.key[slot[free]] = gram[left[free]]
            put = self.key[slot] == gram[left]
            self.log_p[slot[put]] = log_p[left[put]]
            left, slot = left[~put], (slot[~put] + 1) & (len(self.key) - 1)

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return (gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each gram, 0 where it is not in the table, and which are not."""
        out, slot = np.zeros(len(gram), np.float32), self._slot(gram)
        known = self.key[slot]
        hit = known == gram
        out[hit] = self.log_p[slot[hit]]
        lost = ~hit
        at = np.flatnonzero(lost & (known >= 0))
        slot = slot[at]
        while len(at):
            slot = (slot + 1) & (len(self.key) - 1)
            known = self.key[slot]
            hit = known == gram[at]
            out[at[hit]] = self.log_p[slot[hit]]
            lost[at[hit]] = False
            more = ~hit & (known >= 0)
            at, slot = at[more], slot[more]
        return out, lost

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Each text's log10 probability over the grams of the table, and its other grams with their counts."""
        s, starts = symbols(texts)
        sizes = np.diff(starts)
        total, rest = np.zeros(len(texts)), []
        of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        for begin in range(0, max(0, len(s) - ORDER), STEP):
            part = s[begin : begin + STEP + ORDER].astype(np.int64)
            code = np.zeros(len(part) - ORDER, np.int64)
            for k in range(ORDER + 1):
                code = code << BITS | part[k : len(part) - ORDER + k]
            said = part[ORDER:] != START
            code, doc = code[said], of[begin + ORDER : begin + ORDER + len(said)][said]
            log_p, lost = self.find(code)
            total += np.bincount(doc, log_p, minlength=len(texts))
            rest.append((doc[lost].astype(np.int64) << BITS * (ORDER + 1)) | code[lost])
        key, n = np.unique(np.concatenate(rest), return_counts=True) if rest else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        cuts = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.int64) << BITS * (ORDER + 1))
        gram = key & ((1 << BITS * (ORDER + 1)) - 1)
        return total, [(gram[i:j], n[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


_LOADED: dict[str, tuple] = {}


def _model(shared) -> tuple:
    """One gram table and word table per worker and broadcast."""
    if shared.value["id"] not in _LOADED:
        _LOADED.clear()
        _LOADED[shared.value["id"]] = (Head(shared.value["grams"], shared.value["log_p"]), dict(zip(shared.value["words"], shared.value["log_c"].tolist(), strict=True)))
    return _LOADED[shared.value["id"]]


def _suffix(size: int) -> Column:
    """The last ``size`` symbols of a gram."""
    return F.col("gram").bitwiseAND(F.lit((1 << BITS * size) - 1))


def _levels(texts: DataFrame) -> list[DataFrame]:
    """(gram, n) of every gram of the training texts, per length from 1 to ORDER + 1."""
    level = keep(texts.mapInArrow(_count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "ppm-grams")
    levels = [level]
    for size in range(ORDER, 0, -1):
        level = keep(level.groupBy(_suffix(size).alias("gram")).agg(F.sum("n").alias("n")), "ppm-grams")
        levels.append(level)
    return levels[::-1]


def _trained(texts: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The grams and counts of ``_levels`` in memory, for corpora of a size to look at."""
    got = [level.orderBy("gram").toArrow() for level in _levels(texts)]
    return [(t.column("gram").to_numpy(), t.column("n").to_numpy()) for t in got]


def _contexts(levels: list[DataFrame]) -> list[DataFrame]:
    """(context, t, d, e) per order from 1: occurrences, different symbols, and what these symbols count in the next shorter context."""
    out = []
    for order in range(1, ORDER + 1):
        shorter = levels[order - 1].select(F.col("gram").alias("short"), F.col("n").alias("m"))
        each = levels[order].join(shorter, _suffix(order) == F.col("short"))
        each = each.groupBy(F.shiftright("gram", BITS).alias("context")).agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("d"), F.sum("m").alias("e"))
        out.append(keep(each, "ppm-contexts"))
    return out


def _escaped(grams: DataFrame, levels: list[DataFrame], contexts: list[DataFrame]) -> DataFrame:
    """(gram, log_p) of grams that training never saw: down the orders, leaving out what longer contexts excluded.

    A longer context's symbols all follow the shorter one too, so what is left
    there is its own sums less ``e`` and ``d`` of the longer context.
    """
    t0, d0 = levels[0].agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    rows = grams.withColumns({"escape": F.lit(0.0), "log_p": F.lit(None).cast("double"), "off_t": F.lit(0).cast("long"), "off_d": F.lit(0).cast("long")})
    for order in range(ORDER, -1, -1):
        if order:
            rows = rows.join(contexts[order - 1], F.shiftright(_suffix(order + 1), BITS) == F.col("context"), "left")
        else:
            rows = rows.withColumns({"context": F.lit(0).cast("long"), "t": F.lit(t0).cast("long"), "d": F.lit(d0).cast("long"), "e": F.lit(0).cast("long")})
        if order < ORDER:
            rows = rows.join(levels[order].select(F.col("gram").alias("found"), "n"), _suffix(order + 1) == F.col("found"), "left")
        else:
            rows = rows.withColumns({"found": F.lit(None).cast("long"), "n": F.lit(None).cast("long")})
        mass, kinds = F.col("t") - F.col("off_t") + F.col("d") - F.col("off_d"), F.col("d") - F.col("off_d")
        rows = rows.select(
            "gram",
            F.coalesce("log_p", F.col("escape") + F.log10(F.try_divide("n", mass))).alias("log_p"),
            (F.col("escape") + F.when(kinds > 0, F.log10(F.try_divide(kinds, mass))).otherwise(0.0)).alias("escape"),
            F.coalesce("e", F.lit(0)).alias("off_t"), F.coalesce("d", F.lit(0)).alias("off_d"),
        )
    return rows.select("gram", F.coalesce("log_p", F.col("escape") - math.log10(max(1, SYMBOLS - d0))).alias("log_p"))


def _frequent(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows: all whose ``n`` is at least a cut-off found from a histogram of counts.

    The histogram has a few hundred cells at any size (sixteen a doubling), so no
    task sorts or gathers the vocabulary.
    """
    cell = F.floor(F.log2("n") * 16).cast("int")
    held, cut = 0, 1 << 30
    for r in sorted(rows.groupBy(cell.alias("cell")).count().collect(), reverse=True):
        held += r["count"]
        if held > most:
            break
        cut = r["cell"]
    return rows.where(cell >= cut)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, out_fold: int = 1) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (fold(F.col(f"`{id_col}`"), folds) == out_fold).alias("held_out"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    texts = rows.where("not held_out").select("text")
    words = keep(texts.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "ppm-words")
    n_tokens, n_words, n_end = words.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.col("word").isNull(), F.col("n")))).first()
    n_tokens, n_end = n_tokens or 0, n_end or 0
    common = _frequent(words.where(F.col("word").isNotNull() & (F.octet_length("word") <= LONGEST)), FREQUENT).toArrow()
    log_c = np.log10(common.column("n").to_numpy() + 0.5) if common.num_rows else np.zeros(0)
    levels = _levels(texts)
    contexts = _contexts(levels)
    seen = levels[ORDER].join(contexts[ORDER - 1], F.shiftright("gram", BITS) == F.col("context"))
    seen = keep(seen.select("gram", "n", F.log10(F.col("n") / (F.col("t") + F.col("d"))).alias("log_p")), "ppm-seen")
    head = _frequent(seen, HEAD).select("gram", "log_p").toArrow()
    shared = spark.sparkContext.broadcast({"id": uuid.uuid4().hex, "grams": head.column("gram").to_numpy(), "log_p": head.column("log_p").to_numpy(), "words": common.column("word").to_pylist(), "log_c": log_c})
    below, log_end, log_none = math.log10(n_tokens + 0.5 * (n_words + 1)), math.log10(n_end + 0.5), math.log10(0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of, known = _model(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                raw = [t.as_py() for t in batch.column(2)]
                scored = [grams_of.score(g) for g in _windows(iter(raw))]
                probability, others = np.concatenate([p for p, _ in scored]), [o for _, rest in scored for o in rest]
                ends = np.r_[0, np.cumsum([len(g) for g, _ in others])].astype(np.int32)
                grams_left, grams_n = (pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([o[i] for o in others]))) for i in (0, 1))
                n, hits, logs, rare, times = [], [], [], [], []
                for t in raw:
                    counted = Counter(t.lower().split())
                    hit, log, rest, k = int(n_end > 0), log_end, [], []
                    for w, c in counted.items():
                        v = known.get(w)
                        if v is None:
                            rest.append(w)
                            k.append(c)
                        else:
                            hit += c
                            log += c * v
                    n.append(counted.total() + 1)
                    hits.append(hit)
                    logs.append(log)
                    rare.append(rest)
                    times.append(k)
                cols = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(logs, pa.float64()), pa.array(probability, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64())), grams_left, grams_n]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "hits", "logs", "score", "rare", "times", "grams", "grams_n"])

    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, hits long, logs double, score double, rare array<binary>, times array<bigint>, grams array<bigint>, grams_n array<bigint>"
    scored = keep(rows.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()), "ppm-scored")
    asked = scored.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("rid", F.col("r.rare").alias("word"), F.col("r.times").alias("k"))
    found = asked.join(words, "word").select("rid", F.col("k").alias("more"), (F.col("k") * F.log10(F.col("n") + 0.5)).alias("gain"), F.lit(0.0).alias("rest"))
    wanted = scored.select("rid", F.explode(F.arrays_zip("grams", "grams_n")).alias("r")).select("rid", F.col("r.grams").alias("gram"), F.col("r.grams_n").alias("k"))
    distinct = keep(wanted.select("gram").distinct().join(seen.select("gram", "log_p"), "gram", "left"), "ppm-wanted")
    unseen = keep(_escaped(distinct.where("log_p is null").select("gram"), levels, contexts), "ppm-unseen")
    known_p = distinct.where("log_p is not null").unionByName(unseen)
    costs = wanted.join(known_p, "gram").select("rid", F.lit(0).cast("long").alias("more"), F.lit(0.0).alias("gain"), (F.col("k") * F.col("log_p")).alias("rest"))
    found = found.unionByName(costs).groupBy("rid").agg(F.sum("more").alias("more"), F.sum("gain").alias("gain"), F.sum("rest").alias("rest"))
    n_rare = F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x)
    more, gain = F.coalesce("more", F.lit(0)), F.coalesce("gain", F.lit(0.0))
    return scored.join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("hits") + more).alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + gain + (n_rare - more) * log_none - F.col("n_tokens") * below).alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))

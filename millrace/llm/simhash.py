"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints: 64 bits, a majority vote over the XXH64 values of a text's
three-word shingles.  Two fingerprints link at three or fewer differing bits.

The join walks pairs of trie nodes together.  A pair starts as a node with
itself and zero differing bits; one level down it becomes the pairs of its
children, a pair of unlike children costs one bit, and a pair that costs more
than three is pruned with everything below it.

Distribution: four tries, each over the fingerprints rotated by a further 16
bits.  Two fingerprints within three bits agree on at least one of the four
16-bit blocks, so it is enough to start each trie at its 65,536 nodes of depth
16, every one paired with itself: four small rows travel per distinct
fingerprint.  A node pair with more than ``LIMIT`` fingerprints is walked four
levels further down as a DataFrame step, again and again until none is that
large, so no task ever holds an unbounded group.  Below that, whole node pairs
are walked in one task, a level at a time over sorted arrays.

Each task reports a spanning forest of the links it found instead of all pairs,
so a huge group of near copies gives links in proportion to its members.

Defined cases: null text counts as empty; texts without words have fingerprint
zero and link like any other; fewer than three words are one shingle; equal
fingerprints link; repeated rows each get their component and ``dedup`` keeps one
of them; a null id never names a component unless all its ids are null; an empty table gives an empty
table; further columns are ignored by ``components`` and carried by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import keep, shuffles, table
from millrace.llm.components import roots

BITS = 3
SHINGLE = 3
SEED = 42
LIMIT = 20_000  # fingerprints of a node pair walked within one task
STEP = 4  # levels of a larger pair walked at once as a DataFrame step
LEAF = 64  # candidate pairs below which a node pair is compared outright
CHUNK = 1_000_000


def fingerprint(text: bytes) -> int:
    """Signed 64-bit SimHash of a UTF-8 text."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    digest, n = xxhash.xxh64_digest, max(1, len(words) - SHINGLE + 1)
    last = ends[min(SHINGLE, len(ends)) - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + CHUNK)], last[at:], strict=False)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) per row, and the columns named in ``carry`` as ``kept ...``."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("read text"), *[F.col(f"`{c}`").alias(f"kept {c}") for c in carry])
    kept = [f"kept {c}" for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *[batch.column(i) for i in range(2, batch.num_columns)]], ["doc_id", "fp", *kept])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([f"doc_id {kinds['doc_id']}", "fp long", *[f"`{k}` {kinds[k]}" for k in kept]]))


def _node_pairs(fps: DataFrame) -> DataFrame:
    """Start pairs: rotation, depth, nodes p and q, and the rotated fingerprint x."""
    turned = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("turn"))
    left = F.expr("shiftleft(fp, 16 * turn)")
    right = F.when(F.col("turn") == 0, F.lit(0)).otherwise(F.expr("shiftrightunsigned(fp, 64 - 16 * turn)"))
    x = left.bitwiseOR(right.cast("long"))
    node = F.shiftrightunsigned(x, 48)
    return turned.select("turn", F.lit(16).alias("depth"), node.alias("p"), node.alias("q"), x.alias("x"))


KEY = ("turn", "depth", "p", "q")


def _walked(pairs: DataFrame) -> DataFrame:
    """Walk node pairs with more than LIMIT fingerprints further down until none is left."""
    pairs = keep(pairs, "trie")
    small = []
    while True:
        big = keep(pairs.groupBy(*KEY).count().where((F.col("count") > LIMIT) & (F.col("depth") < 64)).select(*KEY), "trie-large")
        if not big.limit(1).count():
            return _all([*small, pairs])
        small.append(pairs.join(big, list(KEY), "left_anti").select(*KEY, "x"))
        deep = pairs.join(big, list(KEY), "left_semi")
        own = F.expr(f"shiftrightunsigned(x, 64 - depth - {STEP})")
        base = F.when(F.expr("shiftrightunsigned(x, 64 - depth)") == F.col("p"), F.col("q")).otherwise(F.col("p"))
        other = F.shiftleft(base, STEP).bitwiseOR(F.col("j").cast("long"))
        down = deep.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << STEP) - 1))).alias("j")).select("turn", (F.col("depth") + STEP).alias("depth"), own.alias("own"), other.alias("other"), "x")
        down = down.where(F.bit_count(F.col("own").bitwiseXOR(F.col("other"))) <= BITS)
        pairs = keep(down.select("turn", "depth", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "x"), "trie")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select(*KEY, "x")
    for p in parts[1:]:
        out = out.unionByName(p.select(*KEY, "x"))
    return out


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class _Forest:
    """Union by least index over one block of rows."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            la, lb = label[a], label[b]
            apart = la != lb
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            if not len(a):
                return
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def join_block(first: np.ndarray, group: np.ndarray, x: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Labels of rows linked within each group.

    Rows are sorted by group and x; ``first`` says for each group of two
    different nodes where its second node's rows begin (or its own start, for a
    node with itself).  ``top``: per group, the depth its nodes share.
    """
    forest = _Forest(len(x))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    stops = np.r_[starts[1:], len(x)]
    same = first == starts
    mid = np.where(same, stops, first)
    # a node with itself, or two nodes of one group with the bits their prefixes differ in
    lo1, hi1 = starts, mid
    lo2, hi2 = np.where(same, starts, mid), np.where(same, mid, stops)
    ok = (hi1 > lo1) & (hi2 > lo2)
    shift = (64 - top).astype(np.uint64)
    diff = np.zeros(len(starts), np.int64)
    cross = ok & ~same
    diff[cross] = _popcount((x[lo1[cross]] ^ x[lo2[cross]]) >> shift[cross])
    stack = []
    for depth in np.unique(top[ok]):
        at = ok & (top == depth)
        stack.append((int(depth), lo1[at], hi1[at], lo2[at], hi2[at], diff[at]))
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, lo1, hi1, lo2, hi2, diff = stack.pop()
        if len(lo1) > CHUNK:
            half = len(lo1) // 2
            stack += [(depth, lo1[s], hi1[s], lo2[s], hi2[s], diff[s]) for s in (slice(half, None), slice(0, half))]
            continue
        self_pair = lo1 == lo2
        alive = ~(self_pair & (hi1 - lo1 < 2)) & (diff <= BITS)
        leaf = alive & (((hi1 - lo1) * (hi2 - lo2) <= LEAF) | (depth >= 64))
        _compare(forest, x, lo1[leaf], hi1[leaf], lo2[leaf], hi2[leaf])
        go = alive & ~leaf
        if not go.any():
            continue
        lo1, hi1, lo2, hi2, diff, self_pair = lo1[go], hi1[go], lo2[go], hi2[go], diff[go], self_pair[go]
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum((x >> np.uint64(63 - depth)) & np.uint64(1))].astype(np.int64)
        c = ones[depth]
        m1, m2 = hi1 - (c[hi1] - c[lo1]), hi2 - (c[hi2] - c[lo2])
        apart = ~self_pair
        parts = [(lo1, m1, lo2, m2, diff), (m1, hi1, m2, hi2, diff), (lo1, m1, m2, hi2, diff + 1), (m1[apart], hi1[apart], lo2[apart], m2[apart], diff[apart] + 1)]
        new = [np.concatenate(p) for p in zip(*parts, strict=True)]
        full = (new[1] > new[0]) & (new[3] > new[2]) & (new[4] <= BITS)
        stack.append((depth + 1, *[v[full] for v in new]))
    return forest.label


def _compare(forest: _Forest, x, lo1, hi1, lo2, hi2) -> None:
    n1, n2 = hi1 - lo1, hi2 - lo2
    total = n1 * n2
    for at in _slices(total):
        t, w = total[at], n2[at]
        k = np.repeat(np.arange(len(t)), t)
        within = np.arange(len(k)) - np.repeat(np.cumsum(t) - t, t)
        a, b = lo1[at][k] + within // w[k], lo2[at][k] + within % w[k]
        near = (a < b) & (_popcount(x[a] ^ x[b]) <= BITS)
        forest.add(a[near], b[near])


def _slices(total: np.ndarray) -> Iterator[slice]:
    if not len(total):
        return
    block = np.cumsum(total) // CHUNK
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield slice(a, b)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of whole node pairs; rows come sorted by pair and fingerprint."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        held = cols if held is None else [np.concatenate(c) for c in zip(held, cols, strict=True)]
        if len(held[0]) < 100_000:
            continue
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[:4]], axis=0))
        if len(change):
            cut = change[-1] + 1
            yield _block([c[:cut] for c in held])
            held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield _block(held)


def _block(cols: list[np.ndarray]) -> pa.RecordBatch:
    turn, depth, p, q, x = cols
    new = np.r_[True, np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)]
    group, at = np.cumsum(new) - 1, np.flatnonzero(new)
    ux = x.astype(np.uint64)
    top = depth[at].astype(np.int64)
    # rows of the second node of a pair: those whose own prefix is q
    own = ux >> (64 - depth.astype(np.int64)).clip(0, 63).astype(np.uint64)
    own = np.where(depth >= 64, ux, own)
    second = (own == q.astype(np.uint64)) & (p != q)
    stops = np.r_[at[1:], len(x)]
    behind = np.add.reduceat(second.astype(np.int64), at)
    first = np.where(p[at] == q[at], at, stops - behind)
    label = join_block(first, group, ux, top)
    moved = np.flatnonzero(label != np.arange(len(label)))
    back = (np.uint64(64) - np.uint64(16) * turn[moved].astype(np.uint64)) % np.uint64(64)

    def unturned(v):
        return np.where(back == 0, v, (v << back) | (v >> ((np.uint64(64) - back) % np.uint64(64)))).astype(np.int64)

    return pa.RecordBatch.from_arrays([pa.array(unturned(ux[moved])), pa.array(unturned(ux[label[moved]]))], ["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints within BITS bits."""
    pairs = _walked(_node_pairs(fps))
    dealt = pairs.repartition(shuffles(fps.sparkSession), *KEY).sortWithinPartitions(*KEY, "x")
    return dealt.mapInArrow(_links, "a long, b long")


def _rooted(rows: DataFrame) -> DataFrame:
    """(fp, first) per distinct fingerprint: ``first`` is the least (no id, id, row) of its component."""
    each = keep(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("rid").alias("rid"))).alias("least")), "simhash-distinct")
    star = roots(links(each.select("fp")))
    named = keep(each.join(star, each["fp"] == star["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = keep(named.groupBy("root").agg(F.min("least").alias("first")), "simhash-components")
    return keep(named.join(least, "root").select("fp", "first"), "simhash-ids")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (hex), component_id."""
    rows = keep(fingerprints(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "simhash")
    return rows.join(_rooted(rows), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that with the smallest id (null last; of equal ids one), all columns whole.

    Rows are told apart by a number of their own, written with them: repeated or
    null ids neither drop other rows nor keep copies.
    """
    names = tuple(docs.columns)
    rows = keep(fingerprints(docs, id_col, text_col, names).withColumn("rid", F.monotonically_increasing_id()), "simhash-rows")
    slim = rows.select("doc_id", "fp", "rid")
    gone = keep(slim.join(_rooted(slim), "fp").where(F.col("rid") != F.col("first.rid")).select("rid"), "simhash-gone")
    return rows.join(gone, "rid", "left_anti").select(*[F.col(f"`kept {c}`").alias(c) for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))

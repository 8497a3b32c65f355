"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Rates minimise the relative entropy to the corpus as it is, subject to one
token constraint per source: rate(d) = min(cap, exp(lambda_s * x_d)), where x_d
is the document's size over its source's mean size and lambda_s the dual
variable.  The dual is convex, so safeguarded Newton steps solve it for every
source at once; each step is one distributed aggregation over the exact
(source, size) histogram, which is far smaller than the corpus.

Rounding: copies = floor(rate + u) with u a hash of the id and the text (of the
row's number, where the id is null).  The rounded total
is a step function that never falls as lambda grows, so a few grid refinements
over all documents re-tune lambda until the taken words meet the target to
within about one document.  Texts never shuffle: a document's copies depend
only on its own row and on its source's lambda.

Scale: per-source state stays a DataFrame (a source is a row; many thousand are
fine); a source with a third of all rows is combined before each exchange, and
where its rows meet the state table Spark broadcasts that table if it is small
by its own size check and otherwise splits the skewed side.

Defined cases: null or empty texts have size 0, take part with rate 1 and add
nothing; a null source is a source of its own, ordered last; repeated rows are
mixed each on its own; rows with the same id and text share a rounding offset, and
the single-document corrections still tell them apart by row;
an empty table, or one without any word, gives targets 0; further columns are
carried by ``mix`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, keep, shuffles, table

CAP = 3.0
GRID = 32
REFINE = 4
FLIPS = 3
FLIP = "array<struct<id:bigint,delta:int>>"
STEPS = 400  # safeguarded Newton steps need some ten; far beyond is a fault, and raised
TOLERANCE = 1e-9
FAR = 1e9  # a dual value at which every document with words is at its cap


def _ranked(sources: DataFrame) -> DataFrame:
    """Rank of each source by code point, null last, without a single-task sort."""
    spark = sources.sparkSession
    none = F.col("source").isNull()
    dealt = keep(
        sources.repartitionByRange(shuffles(spark), none, F.col("source")).withColumn("part", F.spark_partition_id()), "mix-sources"
    )
    by_part = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    before = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(none, "source"))
    return dealt.join(before, "part").withColumn("rank", F.col("before") + inside - 1).drop("part", "before")


def _targets(sources: DataFrame, cycle: int) -> DataFrame:
    """Targets: the total shared by weight, none above CAP times its source.

    Water-filling: target = min(cap, level * weight); the level is found by
    aggregates over the sources, each round fixing those above their cap.
    """
    ranked = keep(
        _ranked(sources).select("source", "source_size", (F.col("rank") % cycle + 1).cast("double").alias("w"), (CAP * F.col("source_size")).alias("cap")),
        "mix-weights",
    )
    total, weight = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    total, level = float(total or 0), float(total or 0) / (weight or 1)
    while total:
        full = F.col("cap") <= F.lit(level) * F.col("w")
        fixed, free = ranked.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        now = (total - (fixed or 0.0)) / free if free else level
        if now <= level * (1 + 1e-15):
            break
        level = now
    return ranked.select("source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def _rate(lam, x):
    return F.least(F.lit(CAP), F.exp(F.least(F.lit(50.0), lam * x)))


def _dual(hist: DataFrame, sources: DataFrame) -> DataFrame:
    """Solve the dual: source, source_size, target, mean, lam."""
    start = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean")).withColumn("mean", F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0))
    full = F.col("target") >= CAP * F.col("source_size") * (1 - 1e-12)
    state = keep(
        sources.join(start, sources["source"].eqNullSafe(start["source"])).select(
            sources["source"], "source_size", "target", "mean",
            F.when(full & (F.col("source_size") > 0), F.lit(FAR)).otherwise(F.lit(0.0)).alias("lam"),
            F.lit(-FAR).alias("lo"), F.lit(FAR).alias("hi"), (full | (F.col("source_size") == 0)).alias("done"),
        ),
        "mix-dual",
    )
    for _ in range(STEPS):
        if not state.where("not done").limit(1).count():
            break
        h, s = hist.alias("h"), state.where("not done").alias("s")
        x = F.col("size") / F.col("mean")
        r = _rate(F.col("lam"), x)
        mass = F.col("size") * F.col("n")
        sums = (
            h.join(s, F.col("h.source").eqNullSafe(F.col("s.source")))
            .groupBy(F.col("s.source").alias("source"))
            .agg(F.sum(mass * r).alias("got"), F.sum(F.when(r < CAP, mass * x * r).otherwise(0.0)).alias("slope"))
        )
        t = state.alias("t").join(sums.alias("g"), F.col("t.source").eqNullSafe(F.col("g.source")), "left")
        gap = F.col("got") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.nullif("slope", F.lit(0.0))
        halved = F.when(F.col("lo2") <= -FAR, F.col("lam") * 2 - 1).when(F.col("hi2") >= FAR, F.col("lam") * 2 + 1).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        inside = (F.col("newton") > F.col("lo2")) & (F.col("newton") < F.col("hi2")) & (F.abs(F.col("newton") - F.col("lam")) < 4)
        settled = F.col("done") | (F.abs(gap) <= TOLERANCE * F.col("target")) | (F.col("hi2") - F.col("lo2") < 1e-12)
        state = keep(
            t.withColumns({"lo2": lo, "hi2": hi, "newton": newton})
            .select(
                F.col("t.source").alias("source"), "source_size", "target", "mean",
                F.when(settled, F.col("lam")).when(inside, F.col("newton")).otherwise(halved).alias("lam"),
                F.when(F.col("done"), F.col("lo")).otherwise(F.col("lo2")).alias("lo"),
                F.when(F.col("done"), F.col("hi")).otherwise(F.col("hi2")).alias("hi"), settled.alias("done"),
            ),
            "mix-dual",
        )
    else:
        raise RuntimeError(f"the dual is not solved after {STEPS} steps")
    # a fixed grid makes reruns agree in spite of floating-point sums in any order
    return state.select("source", "source_size", "target", "mean", F.round("lam", 6).alias("lam"))


def _copies(lam):
    return F.floor(_rate(lam, F.col("size") / F.col("mean")) + F.col("u"))


def _tuned(sizes: DataFrame, dual: DataFrame) -> DataFrame:
    """Re-tune lambda so that the words taken after rounding meet the target."""
    state = dual.select("*", (F.col("lam") - 1).alias("base"), F.lit(2.0 / GRID).alias("step"))
    for _ in range(REFINE):
        z, s = sizes.alias("z"), state.alias("s")
        at = [F.col("base") + F.col("step") * j for j in range(GRID + 1)]
        sums = (
            z.join(s, F.col("z.source").eqNullSafe(F.col("s.source")))
            .groupBy(F.col("s.source").alias("source"))
            .agg(*[F.sum(F.col("size") * _copies(a)).alias(f"t{j}") for j, a in enumerate(at)])
        )
        t = state.alias("t").join(sums.alias("g"), F.col("t.source").eqNullSafe(F.col("g.source")))
        got = F.array(*[F.struct(F.abs(F.col(f"t{j}") - F.col("target")).alias("off"), F.lit(j).alias("j")) for j in range(GRID + 1)])
        below = F.greatest(F.lit(0), sum((F.when(F.col(f"t{j}") <= F.col("target"), 1).otherwise(0) for j in range(GRID + 1)), F.lit(0)) - 1)
        best = F.array_min(got)["j"]
        state = keep(
            t.select(
                F.col("t.source").alias("source"), "source_size", "target", "mean",
                F.when(F.col("lam") >= FAR, F.col("lam")).otherwise(F.col("base") + F.col("step") * best).alias("lam"),
                F.when(F.col("lam") >= FAR, F.col("base")).otherwise(F.col("base") + F.col("step") * below).alias("base"),
                (F.col("step") / GRID).alias("step"),
            ),
            "mix-tuned",
        )
    return state.select("source", "source_size", "target", "mean", "lam", F.array().cast(FLIP).alias("flips"))


def _final():
    """Copies with the source's flips applied."""
    own = F.filter("flips", lambda f: f["id"] == F.col("key"))
    return F.least(F.lit(int(CAP)), F.greatest(F.lit(0), _copies(F.col("lam")) + F.aggregate(own, F.lit(0), lambda acc, f: acc + f["delta"]))).cast("int")


def _flipped(sizes: DataFrame, state: DataFrame) -> DataFrame:
    """Give or take one copy of the document whose size is nearest to what a source lacks."""
    for _ in range(FLIPS):
        z, s = sizes.alias("z"), state.alias("s")
        rows = z.join(s, F.col("z.source").eqNullSafe(F.col("s.source"))).select(F.col("s.source").alias("source"), "target", "size", "key", "u", _final().alias("copies"))
        lack = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("lack"))
        r, g = rows.alias("r"), keep(lack, "mix-lack").alias("g")
        near = r.join(g, F.col("r.source").eqNullSafe(F.col("g.source"))).where(
            F.when(F.col("lack") > 0, F.col("copies") < CAP).otherwise(F.col("copies") > 0) & (F.abs(F.abs("lack") - F.col("size")) < F.abs("lack")) 
        )
        order = F.abs(F.abs("lack") - F.col("size")) + F.col("u") / 1000  # ties by the hash of the id
        pick = near.groupBy(F.col("g.source").alias("source")).agg(F.min_by("key", order).alias("id"), F.first(F.signum("lack").cast("int")).alias("delta"))
        t, k = state.alias("t"), pick.alias("k")
        more = F.when(F.col("k.id").isNull(), F.col("flips")).otherwise(F.concat("flips", F.array(F.struct(F.col("k.id").alias("id"), F.col("delta")))))
        joined = t.join(k, F.col("t.source").eqNullSafe(F.col("k.source")), "left")
        state = keep(joined.select(F.col("t.source").alias("source"), "source_size", "target", "mean", "lam", more.cast(FLIP).alias("flips")), "mix-flips")
    return state


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more) -> DataFrame:
    """Source, size, row number and rounding offset of each row, and further columns, written as a table.

    What tells rows apart is the number they are written with, so repeated or null
    ids do not matter.
    """
    numbered = docs.select(*more, F.col(f"`{id_col}`").alias("own id"), F.col(f"`{text_col}`").alias("own text"), F.col(f"`{source_col}`").alias("source"), F.monotonically_increasing_id().alias("key"))
    drawn = F.xxhash64("own id", "own text", F.when(F.col("own id").isNull(), F.col("key")), F.lit(7))
    return keep(
        numbered.select(
            *[F.col(f"`{c}`") for c in numbered.columns if c not in ("own id", "own text")],
            F.coalesce(F.regexp_count("own text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), (F.pmod(drawn, F.lit(1 << 40)) / float(1 << 40)).alias("u"),
        ),
        "mix-sizes",
    )


def _solve(sizes: DataFrame, cycle: int) -> DataFrame:
    hist = keep(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    sources = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    return _flipped(sizes, _tuned(sizes, _dual(hist, _targets(sources, cycle))))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: int = 3) -> DataFrame:
    """Per input row: doc_id, size, source_size, target, taken, copies, rate."""
    sizes = _sized(docs, id_col, text_col, source_col, F.col(f"`{id_col}`").alias("doc_id"))
    z, s = sizes.alias("z"), _solve(sizes, cycle).alias("s")
    copies = _final().cast("long")
    return z.join(s, F.col("z.source").eqNullSafe(F.col("s.source"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"),
        _rate(F.col("lam"), F.col("size") / F.col("mean")).alias("rate"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: int = 3) -> DataFrame:
    """The mixed corpus: each row as often as its copies say, all columns whole."""
    rows = _sized(docs, id_col, text_col, source_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    z, s = rows.alias("z"), _solve(rows.drop("row"), cycle).alias("s")
    taken = z.join(s, F.col("z.source").eqNullSafe(F.col("s.source"))).withColumn("copies", _final()).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"))

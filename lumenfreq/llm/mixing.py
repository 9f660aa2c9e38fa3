"""Mixing sources to target weights by hash-threshold histograms, without sorting documents.

Each document has a 64-bit hash.  A source's target buys a number of whole passes over the source and a budget for
one partial pass, which takes the documents whose hash lies below a threshold.  The threshold is found in levels:
sizes are summed by source and leading hash bits, the bucket in which the running sum crosses the budget is the
boundary, and only documents in boundary buckets are summed again by the next bits.  Documents are never ordered; a
level moves at most one row for each source and bucket.

Cases: a null text has size 0; a null source is a source of its own, after all others; repeated rows share a hash and
are taken or left together; an empty table, or one without words, takes nothing; result columns replace input columns
of the same name; a very long text is one row, and a source's take may miss its target by as much as one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, materialise

CAP = 3
BITS = 12
LEVELS = (12, 12, 12, 12, 15)  # 63 bits in all


def size_of(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(f"({WORD})"), F.lit(1))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """One row for each source of (source, size): source, source_size, target.

    Shares are poured level by level: source i gets min(cap * size, weight * level) with one level for all, at which
    the targets sum to the sum of sizes.  The sources that stop at their cap are those with the smallest cap / weight,
    so one running sum over the sources finds the level.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    x = by.withColumns({"weight": weight, "most": F.lit(float(cap)) * F.col("source_size")})
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    x = x.withColumns({"full_before": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "total": F.sum("source_size").over(everything).cast("double"), "weights": F.sum("weight").over(everything)})
    # The level if exactly the sources before this one are at their caps; it holds where this source would not reach its own.
    x = x.withColumn("level", (F.col("total") - F.col("full_before")) / (F.col("weights") - F.col("weight_before")))
    fits = F.col("level") * F.col("weight") <= F.col("most")
    x = x.withColumn("level", F.min(F.when(fits, F.struct(F.col("most") / F.col("weight"), F.col("full_before"), F.col("level")))).over(everything)["level"])
    return x.select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(sized, plan): the documents with size and hash, and for each source whole passes and the hash threshold.

    sized has id, source, size, hash; plan has source, source_size, target, passes, below: a document is taken `passes`
    times, and once more if its hash < below.
    """
    sized = materialise(
        docs.select(docs[id_col].alias("doc_id"), docs[source].cast("string").alias("source"), size_of(docs[text]).alias("size"), hash_of(docs[id_col], docs[text]).alias("hash")),
        "mix-sizes",
    )
    # below: documents with a smaller hash are in; left: what the budget still lacks after them; low: where the boundary bucket begins.
    targets = source_targets(sized, weights, cap)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("passes", passes)
    plan = plan.withColumns({"left": F.col("target") - F.col("passes") * F.col("source_size"), "low": F.lit(0).cast("long")})
    plan = materialise(plan, "mix-plan")
    rest = 63
    for bits in LEVELS:
        width, rest = rest, rest - bits
        inside = sized.join(F.broadcast(plan.select(F.col("source").alias("s"), "low")) if _few(plan) else plan.select(F.col("source").alias("s"), "low"), F.col("source").eqNullSafe(F.col("s")))
        inside = inside.filter(F.shiftright("hash", width) == F.shiftright("low", width)) if width < 63 else inside
        hist = inside.groupBy("source", F.shiftleft(F.shiftright("hash", rest), rest).alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("docs"))
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumns({"before": F.coalesce(F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
        hist = hist.join(plan.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s"))).filter((F.col("before") <= F.col("left")) & (F.col("before") + F.col("n") > F.col("left")))
        edge = hist.select(F.col("source").alias("s"), "bucket", "before", "n", "docs")
        p = plan.drop("n", "docs").join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
        plan = materialise(
            p.select(
                "source", "source_size", "target", "passes",
                (F.col("left") - F.coalesce(F.col("before"), F.lit(0))).alias("left"),
                F.coalesce(F.col("bucket"), F.col("low")).alias("low"),
                F.coalesce(F.col("n"), F.lit(0)).alias("n"),
                F.coalesce(F.col("docs"), F.lit(0)).alias("docs"),
            ),
            "mix-plan",
        )
        last = rest
        if not plan.filter("docs > 1").limit(1).count():
            break
    # The boundary bucket that remains (one document, or rows of one hash) goes in if that lands nearer the budget.
    take_edge = (F.col("docs") > 0) & (F.col("left") > F.col("n") - F.col("left"))
    plan = plan.withColumn("below", F.when(F.col("left") < 0, F.lit(0)).when(take_edge, F.col("low") + F.lit(1 << last).cast("long")).otherwise(F.col("low")))
    return sized, plan.select("source", "source_size", "target", "passes", "below")


def hash_of(id_col: Column, text: Column) -> Column:
    """63 bits, from the id and the text."""
    return F.xxhash64(id_col, text).bitwiseAND(F.lit((1 << 63) - 1))


def _few(plan: DataFrame) -> bool:
    """Whether the sources are few enough to send to all tasks: at most 10,000 rows of four numbers and a name."""
    return plan.limit(10_001).count() <= 10_000


def mix_sizes(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken for every document."""
    sized, plan = plan_mix(docs, **kw)
    p = plan.withColumnRenamed("source", "s")
    p = F.broadcast(p) if _few(plan) else p
    x = sized.join(p, F.col("source").eqNullSafe(F.col("s")))
    x = x.withColumn("times", F.col("passes") + (F.col("hash") < F.col("below")).cast("long"))
    return x.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **kw) -> DataFrame:
    """The mix itself: rows of docs, each as many times as the mix takes it, with the columns they came with."""
    _, plan = plan_mix(docs, id_col=id_col, text=text, source=source, **kw)
    p = plan.select(F.col("source").alias("__lf_s"), "passes", "below").withColumnsRenamed({"passes": "__lf_passes", "below": "__lf_below"})
    p = F.broadcast(p) if _few(plan) else p
    x = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__lf_row"), docs[source].cast("string").alias("__lf_source"), hash_of(docs[id_col], docs[text]).alias("__lf_hash"))
    x = x.join(p, F.col("__lf_source").eqNullSafe(F.col("__lf_s")))
    times = F.col("__lf_passes") + (F.col("__lf_hash") < F.col("__lf_below")).cast("long")
    x = x.select("__lf_row", F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("__lf_time"))
    return x.select(*[F.col("__lf_row")[c].alias(c) for c in docs.columns])

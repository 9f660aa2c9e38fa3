"""Best-two-fit packing of pieces into sequences, planned on the histogram of lengths.

How well pieces pack depends on their lengths alone, and there are at most `most` different lengths.  So the plan is
made on one count for each length: a bin is filled greedily with the largest lengths that still fit; then its smallest
piece is replaced by two pieces not yet packed, if they fill the gap so opened more tightly.  The finished bin is a
pattern, which is laid as often as the counts allow.  A pattern uses up some length nearly, so patterns are about as
many as lengths, at any number of documents.

Pieces then take places by their rank among pieces of their length.  Ranks come from counts by (length, salt) and from
row numbers within (length, salt), so a length that a third of all pieces has is spread over many tasks.

Cases: a length of 0 can't occur (each document has its end id); ties in length are broken by the hash of the row;
repeated rows are pieces of their own; an empty table gives no sequence; a null or empty text is its end id; a very
long one is cut by encode_pieces, its first piece being the short one; other columns pass through, and sequence_id and
offset replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import n_partitions


def best_two_fit(counts: np.ndarray, most: int) -> list[tuple[int, dict[int, int]]]:
    """[(times, {length: pieces})] for counts[length]; patterns in the order they are laid."""
    left = np.array(counts, dtype=np.int64)
    plan: list[tuple[int, dict[int, int]]] = []
    while (present := np.flatnonzero(left)).size:
        bin_, gap = _greedy(left, present, most)
        small = min(bin_)
        if gap and (pair := _two_for(left, bin_, small, gap + small, most)):
            bin_[small] -= 1
            for x in pair:
                bin_[x] = bin_.get(x, 0) + 1
            bin_ = {x: n for x, n in bin_.items() if n}
        times = min(int(left[x]) // n for x, n in bin_.items())
        for x, n in bin_.items():
            left[x] -= times * n
        plan.append((times, dict(sorted(bin_.items(), reverse=True))))
    return plan


def _greedy(left: np.ndarray, present: np.ndarray, gap: int) -> tuple[dict[int, int], int]:
    bin_: dict[int, int] = {}
    end = len(present)
    while end and gap:
        end = int(np.searchsorted(present[:end], gap, side="right"))
        if not end:
            break
        x = int(present[end - 1])
        n = min(int(left[x]), gap // x)
        bin_[x] = n
        gap -= n * x
        end -= 1
    return bin_, gap


def _two_for(left: np.ndarray, bin_: dict[int, int], small: int, gap: int, most: int) -> tuple[int, int] | None:
    """The two unpacked lengths that fill `gap` best, if better than `small` does."""
    rest = left.copy()
    for x, n in bin_.items():
        rest[x] -= n
    have = np.flatnonzero(rest[: gap + 1])
    have = have[have > 0]
    if not have.size:
        return None
    at = np.searchsorted(have, np.minimum(have, gap - have), side="right") - 1  # the largest partner that fits, no larger than itself
    twice = (at >= 0) & (have[at] == have) & (rest[have] < 2)
    at = np.where(twice, at - 1, at)
    total = np.where(at >= 0, have + have[at], -1)
    total[total > gap] = -1
    k = int(np.argmax(total))
    return (int(have[k]), int(have[at[k]])) if total[k] > small else None


def pack(pieces: DataFrame, most: int) -> DataFrame:
    """pieces (with a column length, 1 to most) plus sequence_id and offset.  pieces must be a written table: it is read twice."""
    spark = pieces.sparkSession
    pieces = pieces.drop(*[c for c in pieces.columns if c.lower() in ("sequence_id", "offset")])
    counts = np.zeros(most + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `most` rows
        counts[r["length"]] = r["count"]
    plan = best_two_fit(counts, most)
    salts = max(32, n_partitions(spark))
    salted = pieces.withColumn("__lf_salt", F.pmod(F.xxhash64(*pieces.columns), F.lit(salts)).cast("int"))
    group = Window.partitionBy("length", "__lf_salt")
    ranked = salted.withColumn("__lf_rank", F.row_number().over(group.orderBy(*[c for c in pieces.columns if c != "length"])) - 1)
    sizes = salted.groupBy("length", "__lf_salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__lf_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "__lf_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__lf_first"))
    placed = ranked.join(first, ["length", "__lf_salt"]).withColumn("__lf_rank", F.col("__lf_rank") + F.col("__lf_first"))
    return placed.select(*pieces.columns, "__lf_rank").mapInArrow(_placer(plan, most), pieces.schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id long, offset long")


def _placer(plan: list[tuple[int, dict[int, int]]], most: int):
    """By length: for each pattern that holds it, the ranks before, pieces a bin, first bin and offset in the bin."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    done: dict[int, int] = {}
    bins = 0
    for times, bin_ in plan:
        at = 0
        for x, n in bin_.items():
            rows.setdefault(x, []).append((done.get(x, 0), n, bins, at))
            done[x] = done.get(x, 0) + times * n
            at += n * x
        bins += times
    table = {x: np.array(r, dtype=np.int64).T for x, r in rows.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(zero_copy_only=False), b.column("__lf_rank").to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                rows_ = np.flatnonzero(length == x)
                first, n, bin_, at = table[int(x)]
                k = np.searchsorted(first, rank[rows_], side="right") - 1
                q = rank[rows_] - first[k]
                seq[rows_], off[rows_] = bin_[k] + q // n[k], at[k] + q % n[k] * x
            names = [c for c in b.schema.names if c != "__lf_rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return place

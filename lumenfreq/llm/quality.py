"""Quality rules: a table of thresholds compiled into one Spark projection.

Every figure is an expression of built-in functions over the document's own row: no join, no shuffle, no user
function.  Cases: a null text has no words; a document without words fails the base rule (n_words < 20); a figure on a
threshold passes; repeated rows are judged each, alike; a very long text is one row's work, in arrays of its words; an
empty table gives an empty result; other columns, also such as share a name with a figure, don't matter (a result
column replaces one of its name).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD

WINDOW = 8
#: Common function words of the languages served.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which with you "
    "al con de del el en es esta la las lo los no para pero por que se sin su un una y "
    "au aux avec ce dans des du elle est et il je le les ne nous ou pas plus pour qui sa sur une vous "
    "aber auch auf aus das dem den der des die ein eine er es für hat ich im ist mit nicht sich sie sind und von war wie zu"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= figure <= high."""

    name: str
    figure: str
    low: float = float("-inf")
    high: float = float("inf")


#: The threshold table.  Figures are expressions over the columns that `figures` makes.
RULES = (
    Rule("length_words", "n_words", low=20),
    Rule("length_word_mean", "word_chars / nullif(n_words, 0)", low=2, high=20),
    Rule("symbol_ratio", "n_symbols / nullif(n_words, 0)", high=0.1),
    Rule("shout_ratio", "n_shouts / nullif(n_words, 0)", high=0.2),
    Rule("stop_word_ratio", "n_stop_words / nullif(n_words, 0)", low=0.02),
    Rule("dup_line_ratio", "n_dup_lines / greatest(n_lines, 1)", high=0.4),
)


def figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns n_words, word_chars, n_symbols, n_shouts, n_stop_words, n_lines, n_dup_lines, n_repeat_words.

    Windows are compared by 64-bit hash within one document.  Only a document whose window hashes repeat pays for
    the sort that finds which words the repeated windows cover.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_shouts", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")
    keep = [c for c in docs.columns if c.lower() not in made]
    t = F.coalesce(F.col("__lf_doc")[text].cast("string"), F.lit(""))
    x = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__lf_doc"))
    x = x.select("__lf_doc", F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1)).alias("w"), F.filter(F.split(t, "\n", -1), lambda s: s.rlike(WORD)).alias("l"))
    n = F.size("w")
    no_hash = F.array().cast("array<bigint>")
    x = x.select(
        "__lf_doc",
        n.cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, s: a + F.char_length(s)).alias("word_chars"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size(F.filter("w", lambda s: s.endswith("!!"))).cast("long").alias("n_shouts"),
        F.size(F.filter("w", lambda s: F.lower(s).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))).otherwise(no_hash).alias("h"),
    )
    done = ["__lf_doc", *made[:-1]]
    x = x.select(*done, F.when(F.size("h") > F.size(F.array_distinct("h")), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    same = lambda e, j: F.coalesce(F.get("s", j)["h"] == e["h"], F.lit(False))
    x = x.select(*done, F.sort_array(F.transform(F.filter("s", lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["i"])).alias("p"))
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    x = x.select(*done, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    return x.select(*[F.col("__lf_doc")[c].alias(c) for c in keep], *made)


def base_failed() -> Column:
    """The fixed base rule over the columns of `figures`."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column: the base rule holds and each rule of the table passes."""
    ok = ~base_failed()
    for r in rules:
        value = F.expr(r.figure)
        if r.low != float("-inf"):
            ok = ok & F.coalesce(value >= F.lit(r.low), F.lit(False))
        if r.high != float("inf"):
            ok = ok & F.coalesce(value <= F.lit(r.high), F.lit(False))
    return ok


def score_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with the figures, base_failed and kept."""
    made = ("base_failed", "kept")
    x = figures(docs.drop(*[c for c in docs.columns if c.lower() in made]), text)
    return x.withColumns({"base_failed": base_failed(), "kept": verdict(rules)})


def keep_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that pass, with the columns they came with."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__lf_row"), docs[text].alias("__lf_text"))
    # The row number keeps the optimizer from moving the filter below the projections, where it would work out each
    # figure once for every mention.
    kept = score_quality(packed, rules, "__lf_text").withColumn("__lf_n", F.monotonically_increasing_id()).filter("kept AND __lf_n >= 0")
    return kept.select(*[F.col("__lf_row")[c].alias(c) for c in docs.columns])

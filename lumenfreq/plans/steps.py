"""Plans as graphs of SQL steps that run on Spark and read as one statement elsewhere.

A step is a SQL template over named inputs (`{x}`), which are steps or tables.  On Spark each step is a DataFrame made by
spark.sql with its inputs bound as DataFrames, so Catalyst sees one plan.  `statement` gives the same graph as common
table expressions in standard SQL.  The few spots where engines differ are macros: $us, $pct, $seq, $span (a row for each number, in a SELECT list), $r and $x.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_MACRO = re.compile(r"\$(us|pct|seq|span|r|x)\(")

SPARK = {
    "us": lambda a: f"unix_micros(CAST({a} AS TIMESTAMP))",
    "pct": lambda a, p: f"percentile({a}, {p})",
    "seq": lambda a, b: f"(SELECT explode(sequence(CAST({a} AS BIGINT), CAST({b} AS BIGINT))) AS v)",
    "span": lambda a, b: f"explode(sequence(CAST({a} AS BIGINT), CAST({b} AS BIGINT)))",
    "r": lambda a: f"(round(CAST({a} AS DOUBLE), 6) + CAST(0 AS DOUBLE))",
    "x": lambda a, k: f"regexp_extract({a}, {k}, 1)",
}
STANDARD = {
    "us": lambda a: f"epoch_us(CAST({a} AS TIMESTAMP))",
    "pct": lambda a, p: f"quantile_cont({a}, {p})",
    "seq": lambda a, b: f"(SELECT unnest(generate_series(CAST({a} AS BIGINT), CAST({b} AS BIGINT))) AS v)",
    "span": lambda a, b: f"unnest(generate_series(CAST({a} AS BIGINT), CAST({b} AS BIGINT)))",
    "r": lambda a: f"(round(CAST({a} AS DOUBLE), 6) + CAST(0 AS DOUBLE))",
    "x": lambda a, k: f"regexp_extract({a}, {k}, 1)",
}


def _expand(sql: str, macros: dict) -> str:
    while m := _MACRO.search(sql):
        depth, at, args, first = 1, m.end(), [], m.end()
        while depth:
            c = sql[at]
            depth += (c == "(") - (c == ")")
            if depth == 1 and c == ",":
                args.append(sql[first:at])
                first = at + 1
            at += 1
        args.append(sql[first : at - 1])
        sql = sql[: m.start()] + macros[m[1]](*(x.strip() for x in args)) + sql[at:]
    return sql


@dataclass(frozen=True, eq=False)
class Step:
    sql: str
    #: Steps, names of tables, or (on Spark alone) DataFrames.
    inputs: dict[str, Step | str | DataFrame] = field(default_factory=dict)
    #: Makes the same rows from the first input on Spark, where its SQL (a deep recursion) would plan slowly.
    kernel: Callable[[DataFrame], DataFrame] | None = None

    def frame(self, spark: SparkSession, sf_dir: str, made: dict | None = None) -> DataFrame:
        """This step as a DataFrame; a step that several others use is built once."""
        made = {} if made is None else made
        if self not in made:
            args = {}
            for k, x in self.inputs.items():
                args[k] = x.frame(spark, sf_dir, made) if isinstance(x, Step) else x if isinstance(x, DataFrame) else spark.read.parquet(f"{sf_dir}/{x}.parquet")
            made[self] = self.kernel(next(iter(args.values()))) if self.kernel else spark.sql(_expand(self.sql, SPARK), **args)
        return made[self]

    def statement(self) -> str:
        """This step in standard SQL, inputs as common table expressions."""
        names: dict[Step, str] = {}
        parts: list[str] = []

        def place(s: Step) -> str:
            if s not in names:
                args = {k: place(x) if isinstance(x, Step) else x for k, x in s.inputs.items()}
                names[s] = f"s{len(names)}"
                parts.append(f"{names[s]} AS ({_expand(s.sql, STANDARD).format(**args)})")
            return names[s]

        last = place(self)
        return "WITH " + ",\n".join(parts) + f"\nSELECT * FROM {last}"


def step(sql: str, **inputs: Step | str | DataFrame) -> Step:
    return Step(sql, inputs)


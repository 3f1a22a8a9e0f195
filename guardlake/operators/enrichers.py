"""What helps to mend a violation, by rule: joins of violations with the facts of the sources.

Each takes violations ``(rule, relative_path, identifier, detail)`` and facts of
``detect.source_facts``, and returns the violations of its rule with ``hint``. Facts are counted
or listed per key before the join; a list has a fixed length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.storage import saved

#: Names that a hint lists at most; fixed value: calls of a try statement.
SHOWN, CALLS = 6, 5


def _listed(df: DataFrame, by: list[str], what: str, at: str, most: int = SHOWN) -> DataFrame:
    """Per key the names of ``what`` in order of ``at``, the first few."""
    rows = F.array_sort(F.collect_set(F.struct(F.col(at).alias("at"), F.col(what).alias("name"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(F.slice(rows, 1, most), lambda x: x["name"]), ", ").alias("names"))


def _function(identifier: Column) -> Column:
    return F.element_at(F.split(identifier, ":"), 1)


def _with(violations: DataFrame, rule: str, side: DataFrame, keys: dict[str, Column], hint: Column) -> DataFrame:
    v = violations.where(F.col("rule") == rule)
    on = [v_key.eqNullSafe(F.col(f"k_{k}")) for k, v_key in keys.items()]
    side = side.select(*(F.col(k).alias(f"k_{k}") for k in keys), *(c for c in side.columns if c not in keys))
    return v.join(side, on, "left").select("rule", "relative_path", "identifier", "detail", hint.alias("hint"))


def wrappers(violations: DataFrame, facts: DataFrame) -> DataFrame:
    """How often a wrapper is called in its own file, else the files that call it."""
    calls = facts.where("kind = 'call'").groupBy("name", "path").agg(F.count("*").alias("n"))
    own = _with(violations, "unnecessary-wrapper", calls, {"name": F.col("identifier"), "path": F.col("relative_path")}, F.when(F.col("n") > 0, F.concat(F.lit("called "), F.col("n").cast("string"), F.lit(" times in this file"))))
    others = _listed(calls, ["name"], "path", "path")
    far = own.where("hint is null").join(others.withColumnRenamed("name", "identifier"), "identifier", "left")
    hint = F.coalesce(F.concat(F.lit("called in "), "names"), F.lit("no call found"))
    return own.where("hint is not null").union(far.select("rule", "relative_path", "identifier", "detail", hint))


def fixtures(violations: DataFrame, facts: DataFrame) -> DataFrame:
    """The conftest of the folder with its fixtures, or that one is to be made."""
    folder = lambda c: F.regexp_extract(c, "^(.*/)[^/]*$", 1)
    there = facts.where(F.col("path").endswith("conftest.py")).select(folder(F.col("path")).alias("folder")).distinct()
    names = _listed(facts.where(F.col("path").endswith("conftest.py") & (F.col("kind") == "fixture")).withColumn("folder", folder(F.col("path"))), ["folder"], "name", "line")
    hint = F.when(F.col("there"), F.concat_ws(": ", F.lit("move to conftest.py"), "names")).otherwise("make a conftest.py")
    return _with(violations, "fixture-outside-conftest", there.withColumn("there", F.lit(True)).join(names, "folder", "left"), {"folder": folder(F.col("relative_path"))}, hint)


def complexity(violations: DataFrame, facts: DataFrame) -> DataFrame:
    """A function's branches by kind, and what to do about many of one."""
    b = facts.where("kind = 'branches'").select("path", F.concat_ws(":", "name", F.col("line").cast("string")).alias("function"), F.col("lines").alias("ifs"), F.col("params").alias("loops"), F.col("complexity").alias("handlers"))
    part = lambda c, name: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {name}")))
    tips = F.concat_ws("; ", F.when(F.col("ifs") >= 4, "a table of cases"), F.when(F.col("loops") >= 2, "a function for each loop"))
    hint = F.concat_ws(" - ", F.concat_ws(", ", part("ifs", "if"), part("loops", "loops"), part("handlers", "handlers")), F.when(tips != "", tips))
    return _with(violations, "high-complexity", b, {"path": F.col("relative_path"), "function": F.col("identifier")}, hint)


def silent_handlers(violations: DataFrame, facts: DataFrame) -> DataFrame:
    """What the file calls where it catches, handlers included, whose exceptions are to be named."""
    called = _listed(facts.where("kind = 'try_call'").withColumn("at", F.col("line") * 1000 + F.col("lines")), ["path"], "name", "at", CALLS)
    return _with(violations, "silent-except", called, {"path": F.col("relative_path")}, F.coalesce(F.concat(F.lit("may raise: "), "names"), F.lit("name the exception")))


def parameters(violations: DataFrame, facts: DataFrame) -> DataFrame:
    """The parameters that could be grouped."""
    p = _listed(facts.where("kind = 'param'").withColumn("function", F.concat_ws(":", "detail", F.col("line").cast("string"))), ["path", "function"], "name", "lines")
    return _with(violations, "too-many-params", p, {"path": F.col("relative_path"), "function": F.col("identifier")}, F.concat(F.lit("group: "), "names"))


def enriched(violations: DataFrame, facts: DataFrame) -> DataFrame:
    """The violations that have an enricher, each with its hint. Violations are written once, as each enricher reads them; ``facts``
    should be a table too, as most enrichers read them."""
    violations = saved(violations)
    out = wrappers(violations, facts)
    for f in (fixtures, complexity, silent_handlers, parameters):
        out = out.union(f(violations, facts))
    return out

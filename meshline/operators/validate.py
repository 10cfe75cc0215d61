"""Data-quality checks and the guard for generated queries."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Result:
    """Errors block; warnings and information do not (VAL-00)."""

    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    infos: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors

    def raise_if_failed(self) -> None:
        if self.errors:
            raise ValueError("; ".join(self.errors))


@dataclass(frozen=True)
class Check:
    """A count of broken rows of a table. level: error, warning or info; `most`
    broken rows are allowed."""

    name: str
    table: str
    broken: Column | None = None
    level: str = "error"
    unique: tuple[str, ...] = ()
    refers: tuple[str, str, str] | None = None  # column, table, its column
    non_empty: bool = False
    most: int = 0


def run_checks(tables: dict[str, DataFrame], checks: list[Check]) -> tuple[Result, DataFrame]:
    """All checks as one table (check, broken, level) and the result. Conditions
    on one table are counted in one pass; uniqueness and references take an
    aggregation or anti-join each."""
    result, parts = Result(), []
    for table in dict.fromkeys(c.table for c in checks):
        own = [c for c in checks if c.table == table]
        if table not in tables:
            result.errors += [f"{c.name}: table {table} is missing" for c in own if c.level == "error"]
            continue
        df = tables[table]
        simple = [c for c in own if c.broken is not None or c.non_empty]
        if simple:
            counted = df.agg(*((F.when(F.count("*") == 0, 1).otherwise(0) if c.non_empty else F.count(F.when(c.broken, 1))).cast("long").alias(f"c{k}") for k, c in enumerate(simple)))
            parts += [counted.select(F.lit(c.name).alias("check"), F.col(f"c{k}").alias("broken"), F.lit(c.level).alias("level"), F.lit(c.most).alias("most")) for k, c in enumerate(simple)]
        for c in own:
            if c.unique:
                n = df.groupBy(*c.unique).count().where("count > 1").agg(F.count("*").alias("broken"))
            elif c.refers:
                column, other, key = c.refers
                if other not in tables:
                    result.errors.append(f"{c.name}: table {other} is missing")
                    continue
                n = df.where(F.col(column).isNotNull()).join(tables[other].select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_anti").agg(F.count("*").alias("broken"))
            else:
                continue
            parts.append(n.select(F.lit(c.name).alias("check"), "broken", F.lit(c.level).alias("level"), F.lit(c.most).alias("most")))
    if not parts:
        return result, None
    every = reduce(DataFrame.unionAll, parts)
    for r in every.collect():
        if r["broken"] > r["most"]:
            {"error": result.errors, "warning": result.warnings}.get(r["level"], result.infos).append(f"{r['check']}: {r['broken']}")
    return result, every


def targets_exist(tables: dict[str, DataFrame], required: list[str]) -> list[str]:
    """Tables that are absent or empty (VAL-06)."""
    return [t for t in required if t not in tables or tables[t].isEmpty()]


COMMANDS = re.compile(r"^\s*(?:with\b.*?\)\s*)?(insert|update|delete|merge|create|drop|alter|truncate|load|set|reset|cache|uncache|refresh|msck|analyze|grant|revoke|call|add)\b", re.I | re.S)


def guard_sql(spark: SparkSession, query: str, tables: set[str], columns: set[str] | None = None, functions: set[str] | None = None) -> Result:
    """Whether a generated query may run (VAL-07): one statement that only reads,
    that the analyser accepts, over allowed tables, columns and functions. It is
    analysed, not run."""
    result = Result()
    if ";" in query.strip().rstrip(";"):
        result.errors.append("more than one statement")
    if COMMANDS.match(query):
        result.errors.append("only queries are allowed")
    if result.errors:
        return result
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(query.strip().rstrip(";"))
        spark.sql(query)  # analysis only: a query is lazy
    except Exception as e:  # the analyser's own words say what is wrong
        result.errors.append(str(e).splitlines()[0])
        return result
    text = parsed.toString()
    found = {m.split(",")[0].strip("[] ").split(".")[-1].strip() for m in re.findall(r"'UnresolvedRelation \[([^\]]*)\]", text)}
    ctes = {m.lower() for m in re.findall(r"CTE \[([^\]]*)\]", text) for m in m.split(", ")}
    result.errors += [f"table {t} is not allowed" for t in sorted(found) if t.lower() not in {x.lower() for x in tables} | ctes]
    if functions is not None:
        used = {m.lower() for m in re.findall(r"'([a-z_0-9]+)\(", text)}
        result.errors += [f"function {f} is not allowed" for f in sorted(used - {x.lower() for x in functions})]
    if columns is not None:
        named = set(re.findall(r"'(?:\w+\.)*(\w+)(?=[\s,\]\)=<>#]|$)", text))
        known = {x.lower() for x in columns} | {x.lower() for x in found} | {x.lower() for x in re.findall(r" AS (\w+)#", text)} | ctes
        plain = {"unresolvedrelation", "project", "filter", "aggregate", "join", "sort", "globallimit", "locallimit", "distinct", "subqueryalias", "unresolvedalias", "unresolvedhaving", "withcte", "union"}
        result.errors += [f"column {c} is not allowed" for c in sorted(named) if c.lower() not in known | plain]
    return result

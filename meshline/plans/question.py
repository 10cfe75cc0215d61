"""Questions in words: a plan, resolved anchors, a guarded query or a
neighbourhood, and an answer.

Planning, query writing and narration are callables that a language model can
take the place of; the defaults are rules, so that the whole path runs and is
tested without one. Everything between is DataFrame work.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from meshline.operators.validate import guard_sql

DOMAINS = {
    "accessibility": ("elevator", "escalator", "outage", "lift", "accessible"),
    "delay_propagation": ("delay", "late", "propagat"),
    "transfer_impact": ("transfer", "skip", "cancel", "connect", "route"),
}
GRAPH_WORDS = ("shortest", "central", "rank", "component", "communit", "reachable", "path between")


@dataclass
class Plan:
    """path: query, subgraph or both; rejected: why the question isn't answered."""

    domain: str = ""
    path: str = "both"
    anchors: dict[str, list[str]] = field(default_factory=dict)
    uses_graph: bool = False
    rejected: str = ""


@dataclass
class Answer:
    text: str
    mode: str
    rows: list[dict] = field(default_factory=list)
    context: str = ""
    attempts: int = 0
    errors: list[str] = field(default_factory=list)


def plan_by_rules(question: str) -> Plan:
    """The domain whose words occur most; quoted words and codes as anchors;
    graph questions go to a query; a question of no domain is rejected."""
    low = question.lower()
    score = {d: sum(low.count(w) for w in words) for d, words in DOMAINS.items()}
    best = max(score, key=score.get)
    graph = any(w in low for w in GRAPH_WORDS)
    if not score[best] and not graph:
        return Plan(rejected="the question names nothing in the graph")
    anchors = {"name": re.findall(r"['\"]([^'\"]+)['\"]", question), "date": re.findall(r"\b\d{8}\b|\b\d{4}-\d\d-\d\d\b|\btoday\b|\byesterday\b", low)}
    wants_count = re.search(r"\b(how many|count|which|list|most|top)\b", low)
    return Plan(best, "query" if graph or wants_count else "both", {k: v for k, v in anchors.items() if v}, graph)


def parse_plan(text: str) -> Plan:
    """A plan from a model's JSON, with or without a code fence; unknown domains
    and paths are errors."""
    body = re.sub(r"^```(?:json)?\s*|\s*```$", "", text.strip())
    found = json.loads(body)
    p = Plan(found.get("domain", ""), found.get("path", "both"), found.get("anchors", {}) or {}, bool(found.get("uses_graph")), found.get("rejected", "") or "")
    if not p.rejected and p.domain not in DOMAINS:
        raise ValueError(f"no domain {p.domain}")
    if p.path not in ("query", "subgraph", "both"):
        raise ValueError(f"no path {p.path}")
    if p.uses_graph:
        p.path = "query"
    return p


def plan_with_retry(ask: Callable[[str], str], question: str, tries: int = 2, fallback: Callable[[str], Plan] = plan_by_rules) -> Plan:
    """A model's plan; a bad one is asked for again, then the rules decide."""
    for _ in range(tries):
        try:
            return parse_plan(ask(question))
        except (ValueError, KeyError, TypeError):
            continue
    return fallback(question)


def run_query(spark: SparkSession, write: Callable[[str, list[str]], str], question: str, tables: set[str], attempts: int = 3, most_rows: int = 200) -> tuple[DataFrame | None, int, list[str]]:
    """Ask for a query, guard it, run it; what the guard or Spark objects to goes
    into the next attempt. `most_rows` bounds what is shown."""
    errors: list[str] = []
    for k in range(1, attempts + 1):
        text = write(question, errors)
        checked = guard_sql(spark, text, tables)
        if checked.ok:
            try:
                df = spark.sql(text).limit(most_rows)
                df.take(1)
                return df, k, errors
            except Exception as e:  # a query can fail when it runs, too
                errors.append(str(e).splitlines()[0])
        else:
            errors += checked.errors
    return None, attempts, errors


def narrate_by_rules(question: str, rows: list[dict], context: str, mode: str) -> str:
    if mode == "degraded":
        return "No data could be found for this question."
    lines = ["; ".join(f"{k} {v}" for k, v in r.items()) for r in rows[:10]]
    if mode == "contextual":
        return context
    return "\n".join([f"{len(rows)} rows."] + lines + ([context] if mode == "synthesis" else []))


def answer(spark: SparkSession, question: str, tables: set[str], write: Callable[[str, list[str]], str] | None = None, context: Callable[[Plan], str] | None = None, planner: Callable[[str], Plan] = plan_by_rules, narrate: Callable[[str, list[dict], str, str], str] = narrate_by_rules) -> Answer:
    """Plan, query, neighbourhood, narration. The mode says what there was:
    synthesis (rows and context), precision (rows), contextual, or degraded."""
    plan = planner(question)
    if plan.rejected:
        return Answer(plan.rejected, "rejected")
    rows, tries, errors, text = [], 0, [], ""
    if plan.path in ("query", "both") and write:
        df, tries, errors = run_query(spark, write, question, tables)
        rows = [r.asDict() for r in df.collect()] if df is not None else []
    if plan.path in ("subgraph", "both") and context:
        text = context(plan)
    mode = {(True, True): "synthesis", (True, False): "precision", (False, True): "contextual", (False, False): "degraded"}[bool(rows), bool(text)]
    return Answer(narrate(question, rows, text, mode), mode, rows, text, tries, errors)


def agent(tools: dict[str, Callable[..., object]], choose: Callable[[str, list[tuple[str, object]]], tuple[str, dict] | str], question: str, most_steps: int = 5) -> tuple[str, list[tuple[str, object]]]:
    """A loop of tool calls: `choose` names a tool and its arguments, or gives the
    answer. Unknown tools and failures are results too. Ends after `most_steps`."""
    seen: list[tuple[str, object]] = []
    for _ in range(most_steps):
        step = choose(question, seen)
        if isinstance(step, str):
            return step, seen
        name, arguments = step
        try:
            seen.append((name, tools[name](**arguments) if name in tools else f"no tool {name}"))
        except Exception as e:  # a tool's failure is told to the one who chose it
            seen.append((name, f"failed: {e}"))
    return "No answer within the steps allowed.", seen

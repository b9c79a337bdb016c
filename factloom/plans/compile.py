"""From a query to a lazy DataFrame: Catalyst is the optimizer and Spark's plan the physical plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from factloom.functions.temporal import AsOf
from factloom.operators import retrieval
from factloom.plans.parser import Query, parse


@dataclass(frozen=True)
class LogicalPlan:
    """The steps of a query, in order: (name, arguments)."""

    steps: tuple[tuple[str, tuple], ...] = field(default_factory=tuple)


def logical_plan(query: Query) -> LogicalPlan:
    """Seed, as-of filter, expansion, budget, context. Expansion is recorded; answers do not expand."""
    steps: list[tuple[str, tuple]] = [("seed", (query.similar_to,)), ("as_of", (query.as_of or AsOf.now(),))]
    if query.max_depth is not None:
        steps.append(("expand", (query.max_depth,)))
    steps.append(("budget", (retrieval.DEFAULT_BUDGET if query.budget is None else query.budget,)))
    steps.append(("context", (query.cite,)))
    return LogicalPlan(tuple(steps))


def ranked(query: Query, facts: DataFrame, tenant: int | None = None) -> DataFrame:
    """The ranking of a query, before the budget."""
    return retrieval.ranked_facts(facts, query.as_of, query.similar_to, tenant)


def chosen(query: Query, facts: DataFrame, tenant: int | None = None) -> DataFrame:
    """The ranked facts that fit the query's budget."""
    return retrieval.within_budget(ranked(query, facts, tenant), retrieval.DEFAULT_BUDGET if query.budget is None else query.budget)


def answer(source: str, facts: DataFrame, tenant: int | None = None) -> DataFrame:
    """One row (text, citations). What RETURN names does not matter: an answer is always a context."""
    query = parse(source)
    return retrieval.context(chosen(query, facts, tenant), query.cite)

"""What a raw statement may do: read collections, and nothing else. Spark's own parser says what it is."""

from __future__ import annotations

import re

from py4j.java_gateway import is_instance_of
from pyspark.errors import ParseException
from pyspark.sql import SparkSession

from ..errors import SyntaxProblem

_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
#: The interfaces of plans that do something, and the prefixes of those that have none.
_ACTS = (_LOGICAL + "Command", _LOGICAL + "ParsedStatement")
_ACT_NAMES = re.compile(r"Insert|Create|Replace|Drop|Alter|Merge|Delete|Update|Script|Overwrite|Append|Write|Load|Set(?!Operation)")
_RELATION, _CTE = re.compile(r"UnresolvedRelation \[([^\]]*)\]"), re.compile(r"\bCTE \[([^\]]*)\]")


def read_only(spark: SparkSession, statement: str, collections: set[str]) -> set[str]:
    """The collections that a query reads; an error if it is not a query, or reads anything else.

    A table by its path (``parquet.`/folder```) or of another catalog has a name of several parts.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except ParseException as e:
        raise SyntaxProblem(str(e).strip().splitlines()[0]) from e
    if plan.getClass().getSimpleName() == "ExplainCommand":
        plan = plan.logicalPlan()
    _check(spark.sparkContext._gateway, plan)
    tree = plan.treeString()
    local = {n.strip().lower() for names in _CTE.findall(tree) for n in names.split(",")}
    read = {r.strip().lower() for r in _RELATION.findall(tree)} - local
    if other := sorted(r for r in read if r not in collections):
        raise SyntaxProblem(f"{other[0]} is not a collection")
    return read


def _check(gateway, plan) -> None:
    name = plan.getClass().getSimpleName()
    if any(is_instance_of(gateway, plan, c) for c in _ACTS) or _ACT_NAMES.match(name):
        raise SyntaxProblem("only queries can be run this way")
    for children in (plan.children(), plan.innerChildren()):
        for i in range(children.size()):
            child = children.apply(i)
            if hasattr(child, "children") and is_instance_of(gateway, child, _LOGICAL + "LogicalPlan"):
                _check(gateway, child)

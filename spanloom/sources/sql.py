"""User SELECTs over registered tables."""

from __future__ import annotations

import re

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession

#: Words that a statement may not have outside quotes.
FORBIDDEN = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "ATTACH", "DETACH", "RENAME", "SYSTEM", "KILL")
#: Functions that call into the JVM.
CALLS = ("REFLECT", "JAVA_METHOD", "TRY_REFLECT")
_quoted = re.compile(r"\b[rR](?:'[^']*'|\"[^\"]*\")|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", re.S)
_catalyst = "org.apache.spark.sql.catalyst."


def check_select(text: str) -> None:
    """Raises ValueError unless the text is one SELECT (or WITH ... SELECT) without a forbidden word or call."""
    bare = _quoted.sub(" ", text).upper()
    words = re.findall(r"\w+", re.sub(r"`[^`]*`", " ", bare))
    if not words or words[0] not in ("SELECT", "WITH"):
        raise ValueError("only SELECT is allowed")
    if bad := next((w for w in words if w in FORBIDDEN), None):
        raise ValueError(f"{bad} is not allowed")
    if bad := next((w for w in re.findall(r"\w+", bare) if w in CALLS), None):
        raise ValueError(f"{bad} is not allowed")


def check_plan(spark: SparkSession, text: str) -> None:
    """Raises ValueError if Spark would parse the text as anything that is more than a query, at any level, or if it would read a
    path: a name of two parts that is no table of the catalog."""
    plans = [spark._jsparkSession.sessionState().sqlParser().parsePlan(re.sub(r"\{(\w+)\}", r"\1", text))]
    of_kind = lambda plan, kind: is_instance_of(spark._sc._gateway, plan, _catalyst + kind)
    while plans:
        plan = plans.pop()
        if any(of_kind(plan, kind) for kind in ("plans.logical.Command", "plans.logical.ParsedStatement")):
            raise ValueError(f"{plan.nodeName()} is not allowed")
        if of_kind(plan, "analysis.UnresolvedRelation"):
            named = plan.multipartIdentifier()
            parts = [named.apply(i) for i in range(named.size())]
            quoted = ".".join("`" + p.replace("`", "``") + "`" for p in parts)
            if len(parts) > 1 and not spark.catalog.tableExists(quoted):
                raise ValueError(f"{quoted} is not a table")
        for some in (plan.children(), plan.innerChildren()):
            plans += [x for i in range(some.size()) if of_kind(x := some.apply(i), "plans.logical.LogicalPlan")]


def sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """The result of a SELECT over ``tables``, named in braces, and the session's catalog; paths aren't tables.  No setting of the
    session is touched, so callers don't disturb one another."""
    check_select(text)
    check_plan(spark, text)
    return spark.sql(text, **tables)

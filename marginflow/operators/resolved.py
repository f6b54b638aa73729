"""What a query's text resolves to, checked on its analysed plan.

A pattern on the text can be passed by spelling (``IDENTIFIER('ref' || 'lect')``) and refuses
honest literals.  The analysed plan has every name resolved: relations are views, functions are
expressions, and sub-queries are plans of their own.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import DataFrame

_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions"

#: Leaves of a plan that read nothing but literals, ranges and common tables of the same query.
_LEAVES = frozenset({"OneRowRelation", "LocalRelation", "Range", "EmptyRelation", "CTERelationRef", "UnionLoopRef"})
#: Calls of any Java method by name, and plans that run a script.
_REFUSED = frozenset({"CallMethodViaReflection", "ScriptTransformation"})
#: Parts of the class names of user-defined functions.
_USER_DEFINED = ("UDF", "UDAF", "UDTF", "ScalaAggregator", "TypedAggregateExpression")


def _items(sequence: JavaObject) -> Iterator[JavaObject]:
    return (sequence.apply(i) for i in range(sequence.size()))


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def check_resolved(answer: DataFrame, views: Collection[str]) -> None:
    """Raises ValueError unless ``answer`` reads the temporary ``views`` only and calls built-in functions only.

    The plans behind the views are the library's own and are not looked into.
    """
    gateway = answer.sparkSession.sparkContext._gateway
    plans = [answer._jdf.queryExecution().analyzed()]
    while plans:
        plan = plans.pop()
        kind = _kind(plan)
        if kind == "View":
            name = plan.desc().identifier().table()
            if not plan.isTempView() or name not in views:
                raise ValueError(f"{name} is not a relation of this tenant")
            continue
        children = list(_items(plan.children()))
        if kind in _REFUSED:
            raise ValueError(f"{kind} is not admitted in a tenant's query")
        if not children and kind not in _LEAVES:
            raise ValueError(f"relations other than the tenant's are not admitted ({kind})")
        plans += children
        expressions = list(_items(plan.expressions()))
        while expressions:
            expression = expressions.pop()
            kind = _kind(expression)
            if kind in _REFUSED or any(part in kind for part in _USER_DEFINED):
                raise ValueError(f"functions such as {expression.prettyName()} are not admitted in a tenant's query")
            if is_instance_of(gateway, expression, f"{_EXPRESSIONS}.SubqueryExpression"):
                plans.append(expression.plan())
            expressions += _items(expression.children())

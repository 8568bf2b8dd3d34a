"""What a query did, read from its executed plan."""

from __future__ import annotations


def joined_rows(df) -> int:
    """The most rows that a join of the query put out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    most, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most

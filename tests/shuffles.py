"""What a query really moved: the rows and columns of its shuffles, after it has run."""

from __future__ import annotations


def exchanges(df) -> list[tuple[list[str], int]]:
    """Per shuffle of the executed plan: the columns it carried and the rows it wrote."""
    df.collect()
    execution = df._jdf.queryExecution()
    execution.toRdd()
    return _walk(_final(execution.executedPlan()))


def _final(node):
    """The plan that adaptive execution arrived at."""
    return node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node


def _walk(node) -> list[tuple[list[str], int]]:
    out, name = [], node.nodeName()
    if name == "AdaptiveSparkPlan":
        return _walk(node.executedPlan())
    if name.endswith("QueryStage"):
        return _walk(node.plan())
    if name == "Exchange":
        columns = [node.output().apply(i).name() for i in range(node.output().size())]
        out.append((columns, node.metrics().get("shuffleRecordsWritten").get().value()))
    children = node.children()
    for i in range(children.size()):
        out += _walk(children.apply(i))
    return out

"""What a finished query's plan says about the work it did."""


def _children(node):
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if name.endswith("QueryStageExec"):
        return [node.plan()]
    kids = node.children()
    return [kids.apply(i) for i in range(kids.size())]


def nodes(df, kind: str):
    """The nodes of a class whose name starts with ``kind``, of the plan that ran; a reused exchange counts once."""
    found, waiting, seen = [], [df._jdf.queryExecution().executedPlan()], set()
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        if name == "ReusedExchangeExec":
            continue
        if name.startswith(kind) and node.id() not in seen:
            seen.add(node.id())
            found.append(node)
        waiting += _children(node)
    return found


def metric(node, name: str) -> int:
    return node.metrics().apply(name).value()


def exchanged(df, with_column: str | None = None) -> int:
    """Rows written by the exchanges that ran (of those alone that carry ``with_column``)."""
    total = 0
    for x in nodes(df, "ShuffleExchange"):
        names = [x.output().apply(i).name() for i in range(x.output().size())]
        if with_column is None or with_column in names:
            total += metric(x, "shuffleRecordsWritten")
    return total

"""Rows that the operators of Spark's plans put out, read from the session's own metrics."""


def most_rows(spark, run):
    """(result, rows): what ``run()`` returns, and the most rows that any one operator put out meanwhile."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    result = run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    done, most = store.executionsList(), 0
    for k in range(before, done.size()):
        number = done.apply(k).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for n in range(nodes.size()):
            metrics = nodes.apply(n).metrics()
            for m in range(metrics.size()):
                metric = metrics.apply(m)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return result, most

"""Helpers of the test modules."""


def rows(df):
    return [tuple(r) for r in df.collect()]


def _scans(plan):
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _scans(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from _scans(plan.plan())
    elif "FileSourceScanExec" in kind:
        yield plan
    else:
        children = plan.children()
        for i in range(children.size()):
            yield from _scans(children.apply(i))


def scan_metrics(df, name):
    """(rows of ``df``, one metric of each of its file scans as it ran)."""
    found = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return found, [p.metrics().apply(name).value() for p in _scans(plan)]

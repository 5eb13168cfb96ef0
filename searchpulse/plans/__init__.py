"""Compositions of operators: the daily run and the named queries."""


def _load():
    from searchpulse.plans import (  # noqa: F401
        batch_queries,
        landing_queries,
        report_queries,
        serving_queries,
        stream_queries,
        text_queries,
    )
    from searchpulse.plans import registry

    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)

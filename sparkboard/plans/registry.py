"""All registered queries under their names."""

from __future__ import annotations

from sparkboard.plans import datasets, orders, panels, questions, talks
from sparkboard.plans.common import Query


def registered() -> dict[str, Query]:
    result: dict[str, Query] = {}
    for module in (datasets, questions, panels, talks, orders):
        for name, query in module.QUERIES.items():
            if name in result:
                raise ValueError(f"two queries are named {name}")
            result[name] = query
    return result

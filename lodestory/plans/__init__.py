"""Named queries over the driver's tables."""

from __future__ import annotations


def _load():
    from lodestory.plans import catalog, news, registry, scalars, scans, streams, vectors  # noqa: F401

    return catalog


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(_load().ORACLES)

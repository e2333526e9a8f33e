"""Queries over the given tables, by area of the evaluation model."""

from __future__ import annotations

from importlib import import_module

AREAS = ("scoring", "summaries", "items", "records_area", "costs_area", "inference", "calibration_area", "debiasing", "logprob_area", "rankings", "streams", "studies")


def _load() -> None:
    for area in AREAS:
        import_module(f"plumbline.queries.{area}")


def all_queries():
    from plumbline.queries.registry import QUERIES

    _load()
    return dict(QUERIES)


def oracles():
    from plumbline.queries.registry import ORACLES

    _load()
    return dict(ORACLES)

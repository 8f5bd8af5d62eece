"""All registered queries of the exam platform's operators."""

from __future__ import annotations

from gradeloom.plans import changes, grading, lookups, papers, registry, scalars  # noqa: F401


def flagship(spark, sf_dir):
    return grading.attempt_summary(spark, sf_dir)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLE)

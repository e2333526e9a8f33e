"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = (
    "benchmark_summary", "ece_equal_mass", "latest_records", "question_bank", "split_halves", "fold_assignment", "token_costs",
    "paired_bootstrap", "speed_quality_frontier", "batch_debiased", "first_token_read", "streamed_latest_records", "temperature_fits", "registry_applied", "committed_manifest", "system_comparison",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    theirs = sorted((tuple(dict(zip(names, row))[c] for c in columns) for row in result.fetchall()), key=str)
    assert sorted(names) == columns and ours == theirs


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_the_text_operators(monkeypatch):
    """What the text operators need may be missing: the other queries stay."""
    import builtins
    import sys

    real = builtins.__import__

    def lacking(name, *args, **kwargs):
        if name.startswith("public_tokenizers"):
            raise ModuleNotFoundError(name)
        return real(name, *args, **kwargs)

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith(("plumbline.llm", "public_tokenizers"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", lacking)
    assert len(entry.queries()) > 150 and not any(q.startswith("op") and q[2].isdigit() for q in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import math
import os
import subprocess
import sys
from collections import Counter

import pytest

from cadentia.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = [
    "structural_role", "clocks_and_stamps", "value_counts_first_seen", "mood_distribution_summary", "variance_ranks", "order_by_sequence", "features_with_paths", "feature_validation", "phase_validation",
    "phase_means", "window_features", "cluster_table", "collection_figures", "phase_table", "tool_phases", "tool_sequence_totals", "lloyd_iterations", "running_total_of_all", "separated_peaks", "section_split_long",
    "greedy_sequence", "tensor_profile", "export_rounding",
]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("needs the driver's tables")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def test_names_are_known_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(set(e.oracle_sql()) <= set(e.queries()))"], cwd=root, capture_output=True, text=True)
    assert out.stdout.strip() == "True", out.stderr


def told(v) -> str:
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(told(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert got == Counter(tuple(told(r[names.index(c)]) for c in columns) for r in found.fetchall())

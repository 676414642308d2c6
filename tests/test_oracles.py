"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from strokemill import registry

TABLES = "/root/testdata"
#: Every query on the smallest tables; those that compare floats or walk through groups on larger ones, too.
LARGER = "pose_tracker order_nearest clean_paths dedupe_open_paths epoch_losses action_counts action_table view_bounds path_length plan_metrics segment_kinematics stitch_paths emit_commands fit_to_page resample_closed average_closed elongated_centerlines variant_aggregates planning_comparison vision_comparison calibration training_history image_flags match_tiered".split()
DATA = f"{TABLES}/sf0.001"


def shown(x):
    if x is None:
        return "None"
    if isinstance(x, float) and x == int(x):
        return repr(int(x))
    return repr(float(x)) if type(x).__name__ == "Decimal" else repr(x)


@pytest.fixture(scope="module")
def duck():
    held = {}

    def of(sf):
        if sf not in held:
            held[sf] = duckdb.connect()
            for f in os.listdir(f"{TABLES}/{sf}"):
                held[sf].execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{sf}/{f}'")
        return held[sf]

    return of


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize(("name", "sf"), [(n, "sf0.001") for n in sorted(registry.ORACLE)] + [(n, "sf0.01") for n in LARGER])
def test_oracle(spark, duck, name, sf):
    df = registry.queries()[name](spark, f"{TABLES}/{sf}")
    done = duck(sf).execute(registry.ORACLE[name])
    columns = [c[0] for c in done.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted(tuple(shown(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(shown(r[columns.index(c)]) for c in order) for r in done.fetchall())
    assert got == want


def test_every_query_has_columns(spark):
    for name, f in registry.queries().items():
        assert f(spark, DATA).columns, name

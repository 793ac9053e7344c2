"""Weather queries over every grid point, next to their oracle SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_registered_queries import SF, TABLES, order, same

POINTS = ["A22_quarterly_forecast", "P19_forecast_snapshot", "A23_annual_weather", "A24_annual_model_panel", "A25_extension_audit",
          "J18_operations_with_weather", "W16_expanding_forecasts", "A26_forecast_errors", "A27_forecast_skill", "R16_study_completion"]


@pytest.mark.parametrize("name", POINTS)
def test_all_points_equal_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert cols == sorted(names)
    want = sorted([tuple(dict(zip(names, r))[c] for c in cols) for r in cur.fetchall()], key=order)
    rows = df.collect()
    got = sorted([tuple(r[c] for c in cols) for r in rows], key=order)
    assert len(got) == len(want) and all(same(x, y) for g, w in zip(got, want) for x, y in zip(g, w))
    point = next((c for c in cols if c in ("grid_point_id", "weather_point_id")), None)
    if point:
        assert {r[point] for r in rows} == {f"grid_0{k}" for k in range(1, 8)}


"""Transcripts whose topic titles repeat or are empty, against the SQL of the queries."""

import duckdb
import pytest

from subjectloom.plans import registry

from .compare import same_rows

ORACLES, QUERIES = registry.oracle_sql(), registry.queries()


@pytest.mark.parametrize("name", ["marker_extract", "span_modes", "clean_for_eval"])
def test_repeated_titles(spark, tmp_path, name):
    said = ["one two three four", "one two three five", "", "six"]
    rows = [(c, 2 * t + k, role, x if role == "user" else "well") for c in range(1, 41) for t, x in enumerate(said[c % 4 :] + said[: c % 4]) for k, role in enumerate(("user", "assistant"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    same_rows(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name])

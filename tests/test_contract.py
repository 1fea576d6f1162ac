"""The driver's contract: queries agree with their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from seqbraid import queries as own

DATA = "/root/testdata/sf0.001"


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).values.tolist()), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["dedup_ids", "pairs_d2", "mp_tidy", "sphere_tidy", "cc_clusters", "umi_paired", "layout_unique_fastq", "layout_tags", "raw_round_trip", "stream_collapse"])
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{DATA}/events.parquet'")
    assert rows_of(own.queries()[name](spark, DATA).toPandas()) == rows_of(con.execute(own.oracle_sql()[name]).df())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

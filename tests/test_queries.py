"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__
from packsift.plans import ORACLE, QUERIES
from tests.compare import connect, differences


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, sf_dir, name):
    count, problem = differences(spark, db, sf_dir, name)
    assert problem is None, problem
    assert count >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == [
        "pkg",
        "dist_index",
        "path",
        "check_id",
        "start_line",
        "end_line",
    ]


def test_every_check_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"src_file_walk"}

import datetime as dt

import pytest

from shelfcast.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


def day(text):
    return dt.date.fromisoformat(text)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]

"""Every registered query against its SQL, on the smallest tables."""

import glob
import hashlib
import math
import os
from decimal import Decimal

import duckdb
import numpy as np
import pytest

from graphloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    return None if isinstance(v, float) and math.isnan(v) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((v is None, "" if v is None else v) for v in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    want = db.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, want = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-6 for x, y in zip(a, b, strict=True)), (a, b)


def test_frozen_transform(spark):
    r = registry.QUERIES["frozen_transform"](spark, SF).collect()
    assert r and all(x.baseline > 0 for x in r)


def test_path(spark):
    r = registry.QUERIES["compressor_path"](spark, SF).orderBy("n_rules").collect()
    assert [x.n_rules for x in r] == list(range(len(r)))
    assert r[0].net_savings_bits == -1


def test_bootstrap_takes_every_supplier(spark, tmp_path):
    value = [float(i * 37 % 101) + (1000 if i >= 100 else 0) for i in range(130)]
    spark.createDataFrame([(i + 1, v) for i, v in enumerate(value)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = registry.QUERIES["bootstrap_ci"](spark, str(tmp_path)).first()
    n = len(value)
    means = [sum(value[int(hashlib.md5(f"3:{r}:{j}".encode()).hexdigest()[:8], 16) % n] for j in range(n)) / n for r in range(200)]
    want = (sum(value) / n, *np.quantile(means, (0.025, 0.975)))
    assert (got.estimate, got.lower, got.upper) == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("name", ["compressor_path", "frozen_transform"])
def test_every_class_is_priced(spark, monkeypatch, name):
    class Stop(Exception):
        pass

    def top(support, most, *least):
        raise Stop(most, support.count())

    monkeypatch.setattr("graphloom.plans.compressor.motifs.top_motifs", top)
    with pytest.raises(Stop) as e:
        registry.QUERIES[name](spark, SF)
    most, classes = e.value.args
    assert most >= classes > 8

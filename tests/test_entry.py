import glob
import math
import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pytest

from skein.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def values(rows, columns):
    """Rows as sorted text, columns by name, numbers to nine digits."""

    def plain(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return "None" if math.isnan(v) else f"{float(v):.9g}"
        return str(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def compared(spark, sf_dir, query, sql):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = query(spark, sf_dir)
    want = db.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert values([tuple(r) for r in got.collect()], got.columns) == values(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, sf_dir, name):
    compared(spark, sf_dir, catalog.QUERIES[name], catalog.SQL[name])


def vectors(folder, rows):
    db = duckdb.connect()
    db.execute("CREATE TABLE t (vec_id BIGINT, embedding FLOAT[], label INT)")
    db.executemany("INSERT INTO t VALUES (?, ?, 0)", rows)
    db.execute(f"COPY t TO '{folder}/embeddings.parquet'")
    return str(folder)


def test_inverse_cdf_where_draws_equal_sums(spark, tmp_path):
    """Each vector's sum up to some place is exactly the draw's share of the whole."""
    rng, rows = np.random.default_rng(5), []
    for k in range(2000):
        tenths, n = int(rng.integers(1, 10)), int(rng.integers(33, 60))
        before = rng.integers(1, 300, n)
        before[0] += -before.sum() % tenths
        after = rng.multinomial(before.sum() * (10 - tenths) // tenths, np.full(64 - n, 1 / (64 - n)))
        rows.append((10 * k + tenths, (np.concatenate([before, after]) / 1000).tolist()))
    compared(spark, vectors(tmp_path, rows), catalog.QUERIES["inverse_cdf"], catalog.SQL["inverse_cdf"])


def test_inverse_cdf_of_odd_vectors(spark, tmp_path):
    """Zeros, nulls, nothing, numbers that are not finite, ids that are null, negative or repeated."""
    rows = [(1, [0.0] * 64), (3, None), (4, []), (-7, [0.5, 0.25]), (None, [0.1, 0.2]), (5, [None] * 4), (6, [0.5, None, 0.25]), (-9, [None, 0.5]), (9, [math.nan, 0.5]), (8, [math.inf, 0.5]), (19, [0.1, 0.2]), (19, [0.2, 0.2, 0.4])]
    compared(spark, vectors(tmp_path, rows), catalog.QUERIES["inverse_cdf"], catalog.SQL["inverse_cdf"])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.queries())


def test_without_the_training_data_subpackage(tmp_path):
    """Everything else imports with skein/llm, tests/llm and corpus_pipeline.py gone."""
    shutil.copytree(f"{ROOT}/skein", tmp_path / "skein", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    for leftover in (False, True):
        if leftover:
            (tmp_path / "skein" / "llm" / "__pycache__").mkdir(parents=True)
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_scans_are_pruned_and_filters_pushed(spark, sf_dir):
    plan = catalog.QUERIES["star_pricing"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_linestatus:string,l_shipdate:timestamp" in plan
    plan = catalog.QUERIES["dedupe_transcripts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    plan = catalog.QUERIES["star_left_join"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint>" in plan

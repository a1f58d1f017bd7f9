"""Every core query against its SQL; those without SQL run and keep their columns."""

import pytest

from folioscope.plans.oracle import SQL
from folioscope.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_imports_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['folioscope.llm'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__import__("os").path.dirname(__import__("os").path.dirname(__file__)))
    assert out.returncode == 0 and int(out.stdout) >= 50, out.stderr


def test_scan_is_pruned_and_filtered(spark, sf):
    plan = QUERIES["src05_projection"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(manual_type), EqualTo(manual_type,teacher)]" in plan
    assert "content" not in plan.split("ReadSchema")[1]


def test_every_chunk_is_upserted(spark, sf):
    from folioscope.plans.queries import MODEL
    from folioscope.session import table

    got = {(r.document_id, r.model_name): (r.id, r.dimensions) for r in QUERIES["snk03_upserted"](spark, sf).collect()}
    ids = {r.id for r in table(spark, sf, "chunks", "id").collect()}
    assert all(got[i, MODEL] == (f"new-{i}", 32) for i in ids)
    old = {(r.document_id, r.model_name) for r in table(spark, sf, "document_embeddings").collect()}
    assert set(got) == old | {(i, MODEL) for i in ids}

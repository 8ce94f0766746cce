"""Pipeline and registration."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

import corpus_pipeline
from wattle.llm import decontaminate, line_dedup, mixture, near_dup, toxicity
from wattle.llm.queries import QUERIES
from wattle.llm.sql import ORACLE

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_one_query_for_each_operator():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(ORACLE) <= set(QUERIES)


@needs_data
def test_stages_take_effect_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixture"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, stage(spark, out, SF).checkpoint()
        if name == "toxicity":
            s = toxicity.score(before, toxicity.train(before, labels))
            assert ids(out) == ids(s.filter("score < 0.5"))
        elif name == "line_dedup":
            assert sorted(map(tuple, out.select("doc_id", "text").collect())) == sorted(map(tuple, line_dedup.line_dedup(before).select("doc_id", "text").collect()))
        elif name == "near_dedup":
            assert ids(out) == ids(near_dup.near_duplicates(before).filter("kept"))
        elif name == "decontamination":
            assert ids(out) == ids(decontaminate.matches(before, bench).filter("NOT contaminated"))
        else:
            plan = {r.doc_id: r.taken for r in mixture.mixture(before).collect() if r.taken}
            assert {r.doc_id: r.taken for r in out.collect()} == plan
        if name != "mixture":
            assert out.columns == docs.columns
    assert {r.doc_id: r.taken for r in corpus_pipeline.run(spark, SF).collect()} == plan


@needs_data
def test_every_document_has_one_result_row(spark):
    rows = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, query in QUERIES.items():
        df = query(spark, SF)
        if name != "op6_tool_calls":
            assert df.count() == rows["pages" if name == "op13_url_filter" else "documents"], name
        else:
            assert df.count() > 0


def test_entry_works_without_the_subpackage(tmp_path):
    import shutil
    shutil.copytree(os.path.join(ROOT, "wattle"), tmp_path / "wattle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'training_frame' in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})

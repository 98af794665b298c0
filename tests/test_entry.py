"""The driver's contract."""

import os

import __spark_entry__
import pytest


def test_entry_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "rank", "doc_id", "score"] and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tidemark", "llm")), reason="without the training-data operators")
def test_each_training_operator_has_a_query():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_nothing_else_imports_the_training_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "tidemark")):
        if os.path.basename(folder) not in ("llm", "__pycache__"):
            assert not any("tidemark.llm" in open(os.path.join(folder, f)).read() for f in files if f.endswith(".py"))

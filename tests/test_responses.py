"""Tables of OCR responses: resolved inside each response, so no size estimate can turn its blocks into a broadcast."""

import json

import oracle
import pytest

import __spark_entry__ as entry
from paperloom.operators import documents as doc


@pytest.mark.parametrize("name", ["ocr_tables", "table_markdown"])
def test_no_join(spark, name):
    df = entry.queries()[name](spark, oracle.DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    assert plan.count("Exchange hashpartitioning") == 1  # the lines of an order meet once


def test_odd_responses(spark):
    rel = lambda *ids: [{"Type": "CHILD", "Ids": list(ids)}]
    blocks = [
        {"Id": "t1", "BlockType": "TABLE", "Relationships": rel("c1", "gone", "w1", "c2")},
        {"Id": "t2", "BlockType": "TABLE", "Relationships": [{"Type": "MERGED_CELL", "Ids": ["c1"]}, *rel("c3")]},
        {"Id": "t3", "BlockType": "TABLE"},
        {"Id": "c1", "BlockType": "CELL", "RowIndex": 1, "ColumnIndex": 1, "Relationships": rel("w2", "w1", "w3", "none")},
        {"Id": "c2", "BlockType": "CELL", "RowIndex": 2, "ColumnIndex": 2, "Relationships": [*rel("w1"), {"Type": "CHILD"}, *rel("w2")]},
        {"Id": "c3", "BlockType": "CELL", "RowIndex": 1, "ColumnIndex": 1, "Relationships": rel("w1")},
        {"Id": "c4", "BlockType": "CELL", "RowIndex": 9, "ColumnIndex": 9, "Relationships": rel("w1")},
        {"Id": "w1", "BlockType": "WORD", "Text": "old"}, {"Id": "w1", "BlockType": "WORD", "Text": "new"},
        {"Id": "w2", "BlockType": "WORD", "Text": "two"}, {"Id": "w3", "BlockType": "WORD"}, {"BlockType": "WORD", "Text": "lost"},
    ]
    df = spark.createDataFrame([(1, json.dumps(blocks)), (2, "[]"), (3, None), (4, "broken")], "id int, body string")
    want = {(1, "t1", 1, 1, "two new"), (1, "t1", 2, 2, "new two"), (1, "t2", 1, 1, "new")}
    assert {tuple(r) for r in doc.response_cells(df, "id", "body").collect()} == want
    assert {r.markdown for r in doc.markdown(doc.response_cells(df, "id", "body"), ["id", "table_id"]).collect()} == {"| two new |  |\n| --- | --- |\n|  | new two |", "| new |\n| --- |"}

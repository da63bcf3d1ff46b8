import os

from callgauge import session
from callgauge.operators import access


def test_scratch_is_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_made", [f"file://{tmp_path}/ours"])
    for name in ("ours", "another-process"):
        spark.range(3).write.parquet(f"file://{tmp_path}/{name}")
    session.clear_scratch(spark)
    assert os.listdir(tmp_path) == ["another-process"]


def test_metadata_filter_loses_no_row(spark):
    rows = ['{"k":42}', '{"\\u006b":42}', '{"a":{"k":42}}', '{"k":"42"}', '{"k":41}', "{}", None, '{ "k" : 42 }']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, metadata string")
    assert sorted(r.i for r in access.with_metadata(df, "$.k", 42, "int").collect()) == [0, 1, 3, 7]

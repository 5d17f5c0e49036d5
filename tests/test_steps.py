from urllib.parse import urlparse

from kinespark.functions import steps


def test_written_tables_are_read_back_and_cleared(spark):
    from pathlib import Path

    others, steps._AT_END[:] = list(steps._AT_END), []
    df = steps.written(spark.range(5), "step")
    folder = Path(urlparse(steps._AT_END[0]).path)
    assert sorted(r.id for r in df.collect()) == list(range(5)) and folder.is_dir()
    steps._AT_END.append("nosuchstore://x/y")
    steps.clear()
    assert not folder.exists() and steps._AT_END == []
    steps._AT_END[:] = others

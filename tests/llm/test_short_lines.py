"""Line dedup of short lines."""

from faultspark.llm import line_edit


def test_short_lines_are_deduped(spark):
    rows = [(1, "短い文です。\nTi.\nThe same old words\n\n\t"), (2, "短い文です。\nOf.\nThe same odd words\n\n\t"), (3, "Ti.\nshort 1\nOf."), (4, "A new old line here\n Ti. \nshort 2")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: (r.text, r._n_equal, r._n_near) for r in line_edit.dedup_lines(table).collect()}
    assert out == {1: (rows[0][1], 0, 0), 2: ("Of.\n\n\t", 1, 1), 3: ("short 1", 2, 0), 4: ("A new old line here\nshort 2", 1, 0)}

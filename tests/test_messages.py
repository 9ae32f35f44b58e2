"""The message channel as a stream: late turns, many micro-batches, nulls and repeats."""

from runfold.operators import state
from runfold.streaming import streams

SCHEMA = "conv_id long, turn long, role string, text string"


def test_positions_over_many_batches(spark, tmp_path):
    dst = str(tmp_path / "conversations.parquet")
    parts = [[(1, 0, "user", "a"), (1, 3, "user", "d"), (2, 0, "user", None)], [(1, 1, "assistant", "late"), (None, 0, "user", "n")],
             [(1, 2, "user", "later"), (2, 7, None, ""), (2, 9, "user", "z")]]
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(dst)
    got = streams.streaming_messages(spark, str(tmp_path), max_files=1)
    want = state.state_append(spark.read.parquet(dst), "conv_id", "turn", ["role", "text"])
    rows = sorted((str(r.conv_id), r.position, r.turn, str(r.role), str(r.text)) for r in got.collect())
    assert rows == sorted((str(r.conv_id), r.position, r.turn, str(r.role), str(r.text)) for r in want.collect())
    assert [(p, t) for c, p, t, _, _ in rows if c == "1"] == [(0, 0), (1, 1), (2, 2), (3, 3)]

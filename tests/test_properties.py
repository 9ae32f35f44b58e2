"""Property tests: the bucketed scans equal plain windows for any data and
any bucket width."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from runfold.operators.scan import Run, next_in_group, running

rows_st = st.lists(
    st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 400), st.one_of(st.none(), st.sampled_from(["a", "b", "c"])),
              st.booleans(), st.one_of(st.none(), st.integers(-2, 5))),
    min_size=1, max_size=60, unique_by=lambda t: (t[0], t[1]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_st, width=st.integers(1, 50), descending=st.booleans())
def test_running_bucketed_equals_plain(spark, rows, width, descending):
    df = spark.createDataFrame(rows, "k int, seq int, v string, f boolean, n int")
    runs = [Run("last", "last_nonnull", "v"), Run("lw", "last_where", "v", "f"), Run("s", "sum", "n"),
            Run("c", "count")]
    a = running(df, ["k"], "seq", runs, width=width, descending=descending)
    b = running(df, ["k"], "seq", runs, bucketed=False, descending=descending)
    cols = ["k", "seq", "last", "lw", "s", "c"]
    assert sorted(map(tuple, a.select(cols).collect()), key=str) == sorted(map(tuple, b.select(cols).collect()), key=str)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_st, width=st.integers(1, 50))
def test_next_in_group_bucketed_equals_plain(spark, rows, width):
    df = spark.createDataFrame(rows, "k int, seq int, v string, f boolean, n int")
    a = next_in_group(df, ["k"], "seq", ["v"], width=width)
    b = next_in_group(df, ["k"], "seq", ["v"], bucketed=False)
    cols = ["k", "seq", "next_v", "next_seq"]
    assert sorted(map(tuple, a.select(cols).collect()), key=str) == sorted(map(tuple, b.select(cols).collect()), key=str)

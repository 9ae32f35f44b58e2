"""All queries of the subpackage are registered, and nothing else imports it."""

import pathlib
import re

import __spark_entry__ as e


def test_queries_are_registered():
    names = e.queries()
    for n in range(1, 14):
        assert sum(bool(re.match(rf"op{n}_", k)) for k in names) == 1, n
    assert "pipeline" in names and set(e.oracle_sql()) <= set(names)


def test_nothing_else_imports_the_subpackage():
    root = pathlib.Path(e.__file__).parent
    for f in [*root.glob("runfold/**/*.py"), *root.glob("tests/*.py"), root / "bench.py"]:
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) +(runfold\.llm|corpus_pipeline)", f.read_text(), re.M), f


def test_native_modules_run_no_python_in_tasks():
    root = pathlib.Path(e.__file__).parent
    for name in ("chat", "quality"):
        text = (root / "runfold/llm" / f"{name}.py").read_text()
        assert not re.search(r"\b(mapInArrow|mapInPandas|applyIn|pandas_udf|udf|\.rdd)\b", text)

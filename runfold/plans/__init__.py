"""Bindings of every operator to the driver tables (``queries``) and the
equivalent DuckDB SQL (``oracle_sql``)."""

from runfold.plans.bindings import QUERIES  # noqa: F401
from runfold.plans.oracle import ORACLE  # noqa: F401

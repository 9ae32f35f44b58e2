"""Column-expression helpers (all JVM-side built-ins, no UDFs)."""

from runfold.functions.text import (  # noqa: F401
    js_trim, truncate_with_length, drop_think_blocks,
    strip_fences, first_brace_span, email_clean, amount_clean, iso_date,
    namespaced_name, contains_any, contains_all,
)
from runfold.functions.paths import (  # noqa: F401
    normalize_path, resolve_path, basename, dirname, extname, is_within,
)

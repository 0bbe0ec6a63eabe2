"""Column-expression helpers (all JVM-side, codegen-friendly)."""

from stratum.functions.exprs import (  # noqa: F401
    INF,
    clean_double,
    r,
    safe_div,
)
from stratum.functions.hashing import hash_uniform, hash_uniform_sql  # noqa: F401
from stratum.functions.pvalue import f_sf, f_sf_sql, t_sf2, t_sf2_sql  # noqa: F401

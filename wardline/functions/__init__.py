"""Column-level functions (pure JVM expressions, no Python UDFs)."""

from wardline.functions.codes import (  # noqa: F401
    DOSE_LEVELS, binary_flag, dose_ordinal, icd_coarse, icd_fine, icd_root,
    sanitize_name,
)
from wardline.functions.hashing import hash_bucket, hash_int, seeded_hash  # noqa: F401

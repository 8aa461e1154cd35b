from panelwright.functions.cleaning import (
    blank_to_null,
    clip_nonneg,
    finite_or_null,
    is_finite,
    normalize_key,
    to_int,
    to_number,
)
from panelwright.functions.measures import band, delta_fraction, safe_pct, share, signed_label, truncate_label

__all__ = [
    "band", "blank_to_null", "clip_nonneg", "delta_fraction", "finite_or_null", "is_finite", "normalize_key",
    "safe_pct", "share", "signed_label", "to_int", "to_number", "truncate_label",
]

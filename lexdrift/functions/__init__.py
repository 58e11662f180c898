from lexdrift.functions.render import (
    duration_text,
    excerpt,
    html_escape,
    list_text,
    percent_text,
    timestamp_text,
)
from lexdrift.functions.text import (
    ascii_trim,
    decode_utf8,
    derive_title,
    ends_at_boundary,
    is_admin_title,
    is_blank,
    normalize_text,
    split_annotation,
    unicode_strip,
    unify_breaks,
)

__all__ = [
    "ascii_trim",
    "decode_utf8",
    "derive_title",
    "duration_text",
    "ends_at_boundary",
    "excerpt",
    "html_escape",
    "is_admin_title",
    "is_blank",
    "list_text",
    "normalize_text",
    "percent_text",
    "split_annotation",
    "timestamp_text",
    "unicode_strip",
    "unify_breaks",
]

"""Column expressions: missing-value rules, text and recoding."""

from .nulls import if_else, larger_of, log_value, not_in, num, strict_mean
from .recode import (
    button_correct,
    code_by_prefix,
    cross_label,
    likert_score,
    match_class,
    match_score,
    matches,
    map_values,
    order_rank,
    shift_answer,
    sign_by_order,
    suffix_condition,
    unknown_indicator,
)
from .text import (
    answer,
    answer_fields,
    drop_extension,
    item_event,
    item_number,
    malformed_answer,
    strip_literals,
    tag_by_pattern,
)

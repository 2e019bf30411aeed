from adlens.functions.numeric import (  # noqa: F401
    fdiv,
    finite_or_zero,
    fmt_num,
    fmt_plain,
    is_finite,
    money_sum,
    round2,
    roundn,
    snap_round,
    safe_ratio,
)

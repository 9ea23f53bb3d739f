from tradewatch.functions.timefn import (  # noqa: F401
    as_ts, boundary_diff, epoch_micros, epoch_seconds, trunc, since,
)
from tradewatch.functions.text import (  # noqa: F401
    mask_full_name, mask_email, mask_phone, mask_dob, fixed, pad_id,
)
from tradewatch.functions.risk import rule_score, severity_rank, sla_hours, risk_tier  # noqa: F401

from . import constants
from .expressions import (
    days_between,
    floored,
    live_rows,
    not_blank,
    psi_band,
    psi_of_shares,
    psi_term,
    score_multiple,
    seconds_between,
    severity,
    strictly_live_rows,
    value_key,
)

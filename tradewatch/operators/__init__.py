from tradewatch.operators.joins import (  # noqa: F401
    HOT_COPIES, asof_join, either_key_join, explode_slices, frequent_keys, interval_join,
)
from tradewatch.operators.state import (  # noqa: F401
    append_deduped, insert_new, merge_upsert, priority_union, snapshot_diff,
)
from tradewatch.operators.windows import (  # noqa: F401
    global_row_number, latest_by, latest_by_stored, rolling, rolling_partials, rows_last_non_null, rows_sum, sequence_index, top_k,
)
from tradewatch.operators.logstore import LogStore  # noqa: F401
from tradewatch.operators.slices import SliceLayer  # noqa: F401

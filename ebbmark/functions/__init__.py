from ebbmark.functions.delays import delay_ms, draw, phase_name, scramble, with_arrival
from ebbmark.functions.scalars import (
    bucket, bucket_start, clamp, geo_cell, house_cell, label_of, null_safe_mean, one_if_missing,
    safe_divide, window_end, zero_if_missing, zone_cell,
)

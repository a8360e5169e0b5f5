"""Explicit schemas; inference would turn numeric x into strings."""

POINT = "struct<x_kind: string, x_str: string, x_num: double, y: double>"
SERIES = f"struct<name: string, data: array<{POINT}>>"
CHART = f"struct<chart_type: string, title: string, x_label: string, y_label: string, series: array<{SERIES}>>"
PARSED = f"chart {CHART}, error string, repairs array<string>"
PAIRS = "array<struct<g: int, p: int>>"

PREDICTION = "id string, raw string, n_tokens int, seconds double, gen_error string"
PROPERTIES = (
    "struct<chart_type: string, n_series: bigint, n_points: bigint, log_y: boolean, dual_axis: boolean, label_rotation: bigint, grid: boolean, "
    "legend: boolean, dpi: bigint, has_title: boolean, numeric_x: boolean, value_magnitude: bigint, hard_flags: array<string>, source: string>"
)
#: The fields that can be scored.
ALL_FIELDS = ("chart_type", "title", "x_label", "y_label", "series_names")

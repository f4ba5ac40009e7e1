"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, licenses
from .decontamination import op4_decontamination
from .html_text import op8_html_text
from .licenses import op10_licenses
from .line_dedup import op5_line_dedup
from .near_dedup import op2_near_dedup
from .neighbours import op6_neighbours
from .pieces import op7_pieces
from .repeats import op9_repeats
from .sharding import op3_sharding
from .toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_near_dedup": op2_near_dedup,
    "op3_sharding": op3_sharding,
    "op4_decontamination": op4_decontamination,
    "op5_line_dedup": op5_line_dedup,
    "op6_neighbours": op6_neighbours,
    "op7_pieces": op7_pieces,
    "op8_html_text": op8_html_text,
    "op9_repeats": op9_repeats,
    "op10_licenses": op10_licenses,
}

ORACLES: dict[str, str] = {
    "op4_decontamination": decontamination.ORACLE,
    "op10_licenses": licenses.ORACLE,
}

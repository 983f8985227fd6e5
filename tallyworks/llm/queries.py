"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .changes import op11_changes
from .chat import OP1_SQL, op1_preferences
from .decontamination import OP5_SQL, op5_decontamination
from .htmltext import op12_main_text
from .licenses import op6_licenses
from .packing import op3_packing
from .pii import op2_pii
from .quality import op4_quality
from .rollups import op7_rollups
from .sharding import op8_sharding
from .simhash import op9_simhash
from .substrings import OP10_SQL, op10_substrings
from .tries import OP13_SQL, op13_prefixes

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_preferences": op1_preferences,
        "op2_pii": op2_pii,
        "op3_packing": op3_packing,
        "op4_quality": op4_quality,
        "op5_decontamination": op5_decontamination,
        "op6_licenses": op6_licenses,
        "op7_rollups": op7_rollups,
        "op8_sharding": op8_sharding,
        "op9_simhash": op9_simhash,
        "op10_substrings": op10_substrings,
        "op11_changes": op11_changes,
        "op12_main_text": op12_main_text,
        "op13_prefixes": op13_prefixes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_preferences": OP1_SQL, "op5_decontamination": OP5_SQL, "op10_substrings": OP10_SQL, "op13_prefixes": OP13_SQL}

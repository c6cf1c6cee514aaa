"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP2_SQL, op2_chat_format
from .decontam import op10_decontaminate
from .lang_id import op1_language_id
from .licenses import OP6_SQL, op6_license_scan
from .mixing import OP7_SQL, op7_mixing
from .near_dup import OP4_SQL, op4_near_dedup
from .pii import op3_personal_data
from .quality import op8_quality_rules
from .token_count import op9_token_counts
from .token_store import op5_token_output


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_chat_format": op2_chat_format,
        "op3_personal_data": op3_personal_data,
        "op4_near_dedup": op4_near_dedup,
        "op5_token_output": op5_token_output,
        "op6_license_scan": op6_license_scan,
        "op7_mixing": op7_mixing,
        "op8_quality_rules": op8_quality_rules,
        "op9_token_counts": op9_token_counts,
        "op10_decontaminate": op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op4_near_dedup": OP4_SQL, "op6_license_scan": OP6_SQL, "op7_mixing": OP7_SQL}

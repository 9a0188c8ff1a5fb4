"""Queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from .bitpack import op9_bit_packed_ids
from .counts import op5_token_counts
from .decontaminate import OP7_SQL, op7_decontamination
from .langid import op6_language_id
from .neardup import op1_minhash_near_dedup
from .packing import op2_packing
from .pii import op3_pii
from .quality import OP8_SQL, op8_quality_rules
from .secrets import op4_secret_scans
from .urlfilter import OP10_SQL, op10_url_filters

QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_packing, op3_pii, op4_secret_scans, op5_token_counts, op6_language_id, op7_decontamination, op8_quality_rules, op9_bit_packed_ids, op10_url_filters)}
ORACLE_SQL: dict[str, str] = {"op7_decontamination": OP7_SQL, "op8_quality_rules": OP8_SQL, "op10_url_filters": OP10_SQL}

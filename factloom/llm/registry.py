"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from factloom.llm.decontaminate import OP2_SQL, op2_decontaminate
from factloom.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from factloom.llm.language_id import op1_language_id
from factloom.llm.license_scan import OP3_SQL, op3_license_scan
from factloom.llm.near_dedup import OP7_SQL, op7_near_dedup
from factloom.llm.packing import op9_packing
from factloom.llm.period_runs import OP11_SQL, op11_period_runs
from factloom.llm.pii import op12_find_pii
from factloom.llm.resample import OP13_SQL, op13_importance_resample
from factloom.llm.secret_scan import op4_secret_scan
from factloom.llm.sharding import op6_sharding
from factloom.llm.token_store import op5_token_ids
from factloom.llm.url_filter import OP8_SQL, op8_url_filter

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontaminate": op2_decontaminate,
    "op3_license_scan": op3_license_scan,
    "op4_secret_scan": op4_secret_scan,
    "op5_token_ids": op5_token_ids,
    "op6_sharding": op6_sharding,
    "op7_near_dedup": op7_near_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_packing": op9_packing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_period_runs": op11_period_runs,
    "op12_find_pii": op12_find_pii,
    "op13_importance_resample": op13_importance_resample,
}

ORACLES = {
    "op2_decontaminate": OP2_SQL,
    "op3_license_scan": OP3_SQL,
    "op7_near_dedup": OP7_SQL,
    "op8_url_filter": OP8_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_period_runs": OP11_SQL,
    "op13_importance_resample": OP13_SQL,
}

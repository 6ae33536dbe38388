"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from .audit import OP11_SQL, op11_filter_audit
from .chat import OP1_SQL, op1_chat_format
from .contamination import OP12_SQL, op12_decontamination
from .langid import op9_language_id
from .mixing import OP8_SQL, op8_water_fill
from .neardup import op7_setsketch
from .packing import op5_packing
from .passages import op10_bwt_dedup
from .pii import op3_personal_data
from .quality import op6_repetition_rules
from .sql import OP6_SQL, OP7_SQL, OP10_SQL
from .toxicity import op4_toxic_segments
from .variants import OP13_SQL, op13_spelling_variants
from .vectors import OP2_SQL, op2_onebit_ann

QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_onebit_ann,
        op3_personal_data,
        op4_toxic_segments,
        op5_packing,
        op6_repetition_rules,
        op7_setsketch,
        op8_water_fill,
        op9_language_id,
        op10_bwt_dedup,
        op11_filter_audit,
        op12_decontamination,
        op13_spelling_variants,
    )
}
SQL = {
    "op1_chat_format": OP1_SQL,
    "op2_onebit_ann": OP2_SQL,
    "op6_repetition_rules": OP6_SQL,
    "op7_setsketch": OP7_SQL,
    "op8_water_fill": OP8_SQL,
    "op10_bwt_dedup": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_decontamination": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}

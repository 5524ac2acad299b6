"""The queries of this subpackage, as the driver entry registers them."""

from __future__ import annotations

import corpus_pipeline
from queuelens.llm import op4_quotes as op4
from queuelens.llm import op6_jaccard as op6
from queuelens.llm import op7_warc as op7
from queuelens.llm import op8_topk as op8
from queuelens.llm import op10_neardup as op10
from queuelens.llm import op11_runs as op11
from queuelens.llm import op12_collocations as op12
from queuelens.llm import op13_decontaminate as op13
from queuelens.llm.op1_bpe import op1_bpe
from queuelens.llm.op2_quality import op2_quality
from queuelens.llm.op3_packing import op3_packing
from queuelens.llm.op5_pii import op5_pii
from queuelens.llm.op9_html import op9_html


def queries() -> dict:
    found = (op1_bpe, op2_quality, op3_packing, op4.op4_quotes, op5_pii, op6.op6_jaccard, op7.op7_warc, op8.op8_topk, op9_html, op10.op10_neardup, op11.op11_runs, op12.op12_collocations, op13.op13_decontaminate)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query; the others are tested against brute force."""
    return {"op4_quotes": op4.ORACLE, "op6_jaccard": op6.ORACLE, "op7_warc": op7.ORACLE, "op8_topk": op8.ORACLE, "op10_neardup": op10.ORACLE, "op11_runs": op11.ORACLE, "op12_collocations": op12.ORACLE, "op13_decontaminate": op13.ORACLE}

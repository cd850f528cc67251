"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from causalframe.llm.decontam import OP3_SQL, op3_decontamination
from causalframe.llm.fingerprint import op5_fingerprints
from causalframe.llm.html import op2_html
from causalframe.llm.mixing import op4_mixing
from causalframe.llm.quality import op8_quality
from causalframe.llm.simhash import op1_simhash
from causalframe.llm.tokens import op9_tokens
from causalframe.llm.toxicity import op10_toxicity
from causalframe.llm.urlfilter import OP6_SQL, op6_urlfilter
from causalframe.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_html": op2_html,
    "op3_decontamination": op3_decontamination,
    "op4_mixing": op4_mixing,
    "op5_fingerprints": op5_fingerprints,
    "op6_urlfilter": op6_urlfilter,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_tokens": op9_tokens,
    "op10_toxicity": op10_toxicity,
}

#: Queries without SQL here are learnt (8, 10), sample-free but bit-level (1, 5), or made by a parser, a solver or a tokenizer (2, 4, 9).
ORACLE_SQL = {"op3_decontamination": OP3_SQL, "op6_urlfilter": OP6_SQL, "op7_warc": OP7_SQL}

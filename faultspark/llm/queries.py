"""The queries of the training-data operators, one for each, and their SQL."""

from __future__ import annotations

from faultspark.llm.bestfit import op9_bestfit
from faultspark.llm.html_template import op5_html_template
from faultspark.llm.langid_kernel import op7_langid
from faultspark.llm.line_edit import op10_line_edit
from faultspark.llm.preference import OP6_SQL, op6_preference
from faultspark.llm.simhash_golay import op3_simhash
from faultspark.llm.spm_dropout import op1_spm_dropout
from faultspark.llm.srs_ann import op8_srs
from faultspark.llm.telephony import op2_telephony
from faultspark.llm.warc import op4_warc

QUERIES = {
    "op1_spm_dropout": op1_spm_dropout,
    "op2_telephony": op2_telephony,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_html_template": op5_html_template,
    "op6_preference": op6_preference,
    "op7_langid": op7_langid,
    "op8_srs": op8_srs,
    "op9_bestfit": op9_bestfit,
    "op10_line_edit": op10_line_edit,
}
ORACLES: dict[str, str] = {"op6_preference": OP6_SQL}

"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from tallyforge.llm import decontam, filteraudit, langid, linededup, packing, quality, simhash, spotsigs, substring, tokenfiles, tokens, urlfilter, vectorcodes

QUERIES = {
    "op1_decontamination": decontam.op1_decontamination,
    "op2_urlfilter": urlfilter.op2_urlfilter,
    "op3_langid": langid.op3_langid,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_simhash": simhash.op5_simhash,
    "op6_substring": substring.op6_substring,
    "op7_packing": packing.op7_packing,
    "op8_spotsigs": spotsigs.op8_spotsigs,
    "spotsigs_near_classes": spotsigs.spotsigs_near_classes,
    "op9_quality": quality.op9_quality,
    "op10_token_rollup": tokens.op10_token_rollup,
    "op11_filter_audit": filteraudit.op11_filter_audit,
    "op12_vector_codes": vectorcodes.op12_vector_codes,
    "op13_token_files": tokenfiles.op13_token_files,
}

ORACLE = {"op4_line_dedup": linededup.OP4_SQL, "op6_substring": substring.OP6_SQL, "op11_filter_audit": filteraudit.OP11_SQL, "op12_vector_codes": vectorcodes.OP12_SQL}

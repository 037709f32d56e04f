"""Registered queries of the subpackage and their SQL, where SQL can say it."""

from __future__ import annotations

from fedtab.llm import (decontaminate, exact, fingerprints, importance, jaccard, language, packing, records, spelling, toxicity, transducer, urls,
                        warc)

QUERIES = {
    "op1_language": language.op1_language,
    "op2_url_filter": urls.op2_url_filter,
    "op3_packing": packing.op3_packing,
    "op4_exact_dedup": exact.op4_exact_dedup,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_jaccard_groups": jaccard.op6_jaccard_groups,
    "op7_token_records": records.op7_token_records,
    "op8_warc": warc.op8_warc,
    "op9_bpe_round_trip": transducer.op9_bpe_round_trip,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_spelling": spelling.op11_spelling,
    "op12_decontamination": decontaminate.op12_decontamination,
    "op13_importance": importance.op13_importance,
}
SQL = {
    "op4_exact_dedup": exact.SQL,
    "op8_warc": warc.SQL,
    "op12_decontamination": decontaminate.SQL,
}

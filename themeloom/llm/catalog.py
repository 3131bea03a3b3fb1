"""Registered queries of the corpus operators, and their check SQL where SQL can say it."""

from __future__ import annotations

from themeloom.llm import (
    collocations,
    language,
    mixing,
    packing,
    pair_merges,
    periods,
    quality,
    secret_scan,
    sharding,
    simhash,
    token_files,
    topk,
    warc,
)

RUN = {
    "op1_top_k": topk.query,
    "op2_secrets": secret_scan.query,
    "op3_quality": quality.query,
    "op4_shards": sharding.query,
    "op5_token_files": token_files.query,
    "op6_warc": warc.query,
    "op7_near_duplicates": simhash.query,
    "op8_language": language.query,
    "op9_packing": packing.query,
    "op10_mixing": mixing.query,
    "op11_collocations": collocations.query,
    "op12_periodic_runs": periods.query,
    "op13_bpe_pairs": pair_merges.query,
}
SQL = {"op1_top_k": topk.SQL, "op6_warc": warc.SQL, "op10_mixing": mixing.SQL, "op11_collocations": collocations.SQL}

"""The queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

from cairn.llm import bpe, html, minhash, packing, quality, sharding, simhash, substrings, urls, warc


def queries() -> dict:
    return {
        "op1_balanced_shards": sharding.op1_balanced_shards,
        "op2_packed_sequences": packing.op2_packed_sequences,
        "op3_line_quality": quality.op3_line_quality,
        "op4_repeated_substrings": substrings.op4_repeated_substrings,
        "op5_warc_round_trip": warc.op5_warc_round_trip,
        "op6_near_duplicates": minhash.op6_near_duplicates,
        "op7_simhash": simhash.op7_simhash,
        "op8_main_text": html.op8_main_text,
        "op9_bpe_round_trip": bpe.op9_bpe_round_trip,
        "op10_url_filter": urls.op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_quality": quality.SQL,
        "op4_repeated_substrings": substrings.SQL,
        "op5_warc_round_trip": warc.SQL,
        "op10_url_filter": urls.SQL,
    }

"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import chat_format, decontamination, flac, jaccard_join, line_dedup, packing, sharding, toxicity, url_filter, warc


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_sharding": sharding.query,
        "op2_jaccard_join": jaccard_join.query,
        "op3_line_dedup": line_dedup.query,
        "op4_packing": packing.query,
        "op5_url_filter": url_filter.query,
        "op6_decontamination": decontamination.query,
        "op7_chat_format": chat_format.query,
        "op8_warc": warc.query,
        "op9_toxicity": toxicity.query,
        "op10_flac_media": flac.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard_join": jaccard_join.SQL,
        "op3_line_dedup": line_dedup.SQL,
        "op5_url_filter": url_filter.SQL,
        "op7_chat_format": chat_format.SQL,
        "op8_warc": warc.SQL,
    }

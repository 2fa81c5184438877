"""Queries of this subpackage and their SQL, by the name under which they are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, gif, line_dedup, lz_fingerprint, packing, quality, simhash, token_ids, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lz_fingerprint": lz_fingerprint.op1_lz_fingerprint,
        "op2_quality": quality.op2_quality,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_warc_audit": warc.op4_warc_audit,
        "op5_gif": gif.op5_gif,
        "op6_token_ids": token_ids.op6_token_ids,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_simhash": simhash.op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_audit": warc.AUDIT_SQL}

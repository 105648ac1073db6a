"""Operators for training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from pixelweave.llm.ann import op7_ann
    from pixelweave.llm.bpe import op6_byte_bpe
    from pixelweave.llm.chat import op8_chat_format
    from pixelweave.llm.fingerprint import op5_fingerprint
    from pixelweave.llm.html import op3_html_extract
    from pixelweave.llm.licenses import op9_license_scan
    from pixelweave.llm.mixing import op10_source_mixing
    from pixelweave.llm.quality import op4_quality
    from pixelweave.llm.simhash import op1_simhash
    from pixelweave.llm.toxicity import op2_toxicity

    found = (op1_simhash, op2_toxicity, op3_html_extract, op4_quality, op5_fingerprint, op6_byte_bpe, op7_ann, op8_chat_format, op9_license_scan, op10_source_mixing)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from pixelweave.llm.chat import ORACLE

    return {"op8_chat_format": ORACLE}

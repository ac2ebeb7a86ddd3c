"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm.chat import op13_chat_format
from panelforge.llm.collocations import op11_phrase_collocations
from panelforge.llm.digest import op8_document_digest
from panelforge.llm.html_extract import op5_html_extraction
from panelforge.llm.media import op10_media_columns
from panelforge.llm.mixing import op4_mix_sources
from panelforge.llm.oracle import ORACLES as ORACLES
from panelforge.llm.pii import op2_pii_surrogates
from panelforge.llm.quality import op7_quality
from panelforge.llm.sentencepiece_sampling import op1_sentencepiece
from panelforge.llm.simhash import op3_simhash_dedup
from panelforge.llm.spelling import op12_spelling_variants
from panelforge.llm.substring_dedup import op9_suffix_dedup
from panelforge.llm.toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_pii_surrogates,
        op3_simhash_dedup,
        op4_mix_sources,
        op5_html_extraction,
        op6_toxicity,
        op7_quality,
        op8_document_digest,
        op9_suffix_dedup,
        op10_media_columns,
        op11_phrase_collocations,
        op12_spelling_variants,
        op13_chat_format,
    )
}

"""Every query of this subpackage over the driver's tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from gleanery.llm.alignment import op13_token_alignment
from gleanery.llm.edit_prints import op7_edit_fingerprints
from gleanery.llm.language import op5_language_id
from gleanery.llm.licenses import OP4_SQL, op4_license_scan
from gleanery.llm.media import op2_media_columns
from gleanery.llm.mixing import op10_mix_sources
from gleanery.llm.near_dedup import op6_near_duplicates
from gleanery.llm.packing import op3_pack_sequences
from gleanery.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from gleanery.llm.suffix_dedup import op1_suffix_dedup
from gleanery.llm.token_frames import op8_token_frames
from gleanery.llm.toxicity import op11_toxicity
from gleanery.llm.url_filters import OP9_SQL, op9_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_media_columns": op2_media_columns,
    "op3_pack_sequences": op3_pack_sequences,
    "op4_license_scan": op4_license_scan,
    "op5_language_id": op5_language_id,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_edit_fingerprints": op7_edit_fingerprints,
    "op8_token_frames": op8_token_frames,
    "op9_url_filters": op9_url_filters,
    "op10_mix_sources": op10_mix_sources,
    "op11_toxicity": op11_toxicity,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_alignment": op13_token_alignment,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {"op4_license_scan": OP4_SQL, "op9_url_filters": OP9_SQL, "op12_prefix_trie": OP12_SQL}

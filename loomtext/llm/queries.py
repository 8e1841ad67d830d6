"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from loomtext.llm.bpe import op2_bpe_words
from loomtext.llm.decontaminate import op5_benchmark_decontamination, op5_sql
from loomtext.llm.fingerprints import op1_document_fingerprints
from loomtext.llm.languages import op8_language_id
from loomtext.llm.near_copies import op10_simhash_near_dedup
from loomtext.llm.quality import op9_quality_classifier
from loomtext.llm.secrets import op3_secret_scans
from loomtext.llm.substrings import op6_sql, op6_substring_dedup
from loomtext.llm.token_files import op4_token_files
from loomtext.llm.warc import op7_sql, op7_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints, op2_bpe_words, op3_secret_scans, op4_token_files, op5_benchmark_decontamination,
        op6_substring_dedup, op7_warc, op8_language_id, op9_quality_classifier, op10_simhash_near_dedup,
    )
}

SQL = {"op5_benchmark_decontamination": op5_sql(), "op6_substring_dedup": op6_sql(), "op7_warc": op7_sql()}

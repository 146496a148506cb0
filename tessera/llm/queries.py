"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import licenses, packing, pieces, privacy, quality, shingles, substrings, token_files, vectors

QUERIES = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_ngram_join": shingles.op2_ngram_join,
    "op3_packing": packing.op3_packing,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_vector_dedup": vectors.op5_vector_dedup,
    "op6_personal_data": privacy.op6_personal_data,
    "op7_token_files": token_files.op7_token_files,
    "op8_quality": quality.op8_quality,
    "op9_nearest": vectors.op9_nearest,
    "op10_license_scan": licenses.op10_license_scan,
}

#: No SQL for: op1 (suffix order), op2 (MinHash), op3, op4 and op7 (tokenizers), op6 (its terms), op8 (a fitted model), op9
#: (recall below 1); tests hold them against brute force or the libraries.
ORACLE_SQL = {"op5_vector_dedup": vectors.ORACLE_VECTOR_DEDUP, "op10_license_scan": licenses.ORACLE}

"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontaminate import OP9_SQL, op9_decontaminate
from .fingerprint import op4_fingerprints, source_fingerprints
from .jaccard_join import op1_jaccard_join
from .language import op7_language_id, page_language
from .packing import op5_packing
from .shards import op2_shards
from .suffix_dedup import op3_suffix_dedup
from .token_files import op6_token_files
from .url_filter import OP8_SQL, op8_url_filter
from .warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_shards": op2_shards,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_packing": op5_packing,
    "op6_token_files": op6_token_files,
    "op7_language_id": op7_language_id,
    "op8_url_filter": op8_url_filter,
    "op9_decontaminate": op9_decontaminate,
    "op10_warc": op10_warc,
    "page_language": page_language,
    "source_fingerprints": source_fingerprints,
}
SQL = {"op8_url_filter": OP8_SQL, "op9_decontaminate": OP9_SQL, "op10_warc": OP10_SQL}

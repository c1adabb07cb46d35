"""Queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .decontaminate import OP1_SQL, op1_decontaminate
from .embed_dedup import OP6_SQL, op6_embedding_dedup
from .packing import op3_packing
from .quality import op2_quality
from .secret_scan import op10_secrets
from .shard import op4_shards
from .simhash import op9_simhash
from .suffix_dedup import OP5_SQL, op5_repeated_spans
from .token_count import op7_token_counts
from .warc import OP8_SQL, op8_warc

QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_quality, op3_packing, op4_shards, op5_repeated_spans, op6_embedding_dedup, op7_token_counts, op8_warc, op9_simhash, op10_secrets)}
SQL = {"op1_decontaminate": OP1_SQL, "op5_repeated_spans": OP5_SQL, "op6_embedding_dedup": OP6_SQL, "op8_warc": OP8_SQL}

"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from .ann import op1_ann
from .decontam import op5_decontaminate
from .langid import op8_langid
from .lm import op10_lm
from .packing import op4_pack
from .quality import op6_quality
from .shards import op7_token_shards
from .simhash import op3_simhash
from .toxicity import op9_toxicity
from .url_filter import OP2_SQL, op2_url_filter

QUERIES = {f.__name__: f for f in (op1_ann, op2_url_filter, op3_simhash, op4_pack, op5_decontaminate, op6_quality, op7_token_shards, op8_langid, op9_toxicity, op10_lm)} | {"pipeline": corpus_pipeline.run}
ORACLE_SQL = {"op2_url_filter": OP2_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

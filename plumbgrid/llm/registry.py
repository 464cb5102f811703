"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import sql
from .decontaminate import op5_decontaminate
from .embeddings import op4_embedding_groups
from .langid import op8_langid
from .licenses import op1_license_scan
from .mixing import op6_mix
from .pii import op2_pii
from .secrets import op7_secrets
from .simhash import op9_simhash
from .token_counts import op10_token_counts
from .token_files import op3_token_files


def queries():
    found = (op1_license_scan, op2_pii, op3_token_files, op4_embedding_groups, op5_decontaminate, op6_mix, op7_secrets, op8_langid, op9_simhash, op10_token_counts)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    found = {"op1_license_scan": sql.licenses(), "op4_embedding_groups": sql.EMBEDDINGS, "op5_decontaminate": sql.DECONTAMINATION, "op6_mix": sql.MIXTURE}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

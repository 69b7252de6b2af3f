"""Queries of the operators of this subpackage, and SQL that gives the same rows."""

from __future__ import annotations

from .align import op13_token_alignment
from .bpe import op6_bpe_round_trip
from .decontaminate import OP9_SQL, op9_decontamination
from .lloyd import OP12_SQL, op12_lloyd
from .neighbours import op1_additive_quantisation
from .quality import op10_quality_classifier
from .repeats import OP2_SQL, op2_repeated_phrases
from .secrets import op5_secret_scan
from .sharding import op8_histogram_sharding
from .simhash import op3_simhash_groups
from .toxicity import op7_toxicity_neighbours
from .urls import OP4_SQL, op4_host_reputation
from .warc import OP11_SQL, op11_warc_archives

QUERIES = {
    f.__name__: f
    for f in (
        op1_additive_quantisation, op2_repeated_phrases, op3_simhash_groups, op4_host_reputation, op5_secret_scan, op6_bpe_round_trip, op7_toxicity_neighbours,
        op8_histogram_sharding, op9_decontamination, op10_quality_classifier, op11_warc_archives, op12_lloyd, op13_token_alignment,
    )
}
SQL = {"op2_repeated_phrases": OP2_SQL, "op4_host_reputation": OP4_SQL, "op9_decontamination": OP9_SQL, "op11_warc_archives": OP11_SQL, "op12_lloyd": OP12_SQL}

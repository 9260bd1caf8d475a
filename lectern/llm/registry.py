"""The training-data queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .ann import op2_ann_search
from .collocations import OP11_SQL, op11_collocations
from .divergence import OP12_SQL, op12_source_divergence
from .html_template import OP13_SQL, op13_html_extraction
from .mixing import OP8_SQL, op8_mixing
from .packing import op7_packing
from .quality import op3_quality
from .sharding import op5_sharding
from .simhash import op10_simhash_near_dedup
from .sketch import op4_fingerprints
from .suffix_dedup import op6_suffix_array_dedup
from .toxicity import op1_toxicity
from .warc import OP9_SQL, op9_warc_revisits

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_ann_search": op2_ann_search,
    "op3_quality": op3_quality,
    "op4_fingerprints": op4_fingerprints,
    "op5_sharding": op5_sharding,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_packing": op7_packing,
    "op8_mixing": op8_mixing,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_collocations": op11_collocations,
    "op12_source_divergence": op12_source_divergence,
    "op13_html_extraction": op13_html_extraction,
}

SQL: dict[str, str] = {
    "op8_mixing": OP8_SQL,
    "op9_warc_revisits": OP9_SQL,
    "op11_collocations": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_html_extraction": OP13_SQL,
}

"""The queries of this subpackage."""

from __future__ import annotations

from . import neardup, substrings, vectors
from .decontaminate import op2_latent_decontamination
from .html import op9_page_differencing
from .langid import op1_language_id
from .neardup import op3_lsh_forest
from .packing import op6_pattern_packing
from .quality import op8_site_quality
from .sharding import op10_ring_sharding
from .substrings import op5_suffix_family
from .tokenfile import op7_token_files
from .vectors import op4_pigeonhole_join

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_latent_decontamination": op2_latent_decontamination,
    "op3_lsh_forest": op3_lsh_forest,
    "op4_pigeonhole_join": op4_pigeonhole_join,
    "op5_suffix_family": op5_suffix_family,
    "op6_pattern_packing": op6_pattern_packing,
    "op7_token_files": op7_token_files,
    "op8_site_quality": op8_site_quality,
    "op9_page_differencing": op9_page_differencing,
    "op10_ring_sharding": op10_ring_sharding,
}
ORACLE: dict[str, str] = {"op3_lsh_forest": neardup.SQL, "op4_pigeonhole_join": vectors.SQL, "op5_suffix_family": substrings.SQL}

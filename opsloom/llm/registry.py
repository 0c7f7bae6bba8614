"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from opsloom.llm import bpe, exact, gif, infill, jaccard, language, lines, mixing, negatives, neighbours, quality, secrets, urls

QUERIES = {
    "op1_language": language.op1_language,
    "op2_secret_links": secrets.op2_secret_links,
    "op3_url_filter": urls.op3_url_filter,
    "op4_gif_media": gif.op4_gif_media,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_quality": quality.op6_quality,
    "op7_neighbours": neighbours.op7_neighbours,
    "op8_line_spread": lines.op8_line_spread,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_source_mix": mixing.op10_source_mix,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_fill_in_middle": infill.op12_fill_in_middle,
    "op13_exact_dedup": exact.op13_exact_dedup,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op8_line_spread": lines.OP8_SQL,
    "op10_source_mix": mixing.OP10_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op12_fill_in_middle": infill.OP12_SQL,
    "op13_exact_dedup": exact.OP13_SQL,
}

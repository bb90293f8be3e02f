"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from specula.llm import collocations, embedding_dedup, fill_in_middle, line_dedup
from specula.llm.bpe_codec import op2_bpe_codec
from specula.llm.collocations import op13_collocations
from specula.llm.decontamination import op10_decontamination
from specula.llm.embedding_dedup import op11_embedding_dedup
from specula.llm.fill_in_middle import op12_fill_in_middle
from specula.llm.language_id import op7_language_id
from specula.llm.line_dedup import op5_line_dedup
from specula.llm.neighbours import op8_neighbours
from specula.llm.secrets import op4_secret_scan
from specula.llm.sharding import op9_kd_sharding
from specula.llm.simhash import op1_simhash
from specula.llm.token_counts import op3_token_counts
from specula.llm.token_files import op6_token_files

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_bpe_codec,
        op3_token_counts,
        op4_secret_scan,
        op5_line_dedup,
        op6_token_files,
        op7_language_id,
        op8_neighbours,
        op9_kd_sharding,
        op10_decontamination,
        op11_embedding_dedup,
        op12_fill_in_middle,
        op13_collocations,
    )
}

ORACLE_SQL: dict[str, str] = {"op5_line_dedup": line_dedup.SQL, "op11_embedding_dedup": embedding_dedup.SQL, "op12_fill_in_middle": fill_in_middle.SQL, "op13_collocations": collocations.SQL}

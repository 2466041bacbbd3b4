"""Registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from railguard.llm.decontaminate import OP1_SQL, op1_decontaminate
from railguard.llm.langid import op5_langid
from railguard.llm.nbsvm import op12_quality
from railguard.llm.packing import op3_packing
from railguard.llm.pii import op8_pii
from railguard.llm.quality import op6_quality
from railguard.llm.scoring import op7_scoring
from railguard.llm.secrets import op10_secrets
from railguard.llm.simhash import op4_simhash
from railguard.llm.substrings import op9_substrings
from railguard.llm.trie import OP11_SQL, op11_trie
from railguard.llm.urls import OP2_SQL, op2_urls
from railguard.llm.whitening import op13_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_urls,
        op3_packing,
        op4_simhash,
        op5_langid,
        op6_quality,
        op7_scoring,
        op8_pii,
        op9_substrings,
        op10_secrets,
        op11_trie,
        op12_quality,
        op13_whitening,
    )
}

ORACLES = {"op1_decontaminate": OP1_SQL, "op2_urls": OP2_SQL, "op11_trie": OP11_SQL}

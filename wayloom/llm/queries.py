"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .bytebpe import op12_bytebpe
from .caps import OP2_SQL, op2_caps
from .chat import OP3_SQL, op3_chat
from .curves import op6_nearest
from .html import op9_html
from .jaccard import OP4_SQL, op4_jaccard
from .licenses import OP7_SQL, op7_licenses
from .mixing import OP5_SQL, op5_mixing
from .quality import op10_quality
from .resampling import op11_resampling
from .sentencepieces import op1_sentencepiece
from .spelling import op13_spelling
from .suffixes import op8_suffixes

QUERIES = {"op1_sentencepiece": op1_sentencepiece, "op2_caps": op2_caps, "op3_chat": op3_chat, "op4_jaccard": op4_jaccard, "op5_mixing": op5_mixing, "op6_nearest": op6_nearest, "op7_licenses": op7_licenses, "op8_suffixes": op8_suffixes, "op9_html": op9_html, "op10_quality": op10_quality, "op11_resampling": op11_resampling, "op12_bytebpe": op12_bytebpe, "op13_spelling": op13_spelling}
SQL = {"op2_caps": OP2_SQL, "op4_jaccard": OP4_SQL, "op3_chat": OP3_SQL, "op5_mixing": OP5_SQL, "op7_licenses": OP7_SQL}

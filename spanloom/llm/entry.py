"""The queries of this subpackage and the SQL that some of them must equal."""

from .annulus import OP13_SQL, op13_centroids
from .bpe import op10_bpe
from .chat import OP9_SQL, op9_chat
from .fim import OP12_SQL, op12_fim
from .langid import op6_language
from .matroska import op8_matroska
from .packing import op2_packing
from .pieces import op11_sentencepiece
from .quality import op4_quality
from .simhash import op3_simhash
from .token_store import op7_token_store
from .topk import OP5_SQL, op5_topk
from .toxicity import op1_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_packing, op3_simhash, op4_quality, op5_topk, op6_language, op7_token_store, op8_matroska, op9_chat, op10_bpe, op11_sentencepiece,
        op12_fim, op13_centroids,
    )
}
ORACLE_SQL = {"op5_topk": OP5_SQL, "op9_chat": OP9_SQL, "op12_fim": OP12_SQL, "op13_centroids": OP13_SQL}

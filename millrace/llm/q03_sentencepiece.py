"""Query op3: documents encoded with a SentencePiece vocabulary and decoded again."""

from .common import read_table
from .sentencepiece_viterbi import digest

NAME = "op3_sentencepiece"
SQL = None  # needs a vocabulary


def query(spark, sf_dir):
    import public_tokenizers

    return digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

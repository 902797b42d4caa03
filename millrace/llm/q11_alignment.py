"""Query op11: two tokenizers aligned over documents."""

from .alignment import align
from .common import read_table

NAME = "op11_alignment"
SQL = None  # needs two tokenizers


def query(spark, sf_dir):
    import public_tokenizers

    return align(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]

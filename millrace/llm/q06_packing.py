"""Query op6: documents packed into sequences of 4096 tokens."""

from .common import read_table
from .packing import pack

NAME = "op6_packing"
SQL = None  # needs a tokenizer


def query(spark, sf_dir):
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2, length=4096)

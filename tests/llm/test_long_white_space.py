"""Runs of white space far beyond what the library's pattern can match on its stack."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm.bpe import round_trip
from lodestone.llm.packing import END_ID, best_fit_pack
from lodestone.llm.queries import BYTE_BPE


@pytest.mark.parametrize("white", [" ", "\t", "\n", "\n \t"])
def test_two_million_blanks(spark, white):
    texts = [f"a{white * (2_000_000 // len(white))}b", "plain text", white * 9_999, f"x{white * 10_001}", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = Tokenizer.from_file(BYTE_BPE)
    ids = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in round_trip(docs, BYTE_BPE).collect()} == {k: len(v) for k, v in ids.items()}
    for r in best_fit_pack(docs, BYTE_BPE).collect():
        piece = [*ids[r["doc_id"]], END_ID][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())

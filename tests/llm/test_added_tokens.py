"""Ids of texts that hold added tokens, against the tokenizer as loaded."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabscore.llm import packing

JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
END = "<|endoftext|>"
TEXTS = [END, f"a{END}b", f"one  {END}  two", f"{END}{END}\n x", f"<|endoftext|{END}>", "<|endoftext", "no token in it", ""]


def test_added_tokens_are_one_id_each():
    library, added = Tokenizer.from_file(JSON), packing.added_tokens(JSON)
    assert added == {END: 50256}
    known = packing.words(RANKS, public_tokenizers.PATTERN, added)
    for text in TEXTS:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(known.text(text), "<u4").tolist() == want, repr(text)


@pytest.mark.parametrize("name", ["op10_packing", "pipeline"])
def test_queries_pack_added_tokens(spark, tmp_path, name):
    import __spark_entry__
    import corpus_pipeline

    library = Tokenizer.from_file(JSON)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.packed(spark, docs, str(tmp_path)) if name == "pipeline" else __spark_entry__.queries()[name](spark, str(tmp_path))
    got = {r.doc_id: r.doc_tokens for r in out.collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(TEXTS)}

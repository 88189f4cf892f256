"""Token tasks that give up their tokenizer write the same files."""

from __future__ import annotations

import pytest

from ledgerlens.llm import token_files
from ledgerlens.llm.common import release_memory


def test_files_are_the_same_without_kept_encoders(spark, docs, tmp_path):
    path = str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    rows = []
    for keep in (True, False):
        folder = token_files.write_token_files(docs, path, str(tmp_path / str(keep)), cache=50, keep_encoder=keep)
        rows.append(sorted((r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_index(spark, folder).collect()))
    assert rows[0] == rows[1] and rows[0]
    release_memory()

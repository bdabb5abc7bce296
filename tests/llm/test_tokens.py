"""The piece cache gives the library's own ids for whole texts."""

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tessera.llm.tokens import Encoder, public_path  # noqa: E402

TEXTS = [
    "", " ", "\n", "a", " a", "a ", "Hello, world! It's 3.14", "two  spaces", "tab\tand\r\nline", "\n\nlead", "trail \n", "a\x1cb \x1d c",
    "naïve Ünïcödé 漢字  nb  em", "x\x00y \x00z", "<|endoftext|> as text", "don't we'll I'm 'tis", "!!! ??? $$$word 12ab34",
    "w" * 300 + " " + "long" * 50, "emoji 😀 👩‍👩‍👧 é", "a \n b\n c", "q​z  　end",
]


def test_equals_library():
    enc = Encoder(public_path(), limit=20)  # a tiny cache turns over often
    for _ in range(2):
        got = enc.encode_many(TEXTS)
        for t, b in zip(TEXTS, got, strict=True):
            want = enc.library.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(b, "<u4").tolist() == want, t

"""Operator 1: letters beyond ASCII go to the model itself."""

import public_tokenizers as P
from tokenizers import Tokenizer

from korpisto.llm import op01_packing as op1


def test_letters_beyond_ascii_need_no_pipeline(monkeypatch):
    path = P.path("word_bpe_49k.json")
    whole, fast = Tokenizer.from_file(path), op1.WordEncoder(path)
    letters = [chr(c) for c in [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]]
    texts = [*letters, *(f"a{c}b{d}," for c in letters for d in letters[::7]), "Ääkkösiä, ÿ! Straße."]
    asked = []
    plain = fast._ids
    monkeypatch.setattr(fast, "_ids", lambda ts: asked.extend(ts) or plain(ts))
    assert [list(memoryview(x).cast("I")) for x in fast(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert not [t for t in asked if any(c.isalpha() for c in t)]

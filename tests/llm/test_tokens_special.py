import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stratavox.llm.tokens import ChunkTokenizer


def test_special_tokens_in_any_case():
    path = public_tokenizers.path("word_bpe_49k.json")
    mine, library = ChunkTokenizer(path), Tokenizer.from_file(path)
    rng = random.Random(1)
    parts = ["<|startoftext|>", "<|STARTOFTEXT|>", "<|StartOfText|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "A", "b c", " ", "\n", "Ünd", "<|endoftext", "ENDOFTEXT|>", "一"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 8))) for _ in range(600)]
    for t, raw in zip(texts, mine.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t

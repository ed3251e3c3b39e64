import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from targetloom.llm.byte_pairs import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_words_go_to_the_library_once_whatever_their_marks():
    encoder, asked = Encoder(PATH), []
    ids = encoder.ids
    encoder.ids = lambda text: asked.append(text) or ids(text)
    rng = random.Random(4)
    words = ["".join(rng.choices("bdfgklmnrst", k=9)) for _ in range(400)]
    texts = [" ".join(f"{w}{rng.choice(['', '.', ',', '!!'])}" for w in rng.sample(words, 400)) for _ in range(20)]
    list(encoder.encode(texts))
    assert len(asked) < 60 and sum(map(len, asked)) < 3 * sum(map(len, words))


def test_ids_are_the_library_s():
    rng, library = random.Random(6), Tokenizer.from_file(PATH)
    some = [" ", "  ", "\n", "\n\n", "\t", "a", "it's.", "Wort,", "É.", "ª", "日本", "12", "x.\ny", "x.\n\ny", "A,\nB!", "<|endoftext|>.", "|>", "ʰ", "'", "x.'", "..", "a_b", "\x1c"]
    texts = ["".join(rng.choice(some) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    got = [np.frombuffer(b, "<u4").tolist() for b in Encoder(PATH).encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]

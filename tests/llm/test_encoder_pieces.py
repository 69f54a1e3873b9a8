"""Texts are cut into pieces before words are told apart, and their ids stay the library's."""

import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from longtext.llm import tokens

ODD = [
    *"abcdefghijklmnoprstuvxyzABCDHIKLRSTVX0123456789 \t\n.,;:!?'\"<|>-_=/()&$#*@`~^%+{}[]\\\x00\x7f",
    *"äöüßÄÖÜÉéèÈñÑþÞÿ×÷İıſKÅÅΣσς½²٣жЖ你ｆ…–’  \u0085­",
    *"̸̱̀́̇̈̊ͅ⃣‍゙",
    "'s", "'S", "'re", "'LL", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<|x|>", "...", "Straße", "É", "H̱",
]


def pieces(text: str) -> list[str]:
    words = tokens.words_of([text])[-1]
    return words if isinstance(words, list) else words.to_pylist()


def test_words_that_differ_in_case_and_marks_are_one_piece():
    assert set(pieces("Élan élan, ÉLAN; (Abc) abc. ABC!abc 42 24")) == {"élan", "abc", ",", ";", "(", ")", ".", "!", "4", "2"}
    assert pieces("<|ENDOFTEXT|> it's H̱")[1:] == ["it's", "H̱"]  # composition comes before lower case


def test_ids_of_odd_texts_are_the_library_s(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 300)  # forgets often
    tokens.forget()
    path, rng = tokens.vocabulary_path(), random.Random(5)
    library = Tokenizer.from_file(path)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 60))) for _ in range(20_000)]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        want = [e.ids for e in library.encode_batch_fast(part, add_special_tokens=False)]
        assert [x.tolist() for x in tokens.token_ids(part, path)] == want
        assert tokens.lengths(pa.array(part), path).tolist() == [len(x) for x in want]
    tokens.forget()


def test_what_is_known_stays_bounded_and_right(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 100)
    made = tokens.WordEncoder(tokens.vocabulary_path(), tokens._bytes)
    for turn in range(20):
        words = ["always", *(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}{'uvwxyzabcdefghijklmn'[turn]}" for i in range(60))]
        got = made.values(words)
        assert len(made.known) <= 100 + len(words)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [made.tokenizer.encode(w, add_special_tokens=False).ids for w in words]

"""What a worker holds while it encodes."""

import pyarrow as pa

from longtext.llm import tokens


def test_freed_memory_is_given_back_between_batches(monkeypatch):
    told = []
    monkeypatch.setattr(tokens, "give_back", lambda: told.append(1), raising=False)
    text = "word " * 200_000
    parts = [p for _, ps in tokens.balanced(pa.array([text] * 40)) for p in ps]
    assert "".join(parts) == text * 40
    assert len(told) == 2  # 40 MB, every 16 MB


def test_the_library_gets_few_words_in_one_call(monkeypatch):
    path = tokens.vocabulary_path()
    made, sizes = tokens.WordEncoder(path, tokens._lengths), []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode(self, *a, **k):
            return self.inner.encode(*a, **k)

        def encode_batch_fast(self, words, **k):
            sizes.append(len(words))
            return self.inner.encode_batch_fast(words, **k)

    made.tokenizer = Counted(made.tokenizer)
    words = [f"{i}x{i % 7}" for i in range(9000)]
    found = made.values(words)
    assert max(sizes) <= 2000
    assert found == [len(made.tokenizer.encode(w, add_special_tokens=False).ids) for w in words]

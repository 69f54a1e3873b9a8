"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, ship, table, tidy

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Bytes of text that are encoded together; longer texts are split at white space.
BATCH_BYTES = 2 << 20
#: Pieces of words that a worker remembers; beyond, it keeps the half that it met last.
REMEMBERED = 400_000
#: Words that the library encodes in one call: what it returns for each takes about a kilobyte.
CALL_WORDS = 2000
#: Bytes of text after which a worker gives freed memory back, so that what batches leave behind does not add up.
TIDY_BYTES = 16 << 20
#: A long text may be cut before a white space that follows anything else.
_BREAK = re.compile("(?<=[^ \t-\r])[ \t-\r]")
_ENCODERS: dict = {}
_BY_WORDS: dict = {}


#: The normaliser and pre-tokenizer under which a text is what its words are, and the special strings that words may hold.
_STEPS = ["NFC", "Replace", "Lowercase"]
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPECIAL = "<\\|[a-z]+\\|>"
#: Classes of bytes: ASCII letters and digits, and the ASCII marks that neither a contraction nor a special string holds.
_BYTES = np.arange(256)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_ALNUM = _DIGIT | _UPPER | ((_BYTES >= 97) & (_BYTES <= 122))
_MARK = (_BYTES > 32) & (_BYTES < 127) & ~_ALNUM & ~np.isin(_BYTES, list(b"'<|>"))
#: Second bytes, after C3, of Latin letters, and of those in upper case: the lower ones lie 32 further.
_LATIN = (_BYTES >= 0x80) & (_BYTES <= 0xBF) & ~np.isin(_BYTES, [0x97, 0xB7])
_LATIN_UPPER = _LATIN & (_BYTES <= 0x9E)


def spread(texts: pa.Array) -> pa.Array:
    """Texts with a space at each border that the pre-tokenizer cuts anyway (letters, digits and marks of ASCII and Latin-1), these letters in lower case.

    Ids stay what they were: words come out as pieces, and fewer of them differ. A letter before U+0300 or beyond keeps its case, as
    composition comes before the normaliser's lower case; so does what would turn into a special string.
    """
    if not len(texts):
        return texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    first, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    if not size:
        return texts
    given = np.frombuffer(texts.buffers()[2], np.uint8)[first : first + size]
    after = np.append(given[1:], 0)
    latin = np.append(False, (given[:-1] == 0xC3) & _LATIN[given[1:]])
    ends = _ALNUM[given] | latin
    starts = _ALNUM[given] | np.append(latin[1:], False)
    digit, mark = _DIGIT[given], _MARK[given]
    gaps = np.flatnonzero((ends[:-1] & (mark | digit)[1:]) | ((mark | digit)[:-1] & starts[1:])) + 1
    made = given + ((_UPPER[given] | (latin & _LATIN_UPPER[given])) & (after < 0xCC)).astype(np.uint8) * np.uint8(32)
    told = made.tobytes()
    if b"<|" in told:
        for m in re.finditer(_SPECIAL.encode(), told):
            made[m.start() : m.end()] = given[m.start() : m.end()]
    made = np.insert(made, gaps, 32)
    moved = offsets - first + np.searchsorted(gaps, offsets - first)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(moved.astype(np.int32)), pa.py_buffer(made))


class WordEncoder:
    """Encodes white-space separated words with the library and remembers them.

    The vocabulary's pre-tokenizer drops white space and never joins across it, its special strings
    hold none, and Unicode composition does not cross a space: a text's ids are its words' ids in
    order. So a batch is split once, and only its distinct unknown words go to the library, many in
    one call. What is known lies in a few arrays, not in an object a word, and its size is bounded.
    """

    def __init__(self, path: str, keep):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep, self.turn = keep, 0
        self.known, self.used = pa.array([], pa.string()), np.zeros(0, np.int32)
        self.sizes, self.starts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        ends = [i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[ends] = True

    def encoded(self, words: pa.Array) -> tuple[pa.Array, list[np.ndarray], list[np.ndarray]]:
        """The words in another order, and the ids and numbers of ids of some of them at a time.

        A word of lower-case letters is one for the pre-tokenizer too, and the last id of such a word, and no other, is
        one of a word end: such words are encoded as one text and cut at those ids.
        """
        plain = pc.match_substring_regex(words, "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$")
        done, ids, sizes, other = [], [], [], words.filter(pc.invert(plain)).to_numpy(zero_copy_only=False).tolist()
        plain = words.filter(plain).to_numpy(zero_copy_only=False).tolist()
        for at in range(0, len(plain), CALL_WORDS):
            part = plain[at : at + CALL_WORDS]
            found = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[found]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(found):
                done += part
                ids.append(found)
                sizes.append(np.diff(cuts, prepend=0))
            else:
                other += part
        for at in range(0, len(other), CALL_WORDS):
            part = other[at : at + CALL_WORDS]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            done += part
            ids.append(np.array([x for one in found for x in one], "<u4"))
            sizes.append(np.array([len(one) for one in found]))
        return pa.array(done, pa.string()), ids, sizes

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each word is among those known; those that are not yet so are encoded. The places hold until the next call."""
        if len(self.known) > REMEMBERED:
            self.forget_half()
        self.turn += 1
        n = len(self.known)
        coded = pa.concat_arrays([self.known, words]).dictionary_encode()
        place = coded.indices.to_numpy()[n:]
        fresh = coded.dictionary[n:]
        if len(fresh):
            done, ids, sizes = self.encoded(fresh)
            # the library took the fresh words in another order than the dictionary has them
            turned = np.concatenate([np.arange(n), n + pc.index_in(fresh, done).to_numpy()])
            place = turned[place]
            self.known = pa.concat_arrays([self.known, done])
            self.used = np.append(self.used, np.zeros(len(done), np.int32))
            self.sizes = np.concatenate([self.sizes, *sizes])
            self.starts = np.cumsum(self.sizes) - self.sizes
            if self.keep is not _lengths:
                self.ids = np.concatenate([self.ids, *ids])
        self.used[place] = self.turn
        return place

    def forget_half(self) -> None:
        """Keep what was met last."""
        stay = np.sort(np.argsort(-self.used, kind="stable")[: REMEMBERED // 2])
        if self.keep is not _lengths:
            self.ids = self.ids[_runs(self.starts[stay], self.sizes[stay])]
        self.known, self.used, self.sizes = self.known.take(pa.array(stay)), self.used[stay], self.sizes[stay]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def values(self, words: list[str]) -> list:
        """What keep makes of each word's ids."""
        place = self.places(pa.array(words, pa.string()))
        return self.keep(self, place)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + sizes[i] - 1 of each i in turn."""
    places = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    places += np.arange(len(places))
    return places


def _lengths(made: WordEncoder, place: np.ndarray) -> list[int]:
    return made.sizes[place].tolist()


def _bytes(made: WordEncoder, place: np.ndarray) -> list[bytes]:
    return [made.ids[a : a + n].tobytes() for a, n in zip(made.starts[place], made.sizes[place], strict=True)]


def encoder(path: str, kind: str) -> WordEncoder:
    """This worker's encoder; kind 'lengths' or 'ids' (little-endian unsigned 32-bit bytes)."""
    if (path, kind) not in _ENCODERS:
        keep = {"lengths": _lengths, "ids": _bytes}[kind]
        _ENCODERS[path, kind] = WordEncoder(path, keep)
    return _ENCODERS[path, kind]


def forget() -> None:
    """Free what encoders remember: for tasks of other operators in a worker that has encoded before."""
    _ENCODERS.clear()


def safe_parts(text: str, most: int) -> list[str]:
    """Parts of a text of about `most` characters, cut at white space only; a run without any stays whole."""
    parts, at = [], 0
    while len(text) - at > most:
        cut = _BREAK.search(text, at + most)
        if not cut:
            break
        parts.append(text[at : cut.start()])
        at = cut.start()
    return [*parts, text[at:]]


def balanced(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Batches (row numbers, text parts) of about equal bytes; a long text spreads over several.

    Memory that earlier batches freed is given back now and then.
    """
    rows, parts, held, since = [], [], 0, 0
    for i, text in enumerate(t for at in range(0, len(texts), 256) for t in texts.slice(at, 256).to_pylist()):
        for part in safe_parts(text, most) if text and len(text) > most else [text or ""]:
            rows.append(i)
            parts.append(part)
            held += len(part)
            if held >= most:
                yield np.array(rows), parts
                since += held
                rows, parts, held = [], [], 0
                if since >= TIDY_BYTES:
                    give_back()
                    since = 0
    if rows:
        yield np.array(rows), parts


def words_of(parts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """(offsets of each part, its words or pieces of them)."""
    split = pc.ascii_split_whitespace(spread(pa.array(parts, pa.string())))
    flat = split.flatten()
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    # a part without words, or with white space at an end, gives empty ones
    full = pc.not_equal(flat, "")
    total = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return total[offsets], flat.filter(full)


def by_words(path: str) -> bool:
    """Whether a vocabulary's ids are those of its white-space separated words in turn: lower case, white space dropped, word ends marked."""
    if path.endswith(".model"):
        return False
    if path not in _BY_WORDS:
        import json

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = [x.get("type") for x in (told.get("normalizer") or {}).get("normalizers", [])]
        first = ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        _BY_WORDS[path] = (
            steps == _STEPS
            and told["model"].get("end_of_word_suffix") == "</w>"
            and first.get("type") == "Split"
            and first.get("invert") is True
            and first.get("pattern", {}).get("Regex") == _PIECES
            and all(re.fullmatch(_SPECIAL, x["content"]) and not x["normalized"] for x in told.get("added_tokens") or [])
        )
    return _BY_WORDS[path]


def encoded_parts(parts: list[str], path: str) -> list:
    """Ids of whole parts under any vocabulary: sentencepiece for .model, tokenizers otherwise, many in one call."""
    if ("whole", path) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            _ENCODERS["whole", path] = SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            _ENCODERS["whole", path] = Tokenizer.from_file(path)
            _ENCODERS["whole", path].no_truncation()
            _ENCODERS["whole", path].no_padding()
    made = _ENCODERS["whole", path]
    if path.endswith(".model"):
        return made.encode(parts, num_threads=1)
    return [e.ids for e in made.encode_batch_fast(parts, add_special_tokens=False)]


def token_ids(parts: list[str], path: str) -> Iterator[np.ndarray]:
    """Ids of each part, as unsigned 32-bit integers. Words that occur again in a batch are encoded once where the vocabulary allows it."""
    if not by_words(path):
        yield from (np.array(x, dtype="<u4") for x in encoded_parts(parts, path))
        return
    offsets, words = words_of(parts)
    made = encoder(path, "ids")
    place = made.places(words)
    many = made.sizes[place]
    ids = made.ids[_runs(made.starts[place], many)]
    ends = np.cumsum(many)
    bounds = np.concatenate([[0], ends])[offsets]
    yield from (ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def lengths(texts: pa.Array, path: str) -> np.ndarray:
    """Number of tokens of each text; null counts as empty.

    Batches hold about equal bytes. Long texts are cut where white space begins, which no vocabulary of words or of
    bytes with leading spaces joins across; under a sentencepiece model texts stay whole.
    """
    found = np.zeros(len(texts), dtype=np.int64)
    for rows, parts in balanced(texts, sys.maxsize if path.endswith(".model") else BATCH_BYTES):
        if not by_words(path):
            np.add.at(found, rows, [len(x) for x in encoded_parts(parts, path)])
            continue
        offsets, words = words_of(parts)
        made = encoder(path, "lengths")
        place = made.places(words)
        sizes = made.sizes[place]
        total = np.concatenate([[0], np.cumsum(sizes)])
        np.add.at(found, rows, total[offsets[1:]] - total[offsets[:-1]])
    return found


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_bytes, n_tokens, over_limit.

    vocabulary: a path that every executor can open; by default each worker asks the installed package
    for its file. Any vocabulary of tokenizers or sentencepiece gives its library's counts. Under one whose ids
    are those of its words in turn, as the default, only a batch's different words are encoded. Null and empty texts have 0 bytes and 0 tokens; rows are independent, so repeats,
    ties and hot sources need nothing special, and columns beside key and text are not read.
    """
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or vocabulary_path()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lengths(batch.column(2), path))], names=["k", "n_bytes", "n_tokens"]
            )

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("t"))
    counted = rows.mapInArrow(tidy(encode), f"k {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the default vocabulary. Edge cases: see count_tokens()."""
    return count_tokens(table(spark, sf_dir, "documents"))

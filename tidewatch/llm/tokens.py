"""Token ids by a public tokenizer file, with the ids of white-space separated chunks remembered.

The tokenizer replaces runs of white space by one space and its splits never span white space,
so a text's ids are its chunks' ids in order (tests compare this with encoding whole texts).
Chunks are cut at ASCII white space only; everything else is left to the tokenizers library.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .common import LOWER, worker_cache

#: Words of which a worker keeps the ids.
CACHE_WORDS = 1_000_000
#: The same where a stage does nothing else that takes memory: about 150 bytes a word.
LARGE_CACHE_WORDS = 2_200_000
#: Texts that are encoded at once.
ENCODED_ROWS = 512


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Printable ASCII characters that are neither letters nor digits.
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: The steps of a tokenizer file for which words of Latin letters may skip all but the last.
_KNOWN_STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "BPE")


def _lowered(text: bytes) -> bytes:
    """A-Z lower-cased, as the tokenizer does; texts with what may be a special token keep their case."""
    return text if b"<|" in text else text.translate(LOWER)


def _stem(word: bytes) -> tuple[bytes, bytes]:
    """The word with A-Z lower-cased, as the tokenizer does, and the marks that end it apart.

    A split never joins an ASCII letter or digit to such marks. Texts of special tokens keep their case.
    """
    if b"<|" in word:
        return word, b""
    word = word.translate(LOWER)
    stem = word.rstrip(_MARKS)
    if len(stem) < len(word) and stem[-1:].isalnum():
        return stem, word[len(stem) :]
    return word, b""


def _is_latin(word: bytes) -> bool:
    """Lower-case Latin letters only, none of which another step of the tokenizer would change."""
    if word.isalpha():
        return True
    text = word.decode("utf-8")
    return text.isalpha() and max(text) < "\u0250" and text.lower() == text


class ChunkEncoder:
    """Encodes lists of texts to arrays of little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}
        self.cache_words = cache_words
        #: A special token, as text and id: it parts words that are encoded in one call.
        self.mark = next(((t.content.encode(), i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special), None)

        self.plain, self.word_end = self._model_alone(path)

    def _model_alone(self, path: str) -> tuple[object, np.ndarray | None]:
        """A tokenizer of the file's model without the steps that leave words of Latin letters as they are.

        Only for files whose steps are known and whose model marks the last id of each word; such ids
        are the second value.
        """
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        steps = ([x["type"] for x in (given["normalizer"] or {}).get("normalizers", [])], [x["type"] for x in (given["pre_tokenizer"] or {}).get("pretokenizers", [])], given["model"].get("type"))
        suffix = given["model"].get("end_of_word_suffix")
        if steps != _KNOWN_STEPS or not suffix or given["post_processor"]:
            return None, None
        plain = Tokenizer.from_file(path)
        plain.normalizer = normalizers.Sequence([])
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = plain.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        return plain, ends

    def _latin(self, words: list[bytes]) -> list[bytes] | None:
        """The ids of words of lower-case Latin letters by the model alone; None if they can't be told apart."""
        ids = np.array(self.plain.encode_batch_fast([b" ".join(words).decode("utf-8")], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) != len(words):
            return None
        whole, ends = ids.tobytes(), (ends * 4).tolist()
        return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, many words in one call where a special token can part them."""
        if self.mark is None:
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() for e in found]
        text, number = self.mark
        ids = np.array(self.tokenizer.encode_batch_fast([text.join(words).decode("utf-8")], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ids == number)
        if len(ends) == len(words) - 1:
            whole = ids.tobytes()
            starts = [0, *((ends + 1) * 4).tolist()]
            return [whole[a:b] for a, b in zip(starts, [*(ends * 4).tolist(), len(whole)], strict=True)]
        if len(words) == 1:
            return [ids.tobytes()]
        half = len(words) // 2  # a word holds the special token itself
        return self._ids(words[:half]) + self._ids(words[half:])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [_lowered((t or "").encode("utf-8", "replace")).split() for t in texts]
        words: set[bytes] = set()
        for chunk in split:
            words.update(chunk)
        cache = self.cache
        missing = [w for w in words if w not in cache]
        if len(cache) + len(missing) > self.cache_words:
            cache.clear()
            missing = list(words)
        # ASCII letters alone need no look; other words are stems with marks behind.
        letters = [w for w in missing if w.isalpha() and w.islower()]
        stems = {w: _stem(w) for w in missing if not (w.isalpha() and w.islower())}
        other = {x for pair in stems.values() for x in pair if x}.difference(cache, letters)
        latin = list(filter(_is_latin, other)) if self.plain is not None else []
        other.difference_update(latin)
        alone = letters + latin
        for words, ids in ((alone, self._latin if self.plain is not None else self._ids), (list(other), self._ids)):
            for at in range(0, len(words), 2_000):
                part = words[at : at + 2_000]
                cache.update(zip(part, ids(part) or self._ids(part), strict=True))
        cache.update((w, cache[s] + cache[end] if end else cache[s]) for w, (s, end) in stems.items() if w != s)
        return [np.frombuffer(b"".join(map(cache.__getitem__, chunk)), "<u4") for chunk in split]


def encoder(path: str, cache_words: int = CACHE_WORDS) -> ChunkEncoder:
    """This worker's encoder for a tokenizer file."""
    return worker_cache(f"encoder {path} {cache_words}", lambda: ChunkEncoder(path, cache_words))

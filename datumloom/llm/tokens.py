"""Token ids of whole texts with the tokenizers library, word by word.

White space ends a word for the kind of tokenizer that is known here, and no token
crosses it. So each distinct word is encoded once and remembered, and a text's ids
are its words' ids in order: the same ids as encoding the text, for far less work.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import os
import re
import string
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from datumloom.llm.common import Memory, taken

# Fixed value: the expression of word parts that this module knows how to apply.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts that are encoded together; more share more words, and take more memory.
ENCODE_ROWS = 1000
#: Beyond these characters, some may be unknown to this Python's Unicode.
FAR = re.compile("[^\0-ɏ]")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary, by its rule.

    Printable bytes stand for themselves, the others for the characters from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return [chr(256 + others.index(b)) if b in others else chr(b) for b in range(256)]


def splits_at_spaces(config: dict) -> bool:
    """Whether a tokenizer lower-cases, drops white space, cuts words by ``PARTS`` and maps bytes."""
    steps, parts = (config.get("normalizer") or {}).get("normalizers", []), (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in parts] != ["Split", "ByteLevel"]:
        return False
    split, to_bytes = parts
    if steps[1] | {"type": "Replace"} != {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} or to_bytes["add_prefix_space"] or to_bytes["use_regex"]:
        return False
    if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in config["added_tokens"]):
        return False
    return split["behavior"] == "Removed" and split["invert"] and split["pattern"].get("Regex") == PARTS


class WordEncoder:
    """Ids of whole texts; bounded memories of words' and word parts' ids, kept until they are given back.

    Most of the library's time for a word goes into tracking offsets through its
    normalizer. For the kind of tokenizer that ``splits_at_spaces`` knows, texts are
    therefore normalized and split here, and the library's model encodes each distinct
    part once. Texts with a character that this Python's Unicode doesn't know (the
    library's may be newer), and all texts of other tokenizers, go through the whole
    library.
    """

    _kept: dict[str, WordEncoder] = {}

    def __init__(self, path: str, max_words: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        self.known = splits_at_spaces(config)
        # The library's \s is Unicode's White_Space; in Python's expressions \s has more.
        self.pattern = regex.compile(PARTS.replace("\\s", "\\p{White_Space}"))
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.characters = str.maketrans(dict(enumerate(byte_characters())))
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words: Memory[str, bytes] = Memory(self.encode_words, max_words)
        self.parts: Memory[str, bytes] = Memory(self.encode_parts, max_words)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """The process's encoder for this file; reading its vocabulary takes about a second."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def forget(self) -> None:
        """Give back the memory of words, which a worker would hold through other stages."""
        self.words.clear()
        self.parts.clear()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # the C library's, where it has this
            ctypes.CDLL(None).malloc_trim(0)

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        tokenize, bytes_of, out = self.tokenizer.model.tokenize, self.bytes_of, []
        for part in parts:
            written = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.characters)
            out.append(b"".join([bytes_of[t.id] for t in tokenize(written)]))
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of new words, already normalized."""
        # Most often a word is letters, then marks: two parts, or one.
        stems = [w.rstrip(string.punctuation) for w in words]
        split = [(s, w[len(s) :]) if s.isalpha() else self.pattern.findall(w) for s, w in zip(stems, words)]
        distinct = list({p for parts in split for p in parts})
        ids = dict(zip(distinct, self.parts.values(distinct)))
        return [ids[parts[0]] + ids[parts[1]] if len(parts) == 2 else b"".join([ids[p] for p in parts]) for parts in split]

    def normalized(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # Lower case of a capital sigma depends on its place in Python, never in the library.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def is_plain(self, text: str) -> bool:
        """Whether a text has neither special tokens nor characters that this Python doesn't know."""
        if not self.known or any(s in text for s in self.special):
            return False
        return text.isascii() or not FAR.search(text) or not any(unicodedata.category(c) == "Cn" for c in set(text))

    def encode_unusual(self, text: str) -> np.ndarray:
        if self.known and all(map(self.is_plain, between := self.specials.split(text))):
            ids, bounds = self.encode_batch(between)
            return np.insert(ids, bounds[1:-1], [self.special[s] for s in self.specials.findall(text)])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    @staticmethod
    def numbered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct words of texts, each text's words as places among those, and the texts' bounds.

        Texts are cut at space, \\t, \\n, \\v, \\f and \\r alone. What other white space there is stays
        within a word, and no token crosses it. An empty text is an empty word, and that has no ids.
        """
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = pc.dictionary_encode(pc.list_flatten(split))
        return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy(), split.offsets.to_numpy().copy()

    def encode_batch(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, each text's followed by ``end`` if given, and their bounds.

        Words are numbered for the whole batch first, so each distinct one is looked up once.
        """
        unusual = [i for i, t in enumerate(texts) if not self.is_plain(t)]
        normal = list(map(self.normalized, texts))
        for i in unusual:
            normal[i] = ""
        words, which, bounds = self.numbered(normal)
        values = self.words.values(words)
        for i in unusual:
            which[bounds[i]] = len(values)
            values.append(self.encode_unusual(texts[i]).tobytes())
        if end is not None:
            which = np.insert(which, bounds[1:], len(values))
            values.append(end.to_bytes(4, "little"))
            bounds = bounds + np.arange(len(bounds))
        lengths = np.array(list(map(len, values))) // 4
        ids, upto = taken(np.frombuffer(b"".join(values), dtype="<u4"), lengths, which)
        return ids, upto[bounds]

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        return self.encode_batch([text])[0].tobytes()

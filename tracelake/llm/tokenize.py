"""Exact tokenization at chunk speed: texts are cut where no token can span the cut, and chunks are cached.

Both vocabularies split a text into pre-tokens before any merge, so the ids of a text are
the ids of its chunks in a row as long as every cut falls between two pre-tokens. Texts
with white space for which that isn't plain, and texts that hold one of the vocabulary's
added tokens (such as an end-of-text mark), are encoded whole, chunks that aren't plain
words go through the whole tokenizer, plain words straight to its merges.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np

#: Chunks in one generation of a worker process's cache; two generations are kept.
CACHE_CHUNKS = 400_000
_ODD_CODES = (0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)
_ODD = re.compile("[" + "".join(map(chr, _ODD_CODES)) + "]")
#: Signs that make one pre-token together after a word.
_TAIL = ".,;:!?\"*#$%&|)"
_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Generations(dict):
    """A cache that forgets what it wasn't asked for during a generation of CACHE_CHUNKS entries."""

    def __init__(self, compute: Callable[[str], bytes]):
        super().__init__()
        self.compute, self.old = compute, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def age(self) -> None:
        if len(self) > CACHE_CHUNKS:
            self.old = dict(self)
            self.clear()


class ChunkEncoder:
    """``leading_space``: a pre-token may start with the blank before it (byte-level vocabularies);
    else white space separates pre-tokens and is dropped."""

    def __init__(self, path: str, leading_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Written-out added tokens are found before the text is split, so no cut may touch them.
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)", re.I)
        self.leading_space = leading_space
        self.letters = _byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.bare = Generations(lambda c: self._compute(c, ""))
        self.cache = Generations(lambda c: self._compute(c, " ")) if leading_space else self.bare
        self.tails = Generations(self._piece)
        self.line_end = self._piece("\n") if leading_space else b""

    def _encode(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _chunks(self, text: str) -> list[str] | None:
        """None: encode it whole. With leading_space, the blank before each chunk but the first is implied."""
        if _ODD.search(text) or self.added.search(text):
            return None
        if not self.leading_space:
            return text.split()
        if "  " in text or "\n " in text or "\t " in text or "\r " in text:
            return None
        return text.split(" ")

    def _piece(self, text: str) -> bytes:
        """Ids of one pre-token."""
        letters, packed = self.letters, self.packed
        plain = text.replace(" ", letters[32]) if text.isascii() and "\n" not in text else "".join([letters[b] for b in text.encode()])
        return b"".join([packed[t.id] for t in self.tokenizer.model.tokenize(plain)])

    def _word(self, word: str, blank: str) -> bytes | None:
        """Ids of a word of letters only; None if the tokenizer would change it into something else."""
        if not self.leading_space:
            word = word.lower() if word.isascii() else self.tokenizer.normalizer.normalize_str(word)
            if not word.isalpha():
                return None
        return self._piece(blank + word)

    def _compute(self, chunk: str, blank: str) -> bytes:
        """Ids of a chunk after ``blank``."""
        own = self.cache if blank else self.bare
        if chunk.isalpha():
            ids = self._word(chunk, blank)
            return self._encode([blank + chunk])[0] if ids is None else ids
        core = chunk.rstrip(_TAIL)
        if core.isalpha() and (self.leading_space or core.isascii() or self.tokenizer.normalizer.normalize_str(core).isalpha()):
            return own[core] + self.tails[chunk[len(core) :]]
        if self.leading_space and "\n" in chunk and all(parts := chunk.split("\n")):
            return own[parts[0]] + b"".join([self.line_end + self.bare[p] for p in parts[1:]])
        return self._encode([blank + chunk])[0]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        split = [self._chunks(t) if t else [] for t in texts]
        space, out = self.leading_space, []
        for kept in (self.cache, self.bare, self.tails):
            kept.age()
        known = self.cache.__getitem__
        whole = [i for i, c in enumerate(split) if c is None]
        done = dict(zip(whole, self._encode([texts[i] for i in whole]), strict=True))
        for i, chunks in enumerate(split):
            if chunks is None:
                out.append(done[i])
            elif not chunks:
                out.append(b"")
            elif space:
                out.append(self.bare[chunks[0]] + b"".join(map(known, chunks[1:])))
            else:
                out.append(b"".join(map(known, chunks)))
        return out


def encoder(path: str, leading_space: bool) -> ChunkEncoder:
    """The worker process's encoder, kept with its cache between tasks."""
    if (path, leading_space) not in _encoders:
        _encoders[path, leading_space] = ChunkEncoder(path, leading_space)
    return _encoders[path, leading_space]

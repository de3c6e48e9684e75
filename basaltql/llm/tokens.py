"""Byte-level BPE ids of whole texts, from a public tokenizer's files."""

from __future__ import annotations

import base64
import json

import numpy as np


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """Encoder equal to ``tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.

    The same vocabulary's rank file beside ``path`` (same stem, .tiktoken) gives the same ids in a third of the time;
    texts that contain a special token's string go to the tokenizer itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(path, "rb") as f:
            self.specials = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self._path, self._exact = path, None
        self._by_rank = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: UTF-8 bytes of each id.
        self.n_bytes = np.zeros(max(*ranks.values(), *self.specials.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.n_bytes[i] = len(token)
        for token, i in self.specials.items():
            self.n_bytes[i] = len(token.encode())

    @property
    def exact(self):
        """The tokenizer itself, loaded when first needed."""
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self._path)
        return self._exact

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.specials):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self._by_rank.encode_to_numpy(text, disallowed_special=())


def encoder(path: str) -> ByteBpe:
    """The encoder of ``path``, kept with the tokenizer module for as long as a worker process lives."""
    import public_tokenizers

    kept = public_tokenizers.__dict__.setdefault("_kept_encoders", {})
    if path not in kept:
        kept[path] = ByteBpe(path)
    return kept[path]

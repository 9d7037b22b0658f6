"""Byte-level BPE ids: those of a ``tokenizers`` vocabulary file, at a quarter of its cost.

The file's vocabulary is given to ``tiktoken``, which merges the pair whose joined bytes have the least rank, where
``tokenizers`` merges the pair that comes first in the list of merges. Both do the same if

* ids after the single bytes rise with the merges that make them, and
* every vocabulary entry, alone, is encoded as itself.

(Two neighbours whose joined bytes are an entry t were made by merges inside t's bytes only, in the order in which
these happen in t alone. There they end in t, so the two neighbours are the pair that t's merge names.) ``Encoder``
checks both when it loads a file; where one fails, where the file has a normalizer, a
post-processor or another pre-tokenizer, and for texts that hold an added token, ``tokenizers`` itself encodes.
"""

from __future__ import annotations

import json
from array import array

#: Fixed value: the pattern that byte-level pre-tokenizers split by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with runs of white space beyond this go to ``tokenizers``: the pattern's look-ahead walks back over a run.
LONG_RUN = 10_000


def byte_of() -> dict[str, int]:
    """Byte-level BPE shows a byte as itself where that prints, else as the next character from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's encoder for a vocabulary file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.fast = self._fast(json.load(f))

    def _fast(self, spec: dict):
        """The same vocabulary for ``tiktoken``; None where the two are not known to agree."""
        import tiktoken

        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        if model.get("type", "BPE") != "BPE" or not plain or spec.get("normalizer") or spec.get("post_processor") or any(model.get(k) for k in odd):
            return None
        vocab, shown = model["vocab"], byte_of()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [vocab.get(a + b) for a, b in merges]
        singles = [vocab.get(c) for c in shown]
        if None in made or None in singles or len(made) + len(singles) != len(vocab) or made != sorted(set(made)) or max(singles) >= made[0]:
            return None
        tokenize = self.tokenizer.model.tokenize
        if any([t.id for t in tokenize(w)] != [i] for w, i in vocab.items()):
            return None
        ranks = {bytes(shown[c] for c in w): i for w, i in vocab.items()}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        out = []
        for text in texts:
            if self.fast is None or any(a in text for a in self.added) or long_blank(text):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            else:
                ids = self.fast.encode_ordinary(text)
            out.append(little(ids))
        return out


def long_blank(text: str) -> bool:
    """Whether the text may have a run of more than ``LONG_RUN`` characters of white space."""
    return len(text) > LONG_RUN and any(text[i].isspace() and text[i : i + LONG_RUN // 2].isspace() for i in range(0, len(text), LONG_RUN // 2))


def little(ids: list[int]) -> bytes:
    import sys

    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()

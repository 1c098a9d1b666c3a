"""Token ids of a byte-level BPE file of the `tokenizers` library.

Where the merges of the file stand in the order of their ids, merging by rank gives the same ids, and the rank-based
library does that several times quicker; all else goes to the library of the file. Long texts are encoded in blocks: the
pre-tokenizer never puts a blank behind another character into one piece with that character, so a text may be cut in
front of every blank that follows a non-blank.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np

#: Characters after which a long text is cut at the next place that allows it.
BLOCK_CHARS = 1 << 20
#: Blocks with a longer run of non-blanks are left to the library of the file.
RUN_CHARS = 4096
#: The characters that the pre-tokenizer takes for blanks, and its built-in pattern of pieces.
_BLANKS = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLANK = re.compile(f"[{_BLANKS}]")
_CUT = re.compile(f"(?<=[^{_BLANKS}])(?=[{_BLANKS}])")
_LONG_RUN = re.compile(f"[^{_BLANKS}]{{{RUN_CHARS}}}")


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """`text` in blocks of `size` characters or more, cut in front of blanks; one block where nothing allows a cut."""
    low = 0
    while len(text) - low > size:
        cut = _CUT.search(text, low + size)
        if cut is None:
            break
        yield text[low:cut.start()]
        low = cut.start()
    yield text[low:] if low else text


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: itself where it is printable, else the next from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(printable))
    return {**{chr(b): b for b in printable}, **{chr(256 + k): b for k, b in enumerate(rest)}}


def vocabulary_bytes(spec: dict) -> list[bytes]:
    """The bytes of every id of a byte-level file; special tokens stand for their string in UTF-8."""
    alphabet = byte_alphabet()
    entries = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
               for t, i in spec["model"]["vocab"].items()}
    entries.update({t["id"]: t["content"].encode() for t in spec.get("added_tokens") or ()})
    return [entries.get(i, b"") for i in range(1 + max(entries, default=-1))]


class Encoder:
    """Ids of texts by a tokenizer file, without the ids its post-processor would add.

    `plain_specials` takes the strings of special tokens inside texts for ordinary text; else they become their ids.
    Files of another kind than byte-level BPE with the built-in pattern are encoded by their library, text by text.
    """

    def __init__(self, file: bytes, plain_specials: bool = False):
        from tokenizers import Tokenizer

        self.made = Tokenizer.from_buffer(file)
        self.made.no_truncation()
        self.made.no_padding()
        self.made.encode_special_tokens = plain_specials
        self.spec = json.loads(file)
        pre, added = self.spec.get("pre_tokenizer") or {}, self.spec.get("added_tokens") or []
        self.byte_level = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
            and not self.spec.get("normalizer")
            and not any(_BLANK.search(t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        )
        self.strings = [t["content"] for t in added if not (plain_specials and t["special"])]
        self.ranked = self._ranked() if self.byte_level else None

    def _ranked(self):
        """An encoder by ranks, or None where the order of the merges is not that of their ids."""
        model, alphabet = self.spec["model"], byte_alphabet()
        vocabulary = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [vocabulary.get(a + b, -1) for a, b in merges]
        singles = [vocabulary.get(c, -1) for c in alphabet]
        if (
            model.get("type") != "BPE" or model.get("ignore_merges") or model.get("dropout")
            or any(a >= b for a, b in zip(ids, ids[1:])) or min(singles) < 0 or ids and max(singles) > ids[0]
        ):
            return None
        import tiktoken

        words = [*alphabet, *(a + b for a, b in merges)]
        ranks = {bytes(alphabet[c] for c in w): vocabulary[w] for w in words}
        return tiktoken.Encoding("ranked", pat_str=_PIECE, mergeable_ranks=ranks, special_tokens={})

    def _block(self, text: str) -> np.ndarray:
        if self.ranked and not any(s in text for s in self.strings) and not _LONG_RUN.search(text):
            return np.array(self.ranked.encode_ordinary(text), "<u4")
        return np.array(self.made.encode(text, add_special_tokens=False).ids, "<u4")

    def __call__(self, text: str) -> np.ndarray:
        """Ids of `text` as unsigned 32-bit numbers."""
        if not self.byte_level:
            return self._block(text)
        parts = [self._block(b) for b in blocks(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


_made: dict[tuple[bytes, bool], Encoder] = {}


def encoder(file: bytes, plain_specials: bool = False) -> Encoder:
    """The encoder of a file, one per Python worker."""
    key = hashlib.sha256(file).digest(), plain_specials
    if key not in _made:
        _made[key] = Encoder(file, plain_specials)
    return _made[key]

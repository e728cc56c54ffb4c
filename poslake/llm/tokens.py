"""Token ids of many texts by a public byte-level BPE file.

The pre-tokenizer gives a space to the word after it, and cuts a run of white space only before its last
character.  So a text may be cut before every space that no white space follows; the parts encode one by one,
and most of them repeat, so they come from a cache of bounded size.  Other texts are encoded whole.
"""

from __future__ import annotations

import json
import struct

#: Fixed value: how a byte-level pre-tokenizer splits text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Parts that each of the cache's two generations holds.
CACHE_PARTS = 1 << 19


class _Parts(dict):
    """Ids of " " + part, by part; None if the part must not be cut off."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode
        self._older: dict[str, bytes | None] = {}

    def __missing__(self, part: str) -> bytes | None:
        if len(self) >= CACHE_PARTS:
            self._older = dict(self)
            self.clear()
        if part in self._older:
            ids = self._older[part]
        else:
            ids = None if not part or part[0].isspace() else self._encode(" " + part)
        self[part] = ids
        return ids


def _byte_of_character() -> dict[str, int]:
    """The byte-level alphabet: visible Latin-1 bytes stand for themselves, the others follow from 256 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """The file's tokens as bytes with their ids, if lower ids mean earlier merges (so that ids are ranks) and
    the file asks for nothing but byte-level BPE; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and not model.get("dropout") and not model.get("unk_token") and not spec.get("normalizer")
             and not model.get("ignore_merges") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"))
    if not plain:
        return None
    to_byte, special = _byte_of_character(), {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in token): n for token, n in model["vocab"].items() if token not in special}
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    return ranks if merged == sorted(merged) and len(merged) + 256 == len(ranks) else None


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, as bytes.

    Unseen parts go through a rank encoder built from the same file, which starts faster on short strings;
    whole texts go through the file's own tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        ranks = merge_ranks(path)
        self._ranked = None
        if ranks:
            from tiktoken import Encoding
            self._ranked = Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._parts = _Parts(self._part if ranks else self._whole)

    def _part(self, text: str) -> bytes:
        ids = self._ranked.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self._special):
            return self._whole(text)
        first, *parts = text.split(" ")
        ids = [*map(self._parts.__getitem__, parts)]
        if None in ids:
            return self._whole(text)
        return self._whole(first) + b"".join(ids)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder, and one cache, for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")

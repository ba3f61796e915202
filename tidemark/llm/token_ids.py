"""Token ids of texts, for the operators that store or pack them.

The ids are those of the byte-level BPE vocabulary of the ``tokenizers`` file
(``add_special_tokens=False``; an added special token inside a text is one id).
They are made from the same vocabulary in its rank form, which is faster.
"""

from __future__ import annotations

import base64
import re

import numpy as np


class Encoder:
    def __init__(self, ranks_path: str, vocabulary_path: str):
        import json

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.plain = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        added = json.load(open(vocabulary_path, encoding="utf-8")).get("added_tokens", [])
        self.special = {x["content"]: x["id"] for x in added}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def ids(self, text: str) -> list[int]:
        if self.special_re is None or not any(s in text for s in self.special):
            return self.plain.encode_ordinary(text)
        out: list[int] = []
        for part in self.special_re.split(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                out += self.plain.encode_ordinary(part)
        return out

    def array(self, text: str, *tail: int) -> np.ndarray:
        return np.array([*self.ids(text), *tail], dtype="<u4")


_encoders: dict[tuple[str, str], Encoder] = {}


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def encoder(files: tuple[str, str]) -> Encoder:
    if files not in _encoders:
        _encoders[files] = Encoder(*files)
    return _encoders[files]

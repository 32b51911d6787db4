"""Sizes in tokens of a public tokenizer, whose files lie in a folder given as a parameter."""

from __future__ import annotations

import base64
import importlib.util
from functools import cache
from pathlib import Path

import numpy as np

FOLDER, NAME = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"


@cache
def encoding(folder: str = FOLDER, name: str = NAME):  # noqa: ANN201
    """A byte-level BPE, once per process. No token is special; every text is ordinary text."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("_tokenizer_files", Path(folder, "__init__.py"))
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(folder, name).read_bytes().splitlines() if line)}
    return tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Characters given to the tokenizer at once; longer texts are cut before a blank, where no token reaches across.
AT_ONCE = 100_000


def tokens_of(text: str, folder: str = FOLDER, name: str = NAME) -> list[int]:
    """Token ids; in parts where the text is very long, so that memory stays small."""
    own = encoding(folder, name)
    if len(text) <= AT_ONCE:
        return own.encode_ordinary(text)
    out, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > AT_ONCE:
            end = next((i for i in range(at + AT_ONCE, at + AT_ONCE // 2, -1) if text[i] == " " and not text[i - 1].isspace() and not text[i + 1].isspace()), at + AT_ONCE)
        out += own.encode_ordinary(text[at:end])
        at = end
    return out


def starts_of(text: str, ids: list[int], folder: str = FOLDER, name: str = NAME) -> tuple[np.ndarray, np.ndarray]:
    """For each token and the end: the character it begins at or within, and whether it begins there."""
    own = encoding(folder, name)
    lengths = np.array([len(x) for x in own.decode_tokens_bytes(ids)], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    lead = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])
    whole = np.append(lead, True)[at]
    return np.where(whole, chars[at], chars[at] - 1), whole

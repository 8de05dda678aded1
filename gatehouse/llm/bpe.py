"""Byte-level BPE vocabularies, loaded once per Python worker.

Vocabulary files are named by path and read where the work runs, so they have to
be installed on every machine, as the tokenizer libraries are.
"""

from __future__ import annotations

import base64
import functools
import json
import re

import tiktoken

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
"""Pre-token pattern of the byte-level vocabularies (a fixed value)."""

_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
PLAIN_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\t\n\r \u00a0{_L}{_N}]+|[\t\n\r \u00a0]+(?![^\t\n\r \u00a0])|[\t\n\r \u00a0]+")
"""``PATTERN`` over the characters that ``plain`` allows, for the faster matcher."""

_ODD = re.compile("[^\t\n\r\x20-\x7e\u00a0-\u017f\u2010-\u2027]")
_SPACES = re.compile(r"\s{5000}")


def plain(text: str) -> bool:
    """Whether all libraries class the text's characters alike and none backtracks too far; other texts go to the library itself."""
    return not _ODD.search(text) and not (len(text) >= 5000 and _SPACES.search(text))


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update((chr(256 + i), b) for i, b in enumerate(b for b in range(256) if b not in plain))
    return letters


@functools.cache
def ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(rank by token bytes, id by special string) of a ``.json`` or ``.tiktoken`` file."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, {}
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    letters, special = byte_letters(), {t["content"]: t["id"] for t in data["added_tokens"]}
    return {bytes(letters[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in special}, special


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    own, special = ranks.__wrapped__(path)  # the encoding has its own copy
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=own, special_tokens=special)


@functools.cache
def library(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def encode(path: str, text: str):
    """Ids of a text as the library of the file gives them, special strings included."""
    if not path.endswith(".json"):
        return encoding(path).encode_ordinary(text)
    if not plain(text):
        return library(path).encode(text, add_special_tokens=False).ids
    return encoding(path).encode_to_numpy(text, allowed_special="all")

"""Subword ids of whole texts by a public tokenizer, with repeated words looked up.

``word_bpe_49k`` lower-cases, parts a text at white space and then into runs of
letters, single digits and runs of other marks, and encodes each such run on
its own. Words of plain Latin characters are parted here, and each run is
encoded by the tokenizer's model when a worker meets it first; words with any
other character go through the whole tokenizer. A worker process keeps what it
has met for its later tasks, within fixed bounds, until it is told to forget.
"""

from __future__ import annotations

import gc
import os
import re
import struct

#: words and runs that a worker remembers; beyond it the memory starts anew
WORDS_REMEMBERED, RUNS_REMEMBERED = 500_000, 400_000
_LONGEST = 64
# tabs to carriage return, printable ASCII without ' and <, and Latin letters that are their own normal form
_PLAIN = re.compile("[\t-\r\x20-\x26\x28-\x3b\x3d-\x7eÀ-ÖØ-öø-ÿ]*")
_RUNS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_BLANKS = re.compile("[\t-\r\x20]+")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Runs(dict):
    """Ids of runs, encoded when first asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenize = tokenizer.model.tokenize
        # how the tokenizer spells the bytes of a letter; printable ASCII stands for itself
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelled = {c: spell(chr(c))[0][0] for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))}

    def __missing__(self, run: str) -> bytes:
        ids = _packed([t.id for t in self.tokenize(run if run.isascii() else run.translate(self.spelled))])
        if len(run) <= _LONGEST:
            self[run] = ids
        return ids


class _Words(dict):
    """Ids of lower-cased plain words."""

    def __init__(self, runs: _Runs):
        super().__init__()
        self.runs = runs

    def __missing__(self, word: str) -> bytes:
        ids = b"".join(map(self.runs.__getitem__, _RUNS.findall(word)))
        if len(word) <= _LONGEST:
            self[word] = ids
        return ids


class Subwords:
    """The ids of texts as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        # what is remembered lives long and holds no cycles: looking through it often costs a tenth of the time
        gc.set_threshold(100_000, 50, 100)
        self.tokenizer = Tokenizer.from_file(path)
        self.runs = _Runs(self.tokenizer)
        self.words = _Words(self.runs)

    def encode(self, text: str) -> bytes:
        for known, most in ((self.words, WORDS_REMEMBERED), (self.runs, RUNS_REMEMBERED)):
            if len(known) > most:
                known.clear()
        if _PLAIN.fullmatch(text):
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        parts = []
        for word in _BLANKS.split(text):
            if _PLAIN.fullmatch(word):
                parts.append(self.words[word.lower()])
            else:
                parts.append(_packed(self.tokenizer.encode(word, add_special_tokens=False).ids))
        return b"".join(parts)


_OF_WORKER: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    """This process's tokenizer."""
    if path not in _OF_WORKER:
        _OF_WORKER[path] = Subwords(path)
    return _OF_WORKER[path]


def forget() -> None:
    """Give the memory of this process's tokenizers back: for tasks that work on stored ids."""
    _OF_WORKER.clear()

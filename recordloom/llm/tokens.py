"""Token ids of whole texts by a public vocabulary file, with a cache of words.

The vocabulary's pipeline never looks across ASCII white space: normalising,
splitting and merging work inside one run of other characters. A text is
therefore cut at white space and each distinct run is encoded once per Python
worker; the ids of a text are the ids of its runs in order. A run that holds a
character which could make lower-casing or normalising depend on its
neighbours, or that could be a special token, is encoded by itself; the others
are encoded many at a time, joined by spaces, and told apart by the word-end
tokens.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from recordloom.llm.common import word_bytes

# Runs remembered by one worker before it starts anew (about 150 bytes each).
CACHE_RUNS = 650_000
# Pieces of plain runs; on these characters the vocabulary's own pattern cuts at the same places.
_PLAIN = re.compile(rb"[a-z]+|[0-9]|[!\"#$%&()*+,\-./:;=?@\[\\\]^_`{|}~]+")
_ALL_PLAIN = re.compile(rb"[a-z0-9!\"#$%&()*+,\-./:;=?@\[\\\]^_`{|}~]+")
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
# The same with the accented letters of Latin-1, which the pattern takes as letters.
_ACCENTED = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!\"#$%&()*+,\-./:;=?@\[\\\]^_`{|}~]+")
_ALL_ACCENTED = re.compile(r"[a-zß-öø-ÿ0-9!\"#$%&()*+,\-./:;=?@\[\\\]^_`{|}~]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts; made once per worker and vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # For lower-case ASCII pieces normalising and splitting change nothing, and are left out.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        with open(path, encoding="utf-8") as file:
            ending = json.load(file)["model"].get("end_of_word_suffix") or ""
        size = self.whole.get_vocab_size()
        self.ends = np.array([ending != "" and (self.whole.id_to_token(i) or "").endswith(ending) for i in range(size)])
        self.runs: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    def _learn_pieces(self, pieces: list[bytes]) -> None:
        ascii_only = [p for p in pieces if p.isascii()]
        self._learn_joined(self.bare, ascii_only)
        if len(ascii_only) < len(pieces):
            self._learn_joined(self.whole, [p for p in pieces if not p.isascii()])

    def _learn_joined(self, tokenizer: object, pieces: list[bytes]) -> None:
        for at in range(0, len(pieces), 20_000):
            part = pieces[at : at + 20_000]
            lines = [b" ".join(part[i : i + 50]).decode() for i in range(0, len(part), 50)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):  # a vocabulary without word ends
                for piece, e in zip(part, self.whole.encode_batch_fast([p.decode() for p in part], add_special_tokens=False), strict=True):
                    self.pieces[piece] = np.array(e.ids, "<u4").tobytes()
                continue
            raw, before = ids.astype("<u4").tobytes(), 0
            for piece, cut in zip(part, (4 * cuts).tolist(), strict=True):
                self.pieces[piece] = raw[before:cut]
                before = cut

    def _learn(self, runs: list[bytes]) -> None:
        one, marked, plain, odd = {}, {}, {}, []
        for run in runs:
            if run.isalpha():  # of bytes: ASCII letters only
                one[run] = run.lower()
            elif run[-1] in b".," and run[:-1].isalpha():
                marked[run] = run[:-1].lower()
            elif _ALL_PLAIN.fullmatch(low := run.lower()):
                plain[run] = _PLAIN.findall(low)
            elif _LETTERS.fullmatch(text := run.decode("utf-8", "replace").lower()):
                one[run] = text.encode()
            elif _ALL_ACCENTED.fullmatch(text):
                plain[run] = [piece.encode() for piece in _ACCENTED.findall(text)]
            else:
                odd.append(run)
        pieces = {b".", b","}.union(one.values(), marked.values(), *plain.values())
        self._learn_pieces(list(pieces.difference(self.pieces)))
        known = self.pieces
        self.runs.update(zip(one, map(known.__getitem__, one.values()), strict=True))
        for run, low in marked.items():
            self.runs[run] = known[low] + known[run[-1:]]
        for run, found in plain.items():
            self.runs[run] = b"".join(map(known.__getitem__, found))
        for at in range(0, len(odd), 1000):
            part = odd[at : at + 1000]
            for run, e in zip(part, self.whole.encode_batch_fast([r.decode("utf-8", "replace") for r in part], add_special_tokens=False), strict=True):
                self.runs[run] = np.array(e.ids, "<u4").tobytes()

    def raw(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text has none."""
        if len(self.runs) > CACHE_RUNS:
            self.runs, self.pieces = {}, {}
        split = [word_bytes(text or b"") for text in texts]
        known = self.runs
        new = set().union(*split).difference(known)
        if new:
            self._learn(list(new))
        return [b"".join(map(known.__getitem__, found)) for found in split]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file.

    Workers get this module by value with every task, so what should outlive a
    task is kept with the tokenizers library.
    """
    import tokenizers

    made = tokenizers.__dict__.setdefault("_recordloom_encoders", {})
    if path not in made:
        made[path] = Encoder(path)
    return made[path]

"""Token ids of texts by a byte-level BPE vocabulary file, with a bounded cache of text pieces.

Byte-level BPE first cuts a text by a pattern and merges inside each cut.  No cut spans from a
character that isn't white space into one that is, nor from a letter into a sign that isn't one, and
the pattern never looks back, so a text can be taken apart before every run of white space and after
every run of letters and the ids of the parts put together again.  Most parts (a space and a word) come
again and again; their ids are kept in a dictionary of bounded size.

Strings of special tokens (``<|endoftext|>``) are ordinary text by default, or with ``special_ids`` get the ids
that the file gives them.  The cut holds for both: such a string has no white space and begins with a sign, so
it lies inside one part.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

# White space of Unicode (property White_Space), as the vocabulary's cutting pattern takes it.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Letters of which a run may end before an ASCII sign that isn't a letter: a cut always lies there.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_PARTS = re.compile(f"[{_WS}]*[{_LETTERS}]+(?![^\x00-\x40\x5b-\x60\x7b-\x7f])|[{_WS}]*[^{_WS}]+|[{_WS}]+")
_SPACES = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{_WS}]", c))
CACHE_PARTS = 600_000          # the dictionary starts anew beyond this
CACHE_PART_CHARS = 64          # longer parts aren't kept


class PieceEncoder:
    """Little-endian unsigned 32-bit ids of texts, as bytes."""

    def __init__(self, path: str, special_ids: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # the task has one core
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = not special_ids
        self._known: dict[str, bytes] = {}
        self._long: list[str] = []

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts.  Parts that begin with white space and don't end with it are encoded as one text: a cut
        lies wherever two of them meet, and each id's place in the text tells its part."""
        joined = [p for p in parts if p[0] in _SPACES and p[-1] not in _SPACES]
        single = [p for p in parts if p[0] not in _SPACES or p[-1] in _SPACES]
        self._long += [p for p in parts if len(p) > CACHE_PART_CHARS]
        made = {p: np.array(e.ids, dtype="<u4").tobytes()
                for p, e in zip(single, self._tok.encode_batch_fast(single, add_special_tokens=False))}
        if joined:
            whole = self._tok.encode("".join(joined), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))
            at = np.fromiter((o[0] for o in whole.offsets), np.int64, len(whole.ids))
            last = (np.searchsorted(at, ends, side="left") * 4).tolist()
            ids = np.array(whole.ids, dtype="<u4").tobytes()
            made |= {p: ids[i:j] for p, i, j in zip(joined, [0, *last], last)}
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [_PARTS.findall(t) for t in texts]
        if len(self._known) > CACHE_PARTS:
            self._known = {}
        known = self._known
        known |= self._learn(list(set().union(*cut).difference(known)))
        out = [b"".join(map(known.__getitem__, parts)) for parts in cut]
        for p in [p for p in self._long if p in known]:
            del known[p]
        self._long.clear()
        return out


@lru_cache(maxsize=2)
def encoder(path: str, special_ids: bool = False) -> PieceEncoder:
    """One encoder per Python worker, kept between its tasks."""
    return PieceEncoder(path, special_ids)

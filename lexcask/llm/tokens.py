"""Token ids of whole texts, for packing and counting.

Byte-level tokenizers split a text before a space that precedes a printing
character and never merge across that place, so the pieces between are encoded
once and remembered; texts are then put together from remembered pieces.  The
memory is emptied when it is full, so it is bounded however large the corpus.
"""

from __future__ import annotations

import os
import re
from array import array

#: Remembered pieces of one worker.
MEMORY = 1_000_000
#: Unknown pieces that are encoded in one text.
JOINED = 512
#: Texts that are cut and joined at a time.
TEXTS = 64

#: A space before a character that no library counts as white space or control.
_CUT = re.compile(" (?=[!-~¡-¬®-ᙿ、-퟿])")


class ByteBpe:
    """Ids by the tokenizers library, as unsigned 32-bit bytes.

    ``path`` names a tokenizer file with the usual byte-level pre-tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        line = self.lib.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else -1

    def _learn(self, parts: list[list[str]]) -> None:
        new = set().union(*[p[1:] for p in parts]).difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = set().union(*[p[1:] for p in parts])
        # Pieces without white space go many in one text, a line break between: it is one id, and no other piece has it.
        whole = [p for p in new if p.split() == [p]]
        rest = [p for p in new if p.split() != [p]]
        for lo in range(0, len(whole), JOINED):
            some = whole[lo : lo + JOINED]
            ids = array("I", self.lib.encode_batch_fast([" " + "\n ".join(some)], add_special_tokens=False)[0].ids)
            at = [-1, *(k for k, i in enumerate(ids) if i == self.line), len(ids)]
            if len(at) == len(some) + 1:
                for p, a, z in zip(some, at, at[1:]):
                    self.known[p] = ids[a + 1 : z].tobytes()
            else:
                rest += some
        for p, e in zip(rest, self.lib.encode_batch_fast([" " + p for p in rest], add_special_tokens=False)):
            self.known[p] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null one is empty."""
        out = []
        for lo in range(0, len(texts), TEXTS):
            parts = [_CUT.split(t or "") for t in texts[lo : lo + TEXTS]]
            self._learn(parts)
            heads = self.lib.encode_batch_fast([p[0] for p in parts], add_special_tokens=False)
            get = self.known.__getitem__
            out += [array("I", h.ids).tobytes() + b"".join(map(get, p[1:])) for h, p in zip(heads, parts)]
        return out


_CODERS: dict[str, ByteBpe] = {}


def coder(path: str) -> ByteBpe:
    """This worker's coder, which remembers pieces from one task to the next."""
    if path not in _CODERS:
        _CODERS[path] = ByteBpe(path)
    return _CODERS[path]


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

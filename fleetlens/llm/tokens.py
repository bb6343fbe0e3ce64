"""Subword ids of whole texts, one lookup for each word that was seen before.

The word tokenizer drops white space and never joins across it, so the ids of a text are the ids
of its space-separated chunks one after the other.  A test holds this against the plain call.
"""

from __future__ import annotations

import numpy as np

#: What the pre-tokenizer of the vocabulary file takes as one piece (fixed value).
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Words of these characters take the quick way: lower-casing and composing them is plain there.
PLAIN = r"[!-~\u00a1-\u012f\u0131-\u024f]+"
END = "\x00"


def default_tokenizer() -> str:
    """Where the installed vocabulary file lies; read on the driver and on executors alike."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in a byte-level vocabulary: printable ones for themselves,
    the others for 256, 257, ... in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes; ``limit`` bounds the remembered words.

    Unseen plain words go through a rank encoder built from the same vocabulary file, in which the
    end of a word is a byte of its own; any other word is given to the tokenizer itself.
    """

    def __init__(self, path: str | None = None, limit: int = 300_000):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        path = path or default_tokenizer()
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces, self.plain = regex.compile(PIECE), regex.compile(PLAIN)
        letters = _byte_letters()
        ranks, self.ends = {}, np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        for token, number in model["vocab"].items():
            ends = token.endswith("</w>") and token != "</w>"
            body = token[:-4] if ends else token
            if all(c in letters for c in body):
                raw = bytes(letters[c] for c in body) + END.encode() * ends
                if raw not in ranks:
                    ranks[raw] = number
                self.ends[number] = ends
        self.ranks = tiktoken.Encoding(
            "words", pat_str=r"[^ ]+", mergeable_ranks=ranks, special_tokens={}
        )
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {"": b""}
        self.piece_ids: dict[str, bytes] = {}
        self.limit = limit

    def _plainly(self, text: str) -> bytes:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(found.ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Remember the ids of ``words``."""
        parts, missing, known = {}, {}, self.piece_ids
        joined = " ".join(words)
        odd = not self.plain.fullmatch(joined.replace(" ", "")) or any(a in joined for a in self.added)
        for word in words:
            if odd and (not self.plain.fullmatch(word) or any(a in word for a in self.added)):
                self.known[word] = self._plainly(word)
                continue
            small = word.lower()
            if small.isalpha():  # a single run of letters
                found = (small,)
            elif small[:-1].isalpha() and not small[-1].isalnum() and "'" not in small:
                found = (small[:-1], small[-1])
            else:
                found = self.pieces.findall(small)
            parts[word] = found
            for piece in found:
                if piece not in known:
                    missing[piece] = None
        if missing:
            order = list(missing)
            ids = self.ranks.encode_to_numpy(f"{END} ".join(order) + END, disallowed_special=())
            ids = ids.astype("<u4")
            raw, start = ids.tobytes(), 0
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            for piece, stop in zip(order, stops, strict=True):
                known[piece] = raw[start:stop]
                start = stop
        for word, found in parts.items():
            self.known[word] = b"".join([known[p] for p in found])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        words = text.replace("\n", " ").replace("\t", " ").split(" ")
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > self.limit:
            known.clear()
            self.piece_ids.clear()
        self.learn(list({w for w in words if w not in known}))
        return b"".join([known[w] for w in words])

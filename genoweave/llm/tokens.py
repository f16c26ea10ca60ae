"""Tokenizer-library encoding of whole texts, with a bounded cache of encoded words.

A text is cut at spaces where every token must end anyway, so the ids of the text
are the ids of its parts in order. Parts recur, so a worker keeps the ids of
recent parts (two generations of about ``CACHE_WORDS`` each) and encodes only
new ones. Texts with unusual white space, where a cut might not be safe, are
encoded whole. Special tokens' strings inside a text are ordinary text.
"""

from __future__ import annotations

import os

import numpy as np

CACHE_WORDS = 700_000
LONG_PART = 200  # characters; longer parts are not kept
BATCH_WORDS = 100  # new parts encoded in one call
BLOCK_TEXTS = 512  # texts whose new parts are encoded together
MARKS = ".,;:!?"  # that end a run of letters
GLUE = "\x01"  # before a part that had no space before it

#: Characters that are white space for the tokenizers or for str.split but not one of " \\t\\n\\v\\f\\r".
ODD_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)),
              "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
#: With one of these in a text, a space can stand inside a run of white space, so spaces are not safe cuts.
RUNS = ("  ", "\n \n", "\t", "\r", "\f", "\v")
LINE_RUNS = ("\n\n", "\n ", " \n")
_encoders: dict[tuple, "WordEncoder"] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, specials_as_text: bool = False, cache_words: int = CACHE_WORDS) -> None:
        self.cache_words = cache_words
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = [] if specials_as_text else self.tok.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if not t.normalized]
        self.folded = [t.content.lower() for t in added if t.normalized]  # looked for after the normalizer, which may fold case
        self.tok.encode_special_tokens = specials_as_text
        if hasattr(self.tok.model, "_resize_cache"):  # only new words get there, so its own cache only costs time
            self.tok.model._resize_cache(0)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # a tokenizer that drops white space sees words, else a part keeps the space before it
        self.drops_space = not self.tok.encode(" \n ", add_special_tokens=False).ids
        vocab = self.tok.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # ids that begin with a space
        self.closes = np.zeros_like(self.opens)  # ids that end a word
        for token, i in vocab.items():
            self.opens[i], self.closes[i] = token.startswith("Ġ"), token.endswith("</w>")
        self.tails = dict(zip(MARKS, self._whole(list(MARKS))))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts encoded many at a time; parts of a group whose ids can't be told apart are left out."""
        known: dict[str, bytes] = {}
        groups = [parts[i : i + BATCH_WORDS] for i in range(0, len(parts), BATCH_WORDS)]
        lead = "" if self.drops_space else " "
        for group, e in zip(groups, self.tok.encode_batch_fast([lead + " ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            if self.drops_space:
                cuts = np.concatenate([[0], np.flatnonzero(self.closes[ids]) + 1])
            else:
                cuts = np.append(np.flatnonzero(self.opens[ids]), ids.size)
            if len(cuts) == len(group) + 1 and cuts[0] == 0 and cuts[-1] == ids.size:
                raw, at = ids.tobytes(), (cuts * 4).tolist()
                known |= {p: raw[at[i] : at[i + 1]] for i, p in enumerate(group)}
        return known

    def _learn_plain(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of new parts. A part that lost the space before it is told by its first character."""
        if self.drops_space:  # a word of letters only is one unit to the tokenizer
            known = self._joined([p for p in parts if p.isalpha()])
        else:
            known = self._joined([p for p in parts if p[0] not in "\n" + GLUE and p[-1] != "\n"])
        rest = [p for p in parts if p not in known]
        lead = "" if self.drops_space else " "
        return known | dict(zip(rest, self._whole([p[1:] if p[0] == GLUE else lead + p for p in rest])))

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of new parts; letters and the mark after them are two units to the tokenizer, so these parts need their letters only."""
        whole, ended = [], []
        for p in parts:
            (ended if p[-1] in self.tails and p[:-1].isalpha() else whole).append(p)
        known = self._learn_plain(whole)
        bases = {p[:-1] for p in ended}.difference(known, self.young)
        known |= {p: self.old[p] for p in bases if p in self.old}
        known |= self._learn_plain([p for p in bases if p not in known])
        young = self.young
        for p in ended:
            base = p[:-1]
            known[p] = (known[base] if base in known else young[base]) + self.tails[p[-1]]
        return known

    def _holds_added(self, text: str) -> bool:
        return any(t in text for t in self.added) or bool(self.folded) and any(t in text.lower() for t in self.folded)

    def _cut(self, text: str) -> list[str] | None:
        """Parts whose ids, in order, are the text's; each but the first of a spaced tokenizer had a space before it."""
        if self.drops_space:
            return text.split()
        if any(r in text for r in RUNS) or text[-1].isspace() or GLUE in text:
            return None
        if "\n" in text and not any(r in text for r in LINE_RUNS) and text[0] != "\n":
            text = text.replace("\n", f" {GLUE}\n {GLUE}")  # a line's end is a unit of its own
        return text.split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        for at in range(0, len(texts), BLOCK_TEXTS):
            whole, waiting, new = [], [], set()
            get = self.young.get
            for i in range(at, min(at + BLOCK_TEXTS, len(texts))):
                text = texts[i]
                if not text:
                    continue
                parts = None
                if not self._holds_added(text) and not any(c in text for c in (ODD_SPACES[:4] if text.isascii() else ODD_SPACES)):
                    parts = self._cut(text)
                if parts is None:
                    whole.append(i)
                    continue
                if not self.drops_space and (head := parts.pop(0)):
                    out[i] = self._whole([head])[0]
                got = list(map(get, parts))
                if None in got:
                    gaps = [k for k, ids in enumerate(got) if ids is None]
                    missed = [parts[k] for k in gaps]
                    new.update(missed)
                    waiting.append((i, got, gaps, missed))
                else:
                    out[i] += b"".join(got)
            for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
                out[i] = ids
            if waiting:
                ready = {p: self.old[p] for p in new if p in self.old}
                ready |= self._learn([p for p in new if p not in ready])
                for i, got, gaps, missed in waiting:
                    for k, p in zip(gaps, missed):
                        got[k] = ready[p]
                    out[i] += b"".join(got)
                self.young |= ready if max(map(len, ready)) <= LONG_PART else {p: x for p, x in ready.items() if len(p) <= LONG_PART}
                if len(self.young) > self.cache_words:
                    self.old, self.young = self.young, {}
        return out


def encoder(path: str, specials_as_text: bool = False, cache_words: int = CACHE_WORDS) -> WordEncoder:
    """This process's encoder for a tokenizer file; it lives as long as the worker, one at a time."""
    key = path, specials_as_text, cache_words
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(*key)
    return _encoders[key]

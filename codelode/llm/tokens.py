"""Token ids of a public tokenizer, encoded word by word.

The tokenizers library encodes. The vocabulary drops white space and starts a
new pre-token at each change between letters and marks, so a text's ids are
those of its white-space-separated chunks in order, and a lower-case word of
letters only is one pre-token. Each worker therefore encodes a distinct chunk
once and keeps it in a two-generation cache of bounded size: words of letters
many at a time by the vocabulary's model without its (then idle) normaliser,
other chunks by the tokenizer as it is. Texts in which the shortcut could
differ from encoding them whole are encoded whole.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

#: Chunks per cache generation.
CACHE = 160_000
#: Words that one call of the library encodes.
JOINED = 512
#: A character from which lower-casing first might change the ids.
_PECULIAR = re.compile("[<ɐ-\U0010ffff]")
#: White space to Python only.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of two bytes are needed")
        own = json.loads(self.tokenizer.to_str())
        own |= {"normalizer": None, "added_tokens": []}
        own["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.words = Tokenizer.from_str(json.dumps(own))
        suffix = own["model"]["end_of_word_suffix"]
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for t, i in own["model"]["vocab"].items() if suffix and t.endswith(suffix)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint16).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> None:
        for a in range(0, len(words), JOINED):
            some = words[a : a + JOINED]
            ids = np.array(self.words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint16)
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 2).tolist()
            if len(stops) != len(some):
                self.young.update(zip(some, self._whole(some)))
                continue
            raw, begin = ids.tobytes(), 0
            for word, stop in zip(some, stops):
                self.young[word] = raw[begin:stop]
                begin = stop

    def _learn(self, chunks: set[str]) -> None:
        young, old = self.young, self.old
        letters, others, marked = [], [], []
        for c in chunks:
            if c in old:
                young[c] = old[c]
            elif c.isalpha():
                letters.append(c)
            elif c[-1] in ".," and c[:-1].isalpha():
                marked.append(c)
            else:
                others.append(c)
        if marked:
            # a word and one closing mark are two pre-tokens, whatever the word
            bare = {c[:-1] for c in marked}
            bare.difference_update(young, letters)
            letters += bare
            others += [c for c in (".", ",") if c not in young]
        self._letters(letters)
        if others:
            young.update(zip(others, self._whole(others)))
        for c in marked:
            young[c] = young[c[:-1]] + young[c[-1]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 16-bit ids of each text; none for a null."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        out: list[bytes | None] = [b""] * len(texts)
        split: list[tuple[int, list[str], list]] = []
        missing: set[str] = set()
        for k, text in enumerate(texts):
            if not text:
                continue
            if _PECULIAR.search(text) or _ODD_SPACE.search(text):
                out[k] = self._whole([text])[0]
                continue
            chunks = text.lower().split()
            got = list(map(self.young.get, chunks))
            if None in got:
                missing.update([c for c, g in zip(chunks, got) if g is None])
                split.append((k, chunks, got))
            else:
                out[k] = b"".join(got)
        self._learn(missing)
        for k, chunks, got in split:
            out[k] = b"".join(map(self.young.__getitem__, chunks))
        return out


@functools.cache
def encoder(path: str) -> ChunkEncoder:
    """One per Python worker; later tasks of the worker go on with its cache."""
    return ChunkEncoder(path)

"""Public tokenizers as the libraries give them, loaded once in each Python worker."""
from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache
from importlib import metadata
from pathlib import Path

import numpy as np

from .words import Texts, Words, words

DEFAULT_TOKENIZER = "word_bpe_49k.json"
WORDS_AT_ONCE = 4096  # an encoding takes far more memory than its ids


def vocabulary_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def load(path: str):
    """A function from a list of texts to their id lists."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        return lambda texts: [x.ids for x in own.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: pieces.encode(texts, add_bos=False, add_eos=False, num_threads=1)
    raise ValueError(f"no library for {path}")


def version_digest(path: str) -> str:
    """Digest of the vocabulary file and of the library's version: either may change a count."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    return hashlib.sha256(Path(path).read_bytes() + f"|{library} {metadata.version(library)}".encode()).hexdigest()


def folds_white_space(path: str) -> bool:
    """True if any ASCII white space counts as a space for this tokenizer, so that texts differing in it share a digest."""
    if not path.endswith(".json"):
        return False
    spec = json.loads(Path(path).read_text())
    normalizer = spec.get("normalizer") or {}
    steps = normalizer.get("normalizers", [normalizer])
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in spec.get("added_tokens", []))
    return plain and any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)


def splits_at_white_space(path: str) -> bool:
    """True if no token spans ASCII white space and none stands for it, so that the ids of a text are those of its words in turn."""
    if not folds_white_space(path):
        return False
    before = json.loads(Path(path).read_text()).get("pre_tokenizer") or {}
    first = (before.get("pretokenizers") or [before])[0]
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and (first.get("pattern") or {}).get("Regex", "").endswith("[^\\s\\p{L}\\p{N}]+")


class WordIds:
    """Ids of texts by way of their distinct words, for tokenizers that split at white space; else of whole texts.

    Words seen before in this worker are looked up by two hashes among what ``most`` bytes hold; where only one of the two
    agrees, the texts at hand are encoded whole.
    """

    def __init__(self, path: str, most: int = 48 << 20):
        self.ids_of, self.by_word, self.most = load(path), splits_at_white_space(path), most
        self._forget()

    def _ids_of_texts(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(self.ids_of([texts.data[a:b].tobytes().decode()])[0], np.uint32) for a, b in zip(texts.offsets, texts.offsets[1:], strict=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.cumsum([0, *map(len, found)])

    def _ids_of_words(self, raw: bytes, w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words and how many each has."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
        for lo in range(0, len(which), WORDS_AT_ONCE):
            part = which[lo : lo + WORDS_AT_ONCE]
            found = self.ids_of([raw[a:b].decode() for a, b in zip(w.starts[part].tolist(), w.ends[part].tolist(), strict=True)])
            lengths.append(np.fromiter(map(len, found), np.int32, len(found)))
            ids.append(np.fromiter((i for x in found for i in x), np.uint32, int(lengths[-1].sum())))
        return np.concatenate(ids), np.concatenate(lengths)

    def _forget(self) -> None:
        self.keys, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.lengths, self.firsts, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, second: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        firsts = len(self.ids) + np.cumsum(lengths, dtype=np.int64) - lengths
        self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.keys, keys)
        for name, new in (("keys", keys), ("second", second), ("lengths", lengths), ("firsts", firsts)):
            setattr(self, name, np.insert(getattr(self, name), at, new))

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids as uint32, and where those of each text begin and end."""
        if not self.by_word:
            return self._ids_of_texts(texts)
        w = words(texts, second=True)
        keys, one, which = np.unique(w.hashes, return_index=True, return_inverse=True)
        second = w.second[one]
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = np.flatnonzero(at < len(self.keys))
        known[inside] = self.keys[at[inside]] == keys[inside]
        if (second[which] != w.second).any() or (self.second[at[known]] != second[known]).any():
            return self._ids_of_texts(texts)
        if not known.all():
            if 28 * (len(self.keys) + len(keys)) + 4 * len(self.ids) > self.most:  # all words of these texts are needed below
                self._forget()
                known[:] = False
            self._learn(keys[~known], second[~known], *self._ids_of_words(texts.data.tobytes(), w, one[~known]))
            at = np.searchsorted(self.keys, keys)
        lengths, firsts = self.lengths[at][which].astype(np.int64), self.firsts[at][which]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(firsts - (ends - lengths), lengths)]
        return ids, np.concatenate([[0], ends])[w.bounds]


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)

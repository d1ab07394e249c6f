"""Pre-tokens of byte-level BPE vocabularies: how texts fall into them, and the ids of each."""

from __future__ import annotations

import json
import sys
from array import array
from types import ModuleType

import regex
import tiktoken
from tokenizers import Tokenizer

# Fixed value: the split pattern of byte-level BPE.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Beyond these, the library's own tables of letters and digits decide.
UNUSUAL = regex.compile("[^\x00-ɏͰ-ϿЀ-џ‐-‧€]")


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if printable, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def fitting(path: str) -> None:
    """Raises where a file is not of the kind that PreTokens reads: byte-level BPE without a normaliser, whose plain split
    and added tokens are as assumed, and whose merges are in the order of the ids that they make."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, split = file["model"], file.get("pre_tokenizer") or {}
    vocab = model.get("vocab")
    if model.get("type") != "BPE" or not isinstance(vocab, dict) or file.get("normalizer") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError(f"{path}: not a plain BPE vocabulary")
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError(f"{path}: texts are not split as byte-level BPE splits them")
    if any(t.get(k) for t in file.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens that are not matched plainly")
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [vocab.get(m, -1) for m in made]
    added = {t["content"] for t in file.get("added_tokens", ())}
    if any(a >= b for a, b in zip([-1, *ids], ids)) or set(vocab) - added != set(made) | set(_bytes_of()) - added:
        raise ValueError(f"{path}: merges are not in the order of their ids, or don't reach every id")


class PreTokens:
    """Splits texts as the tokenizer of a byte-level BPE file does, and gives each pre-token's ids as little-endian
    32-bit words.

    Ids are looked up once per distinct pre-token and kept; beyond KEPT of these the table starts afresh. Merges go by
    rank, which is the id in such files (`fitting` checks it), so tiktoken's merge loop gives the same ids as the file's
    own library.
    """

    KEPT, LONGEST = 300_000, 64

    def __init__(self, path: str):
        fitting(path)
        tokenizer = Tokenizer.from_file(path)
        self.own = tokenizer.pre_tokenizer
        self.special = {t.content: i.to_bytes(4, "little") for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        of = _bytes_of()
        ranks = {bytes(of[c] for c in t): i for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.ids: dict[str, bytes] = {}

    @classmethod
    def shared(cls, path: str) -> PreTokens:
        """One for each process: tasks of a worker use it one after another."""
        held = sys.modules.setdefault("_pretokens_of_this_worker", ModuleType("_pretokens_of_this_worker")).__dict__
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def split(self, text: str) -> list[str]:
        if self.special and any(s in text for s in self.special):
            return [p for part in self.parts.split(text) if part for p in ([part] if part in self.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if UNUSUAL.search(text):
            return [text[a:b] for _, (a, b) in self.own.pre_tokenize_str(text)]
        return SPLIT.findall(text)

    def ids_of(self, piece: str) -> bytes:
        found = self.ids.get(piece)
        if found is None:
            found = self.special.get(piece) or array("I", self.merge(piece)).tobytes()
            if len(piece) <= self.LONGEST:
                if len(self.ids) >= self.KEPT:
                    self.ids.clear()
                self.ids[piece] = found
        return found

    def encoded(self, text: str) -> bytes:
        return b"".join(map(self.ids_of, self.split(text)))

    def count(self, piece: str) -> int:
        """How many ids a pre-token has."""
        return 1 if piece in self.special else len(self.merge(piece))

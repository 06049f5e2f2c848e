"""Exact tokenisation with the tokenizers library, with a bounded cache of what stands between two spaces.

The two known pre-tokenizers never join characters across a single space that has no white space beside it, so the ids
of a text are the ids of its pieces between such spaces, one after another; pieces repeat far more often than texts. A
piece that is a run of letters and then ASCII punctuation is two pre-tokens, each with ids of its own. Spellings of added
tokens are what the file says of them: a text is split at them first. Any other kind of file goes to the library as it is.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

from .shared import KEPT_IN_WORKER

OPEN: dict[tuple[str, int], PieceTokenizer] = {}
KEPT_IN_WORKER.append(OPEN)
#: White space in any library's sense.
_WHITE = r"\s\x1c-\x1f\x85\u180e\u200b\ufeff"
#: White space other than the space and the line feed.
_RARE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_CUT = re.compile(rf"(?<=[^{_WHITE}])(?= [^{_WHITE}])")
#: Letters, then punctuation other than the apostrophe (of contractions).
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if printable, else the next from U+0100."""
    shown, unseen = {*range(33, 127), *range(161, 173), *range(174, 256)}, iter(range(256, 512))
    return [chr(b if b in shown else next(unseen)) for b in range(256)]


_LETTERS = _byte_letters()
#: The two kinds of files that are cut at spaces, by their normalizers' and pre-tokenizers' settings.
_WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_KNOWN = (
    (["NFC", ["Replace", r"\s+", " "], "Lowercase"], [["Split", _WORD_RULE, "Removed", True], ["ByteLevel", False, False]]),
    ([], [["ByteLevel", False, True]]),
)


def _settings(step: dict | None) -> list:
    """A normalizer or pre-tokenizer as a list of its steps and what they depend on."""
    if step is None:
        return []
    kind, pattern = step["type"], (step.get("pattern") or {}).get("Regex")
    if kind == "Sequence":
        return [x for part in step.get("normalizers") or step.get("pretokenizers") for x in _settings(part)]
    if kind == "Replace":
        return [[kind, pattern, step["content"]]]
    if kind == "Split":
        return [[kind, pattern, step["behavior"], step["invert"]]]
    if kind == "ByteLevel":
        return [[kind, step["add_prefix_space"], step["use_regex"]]]
    return [kind]


def _known(spec: dict) -> bool:
    """Whether a file's pieces between spaces can be encoded on their own, and letters by the model alone."""
    model, added = spec["model"], spec["added_tokens"]
    plain = model["type"] == "BPE" and not (model["dropout"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model.get("ignore_merges"))
    fixed = all(not (a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]) for a in added)
    steps = (_settings(spec["normalizer"]), _settings(spec["pre_tokenizer"]))
    return plain and fixed and spec["truncation"] is None and spec["padding"] is None and spec["post_processor"] is None and steps in _KNOWN


def _odd(text: str) -> bool:
    """Whether a space may have white space or an end of the text beside it."""
    return "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or bool(_RARE.search(text))


class PieceTokenizer:
    """``ids(texts)``: the ids of each text, as ``encode(text, add_special_tokens=False)`` gives them.

    keep: pieces in each of the two generations of the cache, which bounds its memory. longest: pieces kept in it.
    """

    def __init__(self, path: str, keep: int = 400_000, longest: int = 48):
        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.known = _known(spec)
        #: Spellings of added tokens, the longest first, and their ids.
        self.added = {a["content"]: array("I", [a["id"]]).tobytes() for a in sorted(spec["added_tokens"], key=lambda a: -len(a["content"]))}
        self.spelt = re.compile(f"({'|'.join(map(re.escape, self.added))})") if self.added else None
        self.model, self.keep, self.longest = t.model, keep, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.old_stems: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        #: Whether case and white space make no difference; the ids of a line feed between words.
        self.folds = self._whole(" Ab") == self._whole("ab")
        self.line = self._whole("\n")

    def _whole(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _stem(self, stem: str, space: str) -> bytes:
        """The ids of a run of letters, one pre-token."""
        key = stem.lower() if self.folds else space + stem
        got = self.stems.get(key)
        if got is None:
            got = self.old_stems.get(key)
            if got is None:
                if key.isascii():  # letters stand for themselves, a space before them for its byte's letter
                    text = key if key[0] != " " else _LETTERS[32] + stem
                else:
                    text = "".join([_LETTERS[b] for b in key.encode()])
                got = array("I", [x.id for x in self.model.tokenize(text)]).tobytes()
            if len(self.stems) >= self.keep:
                self.stems, self.old_stems = {}, self.stems
            self.stems[key] = got
        return got

    def _part(self, part: str, space: str = "") -> bytes:
        if not part and not space:
            return b""
        if plain := _PLAIN.fullmatch(part):
            stem, tail = plain.groups()
            if tail and tail not in self.tails:
                if len(self.tails) >= 10_000:
                    self.tails.clear()
                self.tails[tail] = self._whole(tail)
            return self._stem(stem, space) + (self.tails[tail] if tail else b"")
        return self._whole(space + part)

    def _piece(self, word: str) -> bytes:
        """The ids of a word that follows a space."""
        got = self.old.get(word)
        if got is None:
            if word.isalpha() and word.isascii():
                got = self._stem(word, " ")
            elif "\n" in word and "\n\n\n" not in word and word[-2:] != "\n\n" and not re.search(rf"[{_WHITE}]", word.replace("\n", "")):
                first, *lines = word.split("\n")
                got = self._part(first, " ") + b"".join([self.line + self._part(x) for x in lines])
            else:
                got = self._part(word, " ")
        if len(word) <= self.longest:
            self.young[word] = got
        return got

    def _stretch(self, text: str) -> list[bytes]:
        """The ids of a text without spellings of added tokens, piece by piece."""
        if _odd(text):
            first, *words = _CUT.split(text)
            words = [w[1:] for w in words]
        else:
            first, *words = text.split(" ")
        young, piece = self.young, self._piece
        found = [self._whole(first)]
        found += [young[w] if w in young else piece(w) for w in words]
        if len(young) > self.keep:
            self.young, self.old = {}, young
        return found

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self.known:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        out = []
        for text in texts:
            if self.spelt is not None and self.spelt.search(text):
                parts = [[self.added[x]] if x in self.added else self._stretch(x) for x in self.spelt.split(text) if x]
                found = [b for part in parts for b in part]
            else:
                found = self._stretch(text)
            out.append(np.frombuffer(b"".join(found), np.uint32))
        return out


def piece_tokenizer(path: str, keep: int = 400_000) -> PieceTokenizer:
    """One for each vocabulary and size of cache in a Python worker."""
    if (path, keep) not in OPEN:
        OPEN[path, keep] = PieceTokenizer(path, keep)
    return OPEN[path, keep]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))

"""Public tokenizers used pre-token by pre-token, with the library's results.

A byte-pair encoder treats each pre-token alone, so a text's ids are those of
its pre-tokens in order and each distinct pre-token needs the library once.
Texts are cut here by the tokenizer's own pattern; that is done only where
Python and the library agree on character classes, on texts in NFC made of
printable ASCII and Latin letters. Any other text goes to the library whole, as
do texts that hold one of the special strings, and every text of a tokenizer
whose rules aren't recognised.
"""

from __future__ import annotations

import json
import os
import re

#: The pattern this module can apply itself, as it stands in the tokenizer's file (a fixed value).
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = "a-zªµºß-öø-ſ"
#: KNOWN_PATTERN on such texts; letters are tried first, which no other branch begins with.
_CUT = re.compile(rf"[{_LATIN}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s{_LATIN}0-9]+")
#: Outside of these characters texts go to the library: others may be letters, numbers or blanks to one side only.
_OTHER = re.compile(r"[^\t\n\r -~¡-±´-¸º»¿-ſ]")
#: Byte-level encoders write bytes that aren't printable as the characters from 256 on, in order.
_SHOWN = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
_LOADED: dict[str, "Pretokens"] = {}


class Pretokens:
    """Cuts texts into pre-tokens and encodes pre-tokens by the batch."""

    def __init__(self, path: str):
        self.piece = path.endswith(".model")
        self.pattern, self.special = None, []
        if self.piece:
            import sentencepiece
            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if (kinds == ["NFC", "Replace", "Lowercase"] and len(cuts) == 2 and cuts[0].get("invert")
                and cuts[0].get("pattern", {}).get("Regex") == KNOWN_PATTERN and cuts[1].get("use_regex") is False
                and not spec["model"].get("dropout") and spec.get("post_processor") is None):
            self.pattern, self.bpe = _CUT, self.model.model
            self.special = [t["content"] for t in spec.get("added_tokens", [])]

    @staticmethod
    def load(path: str) -> "Pretokens":
        """One for each worker process and path."""
        if path not in _LOADED:
            _LOADED[path] = Pretokens(path)
        return _LOADED[path]

    def cut(self, text: str) -> list[str] | None:
        """The pre-tokens, or None if the text must go to the library whole."""
        if self.pattern is None or any(s in text for s in self.special):
            return None
        plain = text.isascii() and text.replace("\n", " ").isprintable()
        if not plain and _OTHER.search(text):
            return None
        return self.pattern.findall(text.lower())

    def ids(self, word: str) -> list[int]:
        """The ids of one pre-token, by the library's model alone."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_SHOWN)
        return [t.id for t in self.bpe.tokenize(word)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The library's ids of whole texts (or of single pre-tokens)."""
        if self.piece:
            return self.model.encode(texts, num_threads=1) if texts else []
        return [e.ids for e in self.model.encode_batch(texts, add_special_tokens=False)]


class Cache(dict):
    """Pre-token -> ``value`` of its ids, filled when asked for. It is emptied
    when it has ``MOST`` entries: only time is lost by that."""

    MOST = 600_000

    def __init__(self, pre: Pretokens, value):
        self.pre, self.value = pre, value

    def __missing__(self, word: str):
        if len(self) >= self.MOST:
            self.clear()
        found = self[word] = self.value(self.pre.ids(word))
        return found


def steps(texts: list[str | None], chars: int = 1 << 20):
    """(start, texts) of a bounded total length (or one longer text)."""
    at, size, out = 0, 0, []
    for t in texts:
        out.append(t or "")
        size += len(t or "")
        if size >= chars:
            yield at, out
            at, size, out = at + len(out), 0, []
    if out:
        yield at, out

"""The byte-level BPE of a tokenizers file: ids exactly as that library gives them, at the speed of tiktoken.

Both libraries hold the same vocabulary. Where every vocabulary entry is what its own bytes encode to, merging by rank and
merging by listed pair agree on any text. That and the file's other settings are checked as it is opened; a file of another
kind is left to the tokenizers library whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Unicode white space, as ``\s`` means it.
BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space runs of this many characters are cut by rule: the pattern's look ahead goes back through a run, on a stack.
LONG_RUN = 4096
_RUNS = re.compile(f"[{BLANKS}]{{{LONG_RUN},}}+")


def _char_bytes() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, by its rule."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(spare)}


class Bpe:
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        self.special = {x["content"]: x["id"] for x in added}
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        #: Whether the fast way gives the library's ids.
        self.plain = self._is_plain(spec, added)
        if not self.plain:
            return
        chars = _char_bytes()
        self._char_of = {b: c for c, b in chars.items()}
        ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max([*ranks.values(), *self.special.values()]) + 1
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: t.encode() for t, i in self.special.items()}
        #: Bytes of each id's text.
        self.lengths = np.zeros(self.size, np.int64)
        for i, b in self.bytes_of.items():
            self.lengths[i] = len(b)
        self._parts = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _is_plain(self, spec: dict, added: list[dict]) -> bool:
        """Byte-level BPE with the usual pattern and nothing else that would change ids."""
        model, before, decoder = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        after = (spec.get("post_processor") or {}).get("type", "ByteLevel")
        if (model.get("type"), before.get("type"), decoder.get("type"), after) != ("BPE", "ByteLevel", "ByteLevel", "ByteLevel") or spec.get("normalizer"):
            return False
        if before.get("add_prefix_space") or not before.get("use_regex", True):
            return False
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return False
        if any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip")):
            return False
        chars, special = _char_bytes(), {x["content"] for x in added}
        own = {t: i for t, i in model["vocab"].items() if t not in special}
        return set(chars) <= set(own) and all(set(t) <= set(chars) and [x.id for x in self.library.model.tokenize(t)] == [i] for t, i in own.items())

    def parts(self, text: str) -> list[str | int]:
        """The text cut at special tokens, which stand as their ids."""
        if self._parts is None:
            return [text] if text else []
        out, at = [], 0
        for m in self._parts.finditer(text):
            out += [text[at : m.start()]] * (m.start() > at) + [self.special[m[0]]]
            at = m.end()
        return out + [text[at:]] * (at < len(text))

    def encode_part(self, text: str) -> np.ndarray:
        """Ids of a text in which nothing is a special token.

        A long run of white space is one piece but for its last character, which may belong to what follows; at the
        text's end the whole run is one piece. The library's model, which has no pattern, encodes such a piece.
        """
        if len(text) < 1000:
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        if len(text) < LONG_RUN or not (runs := list(_RUNS.finditer(text))):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        out, at = [], 0
        for m in runs:
            end = m.end() if m.end() == len(text) else m.end() - 1
            piece = "".join(map(self._char_of.__getitem__, text[m.start() : end].encode("utf-8")))
            out += [self.fast.encode_to_numpy(text[at : m.start()], disallowed_special=())] * (m.start() > at)
            out.append(np.array([t.id for t in self.library.model.tokenize(piece)], np.uint32))
            at = end
        out += [self.fast.encode_to_numpy(text[at:], disallowed_special=())] * (at < len(text))
        return np.concatenate(out)

    def encode(self, text: str) -> np.ndarray:
        if not self.plain:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        ids = [self.encode_part(x) if isinstance(x, str) else np.array([x], np.uint32) for x in self.parts(text)]
        return ids[0] if len(ids) == 1 else np.concatenate([np.zeros(0, np.uint32), *ids])

    def decode(self, ids) -> str:
        """As decode(ids, skip_special_tokens=False)."""
        if not self.plain:
            return self.library.decode(list(ids), skip_special_tokens=False)
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """One tokenizer a Python worker. The file must lie at this path on every executor."""
    return Bpe(path)


#: The parts of a tokenizer file under which white space parts words and is dropped.
_WORD_FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


#: Characters whose case, kind and composition all Unicode versions agree on: ASCII and the letters of Latin-1.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
_EASY = re.compile(f"[\\x00-\\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*+")
#: The file's pattern over such characters in lower case. ASCII's four separators (1C to 1F) are no white space to it.
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \\t-\\r{_LETTERS}0-9]+")
_SPACES = re.compile(r"[^ \t-\r]+")


class _Pieces(dict):
    """Ids, as bytes, of pieces met before; others are encoded when they are asked for."""

    KEPT, LONGEST = 150_000, 48

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= self.LONGEST:
            if len(self) >= self.KEPT:
                self.clear()
            self[piece] = ids
        return ids


class WordCoder:
    """Ids of a tokenizers file whose words end in a mark, as bytes (little-endian, 32 bits an id): those of the library.

    Where a file drops the white space between words (its settings are checked), ASCII white space always parts the text:
    NFC composes nothing with it, lower-casing looks at single characters, and no word of the pattern holds any. Texts
    and stretches of ASCII and Latin-1 letters are cut by the file's pattern here, and tiktoken merges their pieces: the
    mark is a byte that UTF-8 hasn't, joined to a piece's last byte before all other merges. As every entry of the file
    is what its own bytes encode to (checked too), merging by rank gives what merging by listed pair does. All other
    stretches, and whole texts under files of another kind, are left to the library.
    """

    MARK = b"\xff"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        self.special = [x["content"] for x in added]
        model = spec["model"]
        self.by_word = all(spec.get(k) == v for k, v in _WORD_FORM.items()) and model.get("end_of_word_suffix") == "</w>" and model.get("type") == "BPE"
        self.by_word &= not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        self.by_word &= not any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")) and not any(c.isspace() for x in self.special for c in x)
        self.by_word = self.by_word and self._ranked(model)
        self.easy, self.hard = _Pieces(self._merged), _Pieces(self._whole)

    def _ranked(self, model: dict) -> bool:
        import tiktoken

        chars, end = _char_bytes(), model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            mark = self.MARK if token.endswith(end) else b""
            return bytes(chars[c] for c in token.removesuffix(end)) + mark

        own = {t: i for t, i in model["vocab"].items() if t not in set(self.special)}
        single = [bytes([b]) for b in range(256)]
        merged = [raw("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        order = list(dict.fromkeys(single + [b + self.MARK for b in single if b != self.MARK] + merged))
        ids = {raw(t): i for t, i in own.items()}
        id_of = [ids.get(b) for b in order]
        self.bytes_of = [b"" if i is None else i.to_bytes(4, "little") for i in id_of]
        self.core = tiktoken.Encoding("words", pat_str=".", mergeable_ranks={b: k for k, b in enumerate(order)}, special_tokens={})._core_bpe
        marked = [t for t in own if t.endswith(end)]
        fits = all([x.id for x in self.library.model.tokenize(t.removesuffix(end))] == [own[t]] for t in marked if t != end)
        return fits and all([id_of[k] for k in self.core.encode_single_piece(b)] == [i] for b, i in ids.items() if self.MARK not in b[:-1])

    def _merged(self, piece: str) -> bytes:
        return b"".join([self.bytes_of[k] for k in self.core.encode_single_piece(piece.encode() + self.MARK)])

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._whole(text)
        if any(x in text for x in self.special) or not _EASY.fullmatch(text):
            return b"".join([self._stretch(x) for x in _SPACES.findall(text)])
        return b"".join(map(self.easy.__getitem__, _PARTS.findall(text.lower())))

    def _stretch(self, text: str) -> bytes:
        """Ids of a text without ASCII white space."""
        if any(x in text for x in self.special) or not _EASY.fullmatch(text):
            return self.hard[text]
        return b"".join(map(self.easy.__getitem__, _PARTS.findall(text.lower())))


@lru_cache(maxsize=2)
def word_coder(path: str) -> WordCoder:
    """One a Python worker. The file must lie at this path on every executor."""
    return WordCoder(path)

"""Reads the vocabulary file of a public tokenizer; its path is always a parameter."""

import json
import unicodedata
from dataclasses import dataclass

import regex

# The white space of \s in these files' patterns.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The separators FS, GS, RS, US, which str.split takes for white space and the patterns do not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(free)) for b in range(256)]


@dataclass
class Vocabulary:
    ids: dict[str, int]
    merges: dict[tuple[int, int], tuple[int, int]]
    special: dict[str, int]
    suffix: str
    normalizers: list[str]
    pattern: str
    joined: bool

    def tokens(self) -> dict[int, str]:
        return {i: t for t, i in (*self.ids.items(), *self.special.items())}


def read_vocabulary(path: str) -> Vocabulary:
    """The parts of a tokenizer file; a file with parts this package does not know is refused."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model = whole["model"]
    asked = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix")]
    if model["type"] != "BPE" or any(asked) or model.get("ignore_merges") or whole.get("post_processor"):
        raise ValueError(f"{path}: this model is not known here")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in whole["added_tokens"]):
        raise ValueError(f"{path}: added tokens that strip or normalize are not known here")
    steps = whole["normalizer"] or {"type": "Sequence", "normalizers": []}
    steps = steps["normalizers"] if steps["type"] == "Sequence" else [steps]
    split = whole["pre_tokenizer"]
    parts = split["pretokenizers"] if split["type"] == "Sequence" else [split]
    patterns = [p["pattern"]["Regex"] for p in parts if p["type"] == "Split"]
    ids = model["vocab"]
    suffix = model.get("end_of_word_suffix") or ""
    merges: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merges.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
    return Vocabulary(
        ids,
        merges,
        {t["content"]: t["id"] for t in whole["added_tokens"]},
        suffix,
        [s["type"] for s in steps],
        spaced(patterns[0] if patterns else BYTE_PATTERN),
        whole["decoder"] is not None,
    )


# Fixed: the split of byte-level files that name no pattern of their own.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def spaced(pattern: str) -> str:
    """The pattern with \\s and \\S written out, so that they do not depend on the library."""
    return pattern.replace("[^\\s", f"[^{SPACE}").replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]")


def special_pattern(special: dict[str, int]):
    return regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")


def lowered(text: str) -> str:
    """Lower case character by character, without the rule for a final sigma."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


def composed(text: str) -> str:
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)

"""Phrase search on one page: the pattern of a phrase, the text it is searched in, and a skeleton that both must share."""

from __future__ import annotations

import re
import unicodedata

#: What a search takes for plain marks, and what may stand between two words.
SEARCHED = str.maketrans({"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "\u00a0": " ", "·": " ", "•": " ", "|": " "})
#: What relaxed containment takes for plain marks.
RELAXED = str.maketrans({"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "‑": "-"})
BREAKS = r"(?:[ \t]+|[ \t]*\n[ \t]*|[ \t]*\n[ \t]*\n[ \t]*)"  # spaces or up to two line breaks
BRIDGE = r"(?:\d{1,8}[ \t]*)?"  # one number of up to 8 digits
BREAK = re.compile(r"[ \t]*\n[ \t]*(?:\n[ \t]*)?|[ \t]+")
JOIN = r"['\"]*" + BREAKS + BRIDGE + r"['\"]*"
#: What a pattern may skip, and letters that ignoring case takes for ASCII ones.
SKIPPED = b"0123456789'\" \t\n\r\f\v\x1c\x1d\x1e\x1f"
FOLDED = str.maketrans("İıſ\u212a", "iisk")


def replaced(text: str, table: dict[int, str]) -> str:
    """text.translate(table) for a small table of other characters, many times faster: what isn't there costs one scan."""
    for code, by in table.items():
        text = text.replace(chr(code), by if isinstance(by, str) else chr(by))
    return text


def search_text(text: str) -> str:
    """NFKC with plain line ends, quotes and dashes; bullets and bars are spaces."""
    return replaced(unicodedata.normalize("NFKC", text.replace("\r\n", "\n").replace("\r", "\n")), SEARCHED)


def search_phrase(phrase: str) -> str:
    return unicodedata.normalize("NFKC", phrase.strip()).translate(SEARCHED)


#: Each kind of thing in a phrase and what a page may have in its place; {} is the thing itself.
PLACES = {
    "gap": (r"\s+", JOIN),
    "hyphen": ("-", r"\-(?:[ ]*\n[ ]*)?"),
    "mark": ("['\"]", r"['\"]"),
    "inner": (r"[^\W_](?=[^\W_])", "{}[ ]*"),  # spaces may split a word
    "other": (r"[\s\S]", "{}"),
}
PLACE = re.compile("|".join(f"(?P<{kind}>{there})" for kind, (there, _) in PLACES.items()))


def pattern(phrase: str, whole_words: bool) -> re.Pattern:
    """Of a phrase as search_phrase gives it; whole_words: no letter or digit stands before or after."""
    p = PLACE.sub(lambda m: PLACES[m.lastgroup][1].replace("{}", re.escape(m[0])), phrase.strip())
    return re.compile(rf"(?<![^\W_]){p}(?![^\W_])" if whole_words else p, re.IGNORECASE | re.DOTALL)


def skeleton(text: str) -> bytes:
    """The ASCII characters that a match can't skip, in lower case: where a pattern matches, its phrase's skeleton stands in the text's."""
    return replaced(text, FOLDED).encode("ascii", "ignore").translate(None, SKIPPED).lower()


def spaced(text: str) -> str:
    """A page's text with each break that a pattern's gap may be as one space: what of a phrase with single spaces stands here, its pattern finds."""
    return BREAK.sub(" ", text)


def relaxed(text: str) -> str:
    """Case folded, with plain quotes and dashes, white space runs as single spaces."""
    return re.sub(r"\s+", " ", text.translate(RELAXED).casefold())

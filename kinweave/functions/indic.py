"""ITRANS romanisation of the nine Indic blocks U+0900 to U+0D7F.

The blocks are laid out alike, 128 code points each, so one table by offset serves all of them.
"""

from __future__ import annotations

import re

# Offsets of independent vowels, vowel signs, consonants and signs within a block, and their ITRANS letters.
VOWELS = {0x05: "a", 0x06: "A", 0x07: "i", 0x08: "I", 0x09: "u", 0x0A: "U", 0x0B: "RRi", 0x0C: "LLi", 0x0D: "e", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au", 0x60: "RRI", 0x61: "LLI"}
SIGNS = {0x3E: "A", 0x3F: "i", 0x40: "I", 0x41: "u", 0x42: "U", 0x43: "RRi", 0x44: "RRI", 0x45: "e", 0x46: "e", 0x47: "e", 0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x62: "LLi", 0x63: "LLI"}
CONSONANTS = dict(zip(range(0x15, 0x3A), ["k", "kh", "g", "gh", "~N", "ch", "Ch", "j", "jh", "~n", "T", "Th", "D", "Dh", "N", "t", "th", "d", "dh", "n", "n", "p", "ph", "b", "bh", "m", "y", "r", "R", "l", "L", "L", "v", "sh", "Sh", "s", "h"], strict=True))
NUKTA = {"k": "q", "kh": "K", "g": "G", "j": "z", "D": ".D", "Dh": ".Dh", "ph": "f", "y": "Y"}
COMPOSED = {0x58: "q", 0x59: "K", 0x5A: "G", 0x5B: "z", 0x5C: ".D", 0x5D: ".Dh", 0x5E: "f", 0x5F: "Y"}
MARKS = {0x01: ".N", 0x02: "M", 0x03: "H", 0x3D: ".a", 0x50: "OM", 0x64: ".", 0x65: ".."}
VIRAMA, NUKTA_SIGN = 0x4D, 0x3C
# Letters of one block alone, by code point: consonants, the nasal sign and the doubling sign of Gurmukhi, and
# consonants without a vowel.
OWN_CONSONANTS = {0x9F0: "r", 0x9F1: "v"}
TIPPI, ADDAK = 0xA70, 0xA71
BARE = {0x9CE: "t", 0xD7A: "N", 0xD7B: "n", 0xD7C: "r", 0xD7D: "l", 0xD7E: "L", 0xD7F: "k"}

RUN = re.compile("[ऀ-ൿ‌‍]+")
JOINERS = str.maketrans("", "", "‌‍")
SCHWA = re.compile(r"(?<=[^aeiouAEIOU\s])a\b")


def romanise(run: str) -> str:
    """One run in ITRANS: a consonant keeps its inherent a unless a vowel sign or virama follows."""
    out: list[str] = []
    inherent = double = False  # whether the last consonant still has its a to come, whether the next one is doubled
    base = (ord(run[0]) - 0x900) // 0x80
    for ch in run:
        code = ord(ch)
        if (code - 0x900) // 0x80 != base:  # the run's script is that of its first character
            out.append("a" * inherent + ch)
            inherent = double = False
            continue
        at = (code - 0x900) % 0x80
        if at == VIRAMA:
            inherent = False
        elif at in SIGNS:
            out.append(SIGNS[at])
            inherent = False
        elif at == NUKTA_SIGN and out and out[-1] in NUKTA:
            out[-1] = NUKTA[out[-1]]
        else:
            if inherent:
                out.append("a")
            consonant = CONSONANTS.get(at) or COMPOSED.get(at) or OWN_CONSONANTS.get(code)
            inherent = consonant is not None
            if code == ADDAK:
                double = True
            elif consonant is not None:
                out.append(consonant[: consonant[0].isalpha()] * double + consonant)
                double = False
            elif 0x66 <= at <= 0x6F:
                out.append(str(at - 0x66))
            else:
                out.append("M" if code == TIPPI else VOWELS.get(at) or MARKS.get(at) or BARE.get(code) or ("" if at == NUKTA_SIGN else ch))
    return "".join(out) + "a" * inherent


def transliterate_text(text: str) -> str:
    """Every Indic run romanised, without a final schwa, nasals as n."""

    def of(match: re.Match) -> str:
        run = match[0].translate(JOINERS)
        if not run:
            return run
        roman = SCHWA.sub("", romanise(run))
        for sign, plain in (("~N", "n"), (".N", "n"), ("M", "n"), ("JN", "gy")):
            roman = roman.replace(sign, plain)
        return roman

    return RUN.sub(of, text)

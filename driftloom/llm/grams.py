"""Character n-grams of whole texts as small integers, vectorised."""

from __future__ import annotations

import numpy as np

BITS = 6
#: Code points with a code of their own table entry; others share codes by hash.
PLANE = 0x3000


def letter_codes() -> np.ndarray:
    """Code of a code point: 0 for what is no letter, 1-26 for a-z in either case, 27-63 shared by all other letters."""
    codes = np.zeros(0x110000, dtype=np.uint32)
    for cp in range(PLANE):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()[0]
            codes[cp] = ord(low) - 96 if "a" <= low <= "z" else 27 + (ord(low) * 40503 >> 4) % 37
    for cp in range(PLANE, 0x110000):
        if not 0xD800 <= cp < 0xE000 and chr(cp).isalpha():
            codes[cp] = 27 + (cp * 40503 >> 4) % 37
    return codes


def shape_codes() -> np.ndarray:
    """Code of a code point by look: lower 1, upper 2, digit 3, blank 4, line break 5, other 6, each ASCII mark one of 8-40."""
    codes = np.full(0x110000, 6, dtype=np.uint32)
    for cp in range(PLANE):
        ch = chr(cp)
        codes[cp] = 1 if ch.isalpha() and not ch.isupper() else 2 if ch.isalpha() else 3 if ch.isdigit() else 5 if ch in "\n\r" else 4 if ch.isspace() else 6
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    codes[marks] = np.arange(8, 8 + len(marks))
    return codes


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def trigrams(codes: np.ndarray) -> np.ndarray:
    """For each place the codes of it and of the two before it, as one number; blanks (0) stand before the text."""
    out = codes.copy()
    out[1:] |= codes[:-1] << np.uint32(BITS)
    out[2:] |= codes[:-2] << np.uint32(2 * BITS)
    return out


#: Codes of the letters of all scripts, and places of the hashed grams of one, two and three of them.
WIDE_BITS, GRAM_BITS = 12, (12, 16, 18)


def wide_codes() -> np.ndarray:
    """Code of a code point: 0 for what is no letter, 1-26 for a-z in either case, other letters hashed over the rest of 12 bits."""
    codes = np.zeros(0x110000, dtype=np.uint16)
    for cp in (*range(0xD800), *range(0xE000, 0x110000)):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()[0]
            codes[cp] = ord(low) - 96 if "a" <= low <= "z" else 27 + (ord(low) * 2654435761 >> 7) % ((1 << WIDE_BITS) - 27)
    return codes


def letter_grams(codes: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed places of the grams of one, two and three letters that end at each place but the first `skip`.

    Blanks (0) stand before the text; places where it and the one before are blank are left out.
    """
    c = codes.astype(np.uint64)
    two, three = c.copy(), c.copy()
    two[1:] |= c[:-1] << np.uint64(WIDE_BITS)
    three[1:] = two[1:]
    three[2:] |= c[:-2] << np.uint64(2 * WIDE_BITS)
    some = np.flatnonzero(two[skip:]) + skip
    place = lambda g, bits: (g * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)
    return c[some].astype(np.int64), place(two[some], GRAM_BITS[1]), place(three[some], GRAM_BITS[2])

"""Characters that look alike, are invisible or are blanks."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

#: Letters of different scripts with one glyph. In each group the first is the form taken where nothing else decides.
LOOKALIKES = (
    "aа", "cс", "dԁ", "eе", "hһ", "iі", "jј", "oоο", "pр", "qԛ", "sѕ", "vν", "wԝ", "xх", "yу",
    "AАΑ", "BВΒ", "CС", "EЕΕ", "HНΗ", "IІΙ", "JЈ", "KКΚ", "MМΜ", "NΝ", "OОΟ", "PРΡ", "SЅ", "TТΤ", "XХΧ", "YΥ", "ZΖ",
)

#: Kinds of compatibility decompositions that keep the look.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")

#: Hyphens with the look of the ordinary one.
HYPHENS = "‐‑﹣－"

#: Invisible characters that are not in the category of format characters.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"


@cache
def look_table() -> dict[int, str | None]:
    """What each character of unusual form is replaced by: its usual form, or nothing if it is invisible.

    Derived from the Unicode data: compatibility forms of the same look, every kind of one-character blank as a space,
    and every line end as a line feed. Forms that spell a mark in other marks (an ellipsis, a spacing accent) stay.
    """
    out: dict[int, str | None] = {}
    for o in range(0x7F, sys.maxunicode + 1):
        if 0xAC00 <= o <= 0xD7A3 or 0x20000 <= o <= 0xE0000:
            continue
        ch = chr(o)
        cat = unicodedata.category(ch)
        if cat in ("Cf", "Cc") and ch != "\x85" or ch in INVISIBLE or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF:
            out[o] = None
        elif cat == "Zs":
            out[o] = " "
        elif ch in HYPHENS:
            out[o] = "-"
        elif unicodedata.decomposition(ch).split(" ")[0] in SAME_LOOK:
            to = unicodedata.normalize("NFKC", ch)
            if any(c.isalnum() for c in to) or len(to) == 1 and to != " ":
                out[o] = "".join(c for c in to if unicodedata.category(c) != "Cf")
    for o in (0x85, 0x2028, 0x2029):
        out[o] = "\n"
    out |= {o: None for o in range(0x20) if o not in (9, 10, 13)} | {9: " "}
    return out


@cache
def odd() -> re.Pattern:
    """Finds a character of look_table."""
    spans: list[list[int]] = []
    for o in sorted(look_table()):
        if spans and spans[-1][1] == o - 1:
            spans[-1][1] = o
        else:
            spans.append([o, o])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")


def usual(text: str) -> str:
    """The text in composed form without invisible characters, every blank a space, every unusual form the usual one."""
    if odd().search(text):
        text = text.translate(look_table())
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return text

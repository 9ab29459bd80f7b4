"""One consistent form for text that looks the same but differs in its characters."""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts that are drawn like a Latin letter.
CYRILLIC = dict(zip("асеорхуіѕјһԁԛԝАВЕКМНОРСТХУІЅЈԌ", "aceopxyisjhdqwABEKMHOPCTXYISJG", strict=True))
GREEK = dict(zip("οανυρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavupABEZHIKMNOPTYX", strict=True))
OTHER = {"ı": "i", "ɑ": "a", "ɡ": "g", "ԍ": "g", "ո": "n", "օ": "o", "ѵ": "v", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "ѡ": "w", "ꓳ": "O", "Ꭺ": "A", "Ꭼ": "E", "Ꮋ": "H", "Ꮇ": "M", "Ꭲ": "T", "Ꮲ": "P"}
LOOKALIKES = str.maketrans(CYRILLIC | GREEK | OTHER)
_BORROWED = re.compile("[" + "".join(map(chr, LOOKALIKES)) + "]")

INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e007f\U000e0100-\U000e01ef]")
BLANKS = re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
HYPHENS = re.compile("[\u2010\u2011\u2043\u207b\u208b\u2212\ufe63\uff0d]")  # hyphens and minus signs; dashes are other punctuation
_PLAIN = re.compile(r"[\n\r\t -~]*\Z")


def skeleton(text: str | None) -> str | None:
    """Look-alike-mapped form: equal for two texts exactly when a reader sees the same.

    Compatibility forms, composition, invisible characters, kinds of blank and
    of hyphen and borrowed letters go; case, accents, digits, punctuation, line
    breaks and the number of blanks stay.  Null stays null, "" stays "".
    """
    if text is None or _PLAIN.match(text):
        return text
    text = HYPHENS.sub("-", INVISIBLE.sub("", text))
    text = unicodedata.normalize("NFKC", BLANKS.sub(" ", text))
    text = HYPHENS.sub("-", INVISIBLE.sub("", text))
    return text.translate(LOOKALIKES) if _BORROWED.search(text) else text

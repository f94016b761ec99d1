"""Problem 5: text decoded with the wrong character encoding (round-trip repair).

A garbled passage is re-encoded under a candidate legacy encoding and strictly decoded as the
encoding that was meant; a step is kept when the garbling cost of the text drops, and steps are
repeated for nested layers.  Two families of damage are tried:

* UTF-8 bytes read as a single-byte encoding.  A UTF-8 sequence has a lead byte and a known number
  of continuation bytes, so the images of such sequences are found by one pattern per encoding,
  and a text that is garbled only in part is repaired only in that part.
* single-byte text read as another single-byte encoding ("caf\u00da").  The image is word by word.

Bytes that a cleaner turned into blanks (C1 controls, no-break space) and U+FFFD are lost; such
text is reported as garbled, and is restored only where one reading is possible.

Null -> (null, 0, null).  Blank text -> (text, 0, null).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from corpusloom.llm import forms

# Single-byte encodings in which UTF-8 is commonly misread, in order of preference.
UTF8_READ_AS = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1251", "koi8_r", "cp1250")

# Fixed values: (read as, meant) for single-byte text read as another single-byte encoding.
BYTE_READ_AS = (
    ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1251", "cp1252"), ("koi8_r", "cp1252"),
    ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"),
)
# The same for Cyrillic text that is still Cyrillic when misread.
CYRILLIC_READ_AS = (("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("iso8859_5", "cp1251"), ("cp1251", "iso8859_5"))
# Russian letters from the most to the least frequent.
CYRILLIC_LETTERS = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
#: Letters that a text must have for its Cyrillic words to be judged.
LEAST_CYRILLIC = 8
#: How far the mean cost of a letter must drop.
CYRILLIC_DROP = 1.5

# Letters that the supported Latin-script languages write besides a-z.
ACCENTED = "áàâãäçéèêëíìîïñóòôõöúùûüßœæ"
# Signs that stand in ordinary text in these languages.
PLAIN_SIGNS = "“”‘’«»„‚…–—•™€£§°ªº¡¿·×÷©®"


def _byte_image(enc: str) -> dict[int, str]:
    """The character that each byte from 0x80 becomes; undefined bytes become C1 controls, as browsers do."""
    return {b: bytes([b]).decode(enc, "ignore") or chr(b) for b in range(0x80, 0x100)}


@lru_cache(None)
def _tables(enc: str) -> tuple[dict[str, int], re.Pattern]:
    img = _byte_image(enc)
    cls = lambda lo, hi: "[" + "".join(re.escape(img[b]) for b in range(lo, hi + 1)) + "]"
    cont = cls(0x80, 0xBF)
    pattern = f"(?:{cls(0xC2, 0xDF)}{cont}|{cls(0xE0, 0xEF)}{cont}{{2}}|{cls(0xF0, 0xF4)}{cont}{{3}})+"
    return {c: b for b, c in img.items()}, re.compile(pattern)


def _odd(c: str, before: str, after: str) -> float:
    """Cost of one non-ASCII character between its neighbours."""
    if c == "\ufffd" or "\x80" <= c <= "\x9f" or "\ue000" <= c <= "\uf8ff":
        return 3
    kind = unicodedata.category(c)
    if kind[0] == "L":
        low = c.lower()
        if "\u0400" <= c <= "\u052f" or "\u0370" <= c <= "\u03ff":
            mixed = any("a" <= x.lower() <= "z" or "\u00c0" <= x <= "\u024f" for x in (before, after))
            rare = not ("\u0410" <= c <= "\u044f" or c in "ёЁ") and c > "\u0400"
            return (2 if mixed else 0.2) + (1.5 if rare else 0)
        if low in ACCENTED:
            inner = before.islower() and before.isalpha() and c.isupper()
            return 1.6 if inner else 1.2 if c in "Ãã" and not after.isalpha() and c == "Ã" and not before.isupper() else 0.6
        if c < "\u0250":
            return 2
        return 0.4 if c >= "\u3040" else 1.5
    if kind[0] == "M":
        return 0.3 if c == "\ufe0f" else 2
    if c in PLAIN_SIGNS:
        joined = before.isalpha() and after.isalpha() and c not in "’"
        return 1.8 if joined or (c in "ªº©§£¢¤¥¨¬¯°±´µ¶·¸¹" and before.isalpha()) else 1
    if c >= "\u2600":
        return 0.3
    return 2


def cost(text: str) -> float:
    """Garbling cost: how much the characters of a text look like misread bytes.  ASCII costs nothing."""
    if text.isascii():
        return 0.0
    padded = f" {text} "
    return sum(_odd(padded[i], padded[i - 1], padded[i + 1]) for i in range(1, len(padded) - 1) if padded[i] > "\x7f")


def _meant(c: str) -> bool:
    """Whether a decoded character is one that people write in the supported languages."""
    return (
        c.lower() in ACCENTED or c in PLAIN_SIGNS or c <= "\u00bf" or "\u0400" <= c <= "\u045f" or "\u2010" <= c <= "\u206f" or "\u0391" <= c <= "\u03c9"
        or "\u20a0" <= c <= "\u20bf" or "\u2190" <= c <= "\u27bf" or "\u3000" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" or c == "\ufe0f"
        or "\uff01" <= c <= "\uff5e" or c >= "\U0001f000" or c in "ŸŒ™"
    )


def _undo_utf8(text: str, enc: str) -> str:
    back, pattern = _tables(enc)

    def one(m: re.Match) -> str:
        try:
            out = bytes(back[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]
        if not all(map(_meant, out)):  # what a nested layer looks like halfway
            out = _undo_utf8(out, enc)
        return out if all(map(_meant, out)) and cost(out) < cost(m[0]) and not _is_look_alike(m) else m[0]

    return pattern.sub(one, text)


def _is_look_alike(m: re.Match) -> bool:
    """Whether the match and the word that it stands in are Latin letters and look-alikes of such, which are problem 4's."""
    if any(c > "\x7f" and c not in _LOOKALIKE for c in m[0]):
        return False
    before, after = _WORD_END.search(m.string, 0, m.start()), _WORD_START.match(m.string, m.end())
    return all(c <= "\x7f" or c in _LOOKALIKE or "\uff01" <= c <= "\uff5e" for c in before[0] + after[0])


_WORD_END, _WORD_START = re.compile(r"[^\W\d_]*$"), re.compile(r"[^\W\d_]*")


# In these the lead of a sequence is followed by a blank that was a C1 control or a no-break space.
_LOST_DOUBLE = re.compile("Ã Â(?=[\u00a0-\u00bf\u00ad])")  # C3 83 C2 xx: the middle byte is known
_LOST_QUOTE = re.compile("â€(?:(?=[.,!?)])| |$)")
_LOST = re.compile(
    "(?<!\\w)Ã(?=[\\s.,;:!?Â]|$)|(?<=[a-zà-ÿ])Ã(?=[\\s.,;:!?)Â]|$)|Ã(?=\\s?Â)|Ã(?=[\u0080-\u00bf€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–˜™š›œŸ])"
    "|(?<![A-ZÀ-Þ])Â(?![A-Za-zÀ-ÿΑ-ωА-яＡ-ｚ])"
    "|â(?=[ ]|$)(?<!\\w\\wâ)|(?<=[a-z])â(?=[\\s.,;:!?)]|$)|â(?=[\u0080-\u00bf€™œž“”‚„…†‡ˆ‰])"
    "|ð(?![a-zæöáéíóúý])|[ÐÑ](?=[\u0080-\u00bf ]?[ÐÑ])"
    "|[├┬┼╔╚╠═│┤┴┐└┘║╗╝╩╦╬](?=\\w)|(?<=\\w)[├┬┼╔╚╠═│┤┴┐└┘║╗╝╩╦╬]"
    "|[\u0080-\u0084\u0086-\u009f\ufffd\uf8ff]"
    "|(?<![А-Яа-яЁё])[ГВ](?= )(?<![А-Яа-яЁё] [ГВ])(?! [А-Яа-яЁё])|(?<=[a-z])Г"
    "|√(?=\\w)|(?<=\\w)√|(?<= )¿(?= )"
)

_RESTORE_A = re.compile("(?<=\\s)Ã (?=[a-z])|^Ã (?=[a-z])")

# A letter that is upper case only because its byte was misread stands after a lower-case letter.
_MIXED_CASE = re.compile("[a-z]{2}[A-Z][a-z]|\\b[a-z][A-Z]|[A-Z][a-z][A-Z]")
_WORD = re.compile("[^\\s.,;:!?()\"<>|/“”]+")

# Non-ASCII text that cannot be garbled: ordinary letters in ordinary places, other scripts, emoji.
_SUSPECT = re.compile(
    "[^\\x00-\\x7fáàâãäçéèêëíìîïñóòôõöúùûüßœæÁÀÂÄÇÉÈÊËÍÌÎÏÑÓÒÔÕÖÚÙÛÜªº“”‘’—–…™\u0300-\u036f\u0410-\u044fёЁ\u2000-\u200f\u2028-\u202f\u2060\ufeff"
    "\u2600-\u27bf\u3000-\u30ff\u4e00-\u9fff\uff00-\uffef\ufe0f\U0001f000-\U0001faff]"
    "|[a-zà-ÿ][ÁÀÂÄÇÉÈÊËÍÌÎÏÑÓÒÔÕÖÚÙÛÜ]|(?<![A-ZÀ-Þ])[ÂÔ](?![A-Za-zÀ-ÿ])|ß[a-z]{0,3}o\\b|\\b[a-z]?[ßÚÛÒÌÙ]\\b|\\b[ÌÙÛÒ]|[a-zA-Z][бгзйкнуфхъвыэю]|â[ \\s.,;!?)]|â$|[a-zÀ-ÿ][„‚‡·˙…†‹›ˆ˜][a-z]?|Dß|[\u0080-\u009f]|[ªº“”‘’—–…™][\u0080-\u00ff]|(?<![A-ZÀ-Þ])[ÁÀÂÇÉÈÊÍÓÔÕÚ][«»]|[çãâ][\u0080-\u00bf]"
    "|[ãäåæçèé][ \u0080-\u00bf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{2}|ã"
    "(?![oõeses])[^\\w\\s.,;:!?)(\"'”’—-]"
    "|(?<![^ ])[¿ГВ](?= )|Ãƒ|[A-Z]Ò[a-z]"
)


def cyrillic_cost(words: list[str]) -> float:
    """Mean cost of a letter: its place in the order of frequency, and a fine for an upper-case letter after a lower-case one or a word that only its first letter leaves in lower case."""
    total = n = 0
    for w in words:
        for before, c in zip(" " + w, w):
            at = CYRILLIC_LETTERS.find(c.lower())
            total += (at if at >= 0 else 40) + 12 * (c.isupper() and before.islower())
            n += 1
    return total / n if n else 0.0


def _undo_cyrillic(text: str) -> tuple[str, int]:
    """Undo one misreading between Cyrillic encodings in all words without Latin letters; returns the text and how many words changed."""
    words = [w for w in _WORD.findall(text) if _CYRILLIC.search(w) and not _LATIN.search(w) and not all(c in _LOOKALIKE for c in w if c > "\x7f")]
    if sum(map(len, words)) < LEAST_CYRILLIC or not any(c.isupper() or c in "ёЁ" or not "\u0410" <= c <= "\u044f" for w in words for c in w[1:]):
        return text, 0
    best, pair = cyrillic_cost(words) - CYRILLIC_DROP, None
    for wrong, meant in CYRILLIC_READ_AS:
        try:
            out = [w.encode(wrong).decode(meant) for w in words]
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        if all("\u0410" <= c <= "\u044f" or c in "ёЁ" or c <= "\x7f" for w in out for c in w) and (c := cyrillic_cost(out)) < best:
            best, pair = c, (wrong, meant)
    if pair is None:
        return text, 0
    own = frozenset(words)
    return _WORD.sub(lambda m: m[0].encode(pair[0]).decode(pair[1]) if m[0] in own else m[0], text), len(words)


_CYRILLIC, _LATIN = re.compile("[\u0400-\u045f]"), re.compile("[A-Za-z\u00c0-\u024f]")


def _spongy(text: str) -> bool:
    """Whether the letter case of a text is random; then the case of a letter tells nothing."""
    return len(_MIXED_CASE.findall(re.sub("[^\\x00-\\x7f]", " ", text))) >= 2


def _undo_bytes(text: str) -> tuple[str, int]:
    """Undo one single-byte misreading, word by word; returns the text and how many characters changed."""
    spongy = _spongy(text)
    best: tuple[float, str, int] = (0.0, text, 0)
    for wrong, meant in BYTE_READ_AS:
        changed, gain = 0, 0.0

        def one(m: re.Match) -> str:
            nonlocal changed, gain
            w = m[0]
            if w.isascii():
                return w
            try:
                out = w.encode(wrong).decode(meant)
            except (UnicodeEncodeError, UnicodeDecodeError):
                return w
            if all(c in _LOOKALIKE for c in w if c > "\u036f" and c.isalpha()) and any(c > "\u036f" and c.isalpha() for c in w):
                return w
            if meant in ("cp1251", "koi8_r") and (len(w) < 4 or not w.isalpha()):
                return w
            if not _fits(out) or spongy and out.lower() != out and _fits(w.lower()):
                return w
            a, b = _word_cost(w, spongy), _word_cost(out, spongy)
            if a - b > 0.75:
                changed += sum(x != y for x, y in zip(w, out))
                gain += a - b
                return out
            return w

        new = _WORD.sub(one, text)
        if gain > best[0]:
            best = (gain, new, changed)
    return best[1], best[2]


def _fits(word: str) -> bool:
    """Whether a word is written only with letters of one script, as repaired words are."""
    letters = [c for c in word if c > "\x7f"]
    if any("\u0410" <= c <= "\u044f" or c in "ёЁ" for c in letters):
        return not any("a" <= c.lower() <= "z" for c in word) and all("\u0400" <= c <= "\u045f" for c in letters)
    return all(c.lower() in ACCENTED and not (c.isupper() and any(x.islower() for x in word[: word.index(c)])) for c in letters)


def _word_cost(word: str, spongy: bool) -> float:
    total, n = 0.0, len(word)
    for i, c in enumerate(word):
        if c <= "\x7f":
            continue
        low, before, after = c.lower(), word[i - 1] if i else " ", word[i + 1] if i + 1 < n else " "
        if low in "áâãçéêíóôõúàñüäöèìòùëïîû":
            inner = c.isupper() and before.islower() and not spongy
            # these graves end a word where they are written at all
            grave = 1.1 if low in "ìòù" and after.isalpha() else 0.3 if low in "èìòùëîû" else 0.0
            total += 1.7 if inner else 0.8 if c.isupper() and after.islower() and i and not spongy else 0.5 + grave
        elif low == "ß":
            total += 0.5 if i and before in "aeiouäöüAEIOU" and (after in "ebtigls " and after != "o") and n > 2 and not word.endswith("ßo") else 1.6
        elif c in "“”‘’—–™…" and (i == 0 or i == n - 1) or c in "£€¥¢" and (before.isdigit() or after.isdigit()) or c in "¿¡" and i == 0:
            total += 0.4
        elif "\u0400" <= c <= "\u052f" or "\u0370" <= c <= "\u03ff":
            total += 0.5 if all(not ("a" <= x.lower() <= "z") for x in (before, after)) else 1.8
        elif c >= "\u2600" or c in "\u200d\u200c\u200b\u200e\u200f\u2060\ufeff\u00ad" or unicodedata.category(c) in ("Mn", "Zs", "Cf"):
            total += 0.5
        else:
            total += 1.8
    return total


# Signs that stand inside or at the end of a garbled word but never there in ordinary text, or letters no supported language has.
_BYTE_MARKS = re.compile(
    "[A-Z]Ò[a-z]|[a-zà-ÿ][ÁÀÂÄÇÉÈÊËÍÌÎÏÑÓÒÔÕÖÚÙÛÜÝÞÐ]|[þÞýÝð¾¶±˙ı]|\\b[ÒÛÌÙ]|[a-zA-Z][„·‡‚…†ˆ˜¸´§ß‹›¢£¥¬≤⌠⌡][a-z ,.!?]|[a-z][„·‡‚†ˆ˜¸´§‹›¢£¥¬≤⌠⌡]|[·„‡ß´§¾¢][a-z]|\\bß|Dß|\\b[a-z]ß\\b|[ΘΩΦτπφσδ≤≥][a-z]|[a-z][ΘΩΦτπφσδ≤≥]"
    "|[a-z][бгзйкнуфхъвцчшщьюяыэжилпдт]|[бгзйкнуфъвцчшщьюяыэжилпдт][a-z]|[ÁÈÍÏÓÔ][a-z]|Ž|Æ[a-z]|[a-z]Æ|[a-z][ƒŸÿ]"
)

# A Latin letter beside a look-alike of another script is problem 4's, not a misread byte.
_LOOKALIKE = frozenset(c for c in forms.LOOK_ALIKE if "\u0370" <= c <= "\u052f")


# Plain signs beside letters that are images of UTF-8 bytes.
_JOINED = re.compile("[a-zà-ÿ]œ|[“”‘’—™][à-ÿ]|[à-ÿ][“”‘’—™][^\\s.,;:!?)]")


def _ends_word(text: str, i: int) -> bool:
    """Whether the letter at i ends a word in ordinary text: after an upper-case letter, or in a text of random case."""
    return i > 0 and (text[i - 1].isupper() or text[i - 1].isalpha() and _spongy(text))


# Ordinary text of the Latin-script languages; most texts go no further.
_SOUND = re.compile("[\x00-\x7fáàãäçéèêëíìîïñóòôõöúùûüœ“”‘’—™]*")


def repair(text: str | None) -> tuple[str | None, int, str | None]:
    """(repaired text, number of garbled places, how): how is null if the text is sound, 'repaired' or 'lost'."""
    if text is None or text.isascii() or _SOUND.fullmatch(text) and not _JOINED.search(text):
        return text, 0, None
    if _CYRILLIC.search(text):
        out, n = _undo_cyrillic(text)
        if n:
            return out, n, "repaired"
    if not _SUSPECT.search(text):
        return text, 0, None
    now, places, how = text, 0, None
    for _ in range(4):  # nested layers
        step = _LOST_QUOTE.sub("”", _LOST_DOUBLE.sub("Ã\u0083Â", now))
        best, best_cost = step, cost(step)
        for enc in UTF8_READ_AS:
            out = _undo_utf8(step, enc)
            if out != step and (c := cost(out)) < best_cost - 0.3:
                best, best_cost = out, c
        if best == now:
            break
        places += max(1, abs(len(now) - len(best)))
        now, how = best, "repaired"
    if _BYTE_MARKS.search(now):
        out, n = _undo_bytes(now)
        if n:
            now, places, how = out, places + n, "repaired"
    restored = _RESTORE_A.sub("à ", now) if "Ã " in now else now
    if restored != now:
        places, now, how = places + 1, restored, "repaired"
    lost = [m for m in _LOST.finditer(now) if not (m[0] in "Ãâ" and m.end() < len(now) + 1 and _ends_word(now, m.start()))]
    if lost:
        places, how = places + len(lost), "lost"
    return now, places, how

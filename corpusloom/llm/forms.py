"""Problem 4: text that looks the same but is written with different characters (confusables skeleton).

skeleton(text): decompose, replace every character by its prototype, decompose again; texts that
look the same have equal skeletons.  plain(text) is the readable form: each character whose prototype is
another one is a candidate; it is replaced by the letter of that prototype which its word's script calls
for, unless it is at home where it stands.  Invisible characters go, every space becomes the plain one, and
letters are composed.  A form is accepted only if its skeleton is that of the text.

The prototypes are Unicode's table of confusable characters, read from the data of the ICU library that is
part of every Spark distribution; wide, font and ligature forms decompose by Unicode's own data.
Null -> null, blank -> itself.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import unicodedata
import zipfile
from functools import lru_cache

# Letters that Unicode's table does not hold for Latin ones, or holds for rarer ones.
MORE_ALIKE = {"ӏ": "l", "κ": "k", "τ": "t", "η": "n", "ω": "w", "ε": "e", "Ԁ": "D", "Ԛ": "Q", "Һ": "H", "յ": "j", "Լ": "L", "ʋ": "v"}


def confusables_file() -> bytes:
    """The table of confusable characters from the ICU library beside Spark's own."""
    import pyspark

    homes = [os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)]
    for jar in (j for h in homes if h for j in sorted(glob.glob(os.path.join(h, "jars", "icu4j-*.jar")))):
        with zipfile.ZipFile(jar) as z:
            for name in z.namelist():
                if name.endswith("/confusables.cfu"):
                    return z.read(name)
    raise FileNotFoundError("no icu4j library among Spark's jars")


def read_confusables(raw: bytes) -> dict[str, str]:
    """Prototypes by character.  A key holds a code point and, above it, the length less one; its value is the prototype's one unit or the place of its string."""
    start, byte_order = struct.unpack(">H", raw[:2])[0], ">" if raw[8] else "<"
    body = raw[start:]
    _, _, _, keys_at, n, values_at, _, text_at, n_text = struct.unpack(f"{byte_order}9I", body[:36])
    keys = struct.unpack_from(f"{byte_order}{n}I", body, keys_at)
    values = struct.unpack_from(f"{byte_order}{n}H", body, values_at)
    text = struct.unpack_from(f"{byte_order}{n_text}H", body, text_at)
    units = lambda v, size: [v] if size == 1 else text[v : v + size]
    return {chr(k & 0xFFFFFF): struct.pack(f"<{size}H", *units(v, size)).decode("utf-16-le", "surrogatepass") for k, v in zip(keys, values) for size in [(k >> 24) + 1]}


PROTOTYPES = read_confusables(confusables_file()) | MORE_ALIKE


def _look_alikes() -> dict[str, str]:
    """Letters of other scripts, and of phonetic Latin, by the ASCII letter of the same prototype and, if there is one, the same case."""
    of: dict[str, list[str]] = {}
    for c in map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B)]):
        of.setdefault(PROTOTYPES.get(c, c), []).append(c)
    out = {}
    for c, p in PROTOTYPES.items():
        if (c > "ɏ" or c == "ı") and unicodedata.category(c) in ("Lu", "Ll", "Lo", "Lt", "Nl") and not _compat_kind(c) in ("<wide>", "<font>", "<narrow>"):
            if same := of.get(p):
                out[c] = next((x for x in same if x.isupper() == c.isupper()), same[0])
    # letters with a mark, whose bare letter is in the table
    for c in map(chr, range(0x370, 0x530)):
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and d[0] in out and len(composed := unicodedata.normalize("NFC", out[d[0]] + d[1:])) == 1:
            out[c] = composed
    return out


def _compat_kind(c: str) -> str:
    return unicodedata.decomposition(c).partition(" ")[0]


LOOK_ALIKE = _look_alikes()
# Characters without a shape of their own.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤⁦-⁯ㅤ︀-️﻿ﾠ"
SPACES = "   -   　"

_CJK = "　-ヿ㐀-䶿一-鿿가-힯！-｠･-ﾟ"
_EMOJI = "‼⁉™ℹ←-⇿⌀-⏿☀-➿⬀-⯿〰〽\U0001f000-\U0001faff\U000e0020-\U000e007f"
# ZWJ, variation selectors and tags inside an emoji sequence; joiners between letters that join.
_AT_HOME = re.compile(f"(?<=[{_EMOJI}0-9#*])️|(?<=[{_EMOJI}])︎|(?<=[{_EMOJI}️])‍(?=[{_EMOJI}])|(?<=[؀-ۿऀ-෿])[‌‍]")
_HIDDEN = re.compile(f"[{INVISIBLE}]")
_SPACE = re.compile(f"[{SPACES}]")
_CJK_SPACE = re.compile(f"(?<=[{_CJK}])　|　(?=[{_CJK}])|^　")
_WIDE = re.compile("[！-～￠-￦]")
_CJK_TEXT = re.compile("[぀-ヿ一-鿿가-힯]")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
_QUICK = re.compile("[^\\x00-\\x7fáàâãäçéèêëíìîïñóòôõöúùûüßœæÁÀÂÃÄÇÉÈÊËÍÌÎÏÑÓÒÔÕÖÚÙÛÜ¡¿ªº°§£€«»“”‘’—–…™©®\U0001f300-\U0001f64f、-ヿ一-鿿]")
_OTHER_SCRIPT = re.compile("[" + "".join(map(re.escape, LOOK_ALIKE)) + "]")


@lru_cache(100_000)
def _compat(c: str) -> str | None:
    """The plain form of a character that Unicode calls a wide, narrow, font or ligature form of others; null for all else."""
    if c == "Ω" or c == "K" or c == "Å":
        return unicodedata.normalize("NFC", c)
    if _SPACE.match(c):
        return None
    kind = _compat_kind(c)
    if kind in ("<wide>", "<font>") or kind == "<compat>" and unicodedata.category(c)[0] == "L" and c > "ǃ" and not "㄰" <= c <= "㏿":
        return unicodedata.normalize("NFKC", c)
    return None


class _Prototype(dict):
    """The prototype of each code point met so far, for str.translate."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        p = "".join([PROTOTYPES.get(x, x) for x in _compat(c) or c])
        self[code] = p
        return p


_prototype = _Prototype()


def skeleton(text: str | None) -> str | None:
    """Decompose, replace every character by its prototype, decompose again.  Invisible characters are left out, all spaces are one."""
    if text is None:
        return None
    s = unicodedata.normalize("NFD", _HIDDEN.sub("", _SPACE.sub(" ", text)))
    return unicodedata.normalize("NFD", s.translate(_prototype))


# Letters of Cyrillic and Greek that look like Latin ones; the words of a text tell which script is meant.
def _script(word: str) -> tuple[bool, bool, bool]:
    """(holds Latin letters, holds look-alikes of other scripts, holds letters of other scripts that no Latin one resembles)"""
    latin = alike = own = False
    for c in word:
        if c <= "ɏ" and c != "ı":
            latin |= c.isalpha()
        elif c in LOOK_ALIKE:
            alike = True
        elif c > "Ͱ" and c.isalpha():
            own = True
    return latin, alike, own


_TO_CYRILLIC = {v: k for k, v in LOOK_ALIKE.items() if "Ѐ" <= k <= "џ" and k not in "іјѕїІЈЅЇѐѵѴЬгѓ"}


def plain(text: str | None) -> tuple[str | None, bool]:
    """(text in one consistent character form, whether it held a look-alike, invisible character or other space)."""
    if text is None or text.isascii() or not _QUICK.search(text) and unicodedata.is_normalized("NFC", text):
        return text, False
    s, found = text, False
    if _HIDDEN.search(s):
        keep = {m.start() for m in _AT_HOME.finditer(s)}
        t = _HIDDEN.sub(lambda m: m[0] if m.start() in keep else "", s)
        found, s = found or t != s, t
    if not unicodedata.is_normalized("NFC", s):
        found, s = True, unicodedata.normalize("NFC", s)
    if _SPACE.search(s):
        keep = {m.start() for m in _CJK_SPACE.finditer(s)} if _CJK_TEXT.search(s) else ()
        t = _SPACE.sub(lambda m: m[0] if m.start() in keep else " ", s)
        found, s = found or t != s, t
    t = "".join([c if c <= "ǃ" or (p := _compat(c)) is None else p for c in s])
    if t != s:
        if _CJK_TEXT.search(s):  # wide forms are at home beside ideographs and kana
            t = _WIDE_RUN.sub(lambda m: m[0] if _beside_cjk(s, m.start(), m.end()) else unicodedata.normalize("NFKC", m[0]), s)
            t = "".join([c if c <= "ǃ" or _WIDE.match(c) or (p := _compat(c)) is None else p for c in t])
        found, s = found or t != s, t
    if _OTHER_SCRIPT.search(s):
        words = {m[0]: _script(m[0]) for m in _WORD.finditer(s)}
        has_own = any(own for _, _, own in words.values())
        other = [w for w, (latin, alike, own) in words.items() if not latin and alike and not own]
        # A word wholly of look-alikes is at home only among real words of its script.
        real = has_own and any(own and not latin for latin, _, own in words.values())

        def one(m: re.Match) -> str:
            latin, alike, own = words[m[0]]
            if own and latin and not any("Ͱ" <= c <= "Ͽ" for c in m[0]):
                t = "".join([_TO_CYRILLIC.get(c, c) for c in m[0]])
                return t if not any("a" <= c.lower() <= "z" for c in t) else m[0]
            if alike and (latin or not real and m[0] in other):
                return "".join([LOOK_ALIKE.get(c, c) for c in m[0]])
            return m[0]

        t = _WORD.sub(one, s)
        found, s = found or t != s, t
    return (s, True) if found and skeleton(s) == skeleton(text) else (text, False)


_WIDE_RUN = re.compile("[！-～￠-￦]+")


def _beside_cjk(s: str, i: int, j: int) -> bool:
    """Whether the nearest letters around a run of wide forms are ideographs or kana; a text may also hold Latin passages."""
    before = next((c for c in reversed(s[max(0, i - 12) : i]) if c.isalpha()), "")
    after = next((c for c in s[j : j + 12] if c.isalpha()), "")
    return bool(_CJK_TEXT.match(before or " ")) or not before and bool(_CJK_TEXT.match(after or " "))

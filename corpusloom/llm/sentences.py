"""Problem 9: sentence boundaries across languages and scripts (semi-Markov dynamic programming).

Each line of a text is cut at the places where a sentence can end: after end marks with the closing quotes,
brackets and emoji that follow, and at gaps in scripts that write no end mark.  Dynamic programming chooses
the spans between these places that together score best.  A span's score joins its length, its opening (what
stands first), its closing (which mark, after which word) and the balance of its quotations and brackets: a span
that opens one which it does not close, or the reverse, pays for it; one that lies wholly inside does not.

The score of a long span falls linearly with its length, so all starts that lie further back than LONG
characters share one running maximum for each depth of quotation: the choice is exact however long a line is,
in linear time.

end_pos is the number of code points up to and including the sentence's last character.  Null, blank and
signless texts have no sentences; a line without any letter or digit is none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations after which a sentence does not end (a number, a name or a noun follows).
ABBREVIATIONS = frozenset(
    "mr mrs ms dr prof st jr sr gen col lt sgt capt rev hon no nos vs fig figs vol ch sec ed eds pp approx dept est inc ltd co corp mt ave blvd "
    "e.g i.e cf viz al jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun a.m p.m u.s "
    "sra srta dra d dna profa exmo exma ex pág pag págs av rua r n núm num art cap tel p.ex aprox fev abr mai ago set out dez jan "
    "ud uds vd vds ee.uu pza avda c/ s.a p.ej ej "
    "m mm mme mlle mlles me bd p.-d env chap réf av "
    "hr fr frl nr str bzw ca z.b z u.a d.h d.i s.o s.u u evtl ggf inkl bzgl abs bd hrsg geb sog vgl usf mio mrd tsd max min kap abb "
    "sig sigg dott dott.ssa ing avv prof.ssa pagg pag es ecc.to "
    "г гг стр см ул д др мин сек ч  им рис тыс млн млрд руб коп проф акад т.е т.к т.н напр гл ред тов гос св в "
    "डॉ श्री श्रीमती सं पृ د أ م ص ت ดร นพ พ.ศ ค.ศ น.ส ver vs".split()
)
# Abbreviations that may also stand at the end of a sentence.
CLOSING_ABBREVIATIONS = frozenset("etc usw ecc т.д т.п и.т.д a.m p.m jr u.s inc ltd др h min std uhr гг руб".lower().split())
# Abbreviations that are words too; they are abbreviations before a number only.
WORDS_TOO = frozenset("ago mai set out no nos art es max min mar sat sun sec".split())
# Month names that follow a day written with a point.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep okt nov dez jänner".split())

# Words that go on a sentence after a quotation, in scripts without letter case.
GOING_ON = frozenset("في ने को में और".split())

END = ".!?…。！？।॥؟۔︒｡．‼⁇⁈⁉"
STRONG = frozenset("!?。！？।॥؟۔｡‼⁇⁈⁉︒")
OPENERS = {"“": "”", "«": "»", "„": "“”", "‘": "’", "(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉", "‹": "›", "［": "］", "〔": "〕"}
CLOSERS = frozenset("”»’)]}」』）】》〉›\"'“［］〕")
_EMOJI = "‼⁉ℹ←-⇿⌚-⏿■-➿⤴-⭕〰〽\U0001f000-\U0001faff️‍\U0001f3fb-\U0001f3ff"

_LINE = re.compile("[^\n\r  \x0b\x0c\x85]+")
_HAS_WORD = re.compile(r"[^\W_]")
# An end: marks, then closers, then emoji with blanks between.  A blank may stand before the marks ("bom ... mas").
_STOP = re.compile(f"[{END}]+(?:[”»’)\\]}}」』）】》〉›\"'“］〕]|[ \u00a0\u202f]»)*(?:[  　]*[{_EMOJI}]+)*")
_THAI = re.compile("[฀-໿ក-៿က-႟]")
_GAP = re.compile("[   -​　]+")
_WORD_BEFORE = re.compile(r"([^\s“”«»„()\[\]\"'‘’「」『』（）—–]*)$")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿＀-￯]")
_LIST_MARK = re.compile(r"\s*(?:[-*•‣◦–—▪·]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s*$")

#: Spans up to this many characters have no price of length; beyond, RATE a character.
LONG, RATE = 400, 0.002
#: Price of each quotation or bracket that a span opens and does not close, or the reverse.
UNBALANCED = 8.0
#: No abbreviation is as long; of a longer word, its end is read.
LONGEST_WORD = 24


def _nesting(line: str) -> dict[int, int]:
    """Matched quotations and brackets: closer -> its opener.  An opener without a closer counts for nothing."""
    stack: list[tuple[str, int]] = []
    waiting: dict[str, list[int]] = {}  # closer -> places in the stack of the openers that it closes
    pairs: dict[int, int] = {}

    def push(c: str, i: int) -> None:
        for x in OPENERS.get(c, c):
            waiting.setdefault(x, []).append(len(stack))
        stack.append((c, i))

    def close(c: str, i: int) -> None:
        k = waiting[c][-1]
        pairs[i] = stack[k][1]
        while len(stack) > k:
            for x in OPENERS.get(stack[-1][0], stack[-1][0]):
                waiting[x].pop()
            stack.pop()

    for m in _BRACKET.finditer(line):
        c, i = m[0], m.start()
        inner = c == "’" and i and i + 1 < len(line) and line[i - 1].isalpha() and line[i + 1].isalpha()
        if waiting.get(c) and not inner:
            close(c, i)
        elif c == '"' or c in OPENERS:
            push(c, i)
    return pairs


_BRACKET = re.compile("[“”«»„‘’()\\[\\]{}「」『』（）【】《》〈〉‹›［］〔〕\"]")


def _closing(line: str, start: int, stop: int, own_start: int) -> float:
    """Score of a sentence that closes with the marks in line[start:stop]."""
    marks = line[start:stop].rstrip()
    core = marks.rstrip("".join(CLOSERS)) or marks
    ends = "".join(c for c in marks if c in END)
    after = line[stop : stop + 1]
    if any(c in STRONG for c in ends):
        return 2.0
    if not ends:
        return -3.0
    if len(ends) > 1 or "…" in ends:
        return 0.6
    # a single point: what stands before it
    if after and not after.isspace() and not _UNSPACED.match(after) and len(core) == len(marks):
        return -9.0
    word = _WORD_BEFORE.search(line, max(own_start, start - LONGEST_WORD), start)
    w = word[1].lower() if word else ""
    if not w:
        return 0.3
    nxt = _FIRST_WORD.match(line, stop)
    follow = nxt[1].lower() if nxt else ""
    if w in CLOSING_ABBREVIATIONS or w == "д" and line[max(0, start - 4) : start].replace(" ", "").lower().endswith("т.д") or w == "п" and line[max(0, start - 4) : start].replace(" ", "").lower().endswith("т.п"):
        return 0.6
    if w in WORDS_TOO and not follow[:1].isdigit():
        return 1.6
    if w in ABBREVIATIONS or w.lstrip("(") in ABBREVIATIONS:
        return -4.0
    if len(w) == 1 and w.isalpha() and not _UNSPACED.match(w) and (word[1].isupper() or w not in "aeiouyàéèòôáóíñ"):
        return -4.0
    if "." in w and len(w) <= 6 and all(len(x) <= 2 for x in w.split(".")) and not any(c.isdigit() for c in w):
        return -4.0
    if w.isdigit() and (follow in MONTHS or not line[own_start : start - len(w)].strip()):
        return -4.0
    if w.isdigit() and len(w) <= 2 and follow[:1].isalpha() and own_start < start - len(w) and line[: start - len(w)].rstrip().lower().endswith((" am", " vom", " zum", " den", " dem", " der", " im")):
        return -3.0
    return 1.6


_FIRST_CHAR = re.compile(r"\s*(\S)")
_FIRST_WORD = re.compile(r"[\s“«„‘\"'(]*([^\W_]+)")


def _opening(line: str, pos: int, strong: bool) -> float:
    """Score of a sentence that opens at line[pos:]."""
    rest = line[pos:].lstrip() if pos < len(line) else ""
    if not rest:
        return 0.0
    c = rest[0]
    if c in "“«„‘\"'(「『（¿¡[【《‹":
        return 0.8
    if c in "—–-,;:)]}»”/":
        return -4.0
    if c.isupper() or c.isdigit():
        return 0.8
    if c.islower():
        return -0.6 if strong else -1.5
    return 0.5  # scripts without letter case


def spans(line: str) -> list[int]:
    """End positions of the sentences of one line (no line breaks), in characters of the line."""
    end = len(line.rstrip())
    end = len(line[:end].rstrip("\x00﻿​"))
    if not _HAS_WORD.search(line):
        return []
    first = len(line) - len(line.lstrip())
    pairs = _nesting(line) if _BRACKET.search(line) else {}
    openers = set(pairs.values())
    inside = sorted((o, c) for c, o in pairs.items())
    # outermost pairs only
    outer: list[tuple[int, int]] = []
    for o, c in inside:
        if not outer or o > outer[-1][1]:
            outer.append((o, c))
    turns = sorted([(o, 1) for o in openers] + [(c, -1) for c in pairs])
    thai = bool(_THAI.search(line))
    cand: list[tuple[int, int, float]] = []  # (end, next start, score of closing here and opening there)
    k = 0
    last_stop = first
    for m in _STOP.finditer(line):
        start, stop = m.start(), m.end()
        for i in range(start, stop):  # a quotation that opens here belongs to what follows
            if line[i] in "“\"'" and (i in openers or line[i] == "“" and i not in pairs):
                stop = i
                break
        if stop >= end:
            break
        while k < len(outer) and outer[k][1] < start:
            k += 1
        strong = any(c in STRONG for c in m[0])
        nested = k < len(outer) and outer[k][0] < start
        if nested and outer[k][1] < stop:
            close = outer[k][1]
            # the mark closes the quotation: does the sentence around it end too?
            opener = outer[k][0]
            lead = line[last_stop:opener].strip()
            bracket = line[opener] in "([{（【［〔"
            first_char = _FIRST_CHAR.match(line, stop)
            nxt = first_char[1] if first_char else ""
            own = line[close + 1 : stop].strip()
            if own and any(c in END for c in own):
                score = 2.0 + max(_opening(line, stop, True), -2.0)
            elif bracket:
                score = 1.2 + _opening(line, stop, strong) if not lead else -2.0 + _opening(line, stop, strong)
            elif not lead:
                # the sentence is the quotation so far; who said it follows
                spaced = line[stop : stop + 1].isspace()
                score = -3.0 if not spaced or not nxt.isupper() or _mixed_script(line, opener, close, nxt) else _attribution(line, stop)
            else:
                follow = _FIRST_WORD.match(line, stop)
                if follow and follow[1] in GOING_ON:
                    continue
                score = (1.5 if lead[-1:] in ":：,，" or not nxt.islower() else 0.0) + min(_opening(line, stop, strong), 0.5) if line[stop : stop + 1].isspace() or lead[-1:] in ":：" else -3.0
            if score > -3.0:
                cand.append((stop, stop, score))
                if score > 0:
                    last_stop = stop
            continue
        after = line[stop : stop + 1]
        if not after.isspace() and not (any(c in "。！？｡︒" for c in m[0]) or _UNSPACED.match(after) and strong or stop - start > 1 and _is_emoji(line[stop - 1])):
            if not (strong and (after.isupper() or after in "“«¿¡\"") and line[start - 1 : start].isalpha() and len(m[0]) >= 1 and not after.isdigit()):
                continue
        score = _closing(line, start, stop, first if not cand else max(first, cand[-1][0])) + _opening(line, stop, strong)
        if score > -3.0:
            cand.append((stop, stop, score))
            if score > 0 and not nested:
                last_stop = stop
    if thai:
        have = {c[0] for c in cand}
        k = 0
        for m in _GAP.finditer(line, first, end):
            a, z = m.start(), m.end()
            while k < len(outer) and outer[k][1] < a:
                k += 1
            if k < len(outer) and outer[k][0] < a or a in have:
                continue
            before, behind = line[first:a].rsplit(None, 1)[-1:] or [""], line[z:end].split(None, 1)[:1] or [""]
            if not (_THAI.search(before[0]) or _THAI.search(behind[0]) and not before[0][-1:].isalpha()):
                continue
            if before[0].rstrip(".") in ABBREVIATIONS or before[0].endswith(".") or _LIST_MARK.match(line[first:a]) or _is_emoji(behind[0][:1]):
                continue
            if not _HAS_WORD.search(behind[0]) and not _THAI.search(behind[0]):
                continue
            cand.append((a, z, 1.5))
        cand.sort()
    if not cand:
        return [end]
    # dynamic programming over spans between candidates
    pos = [first, *[c[0] for c in cand], end]
    gain = [0.0, *[c[2] for c in cand], 3.0]
    n = len(pos)
    depth, at, now = [], 0, 0
    for p in pos:
        while at < len(turns) and turns[at][0] < p:
            now += turns[at][1]
            at += 1
        depth.append(now)
    best, back = [0.0] * n, [0] * n
    far: dict[int, tuple[float, int]] = {}
    near = 0
    for j in range(1, n):
        while pos[j] - pos[near] > LONG:  # starts too far back share a running maximum
            v = best[near] + RATE * pos[near]
            if v > far.get(depth[near], _NEVER)[0]:
                far[depth[near]] = (v, near)
            near += 1
        top, at = _NEVER
        for d, (v, i) in far.items():
            v -= RATE * (pos[j] - LONG) + UNBALANCED * abs(depth[j] - d)
            if v > top:
                top, at = v, i
        for i in range(near, j):
            size = pos[j] - pos[i]
            v = best[i] - (1.2 if size < 3 else 0.5 if size < 8 else 0.0) - UNBALANCED * abs(depth[j] - depth[i])
            if v > top:
                top, at = v, i
        best[j], back[j] = top + gain[j], at
    out = []
    j = n - 1
    while j:
        out.append(pos[j])
        j = back[j]
    out.reverse()
    kept: list[int] = []
    start = first
    for e in out:
        e2 = len(line[:e].rstrip())
        if _HAS_WORD.search(line, start, e2):
            kept.append(e2)
        elif kept and not line[start:e2].strip("".join(CLOSERS) + END + " "):
            kept[-1] = e2
        start = e2
    return kept


_NEVER = (float("-inf"), 0)


def _is_emoji(c: str) -> bool:
    return bool(c) and bool(_EMOJI_ONE.match(c))


_EMOJI_ONE = re.compile(f"[{_EMOJI}]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_ATTRIBUTED = re.compile(r"\s*(?:[^\W\d_][\w.'’-]*\s+){1,3}?(?:said|says|wrote|asked|shouted|replied|added|yelled|posted|commented|whispered|answered|escreveu|disse|gritou|respondeu|perguntou|comentou)\b")


def _mixed_script(line: str, opener: int, close: int, following: str) -> bool:
    """Whether the quotation is not in Latin script while the next word is: a name that goes on the sentence."""
    inner = line[opener + 1 : close]
    return not _LATIN.search(following) or len(_LATIN.findall(inner)) < len(inner) / 3


def _attribution(line: str, stop: int) -> float:
    return -3.0 if _ATTRIBUTED.match(line, stop) else 1.5


def ends(text: str | None) -> list[int]:
    """end_pos of each sentence of a text."""
    if not text or text.isspace():
        return []
    out: list[int] = []
    for m in _LINE.finditer(text):
        at = m.start()
        out += [at + e for e in spans(m[0])]
    return out


def boundaries(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, end_pos): one row per sentence of every text."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    kind = src.schema["id"].dataType.simpleString()

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [ends(t) for t in b.column(1).to_pylist()]
            n = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(n), pa.array([e for f in found for e in f], pa.int32())], names=["id", "end_pos"])

    return src.mapInArrow(one, f"id {kind}, end_pos int")


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, number, sentence): the sentences of every text, numbered from 1, without the white space between them."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    kind = src.schema["id"].dataType.simpleString()

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, number, out = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                at = 0
                for k, e in enumerate(ends(t), 1):
                    rows.append(i)
                    number.append(k)
                    out.append(t[at:e].strip())
                    at = e
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(number, pa.int32()), pa.array(out, pa.string())], names=["id", "number", "sentence"])

    return src.mapInArrow(one, f"id {kind}, number int, sentence string")

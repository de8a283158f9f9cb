"""Sentence boundaries across languages and scripts.

Method: a pushdown automaton reads the marks of each block (blocks end at blank lines and where a list item starts).  Its
stack holds the open quotations and brackets and, at the bottom, whether it reads a list item; a final mark of any script
ends a sentence only with an empty stack.  Dots ask a trie of abbreviations, read backwards from the dot, and the
characters around them.  Offsets are counted in characters that are not white space.

Rules, in short:
* ``. ! ?`` and their full-width, Han, Devanagari and Arabic counterparts end a sentence, in a row once; the quotes and
  brackets that close right there belong to it.  A dot between letters or digits ends nothing unless a capital follows a
  lower-case word or a number ends there.
* Quotations and brackets belong to the sentence around them.  If one closes right after a final mark inside it, the
  sentence ends there only if what follows can begin a new one: a capital, a file name, another quotation; in Japanese not
  before hiragana, in Chinese not before particles that carry the sentence on; in scripts without case only if the
  quotation is the whole sentence.
* An opening mark without its partner in the block is a plain character.
* Marks of omission end a sentence only if something that begins a new one follows; never before Han or kana.
* A list item, from its mark to the next item or blank line, is one sentence.
* White space between two Thai letters ends a sentence.

Defined results: null texts and texts of white space only have no sentences; every other text has at least one, and the
last end equals the number of its characters that are not white space.  Repeated rows give their sentences once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.identifiers import WS_CHARS

_WS = re.escape(WS_CHARS)
_BREAK = "(?:\r\n|\r(?!\n)|\n)"
_INLINE = re.escape(WS_CHARS.replace("\r", "").replace("\n", ""))
_BLANK = re.compile(f"{_BREAK}[{_INLINE}]*{_BREAK}[{_WS}]*")
_ITEM = re.compile(f"(?:^|[\r\n])[{_WS}]*(?=(?:[-*•‣◦▪·–]|\\(?[0-9]{{1,3}}[)）])[{_WS}])")
_THAI = re.compile(f"(?<=[ก-ฺเ-๎])[­​-‍⁠﻿]*[{_WS}][{_WS}­​-‍⁠﻿]*(?=[ก-ฺเ-๎])")

# Marks of the scripts.
DOTS = ".．"
STRONG = "!?。！？｡।॥؟۔‼⁇⁈⁉"
OMISSION = "…⋯"
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "［": "］", "《": "》", "〈": "〉", "【": "】", "‹": "›", "〝": "〟"}
CLOSERS = "”»」』)）]］》〉】›〟"
_MARK = re.compile(f"[{re.escape(DOTS + STRONG + OMISSION)}]+|[\"{re.escape(''.join(PAIRS) + CLOSERS)}]")

# Abbreviations.  Those of the first group never close a sentence, those of the second may.
NEVER = (
    "e.g i.e eg ie cf vs approx incl excl fig figs sec sect app vol ch chap art pp p nr no nos eq ref dept mr mrs ms. dr prof st inc ltd co corp "
    "ca bzw abb kap z d h b ex env zb dh vgl evtl ggf inkl max. str tab art. bd s. av p.ex m mme mlle réf éd ver v rev"
).split()
MAY = "etc usw a.m p.m max min hr hrs usf al jr sr u.a u.ä o.ä".split()
_ORDINAL_BEFORE = frozenset("dem den der des die das am im vom zum zur beim ab seit bis jedem jeder jedes und".split())
_CARRY_ON = frozenset("是时時的地得等这這那之而就也都则則与與和及或中里裡后後前上下为為来來让讓使被把，、；：,;:”’")
_FILE = re.compile(r"[/\w-]*\w\.[a-z]{1,5}\b")
_NOT_FORMAT = re.compile("[­​-‍⁠﻿]")
_SKIP = WS_CHARS + "­​‌‍⁠﻿"


def _trie(words: list[str], value: int, root: dict) -> dict:
    for w in words:
        node = root
        for c in reversed(w.rstrip(".")):
            node = node.setdefault(c, {})
        node[""] = value
    return root


class Abbreviations:
    """Abbreviations as a trie, read backwards from the dot.

    The lists cover English, German and French as far as technical prose has them; pass others for other texts.
    ``never`` close a sentence, ``may`` close one; those of ``also_words`` do if they stand as a word.
    """

    def __init__(self, never: Sequence[str] = NEVER, may: Sequence[str] = MAY, also_words: Sequence[str] = ("no", "nos")) -> None:
        self.also_words = frozenset(also_words)
        self.trie = _trie(list(may), 2, _trie([w for w in never if not w.endswith(".")], 1, {}))


KNOWN = Abbreviations()


def _abbreviation(text: str, dot: int, trie: dict) -> tuple[int, str]:
    """1 for an abbreviation that never closes a sentence, 2 for one that may, 0 for none; and the word before the dot."""
    i, word = dot - 1, []
    while i >= 0 and (text[i].isalnum() or text[i] in DOTS or text[i] in "_/-­​‌‍⁠﻿" or unicodedata.category(text[i])[0] == "M"):
        if text[i] not in _SKIP:
            word.append(text[i])
        i -= 1
    node, kind = trie, 0
    for c in word:
        node = node.get(c.lower())
        if node is None:
            break
    else:
        kind = node.get("", 0)
    return kind, "".join(reversed(word))


def _script(c: str) -> str:
    o = ord(c)
    if 0x3040 <= o <= 0x309F:
        return "hiragana"
    if 0x30A0 <= o <= 0x30FF or 0x31F0 <= o <= 0x31FF or 0xFF66 <= o <= 0xFF9F:
        return "katakana"
    if 0x2E80 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0x20000 <= o <= 0x3FFFF:
        return "han"
    if 0x0900 <= o <= 0x0DFF or 0x0E00 <= o <= 0x0EFF or 0x0590 <= o <= 0x08FF or 0xFB50 <= o <= 0xFEFC:
        return "caseless"
    return "other"


class Automaton:
    """Reads one block and keeps the ends of its sentences, as positions after their last character."""

    def __init__(self, text: str, known: Abbreviations = KNOWN) -> None:
        self.text, self.known, self.ends, self.start = text, known, [], 0
        self.marks = [(m.start(), m.group()) for m in _MARK.finditer(text)]
        self.partner = self._partners()

    def _partners(self) -> dict[int, int]:
        """Opening positions to the positions of their closing marks, both ways; unpaired marks are absent."""
        text, stack, found = self.text, [], {}
        for at, mark in self.marks:
            if mark == '"':
                held = [k for k, (_, o) in enumerate(stack) if o == '"']
                before = text[at - 1] if at else " "
                after = text[at + 1] if at + 1 < len(text) else " "
                if held and before not in WS_CHARS:
                    self._pair(stack, held[-1], at, found)
                elif after not in WS_CHARS and (before in _SKIP or before in PAIRS or not before.isalnum() or _script(before) != "other"):
                    stack.append((at, mark))
            elif mark in CLOSERS or (mark == "“" and any(o == "„" for _, o in stack)):
                held = [k for k, (_, o) in enumerate(stack) if mark in PAIRS.get(o, "")]
                if held:
                    self._pair(stack, held[-1], at, found)
            elif mark in PAIRS:
                stack.append((at, mark))
        return found

    @staticmethod
    def _pair(stack: list, k: int, at: int, found: dict[int, int]) -> None:
        found[stack[k][0]], found[at] = at, stack[k][0]
        # Marks that stayed open inside are plain characters.
        del stack[k:]

    def _next(self, i: int) -> int:
        while i < len(self.text) and self.text[i] in _SKIP:
            i += 1
        return i

    def _previous(self, i: int) -> str:
        while i >= 0 and self.text[i] in _SKIP:
            i -= 1
        return self.text[i] if i >= 0 else ""

    def _begins(self, i: int) -> bool:
        """Whether what stands at ``i`` can begin a sentence, as far as letter case tells."""
        t = self.text
        j = i
        while j < len(t) and (t[j] in PAIRS or t[j] == '"'):
            j = self._next(j + 1)
        if j >= len(t):
            return True
        c = t[j]
        if _script(c) != "other":
            return True
        if c.islower() or c == "/":
            return bool(_FILE.match(_NOT_FORMAT.sub("", t[j : j + 80])))
        return c.isupper() or c.isdigit() or j > i or c in "¿¡"

    def _end(self, i: int) -> None:
        # Closing marks that lost their partner still belong to the mark before them.
        while i < len(self.text) and i not in self.partner and (self.text[i] in CLOSERS or self.text[i] in "­​‌‍⁠﻿"):
            if self.text[i] not in CLOSERS and not (i + 1 < len(self.text) and self.text[i + 1] in CLOSERS):
                break
            i += 1
        if i > self.start:
            self.ends.append(i)
            self.start = i

    def run(self) -> list[int]:
        stack: list[int] = []
        for at, mark in self.marks:
            if at < self.start:
                continue
            if mark[0] == '"' or mark[0] in PAIRS or mark[0] in CLOSERS:
                if at not in self.partner:
                    continue
                if self.partner[at] > at:
                    stack.append(at)
                else:
                    stack.pop()
                    if not stack:
                        self._closed(at)
            elif not stack:
                self._final(at, mark)
        thai = [m.start() for m in _THAI.finditer(self.text) if not any(o < m.start() < c for o, c in self.partner.items() if o < c)]
        return sorted({*self.ends, *thai})

    def _final(self, at: int, mark: str) -> None:
        end = at + len(mark)
        nxt = self._next(end)
        if nxt >= len(self.text):
            return self._end(end)
        c, gap = self.text[nxt], any(x in WS_CHARS for x in self.text[end:nxt])
        if any(x in STRONG for x in mark):
            return self._end(end)
        if c in ",;:，、；：":
            return None
        if any(x in OMISSION for x in mark) or len(mark) > 1:
            if _script(c) in ("han", "hiragana", "katakana") and not any(x in DOTS for x in mark):
                return None
            if gap and self._begins(nxt) and not c.isdigit():
                return self._end(end)
            return None
        before = self._previous(at - 1)
        if not before or "ऀ" <= before <= "ॿ":
            return None
        kind, word = _abbreviation(self.text, at, self.known.trie)
        if not gap:
            # Without white space only a capital after a word or a number, or another script, begins a sentence.
            if c.isupper() and kind != 1 and len(word) > 1 and (before.islower() or before.isdigit() or self.text[nxt + 1 : nxt + 2].islower()):
                if not (before.isdigit() and "." in word) and not (word[-2:].isupper() and not self.text[nxt + 1 : nxt + 2].islower()):
                    return self._end(end)
            elif _script(c) != "other" and not kind and not before.isdigit():
                return self._end(end)
            elif c in PAIRS and not kind:
                return self._end(end)
            return None
        # Abbreviations that are words too: ``no`` closes a sentence unless a number follows.
        if kind == 1 and not (word in self.known.also_words and not c.isdigit()):
            return None
        if kind == 2:
            return self._end(end) if self._begins(nxt) and not c.isdigit() else None
        if len(word) == 1 and word.isalpha() and _script(word) == "other":
            return None
        if word.isdigit() and self._ordinal(at - len(word), c):
            return None
        return self._end(end)

    def _ordinal(self, number: int, c: str) -> bool:
        if c.islower():
            return True
        before = re.search(r"(\w+)[\s­​]*$", self.text[max(0, number - 40) : number])
        return bool(before) and before.group(1).lower() in _ORDINAL_BEFORE

    def _closed(self, at: int) -> None:
        """A quotation or bracket has closed at depth 0."""
        opened = self.partner[at]
        last = self._previous(at - 1)
        if not last or last not in STRONG + DOTS + OMISSION:
            return
        nxt = self._next(at + 1)
        if nxt >= len(self.text):
            return self._end(at + 1)
        if last in DOTS and _abbreviation(self.text, self.text.rindex(last, 0, at), self.known.trie)[0] == 1:
            return None
        c = self.text[nxt]
        if c in CLOSERS or c in ",;:，、；：.．。!?！？…-–—" or c in _CARRY_ON:
            return None
        script = _script(c)
        whole = not self.text[self.start : opened].strip(_SKIP)
        if script == "hiragana" or (script == "caseless" and not whole):
            return None
        if script == "han" and (self.text[opened] in "（(" or (last not in "。｡" and not whole)):
            return None
        if script in ("other",) and not self._begins(nxt):
            return None
        return self._end(at + 1)


def sentence_ends(text: str, known: Abbreviations = KNOWN) -> list[int]:
    """Ends of the sentences of ``text``, each as the number of characters up to it that are not white space."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = np.concatenate([[0], np.cumsum(~np.isin(codes, np.array([ord(c) for c in WS_CHARS], np.uint32)))])
    ends: set[int] = set()
    at = 0
    blocks = []
    for m in _BLANK.finditer(text):
        blocks.append((at, m.start()))
        at = m.end()
    blocks.append((at, len(text)))
    for lo, hi in blocks:
        block = text[lo:hi]
        starts = [m.end() for m in _ITEM.finditer(block)]
        edges = sorted({0, *starts, len(block)})
        for a, b in zip(edges, edges[1:]):
            ends.add(int(solid[lo + b]))
            if a not in starts:
                ends.update(int(solid[lo + a + e]) for e in Automaton(block[a:b], known).run())
    return sorted(ends - {0})


def sentences(documents: DataFrame, with_text: bool = False, known: Abbreviations = KNOWN) -> DataFrame:
    """``documents`` (id, text) to one row per sentence: id and end_pos, and with ``with_text`` the sentence itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ends, texts = [], [], []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sentence_ends(text, known)
                ids += [id_] * len(found)
                ends += found
                if with_text:
                    solid = [i for i, c in enumerate(text) if c not in WS_CHARS]
                    for a, b in zip([0, *found], found):
                        texts.append(text[solid[a] : solid[b - 1] + 1])
            cols = [pa.array(ids, pa.int64()), pa.array(ends, pa.int64())] + ([pa.array(texts, pa.string())] if with_text else [])
            yield pa.RecordBatch.from_arrays(cols, ["id", "end_pos", "sentence"][: len(cols)])

    schema = "id bigint, end_pos bigint" + (", sentence string" if with_text else "")
    return documents.select(F.col("id").cast("bigint"), "text").dropna().mapInArrow(run, schema)

"""Text that was read in the wrong character encoding: find it and restore it where possible."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Encodings that text is commonly misread in, in the order in which they are tried.
CODECS = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850")
#: Well-formed multibyte sequences of UTF-8 as an automaton over bytes (written as characters).
WELL_FORMED = re.compile(
    "(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    "|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
#: Characters that text holds; a span that decodes to others was no damage.
PLAUSIBLE = re.compile("[\xa0-\xffĀ-ſƒˆ˜Ά-ώЁА-яё‐-‧‰-›⁄€№™←-⇿∀-⋿─-╿■-◿☀-➿ﬁﬂ\U0001f300-\U0001faff]+")
HALF = re.compile("[\x80-\x9f]")
#: A word whose case is inverted, as letters of KOI8-R read as Windows-1251 are.
INVERTED = re.compile("(?<![Ѐ-ӿ])[а-яё][А-ЯЁЂ-Џ]{3,}(?![Ѐ-ӿ])")
LOST = "�"
NO_BYTE = "☃"
ROUNDS = 4


class _Bytes(dict):
    """Translation of characters to the bytes they stood for, as characters; ASCII stays."""

    def __init__(self, codec: str) -> None:
        super().__init__()
        for b in range(0x80, 0x100):
            try:
                self[ord(bytes([b]).decode(codec))] = b
            except UnicodeDecodeError:
                pass
        for b in range(0x80, 0xA0):  # undefined bytes are passed through by lenient readers
            self.setdefault(b, b)

    def __missing__(self, char: int) -> int:
        value = char if char < 0x80 else ord(NO_BYTE)
        self[char] = value
        return value


TABLES = {c: _Bytes(c) for c in CODECS}


def _pair(table: _Bytes) -> re.Pattern:
    """A character that stood for a lead byte before one that stood for a continuation byte."""
    chars = lambda lo, hi: "".join(re.escape(chr(c)) for c, b in table.items() if lo <= b <= hi)
    return re.compile(f"[{chars(0xC2, 0xF4)}][{chars(0x80, 0xBF)}]")


PAIRS = {c: _pair(t) for c, t in TABLES.items()}
#: A word of accented letters only, as Cyrillic read in a western single-byte encoding is.
ACCENTED = re.compile("(?<![A-Za-z])[\xc0-\xff]{4,}")


#: Characters that stood for a byte above ASCII in a western encoding.
HIGH = re.compile("[\x80-\xff€‚-„†-•–-›ŒœŠšŽžŸˆ˜™ƒ]+")


def decoded_spans(text: str, codec: str) -> list[tuple[int, int, str]]:
    """``(start, end, restored)`` of maximal runs that are well-formed multibyte text in the bytes of
    ``codec`` and decode to plausible characters."""
    if not PAIRS[codec].search(text):
        return []
    mapped = text.translate(TABLES[codec])
    out = []
    for m in WELL_FORMED.finditer(mapped):
        restored = m[0].encode("latin-1").decode("utf-8")
        firm = HALF.sub("", restored)
        if firm and not PLAUSIBLE.fullmatch(firm):
            continue
        if len(firm) < len(restored) and len(restored) < 2 and not (m.end() < len(text) and text[m.end()] > "\x7f"):
            continue  # half of a doubly damaged character stands beside its other half
        if codec == "cp1251" and len(restored) < 2 and "Ѐ" < text[m.start()] and not _latin_pair(text, m.start(), restored):
            continue
        out.append((m.start(), m.end(), restored))
    return out


def _latin_pair(text: str, at: int, restored: str) -> bool:
    """Whether one Cyrillic pair is a damaged Latin letter or mark, not two letters of Russian."""
    first = text[at]
    if "А" <= restored <= "ё":
        around = text[max(0, at - 1) : at] + text[at + 2 : at + 3]
        return not re.search("[Ѐ-ӿ]", around) and first in "РС" and text[at + 1] not in "»…—–"
    return first in "ГВв" and not re.search("[А-я]", text[max(0, at - 1) : at])


def restore_once(text: str) -> tuple[str, str | None]:
    """The text with the best codec's spans decoded, and that codec; None if there are no spans."""
    best: tuple[int, list, str] | None = None
    for codec in CODECS:
        spans = decoded_spans(text, codec)
        gain = sum(b - a for a, b, _ in spans)
        if gain and (best is None or gain > best[0]):
            best = (gain, spans, codec)
    if best is None:
        return text, None
    out, at = [], 0
    for a, b, restored in best[1]:
        out += [text[at:a], restored]
        at = b
    return "".join([*out, text[at:]]), best[2]


def repair(text: str | None) -> tuple[str | None, str, str]:
    """``(restored, state, codecs)``: state is ``clean``, ``restored``, ``partly`` or ``lost``.

    Spans are decoded again and again, for text that was damaged more than once. Characters that a
    reader replaced can't be had back: such text is ``lost`` if nothing else could be restored.
    """
    if not text or text.isascii():
        return text, "clean", ""
    used = []
    fixed = text
    if INVERTED.search(fixed):
        words = INVERTED.findall(fixed)
        upright = [w for w in re.findall("[А-ЯЁ][а-яё]{3,}", fixed)]
        if len(words) > len(upright):
            fixed = "".join(_koi(w) for w in re.split("([Ѐ-ӿ]+)", fixed))
            used.append("koi8_r")
    if ACCENTED.search(fixed):
        lines = [_cyrillic(line) for line in fixed.split("\n")]
        used += sorted({codec for _, codec in lines if codec})
        fixed = "\n".join(line for line, _ in lines)
    for _ in range(ROUNDS):
        fixed, codec = restore_once(fixed)
        if codec is None:
            break
        used.append(codec)
    lost = LOST in text
    if not used:
        return text, "lost" if lost else "clean", ""
    return fixed, "partly" if lost or HALF.search(fixed) else "restored", ",".join(used)


def _cyrillic(line: str) -> tuple[str, str]:
    """A line whose words are Cyrillic read as western letters, decoded, and the encoding it had."""
    words = [w for w in ACCENTED.findall(line) if len(set(w) - set("ÃÂâ")) > 2]
    if not words:
        return line, ""
    best = None
    for codec in ("cp1251", "koi8_r"):
        fixed = HIGH.sub(lambda m, c=codec: _reread(m[0], c), line)
        odd = len(INVERTED.findall(fixed)) + len(re.findall("[а-яё][А-ЯЁ]", fixed)) + len(re.findall(r"[^\W\d_Ѐ-ӿ][Ѐ-ӿ]", fixed))
        if best is None or odd < best[0]:
            best = (odd, fixed, codec)
    return best[1], best[2]


def _reread(run: str, codec: str) -> str:
    try:
        return bytes(TABLES["cp1252"][ord(c)] for c in run).decode(codec)
    except (UnicodeError, ValueError):
        return run


def _koi(word: str) -> str:
    try:
        return word.encode("cp1251").decode("koi8_r")
    except UnicodeError:
        return word


def repair_texts(docs: DataFrame) -> DataFrame:
    """``docs`` (``row_key``, ``text``) with ``restored``, ``state`` and ``codecs``, one row each.

    Characters are mapped back to legacy bytes, maximal well-formed multibyte spans of these bytes
    are found by their structure, and only they are decoded. Null texts stay null and are clean. Each
    text is read whole and by itself; nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, *repair(text)) for key, text in zip(batch["row_key"], batch["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["row_key", "restored", "state", "codecs"])

    return docs.select("row_key", "text").mapInPandas(run, "row_key bigint, restored string, state string, codecs string")

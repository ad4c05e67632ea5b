"""Garbled text from a wrong character encoding: find it and restore the original where possible.

Main stage. The characters of a text are mapped back to the bytes of a legacy code page, and an automaton over the
structure of UTF-8 (a lead byte, then its continuation bytes) finds the maximal well-formed multibyte spans. Only
those spans are decoded, and only if what comes out is text that people write (``plausible``), or letters of one script
(``consistent``), of any language. Rounds repeat, since texts are garbled more than once. The code page is chosen by the characters its spans explain.

Second stage, for bytes of one single-byte code page read in another, where no multibyte structure exists: words in which letters
stand beside symbols, frames, letters of another script or capitals within lower case are mapped back word by word,
and kept if the result is an ordinary word. U+FFFD marks text whose bytes are lost: found, but not restorable.

Null and empty texts are not garbled and give no row; texts of any length are processed whole; repeated texts are
judged alike. Columns other than the two named are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.physical import spread

ROUNDS = 4
#: Code pages that texts are misread in, and the lead bytes that each may show by themselves. Fixed values.
LATIN, WIDE = (0xC2, 0xC3, 0xCE, 0xCF, 0xE2, 0xEF), (0xC2, 0xC3, 0xC4, 0xC5, 0xCE, 0xCF, 0xD0, 0xD1, 0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEF, 0xF0)
CODE_PAGES = {
    "cp1252": WIDE,
    "cp1250": (*LATIN, 0xC4, 0xC5, 0xD0, 0xD1),
    "cp1251": (*LATIN, 0xC4, 0xC5, 0xD0, 0xD1),
    "cp1254": WIDE,
    "cp437": (*LATIN, 0xC4, 0xC5, 0xD0, 0xD1),
    "cp850": (*LATIN, 0xC4, 0xC5, 0xD0, 0xD1),
    "cp866": (*LATIN, 0xC4, 0xC5, 0xD0, 0xD1),
    "mac_roman": LATIN,
    "koi8_r": (*LATIN, 0xD0, 0xD1),
    "iso8859_2": LATIN,
    "iso8859_15": LATIN,
}
#: Characters that sound texts put after a capital or a unit; a span that ends in one needs another span beside it.
CLOSERS = "‘’“”–—…•›»"
CAPITALS = "ÄÅÆÀÇÈÉÊÍÑÓÔÕÖØÚÜß"


def byte_map(page: str) -> dict[str, int]:
    out = {}
    for b in range(0x80, 0x100):
        try:
            out.setdefault(bytes([b]).decode(page), b)
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):  # bytes without a character there come through as control characters
        out.setdefault(chr(b), b)
    return out


MAPS = {page: byte_map(page) for page in CODE_PAGES}


def char_class(chars: list[str]) -> str:
    return "[" + "".join(map(re.escape, chars)) + "]"


def automaton(page: str, leads) -> re.Pattern:
    """Maximal runs of well-formed UTF-8 sequences as they look in ``page``."""
    of = {}
    for c, b in MAPS[page].items():
        of.setdefault("tail" if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4, []).append((c, b))
    tail = char_class([c for c, _ in of["tail"]])
    parts = [char_class(got) + tail + f"{{{n - 1}}}" for n in (4, 3, 2) if (got := [c for c, b in of.get(n, []) if b in leads])]
    return re.compile("(?:" + "|".join(parts) + ")+")


AUTOMATA = {page: automaton(page, range(0xC2, 0xF5)) for page in CODE_PAGES}
USUAL = {page: automaton(page, leads) for page, leads in CODE_PAGES.items()}
LEADS = {page: frozenset(c for c, b in MAPS[page].items() if 0xC2 <= b <= 0xF4) for page in CODE_PAGES}
ANY_LEAD = frozenset().union(*LEADS.values())
#: Blocks of decoded characters that count as text. Fixed values.
BLOCKS = ((0x80, 0x9F), (0xA0, 0x17F), (0x192, 0x192), (0x2C6, 0x2DD), (0x370, 0x3FF), (0x400, 0x45F), (0x1E00, 0x1EFF), (0x2010, 0x203A), (0x20AC, 0x20AC), (0x2122, 0x2122), (0x2190, 0x2193), (0x2200, 0x2265), (0x2500, 0x25A0), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xFB01, 0xFB02), (0xFEFF, 0xFEFF), (0xFF00, 0xFFEF), (0xFFFD, 0xFFFD), (0x1F300, 0x1FAFF))


def plausible(text: str) -> bool:
    return all(any(lo <= ord(c) <= hi for lo, hi in BLOCKS) for c in text)


def script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() else ""


def consistent(text: str, touches: bool) -> bool:
    """Letters of one script: three of them, or two of three bytes; one Latin letter in a word."""
    if any(unicodedata.category(c) in ("Cn", "Co", "Cs", "Cc") for c in text):
        return False
    letters = [c for c in text if c.isalpha()]
    scripts = {"CJK" if script(c) in ("HIRAGANA", "KATAKANA") else script(c) for c in letters}
    if len(scripts) != 1:
        return False
    long = sum(c >= "\u0800" for c in letters)
    return len(letters) >= 3 or long >= 2 or (touches and scripts == {"LATIN"} and all(c.isalpha() or c in "\xa0" for c in text))


def is_weak(garbled: str) -> bool:
    """Two characters that sound texts may hold side by side: a capital or a unit, and a closing sign."""
    return len(garbled) == 2 and garbled[1] in CLOSERS and garbled[0] in CAPITALS


def spans(text: str, page: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, decoded): whole maximal spans of one script, else the parts of them with usual leads."""
    back = MAPS[page]

    def decoded(garbled: str) -> str:
        try:
            return bytes(back[c] for c in garbled).decode("utf-8")
        except UnicodeDecodeError:
            return ""

    for m in AUTOMATA[page].finditer(text):
        usual = USUAL[page].fullmatch(m.group())
        touches = text[max(0, m.start() - 1) : m.start()].isalpha() or text[m.end() : m.end() + 1].isalpha()
        got = decoded(m.group())
        if got and (usual and plausible(got) or consistent(got, touches)):
            yield m.start(), m.end(), got
            continue
        for part in USUAL[page].finditer(m.group()):
            if (got := decoded(part.group())) and plausible(got):
                yield m.start() + part.start(), m.start() + part.end(), got


def decode_spans(text: str, page: str) -> tuple[str, int, int]:
    """The text with the page's spans decoded, the characters these explain, and how many spans are not weak."""
    out, last, explained, firm = [], 0, 0, 0
    for start, end, got in spans(text, page):
        out += [text[last:start], got]
        last = end
        explained += end - start
        firm += not is_weak(text[start:end])
    out.append(text[last:])
    return "".join(out), explained, firm


def restore_spans(text: str) -> tuple[str, bool]:
    found = False
    for _ in range(ROUNDS):
        foreign = {c for c in set(text) if c > "\x7f"}
        best = None
        for page in CODE_PAGES:
            if foreign.isdisjoint(LEADS[page]):
                continue
            got, explained, firm = decode_spans(text, page)
            if firm and (best is None or explained > best[1]):
                best = (got, explained)
        if best is None:
            return text, found
        text, found = best[0], True
    return text, found


LOWER = "a-zß-öø-ÿœšž"
CAPITAL = "A-ZÀ-ÖØ-ÞŒŠŽŸ"
#: (read as, written in) for single-byte confusions. Fixed values.
CONFUSIONS = (("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp866", "cp1252"), ("koi8_r", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1250", "cp1252"))
#: Pages in which a sharp s stands for another letter, so that a word can look ordinary and be garbled
FRAMED = ("cp437", "cp850")
ORDINARY = re.compile(f"(?:[{CAPITAL}]?[{LOWER}’]+|[{CAPITAL}’]+)(?:-[{CAPITAL}]?[{LOWER}]+)*|[±°µÅ¿¡]+[A-Za-z]*")
FRAME = re.compile(r"[─-▟⌐⌠⌡]")
MIXED = re.compile(r"[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]")
#: Symbols or capitals with an accent between lower-case letters, symbols between capitals, a unit after a number
INTRUDER = re.compile(
    r"(?<=[a-zß-öø-ÿ])[ÀÁÂÈÉÊËÌÍÎÏÒÓÔÕÙÚÛÜÄÖÇÑ‡·‰ˆﬂ¸˘ı„‚˙≤≥∞≈∂∑∏π∫ΩΘατσφδεšŠŽŸ™†¤§¢£¥¦¨¬«»¼½¾±]+(?=[a-zß-öø-ÿ])"
    r"|(?<=[A-Z])[«√¬‡·„‰¸˙]+(?=[A-Z])"
)
UNIT = re.compile(r"\d\s?(?:∞C|≈(?=[\s.,;)]))")
WORD = re.compile(r"[^\s.,;:!?()\[\]{}\"“”/]+")
SINGLE_SUSPECTS = re.compile(f"{FRAME.pattern}|{MIXED.pattern}|{INTRUDER.pattern}|[∞≈√«¬]")


def reread(word: str, read_as: str, written_in: str) -> str | None:
    back = MAPS[read_as]
    try:
        return "".join(c if c < "\x80" else bytes([back[c]]).decode(written_in) for c in word)
    except (KeyError, UnicodeDecodeError):
        return None


def restore_words(text: str) -> tuple[str, bool]:
    """Single-byte confusions. A frame or a mixed script is evidence enough, intruders count from two on."""
    if not (SINGLE_SUSPECTS.search(text)):
        return text, False
    strong = bool(MIXED.search(text) or UNIT.search(text)) or any(re.search(r"[^\W_]", text[max(0, m.start() - 1) : m.end() + 1].replace(m.group(), "")) for m in FRAME.finditer(text))
    intruders = len(INTRUDER.findall(text))
    if not strong and intruders < 2:
        return text, False
    words = [w for w in WORD.findall(text) if not w.isascii()]
    best, most = None, 0
    for pair in CONFUSIONS:
        fixed = 0
        for w in words:
            if SINGLE_SUSPECTS.search(w) and (got := reread(w, *pair)) and ORDINARY.fullmatch(got):
                fixed += max(1, len(INTRUDER.findall(w)))
        if fixed > most:
            best, most = pair, fixed
    if best is None or (not strong and most < 2):
        return text, False

    def fix(m: re.Match) -> str:
        w = m.group()
        got = None if w.isascii() or (best[0] not in FRAMED and ORDINARY.fullmatch(w)) else reread(w, *best)
        return got if got and ORDINARY.fullmatch(got) else w

    return WORD.sub(fix, text), True


def restore(text: str | None) -> tuple[str, bool]:
    """(restored text, whether any character came from a wrong encoding)."""
    if not text or text.isascii():
        return text, False
    got, found = restore_spans(text)
    if "�" in got:
        found = True
    again, words = restore_words(got)
    return again, found or words


def garbled(documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, restored) of the rows whose text shows characters from a wrong encoding. Narrow, in Arrow batches."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for i, text in enumerate(batch.column(column).to_pylist()):
                got, found = restore(text)
                if found:
                    rows.append(i)
                    texts.append(got)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), pa.array(texts, pa.string())], names=[key, "restored"])

    return spread(documents.select(key, column).where(f"`{column}` <> ''"), key).mapInArrow(run, f"`{key}` {kind}, restored string")

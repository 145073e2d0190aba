"""Passages decoded with the wrong character encoding: found by a multi-pattern automaton, restored span by span."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings of one byte per character as which UTF-8 is wrongly read.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "cp866", "mac_roman", "koi8-r", "iso8859-2", "iso8859-15", "cp1254", "cp1257", "cp1258", "cp852", "cp1253", "iso8859-7", "cp1255", "cp1256", "mac_cyrillic")
#: Encodings of two bytes per character, as which UTF-8 is wrongly read and which are read as Latin ones.
READ_WIDE = ("gbk", "cp932", "big5", "cp949")
JAPANESE_PAIRS = (("cp932", "cp1252"), ("cp932", "latin-1"), ("euc-jp", "cp1252"), ("euc-jp", "latin-1"))
LATIN_PAIRS = (("iso8859-2", "latin-1"), ("cp1250", "cp1252"), ("cp1250", "latin-1"), ("iso8859-2", "cp1252"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1250", "cp1251"), ("cp1252", "cp1253"), ("cp1252", "koi8-r"), ("cp1252", "cp866"))
CYRILLIC_PAIRS = (("cp1251", "cp1252"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8-r", "cp1252"), ("koi8-r", "latin-1"), ("cp866", "cp1252"), ("cp866", "latin-1"), ("iso8859-5", "latin-1"), ("iso8859-5", "cp1251"), ("cp1251", "mac_roman"), ("koi8-r", "cp866"), ("cp866", "koi8-r"), ("cp1251", "cp437"), ("cp866", "cp437"), ("mac_cyrillic", "cp1252"))
GREEK_PAIRS = (("cp1253", "cp1252"), ("iso8859-7", "latin-1"), ("cp1253", "latin-1"), ("cp1253", "cp1251"))
HEBREW_PAIRS = (("cp1255", "cp1252"), ("iso8859-8", "latin-1"), ("cp1255", "cp1251"))
ARABIC_PAIRS = (("cp1256", "cp1252"), ("iso8859-6", "latin-1"), ("cp1256", "cp1251"))

#: Letters of the languages that are restored, and letters of running text, most frequent first.
CYRILLIC_LOWER = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
POLISH_LOWER = "ąćęłńóśźż"
ORDER = {
    "russian": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё",
    "greek": "αοιετσνηυρπκμλςωδγχθφβξζψ",
    "hebrew": "יוהלאתרבמשנדעקחפכםגטןסזצךףץ",
    "arabic": "المنويتبرعدفهسكقحجةشصىطخأضذثزئغءظإآؤ",
}
#: Single letters that are words; the most frequent characters of Chinese and Korean text.
SINGLE_WORDS = {"russian": "авикосуяАВИКОСУЯ", "greek": "οηΟΗ", "hebrew": "", "arabic": "و"}
FREQUENT = {"gbk": "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里", "big5": "的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年過發後作裡", "cp949": "이다는을가의에하고지은로를기사한도리서인어시대자나아수그들해일정것부있전"}
#: Names of units after which a raised figure is right.
UNITS = frozenset("m cm mm km dm nm hm dam ft in yd mi s h kg g mg N J W Pa K".split())
#: Foreign letters that look like Latin ones.
LOOKALIKES = frozenset("аеорсухіјѕһАВЕКМНОРСТУХІЈЅοναιρτυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ")

SCRIPT_OF = {p: "russian" for p in CYRILLIC_PAIRS} | {p: "greek" for p in GREEK_PAIRS} | {p: "hebrew" for p in HEBREW_PAIRS} | {p: "arabic" for p in ARABIC_PAIRS}
LATIN_SET = set(LATIN_PAIRS)

QUOTES = "`'\"‘’“”„«»‹›"
ISOLATED = "�"


_TABLES: dict[str, dict[int, str]] = {}
_BYTES: dict[str, dict[str, int]] = {}


def wrongly(data: bytes, encoding: str) -> str:
    """``data`` read as a single-byte encoding; bytes it does not define become the control characters they are."""
    if encoding not in _TABLES:
        seen = bytes(range(256)).decode(encoding, "replace")
        _TABLES[encoding] = {i: c for i, c in enumerate(seen) if c != ISOLATED and c != chr(i)}
    return data.decode("latin-1").translate(_TABLES[encoding])


def bytes_of(encoding: str) -> dict[str, int]:
    """Character -> byte, the inverse of :func:`wrongly`."""
    if encoding not in _BYTES:
        _BYTES[encoding] = {wrongly(bytes([i]), encoding): i for i in range(255, -1, -1)}
    return _BYTES[encoding]


def cyrillic() -> str:
    return CYRILLIC_LOWER + CYRILLIC_LOWER.upper() + "єіїґЄІЇҐўЎ"


def decoded_pairs(encoding: str) -> list[str]:
    """All characters of two bytes of a Japanese encoding."""
    out = []
    for hi in range(0x81, 0xFD):
        for lo in range(0x40, 0xFF):
            try:
                c = bytes([hi, lo]).decode(encoding)
            except UnicodeDecodeError:
                continue
            if len(c) == 1:
                out.append(c)
    return out


def utf8_starts() -> dict[str, list[str]]:
    """First two bytes of every UTF-8 character outside ASCII, of whatever script, wrongly read -> the readings.

    Two bytes are a whole character or tell its length; the bytes behind them are checked where a match is found.
    """
    found: dict[str, list[str]] = {}
    for wrong in READ_AS:
        for lead in range(0xC2, 0xF5):
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
            for second in range(low, high + 1):
                g = wrongly(bytes([lead, second]), wrong)
                if not g.isascii():
                    found.setdefault(g, []).append(wrong)
    return found


def japanese_sequences() -> dict[str, tuple[str, str]]:
    """Characters of two bytes of a Japanese encoding, seen as two Latin ones -> (pair, original)."""
    found: dict[str, tuple[str, str]] = {}
    for true, wrong in JAPANESE_PAIRS:
        for c in decoded_pairs(true):
            g = wrongly(c.encode(true), wrong)
            if not g.isascii():
                found.setdefault(g, (f"{true}>{wrong}", c))
    return found


def letter_pairs() -> dict[str, list[tuple[tuple[str, str], bool]]]:
    """Garbled pair of neighbouring letters -> encoding pairs of one byte per character that make it, and whether it tells.

    Single letters would be ambiguous; letters that are words count between blanks. Pairs that are as common in right
    text (two plain Latin letters) tell nothing by themselves: they are replaced only where others tell.
    """
    found: dict[str, list] = {}

    def add(both: str, pair: tuple[str, str], tells: bool = True) -> None:
        raw = both.encode(pair[0], "ignore")
        g = wrongly(raw, pair[1])
        if len(raw) == len(both) and not g.isascii() and g != both:
            found.setdefault(g, []).append((pair, tells))

    for pair, script in SCRIPT_OF.items():
        low = ORDER[script] + ("άέήίόύώϊϋ" if script == "greek" else "")
        upper = "".join(c for c in low.upper() if c.lower() != c) if script in ("russian", "greek") else ""
        for x in low + upper:
            for y in low:
                add(x + y, pair)
        for x in upper:
            for y in upper:
                add(x + y, pair)
        for x in SINGLE_WORDS[script]:
            add(f" {x} ", pair, False)
    for pair in LATIN_PAIRS:
        for x in POLISH_LOWER + POLISH_LOWER.upper() if pair[0] in ("iso8859-2", "cp1250") else WESTERN_MARKED:
            g = wrongly(x.encode(pair[0], "ignore"), pair[1])
            if g and not g.isascii():
                for y in "abcdefghijklmnopqrstuvwxyz":
                    tells = not g.isalpha() or ord(g) > 0x24F
                    add(x + y, pair, tells)
                    add(y + x, pair, tells)
                for y in POLISH_LOWER if pair[0] in ("iso8859-2", "cp1250") else WESTERN_MARKED[:26]:
                    add(x + y, pair, False)
    return found


WESTERN_MARKED = "äöüßéèêàçñáíóúãõâôåæøïîëûùœÄÖÜÉ"
MARKED = POLISH_LOWER + POLISH_LOWER.upper() + WESTERN_MARKED


def odd_signs() -> str:
    """What letters of Latin script become under the pairs of Latin encodings, if it is no Latin letter itself."""
    seen = {wrongly(c.encode(true, "ignore"), wrong) for true, wrong in LATIN_PAIRS for c in MARKED}
    return "".join(sorted(g for g in seen if g and not g.isascii() and not (g.isalpha() and ord(g) < 0x250)))


ODD = odd_signs()
#: Signs of a text that may hold a passage of one single-byte encoding read as another.
SINGLE = re.compile(
    "[а-яё][А-ЯЁ]{2}|[А-ЯЁ]{4}|[À-ÖØ-öø-ÿ]{3}|[Ѐ-ӿ][®ўҐЄЇґ©«»°±¤¦§¬†‡€‰‹›•™ЂЃѓЉЊЌЋЏђљњќћџЎЈіјѕ\xa0\xad][Ѐ-ӿ®ўҐЄ]"
    "|[─-▟][─-▟Ѐ-ӿ]|[ΓπΣστΦΘΩδφε][ß-ÿΓπΣστΦΘΩδφε]|[A-Za-zÀ-ÿ][" + re.escape(ODD) + "]|[" + re.escape(ODD) + "][a-z]"
)


def wide_starts(encoding: str) -> str:
    """First characters of what UTF-8 of East Asian text becomes in an encoding of two bytes."""
    out = []
    for lead in range(0xE2, 0xEE):
        for second in range(0x80, 0xC0):
            try:
                c = bytes([lead, second]).decode(encoding)
            except UnicodeDecodeError:
                continue
            if len(c) == 1:
                out.append(c)
    return "".join(out)


class Finder:
    """The automaton over all garbled sequences and the rules that tell garbled passages from right or quoted ones."""

    def __init__(self):
        import ahocorasick

        self.starts, self.twos, self.evidence = ahocorasick.Automaton(), ahocorasick.Automaton(), ahocorasick.Automaton()
        for g, wrongs in utf8_starts().items():
            self.starts.add_word(g, wrongs)
        for g, v in japanese_sequences().items():
            self.twos.add_word(g, (len(g), *v))
        for g, pairs in letter_pairs().items():
            self.evidence.add_word(g, (len(g), pairs))
        for a in (self.starts, self.twos, self.evidence):
            a.make_automaton()
        self.wide = {e: re.compile("[" + "".join(map(re.escape, wide_starts(e))) + "]") for e in READ_WIDE}

    def garbled(self, text: str) -> list[tuple[int, int, str]]:
        """Spans to replace, as (start, end, restored text); characters lost for good give None as restored text."""
        if text.isascii():
            return []
        out = self.multi(text)
        out += self.japanese(text)
        if EAST_ASIAN.search(text):
            out += self.wide_readings(text)
        if HIGH_RUN.search(text):
            for n in two_byte_passages(text):
                within = [x for x in out if x[0] < n[1] and n[0] < x[1]]
                if 2 * sum(b - a for a, b, _ in within) < n[1] - n[0]:
                    out = [x for x in out if x not in within] + [n]
        if SINGLE.search(text):
            out += self.single_byte(text, [(a, b) for a, b, _ in out])
        if ISOLATED in text:
            out += lost(text)
        out.sort(key=lambda x: (x[0], -x[1]))
        kept: list = []
        for s in out:
            if not kept or s[0] >= kept[-1][1]:
                kept.append(s)
        return kept

    def multi(self, text: str) -> list[tuple[int, int, str]]:
        """UTF-8 read as an encoding of one byte: whole chains of characters that one reading explains.

        Of several readings the one with the longest chain stands, then the one that explains most of the text.
        """
        hits: dict[int, list[str]] = {end - 1: wrongs for end, wrongs in self.starts.iter(text)}
        chains: dict[int, list] = {}
        weight: dict[str, int] = {}
        known: dict[str, int] = {}
        for i in sorted(hits):
            for wrong in hits[i]:
                if i < known.get(wrong, 0):
                    continue  # inside a chain of this reading
                c = chain(text, i, bytes_of(wrong))
                word = again("".join(x[2] for x in c))
                if C1.search(word):
                    c = chain(text, i, bytes_of(wrong), False)
                    word = again("".join(x[2] for x in c))
                if c:
                    known[wrong] = c[-1][1]
                    if plausible(word):
                        weight[wrong] = weight.get(wrong, 0) + c[-1][1] - i
                        chains.setdefault(i, []).append((wrong, c, word))
        out = []
        done = 0
        for i in sorted(chains):
            if i < done:
                continue
            good = [(c[-1][1], weight[w], -READ_AS.index(w), word) for w, c, word in chains[i] if telling(text, i, c[-1][1], word, w, len(c))]
            if not good:
                continue
            end, _, _, word = max(good, key=lambda g: g[:3])
            if not quoted(text, i, end):
                out.append((i, end, word))
            done = end
        return out

    def single_byte(self, text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        """Passages (sentences, lines) of one single-byte encoding read as another.

        The precomputed letter pairs found in a passage name the encoding pairs to try, most hits first; of an accepted
        pair only the matched spans are replaced.
        """
        covered = [False] * len(text)
        for a, b in taken:
            covered[a:b] = [True] * (b - a)
        hits = [(end + 1 - n, end + 1, pairs) for end, (n, pairs) in self.evidence.iter(text) if not covered[end]]
        out: list = []
        at = 0
        taken_pairs: list = []
        waiting: list = []

        def take(m, spans, pair, words) -> None:
            new = matched(m.group(), words, spans[pair], pair)
            out.extend((m.start() + a, m.start() + b, t) for a, b, t in new if not any(covered[m.start() + a : m.start() + b]))

        for m in PASSAGE.finditer(text):
            count: dict = {}
            spans: dict = {}
            while at < len(hits) and hits[at][1] <= m.end():
                a, b, pairs = hits[at]
                for pair, tells in pairs:
                    spans.setdefault(pair, []).append((a - m.start(), b - m.start()))
                    if tells:
                        count[pair] = count.get(pair, 0) + 1
                at += 1
            if not count or not SINGLE.search(m.group()):
                continue
            order = sorted(count, key=lambda p: -count[p])
            pair, words = script_passage(m.group(), [p for p in order if p in SCRIPT_OF and count[p] >= 3])
            if pair is None:
                pair, words = latin_passage(m.group(), [p for p in order if p in LATIN_SET])
                if pair is None:
                    waiting.append((m, spans, set(count)))
                elif pair not in taken_pairs:
                    taken_pairs.append(pair)
            if pair is not None:
                take(m, spans, pair, words)
        for m, spans, told in waiting:  # less is enough beside a passage of the same damage
            pair, words = latin_passage(m.group(), [p for p in taken_pairs if p in told], False)
            if pair is not None:
                take(m, spans, pair, words)
        return out

    def japanese(self, text: str) -> list[tuple[int, int, str]]:
        """Runs of several two-byte characters seen as Latin ones, of which some hold C1 controls or odd signs."""
        runs: list[list] = []
        for end, (n, _, c) in self.twos.iter_long(text):
            if runs and runs[-1][-1][1] == end + 1 - n:
                runs[-1].append((end + 1 - n, end + 1, c))
            else:
                runs.append([(end + 1 - n, end + 1, c)])
        out = []
        for r in runs:
            body = text[r[0][0] : r[-1][1]]
            odd = sum(not c.isalnum() for c in body)
            kana = sum("぀" <= s[2] <= "ヿ" for s in r)
            kanji = sum("一" <= s[2] <= "鿿" or s[2] in "。、・ー" for s in r)
            if len(r) >= 3 and odd >= len(r) // 2 and kana >= 0.15 * len(r) and kana + kanji >= 0.8 * len(r):
                out += r
        return out

    def wide_readings(self, text: str) -> list[tuple[int, int, str]]:
        """UTF-8 read as an encoding of two bytes: three characters or more that are UTF-8 throughout, or one that stands
        for an accented letter inside a Latin word."""
        out = []
        for wrong in READ_WIDE:
            at = 0
            while m := self.wide[wrong].search(text, at):
                at = m.end()
                end, back = wide_chain(text, m.start(), wrong)
                if end - m.start() >= 3 and len(back) >= 2 and all(EAST_ASIAN.match(c) or c in "，。、！？：；“”" for c in back) and not quoted(text, m.start(), end):
                    out.append((m.start(), end, back))
                    at = end
        for m in IN_WORD.finditer(text):
            for wrong in ("gbk", "cp932"):
                try:
                    back = m.group().encode(wrong).decode()
                except UnicodeError:
                    continue
                if len(back) == 1 and back.isalpha():
                    out.append((m.start(), m.end(), back))
                    break
        return out


EAST_ASIAN = re.compile("[぀-ヿ㐀-鿿가-힯豈-﫿｡-ﾟ]")
#: One character, or two of half width, inside a Latin word.
IN_WORD = re.compile("(?<=[A-Za-z])(?:[一-鿿]|ﾃ[｡-ｿ])(?=[a-z])")
#: Letters and signs of Western encodings outside ASCII, four in a row, or the pairs of a two-byte encoding of Chinese.
HIGH = "".join(c for c in {wrongly(bytes([i]), e) for i in range(0x81, 0xFF) for e in ("cp1252", "latin-1")} if c != "\xa0")
HIGH_RUN = re.compile("[" + re.escape(HIGH) + "]{4,}|(?:[¤-Æ][@-~¡-þ]){4,}")


def chain(text: str, i: int, byte: dict[str, int], controls: bool = True) -> list[tuple[int, int, str]]:
    """UTF-8 characters from ``i`` on, as (start, end, character), read through ``byte``; ends where there is none.

    ``controls``: whether C1 control characters may come out, which are parts of what was damaged twice."""
    out = []
    n = len(text)
    while i < n:
        b = byte.get(text[i], 0)
        if not 0xC2 <= b <= 0xF4:
            break
        size = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        try:
            c = bytes([byte.get(x, 0) for x in text[i : i + size]]).decode()
        except UnicodeDecodeError:
            break
        if len(c) != 1 or unicodedata.category(c) in ("Cn", "Co") or (not controls and unicodedata.category(c) == "Cc"):
            break
        out.append((i, i + size, c))
        i += size
    return out


C1 = re.compile("[\x80-\x9f]")
#: Ranges of letters and signs that may stand alone between right characters.
ALONE = re.compile("[\xa0-\u017f\u0192\u0218-\u021b\u0386-\u03ce\u0401-\u044f\u0451-\u045f\u0490\u0491\u05d0-\u05ea\u0621-\u064a\u1ea0-\u1ef9\u2010-\u203a\u20ac\u2116\u2122\u2150-\u22ff\u2500-\u27bf\u3001-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff01-\uff5e\U0001f000-\U0001faff]")


def script(c: str) -> str:
    """Script of a letter or mark, the first word of its name; East Asian ones written together count as one."""
    first = unicodedata.name(c, "").split(" ")[0]
    return "CJK" if first in ("HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "FULLWIDTH", "IDEOGRAPHIC") else first


def plausible(word: str) -> bool:
    """Can ``word`` be right text? No controls, and letters of one script besides Latin; alone only what stands alone."""
    if not word or C1.search(word):
        return False
    if len(word) == 1:
        return bool(ALONE.match(word))
    if unicodedata.category(word[0])[0] == "M":
        return False
    near = [c for c in word if script(c) in ("LATIN", "CYRILLIC", "GREEK")]
    if 2 * sum(bool(ALONE.match(c)) for c in near) < len(near) or (len(near) < 4 and not all(map(ALONE.match, near))):
        return False
    return len({script(c) for c in word if unicodedata.category(c)[0] in "LM"} - {"LATIN", "COMBINING", "MODIFIER", "FEMININE", "MASCULINE", "MICRO", "VARIATION"}) <= 1


def again(word: str) -> str:
    """``word`` without further rounds of the same damage: while all of it is UTF-8 read as a Western encoding."""
    for _ in range(3):
        for wrong in ("cp1252", "latin-1"):
            c = chain(word, 0, bytes_of(wrong))
            if c and c[-1][1] == len(word):
                word = "".join(x[2] for x in c)
                break
        else:
            break
    return word


def wide_chain(text: str, i: int, wrong: str) -> tuple[int, str]:
    """End and original of the longest stretch from ``i`` on whose bytes in ``wrong`` are UTF-8."""
    raw, ends, j = b"", [], i
    while j < len(text) and not text[j].isascii():
        try:
            raw += text[j].encode(wrong)
        except UnicodeEncodeError:
            break
        j += 1
        ends.append(len(raw))
        if len(ends) == 3:
            try:
                raw.decode()
            except UnicodeDecodeError as e:
                if e.start < 3:
                    return i, ""
    try:
        good = len(raw.decode().encode())
    except UnicodeDecodeError as e:
        good = e.start
    while good and good not in ends:
        good = len(raw[:good].decode()[:-1].encode())
    return (i + ends.index(good) + 1, raw[:good].decode()) if good else (i, "")


def two_byte_passages(text: str) -> list[tuple[int, int, str]]:
    """Chinese and Korean text of two bytes per character seen as Latin letters and signs.

    A run must decode as a whole, into at least four characters of which most are common ones; runs in the order of the
    code table are lists of letters. The language whose frequent characters occur most often stands.
    """
    out = []
    for m in HIGH_RUN.finditer(text):
        body = m.group()
        codes = [ord(c) for c in body]
        if sum(b - a == 1 for a, b in zip(codes, codes[1:])) > len(codes) // 3 or len(set(codes)) < 4:
            continue
        best = None
        for true in FREQUENT:
            for wrong in ("cp1252", "latin-1"):
                byte = bytes_of(wrong)
                raw = bytes([byte.get(c, 0) for c in body])
                back = recoded(raw, true)
                if not back or len(back) < 4:
                    continue
                pairs = [raw[k : k + 2] for k in range(0, len(raw), 2)]
                if len(pairs) != len(back) or len(raw) % 2:
                    continue
                low, high = {"gbk": (0xB0, 0xD7), "big5": (0xA4, 0xC6), "cp949": (0xB0, 0xC8)}[true]
                words = [k for k, q in enumerate(pairs) if q[0] not in (0xA1, 0xA3)]
                common = sum(low <= pairs[k][0] <= high and (pairs[k][1] >= 0xA1 or true == "big5") for k in words)
                frequent = sum(c in FREQUENT[true] for c in back)
                if len(words) >= 3 and common >= 0.85 * len(words) and (frequent or len(back) >= 6) and (best is None or frequent > best[0]):
                    best = (frequent, back)
                break
        if best and not quoted(text, m.start(), m.end()):
            out.append((m.start(), m.end(), best[1]))
    return out


def recoded(raw: bytes, true: str) -> str | None:
    try:
        return raw.decode(true)
    except UnicodeDecodeError:
        return None


def quoted(text: str, start: int, end: int) -> bool:
    """Is the sequence, as a whole, the content of quotes, backticks or a code element (an example of garbling)?"""
    a, b = start, end
    while a > 0 and text[a - 1] == " " and start - a < 2:
        a -= 1
    while b < len(text) and text[b] == " " and b - end < 2:
        b += 1
    before, after = text[a - 1 : a], text[b : b + 1]
    if before and after and before in QUOTES and after in QUOTES:
        return True
    return text[max(0, a - 6) : a] == "<code>" and text[b : b + 7] == "</code>"


def telling(text: str, start: int, end: int, word: str, wrong: str, size: int) -> bool:
    """Is a chain of ``size`` sequences garbling and not rare but right text? ``word`` is what it would be restored to."""
    seen = text[start:end]
    before, after = text[start - 1 : start], text[end : end + 1]
    if any("\x80" <= c <= "\x9f" for c in seen):
        return True
    letters = [c for c in seen if c.isalpha()]
    inside = (before.isascii() and before.isalpha()) or (after.isascii() and after.isalpha())
    if wrong in ("cp1251", "koi8-r", "cp866", "mac_cyrillic") and len(letters) == len(seen):
        # Cyrillic letters only: right text unless they stand inside a Latin word, or follow one another and give Russian.
        return inside or (size >= 2 and all(c.lower() in CYRILLIC_LOWER for c in word) and any(c not in cyrillic() for c in seen))
    if wrong in ("cp1253", "iso8859-7", "cp1255", "cp1256", "mac_cyrillic"):
        # Letters of a script that is written in words: right text beside letters of that script, or alone.
        foreign = [x for x in (before, after) if x.isalpha() and not x.isascii()]
        return not foreign and len(letters) < len(seen) and (inside or size >= 2) or (inside and len(letters) == len(seen) and not foreign)
    if len(letters) == len(seen) and seen.isupper() and (before.isupper() or after.isupper()):
        return False
    if not inside and (all(c in "│┤┐└┴┬├─┼┘┌" for c in seen) or all(c in "═║╗╝╚╔╩╦╠╬╣" for c in seen) or all(c in "░▒▓█▄▌▐▀" for c in seen)):
        return False  # lines of a table
    beside = any(x.isalpha() and not x.isascii() for x in (before, after))
    if size == 1 and beside and any(c.isalpha() and ord(c) > 0x24F for c in seen + word):
        return False  # part of a word of another script
    if wrong in ("cp437", "cp850", "cp852", "mac_roman") and all(c.isalpha() and ord(c) < 0x250 for c in seen) and not (inside and ord(word[0]) < 0x250):
        return size >= 2 and not any(x.isalpha() and not x.isascii() for x in (before, after))
    return True


LETTERS = "A-Za-zÀ-ÖØ-öø-ÿĀ-ſ"
PASSAGE = re.compile(r"[^\n.!?]+[.!?]*")


def fluency(s: str, order: str) -> float:
    """Mean rank score of the letters of ``s`` in running text: about 0.7 for words, 0.5 for any letters."""
    marks = [1 - order.index(c) / len(order) for c in unaccented(s.lower()) if c in order]
    return sum(marks) / len(marks) if marks else 0.0


def unaccented(s: str) -> str:
    """Greek letters without their accents; all others as they are."""
    return "".join(unicodedata.normalize("NFD", c)[0] if "Ͱ" <= c <= "Ͽ" else c for c in s)


def recode(s: str, pair: tuple[str, str]) -> str | None:
    """Undo a wrong single-byte reading of a whole string; None if it can't have come about so."""
    byte = bytes_of(pair[1])
    if any(c not in byte for c in s):
        return None
    return recoded(bytes([byte[c] for c in s]), pair[0])


def script_word(s: str, order: str) -> bool:
    """Does ``s`` look like one word of a script as written: lower case, capitalised, or all capitals?"""
    core = s.strip("«»“”—–…№\xa0")
    return bool(core) and all(c in order for c in unaccented(core.lower())) and (core.islower() or core.istitle() or (core.isupper() and len(core) > 1) or len(core) == 1 or core.lower() == core.upper())


def script_passage(part: str, pairs: list[tuple[str, str]]) -> tuple:
    """The best of the encoding pairs for which there is evidence, and the words ``(start, end, restored)`` it makes right.

    At least two long words and most of the non-ASCII characters must become right words, and the letters must be as
    frequent as in running text. Blanks a wrong reading makes (U+00A0, U+00AD) belong to the words.
    """
    words = list(re.finditer(r"[^\x00-\x7f]+", part))
    size = sum(len(w.group()) for w in words)
    best = None
    for pair in pairs:
        order = ORDER[SCRIPT_OF[pair]]
        good = []
        for w in words:
            back = recode(w.group(), pair)
            if back and back != w.group() and script_word(back, order):
                good.append((w, back))
        long = [b for _, b in good if len(b) >= 3]
        share = sum(len(b) for _, b in good) / size
        if len(long) < 2 or share < 0.6:
            continue
        score = fluency("".join(long), order) + 0.2 * sum(b.islower() or b.istitle() or b.upper() == b.lower() for b in long) / len(long)
        score -= sum(c not in order for _, b in good for c in unaccented(b.lower())) / sum(len(b) for _, b in good)
        if score > (0.68 if SCRIPT_OF[pair] == "russian" else 0.75) and (best is None or score + share > best[0] + 1e-9):
            best = (score + share, good, score, pair)
    if best is None:
        return None, []
    here = "".join(w.group() for w in words if len(w.group()) >= 3)
    lower = sum(w.group().islower() or w.group().istitle() for w in words if len(w.group()) >= 3) / max(1, sum(len(w.group()) >= 3 for w in words))
    russian = ORDER["russian"]
    if all(c.lower() in CYRILLIC_LOWER for c in here) and fluency(here, russian) + 0.2 * lower >= best[2]:
        return None, []
    return best[3], [(w.start(), w.end(), b) for w, b in best[1]]


LATIN_WORD = re.compile(rf"[{LETTERS}{re.escape(ODD)}]+")
#: A sign where only a letter can stand: between letters of a word, of which two at least follow or precede it.
INSIDE = re.compile(rf"[A-Za-zÀ-ÿ]{{2}}[{re.escape(ODD)}]+[a-zÀ-ÿ]|[A-Za-zÀ-ÿ][{re.escape(ODD)}]+[a-zÀ-ÿ]{{2}}|^(?![¹²³]+[a-z])[{re.escape(ODD)}]{{2,}}[a-z]{{2}}")
AT_EDGE = re.compile(rf"[a-z]{{2}}[{re.escape(ODD)}]$|^[±³¶¹¼£¯¦Œœ][±³¿¼a-zó]|[A-Za-zÀ-ÿ][{re.escape(ODD)}]+[a-zÀ-ÿ]")


def latin_passage(part: str, pairs: list[tuple[str, str]], alone: bool = True) -> tuple:
    """Best encoding pair and words of Latin script whose signs stand where letters belong.

    A passage is taken only if a sign stands inside a word: raised figures, units, footnote marks and currency signs
    stand at the edges of right words. Where a passage beside it was taken (not ``alone``), the edges are enough. Units, single letters and words with foreign look-alikes are never replaced.
    """
    words = [w for w in LATIN_WORD.finditer(part) if not w.group().isascii() and not spared(w.group())]
    strong = {w.start() for w in words if INSIDE.search(w.group())}
    odd = strong | {w.start() for w in words if AT_EDGE.search(w.group())}
    if not pairs or not (strong if alone else odd):
        return None, []
    best = None
    for pair in pairs:
        good = []
        for w in words:
            b = recode(w.group(), pair)
            if b and b != w.group() and b.isalpha() and all(ord(c) < 0x180 for c in b) and not (b[1:].lower() != b[1:] and b.upper() != b):
                good.append((w, b))
        hit = sum(w.start() in odd for w, _ in good)
        new = [c for _, b in good for c in b if ord(c) > 127]
        right = sum(c in MARKED for c in new)
        if any(w.start() in (strong if alone else odd) for w, _ in good) and hit >= max(1, 0.6 * len(odd)) and right and right >= 3 * (len(new) - right) and (best is None or 2 * right - len(new) > best[0]):
            best = (2 * right - len(new), good, pair)
    if best and (not alone or len(odd) >= 2 or best[0] >= 3 or not best[2][1].startswith(("cp1251", "cp1253", "koi8", "cp866"))):
        return best[2], [(w.start(), w.end(), b) for w, b in best[1]]
    return None, []


def spared(word: str) -> bool:
    """Words whose signs are right at their edges whatever stands around: powers of units and of single letters; and
    words in which only letters are strange that look like Latin ones."""
    core = word.strip(ODD)
    strange = [c for c in word if c in ODD]
    return (core.isascii() and (len(core) <= 1 or core in UNITS) and core != word) or (bool(strange) and all(c in LOOKALIKES for c in strange))


def matched(part: str, words: list[tuple[int, int, str]], spans: list[tuple[int, int]], pair: tuple[str, str]) -> list[tuple[int, int, str]]:
    """Of the accepted words the stretches that matches of the automaton cover, with what they become."""
    hit = [False] * (len(part) + 1)
    for a, b in spans:
        hit[max(a, 0) : b] = [True] * (b - max(a, 0))
    out = []
    for a, b, back in words:
        i = a
        while i < b:
            if not hit[i]:
                i += 1
                continue
            j = i
            while j < b and hit[j]:
                j += 1
            if part[i:j] != back[i - a : j - a]:
                out.append((i, j, back[i - a : j - a]))
            i = j
    return out


def lost(text: str) -> list[tuple[int, int, None]]:
    """Replacement characters that stand for characters lost in decoding; a quoted or lone named one is an example."""
    out = []
    for m in re.finditer(ISOLATED + "+", text):
        if not quoted(text, m.start(), m.end()):
            out.append((m.start(), m.end(), None))
    return out


_FINDER: list[Finder] = []


def finder() -> Finder:
    if not _FINDER:
        _FINDER.append(Finder())
    return _FINDER[0]


def restore(documents: DataFrame) -> DataFrame:
    """``(doc_id, restored, n_spans, n_lost)`` of the documents with at least one garbled passage.

    Only matched spans are replaced; all other text, right text of other scripts included, stays as it is. Spans whose
    characters are lost (U+FFFD) are counted in ``n_lost`` and left. Null, empty and ASCII-only texts are never garbled
    and are filtered out before Python sees them; repeated rows give repeated rows; no shuffle takes place.
    """
    src = documents.select("doc_id", "text").where(F.col("text").rlike(r"[^\x00-\x7F]"))

    def run(frames):
        f = finder()
        for pdf in frames:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                spans = f.garbled(text)
                if spans:
                    parts, at = [], 0
                    for a, b, new in spans:
                        parts += [text[at:a], text[a:b] if new is None else new]
                        at = b
                    rows.append((doc, "".join([*parts, text[at:]]), len(spans), sum(n is None for *_, n in spans)))
            yield pd.DataFrame(rows, columns=["doc_id", "restored", "n_spans", "n_lost"])

    return src.mapInPandas(run, "doc_id bigint, restored string, n_spans int, n_lost int")


def found(documents: DataFrame) -> DataFrame:
    """Distinct ``doc_id`` of documents with a garbled passage, whether or not it can be restored."""
    return restore(documents).select("doc_id").where("doc_id IS NOT NULL").distinct()

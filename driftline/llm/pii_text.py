"""Reading one text for personal information: candidates, their contexts, and placeholders.

Candidates are spans that could be an item, whatever surrounds them; whether they are is decided by what
:mod:`driftline.llm.pii_bootstrap` has learned. Everything here works on whole texts, in JSON or not:
escapes are undone (also nested ones) with a map back to the original positions.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Kinds of learned patterns and words.
KEY_KINDS = ("name", "phone", "ident", "address", "given", "surname")
KINDS = ("email", "phone", "ident", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "ident": "[IDENT]", "address": "[ADDRESS]", "name": "[NAME]"}

# Vocabulary of notations.
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra"
PARTICLES = "de la|van der|van den|von der|von|van|da|de|del|della|di|du|el|al|bin|la|le|dos"
DIGIT_WORDS = "zero|oh|one|two|three|four|five|six|seven|eight|nine"
STREET_EN = "street|st|avenue|ave|road|rd|boulevard|blvd|close|court|drive|lane|row|way|terrace|place|square|crescent|gardens|mews"
STREET_FR = r"rue|avenue|av\.|bd\.?|boulevard|chemin|impasse|place|allée|quai|route|cours|sentier"
STREET_DE = r"straße|strasse|str\.|weg|gasse|platz|allee|ufer|ring|damm|steig"
STREET_ES = r"c/|calle|avda\.?|avenida|paseo|plaza|camino|ronda|travesía"

_TITLE_WORDS = {w.lower() for w in TITLES.split("|")}
_AT = r"(?:\s?@\s?|\s?＠\s?|%40|\s?[\[({]\s?at\s?[\])}]\s?)"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\s+dot\s+)"
_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
EMAIL = re.compile(
    rf"(?:[a-z0-9](?:[\w.+-]|%2b)*{_AT}(?:{_LABEL}{_DOT})+[a-z]{{2,}}|[a-z0-9][\w.+-]*\s+at\s+(?:{_LABEL}\.)*{_LABEL}(?:\s?[\[({{]\s?dot\s?[\])}}]\s?|\s+dot\s+)[a-z]{{2,}})"
    r"(?![a-z0-9@])", re.I)
_BRACKETED_AT = re.compile(r"[\[({]\s?at\s?[\])}]", re.I)
LINK = re.compile(r"\b(?:https?://|www\.)[^\s\"'<>)]+", re.I)

NUMBER = re.compile(
    r"(?<![\w@/=&$#.-])(?:[A-Z]{1,2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z]\b|\d{2}\.?\d{3}\.?\d{3}-?[A-Z]\b|[A-Z]\d(?:\d-?|[A-Z])\d{5,7}\b"
    r"|\+?\(?\d(?:[ .\-/]?[()]?[ .\-/]?\d){5,21}(?:\s?(?:ext\.?|x)\s?\d{1,5}\b)?"
    rf"|\b(?:(?:{DIGIT_WORDS})[ -]){{5,}}(?:{DIGIT_WORDS})\b)(?![\w@])")
NUMBER_HINT = re.compile(rf"\d[^a-z]{{4,}}|\b(?:{DIGIT_WORDS})[ -](?:{DIGIT_WORDS})[ -]")
HASHED = re.compile(r"#(?=[A-Z]\d{6,8}\b)")

_UP, _LO = "A-ZÀ-ÖØ-ÞŁŚŻŹČŠŽĐŐŰ", "a-zß-öø-ÿąćęłńśźżčšžěřůđőű"
_CAP = rf"(?:[{_UP}][{_LO}]+(?:['’][{_UP}]?[{_LO}]+)?|[{_UP}]{{2,}})"
_CAPS = rf"{_CAP}(?:-{_CAP})?"
NAME = re.compile(
    rf"(?=[{_UP}])(?<![\w@/.-])(?=(?P<title>(?:{TITLES})\.?\s(?:(?:{PARTICLES})\s)?(?P<ts>{_CAPS})(?![\w-]))?"
    rf"(?P<initial>(?P<ii>[{_UP}])\.\s(?:(?:{PARTICLES})\s)?(?P<is>{_CAPS})(?![\w-]))?"
    rf"(?P<full>(?P<fg>{_CAP})(?:\s[{_UP}]\.)?\s(?:(?:{PARTICLES})\s)?(?P<fs>{_CAPS})(?![\w-]))?"
    rf"(?P<turned>(?P<us>{_CAPS}),\s(?P<ug>{_CAP})(?![\w-]))?)")
SHORT = re.compile(rf"(?=[{_UP}])(?<![\w@/.-])(?P<g>{_CAP})\s(?P<i>[{_UP}])\.(?=[\s\"'.,;)]|$)")
LOWER = re.compile(rf"(?<![\w@/.+-])[{_LO}]{{2,}}(?:-[{_LO}]{{2,}})?(?![\w@+])")
_BETWEEN = re.compile(rf"\s(?:[{_LO}]\.\s)?(?:(?:{PARTICLES})\s)?|,\s", re.I)

_TAIL = (r"(?:(?:,\s?|\s)(?:(?:apt|unit|flat|suite)\.?\s?\w{1,4}|#\s?\d{1,4}|\d{1,2}º\s?[a-z]))?"
         r"(?P<town>(?:,\s?|\s-\s|\n)(?:(?:d-)?\d{5}\s)?[^\W\d_]{3,}(?:,?\s(?:[a-z]{2}\s)?\d{5}\b|,?\s[a-z]{1,2}\d{1,2}[a-z]?\s\d[a-z]{2}\b)?)?")
ADDRESS = re.compile(
    rf"(?<![\w/.-])(?:\d{{1,5}}\s?[a-z]?\s(?:(?!of\b|the\b|a\b|in\b|on\b|per\b)[^\W\d_][\w'’]*\s){{1,3}}(?:{STREET_EN})\b\.?"
    rf"|\d{{1,4}}(?:\s?(?:bis|ter|[a-d]))?,?\s(?:{STREET_FR})\s(?:(?:de|du|des|la|le|les)\s|[dl]['’])*[^\W\d_]+"
    rf"|(?:[^\W\d_]+(?:{STREET_DE})|(?:am|an der|im|zum|zur)\s[^\W\d_]+)\s\d{{1,4}}\s?[a-z]?(?:/\d{{1,3}})?(?![\w/])"
    rf"|(?:{STREET_ES})\s?(?:(?:de|del|la|las|los|el)\s)*[^\W\d_]+,?\s(?:n[º°]\s?)?\d{{1,4}}\b){_TAIL}", re.I)
STREET_WORDS = {w.replace("\\", "").replace("?", "") for w in "|".join((STREET_EN, STREET_FR, STREET_ES, "bd|avda|am|zum|zur|im|an|c")).split("|")}
STREET_END = re.compile(rf"(?:{STREET_DE})\s\d", re.I)
WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


JOIN = re.compile(r"\s*(?:,\s(?:also\s)?|\s?(?:and|und|et|y|/|or|&)\s)", re.I)


class Candidate(NamedTuple):
    kind: str  # number, name or address: what it could be
    start: int
    end: int
    instance: str
    cls: str  # number: its mask; name: its form
    given: str
    surname: str
    sure: bool  # address: with a town


_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.S)
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": " ", "f": " "}


def unescape(text: str) -> tuple[str, list[int] | None]:
    """Text without JSON escapes, and the original position of each of its characters (and of its end)."""
    if "\\" not in text:
        return text, None
    places = list(range(len(text) + 1))
    for _ in range(4):
        if "\\" not in text:
            break
        out, where, last = [], [], 0
        for m in _ESCAPE.finditer(text):
            a, b = m.span()
            out.append(text[last:a])
            where += places[last:a]
            ch = chr(int(m.group(1), 16)) if m.group(1) else _SIMPLE.get(m.group(2), m.group(2))
            if "\ud800" <= ch <= "\udfff":  # half of a pair: left as it is
                out.append(text[a:b])
                where += places[a:b]
            else:
                out.append(ch)
                where.append(places[a])
            last = b
        out.append(text[last:])
        where += places[last:]
        new = "".join(out)
        if new == text:
            break
        text, places = new, where
    return text, places


def mask(number: str) -> str:
    """The notation of a number: 9 for digits, A for letters."""
    if number[0].isalpha() and number.split()[0].lower() in DIGIT_WORDS.split("|"):
        return "spelled"
    m = re.sub(r"(?:ext\.?|x) ?\d+$", "ext", number)
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", m))


#: Numbers whose form alone says what they are: the seeds.
PHONE_SEED = re.compile(r"(?:\+|00)[1-9][\d ().\-/]{7,20}")
IDENT_SEED = re.compile(r"[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]|\d{2}\.?\d{3}\.?\d{3}-?[A-Z]")

# Words that name what the number after them is, as patterns.
SEED_PATTERNS = {p: kind for kind, ps in {
    "phone": ["K phone", "K mobile", "K tel", "K telephone", "K ph", "K fax", "L phone", "L tel", "L telephone", "L whatsapp"],
    "ident": ["K ssn", "L ssn", "L security number", "L security no.", "K nino", "L nino", "L ni number", "L national insurance", "K dni", "L dni", "L documento", "K passport", "L passport",
              "L passport no.", "L passport #", "L reisepass nr.", "L passeport n°", "L personalausweis", "L driving licence", "L card no.", "L national id", "L tax id"],
}.items() for p in ps}


def seed_kind(c: "Candidate", patterns: list[str]) -> str:
    """phone or ident if the form of a number, or the word before it, says so; else empty."""
    if PHONE_SEED.fullmatch(c.instance):
        return "phone"
    if IDENT_SEED.fullmatch(c.instance):
        return "ident"
    return next((SEED_PATTERNS[p] for p in patterns if p in SEED_PATTERNS), "")


_KEY = re.compile(r"[\"'-]?([\w$.°]+)[\"']?\s*:\s*[\"'(<]?$")
_WORDS_BEFORE = re.compile(r"([^\W_]+(?:['’][^\W_]+)?[.°]?|[#,/])\s*[(<\"#]?$")
_WORD_AFTER = re.compile(r"[)>\"]?\s*([^\W\d_]+(?:['’][^\W\d_]+)?|,)\s*")


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: its key (K), the one and two words before (L) and after (R)."""
    out = []
    before = text[max(0, start - 48):start]
    m = _KEY.search(before)
    if m:
        out.append("K " + m.group(1).lower())
    else:
        m = _WORDS_BEFORE.search(before)
        if m and "\n" not in before[m.end(1):] and not (m.group(1)[-1] == "." and len(m.group(1)) > 4):
            one = m.group(1).lower()
            if one != ",":
                out.append("L " + one)
            m2 = _WORDS_BEFORE.search(before[:m.start()])
            if m2 and "\n" not in before[m2.end():m.start()]:
                out.append(f"L {m2.group(1).lower()} {one}")
    after = text[end:end + 48]
    m = _WORD_AFTER.match(after)
    if m and after[0] not in "\"\n":
        one = m.group(1).lower()
        if one != ",":
            out.append("R " + one)
        m2 = _WORD_AFTER.match(after[m.end():])
        if m2:
            out.append(f"R {one} {m2.group(1).lower()}")
    return out


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    for a, b in spans:
        text = text[:a] + "\x00" * (b - a) + text[b:]
    return text


def emails(text: str) -> list[tuple[int, int]]:
    if not ("@" in text or "＠" in text or "%40" in text or "at" in (low := text.lower()) and ("dot" in low or _BRACKETED_AT.search(low))):
        return []
    return [m.span() for m in EMAIL.finditer(text)]


def without_links(text: str, found: list[tuple[int, int]]) -> str:
    """The text with e-mail addresses and links blanked: no other item is sought inside them."""
    if found:
        text = _blank(text, found)
    if "://" in text or "www." in text.lower():
        text = _blank(text, [m.span() for m in LINK.finditer(text)])
    return text


def numbers(text: str) -> list[Candidate]:
    if not NUMBER_HINT.search(text):
        return []
    if "#" in text:
        text = HASHED.sub(" ", text)
    out = []
    for m in NUMBER.finditer(text):
        a, b = m.span()
        if text[max(0, a - 3):a].rstrip().endswith(":") and text[max(0, a - 6):a].find('":') >= 0 and not text[max(0, a - 1):a] == '"':
            continue  # a JSON number
        s = m.group()
        if sum(c.isdigit() for c in s) < 6 and s[0] in "0123456789+(":
            continue
        out.append(Candidate("number", a, b, s, mask(s), "", "", False))
    return out


def names(text: str) -> list[Candidate]:
    out = []
    for m in NAME.finditer(text):
        a = m.start()
        for form, g, s in (("title", None, "ts"), ("initial", None, "is"), ("full", "fg", "fs"), ("turned", "ug", "us")):
            if m.group(form):
                given, surname = (m.group(g).lower() if g else ""), m.group(s).lower()
                if form in ("full", "turned") and (given in _TITLE_WORDS or surname in _TITLE_WORDS):
                    continue
                out.append(Candidate("name", a, m.end(form), m.group(form).lower(), form, given, surname, False))
    for m in SHORT.finditer(text):
        out.append(Candidate("name", *m.span(), m.group().lower(), "short", m.group("g").lower(), "", False))
    return out


def addresses(text: str, known: list[str] | None = None) -> list[Candidate]:
    known = words(text) if known is None else known
    if STREET_WORDS.isdisjoint(known) and not STREET_END.search(text):
        return []
    return [Candidate("address", *m.span(), m.group().lower(), "", "", "", bool(m.group("town"))) for m in ADDRESS.finditer(text)]


_LOW_TITLE = re.compile(rf"(?<![\w@/.-])(?:(?:{TITLES.lower()})\.?|[a-z]\.)\s((?:(?:{PARTICLES})\s)?[{_LO}]{{2,}}(?:-[{_LO}]{{2,}})?)(?![\w@+])")


def _without_overlaps(items: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out, end = [], -1
    for a, b, kind in sorted(items, key=lambda x: (x[0], -x[1])):
        if a >= end:
            out.append((a, b, kind))
            end = b
    return out


class Reader:
    """What was learned, applied to a text."""

    def __init__(self, patterns: dict[str, set[str]], masks: dict[str, str], given: set[str], surnames: set[str]):
        self.patterns, self.masks, self.given, self.surnames = patterns, masks, given, surnames

    def _known(self, surname: str) -> bool:
        return surname in self.surnames or "-" in surname and any(p in self.surnames for p in surname.split("-"))

    def _is_name(self, c: Candidate, text: str) -> bool:
        given, surname = c.given in self.given, self._known(c.surname) if c.surname else False
        if c.cls in ("full", "turned") and given and surname:
            return True
        if c.cls in ("title", "initial") and surname:
            return True
        if c.cls == "turned" and not surname:
            return False
        found = [p for p in contexts(text, c.start, c.end) if p in self.patterns["name"]]
        if surname or c.cls in ("title", "short"):
            return bool(found) and (given or surname or c.cls == "title")
        # An unknown surname takes a pattern before it, and isn't the given name of a span that starts later.
        return given and c.surname not in self.given and any(p[0] == "K" or p[0] == "L" and p.count(" ") == 2 for p in found)

    def read(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of all items of an unescaped text, without overlaps."""
        items = [(a, b, "email") for a, b in emails(text)]
        rest = without_links(text, [x[:2] for x in items])
        found = []
        known = words(rest)
        for c in addresses(rest, known):
            if c.sure or any(p in self.patterns["address"] for p in contexts(rest, c.start, c.end)):
                found.append((c.start, c.end, "address"))
        if found:
            rest = _blank(rest, [x[:2] for x in found])
        last: tuple[int, str] | None = None
        for c in numbers(rest):
            found_in = contexts(rest, c.start, c.end)
            kind = seed_kind(c, found_in)
            if not kind:
                k = self.masks.get(c.cls)
                if k and any(p in self.patterns[k] for p in found_in):
                    kind = k
                elif k and last and last[1] == k and JOIN.match(rest, last[0]) and c.start - last[0] < 40:
                    kind = k
            if kind:
                found.append((c.start, c.end, kind))
                last = (c.end, kind)
        surnames = not self.surnames.isdisjoint(known)
        if not surnames and self.given.isdisjoint(known) and _TITLE_WORDS.isdisjoint(known):
            return _without_overlaps(items + found)
        taken = -1
        best: dict[int, tuple[int, int, str]] = {}
        for c in names(rest):
            if self._is_name(c, rest) and c.end > best.get(c.start, (0, 0, ""))[1]:
                best[c.start] = (c.start, c.end, "name")
        for a in sorted(best):
            if a >= taken:
                found.append(best[a])
                taken = best[a][1]
        if surnames:
            found += self._lower_names(rest)
        return _without_overlaps(items + found)

    def _lower_names(self, text: str) -> list[tuple[int, int, str]]:
        out, low = [], list(LOWER.finditer(text))
        for x, y in zip(low, low[1:]):
            gap = text[x.end():y.start()]
            if len(gap) > 12 or not _BETWEEN.fullmatch(gap):
                continue
            a, b = (y.group(), x.group()) if gap == ", " else (x.group(), y.group())
            if self._known(b) and (a in self.given or any(p in self.patterns["name"] for p in contexts(text, x.start(), y.end()))):
                out.append((x.start(), y.end(), "name"))
        # A title or an initial before a surname.
        for m in _LOW_TITLE.finditer(text):
            if self._known(m.group(1).split()[-1]):
                out.append((*m.span(), "name"))
        return out


def asked(text: str, reader: Reader | None) -> set[str]:
    """All patterns and words that reading an unescaped text can look up: those of its addresses, or, with a reader
    that knows these, all others."""
    rest = without_links(text, emails(text))
    known = words(rest)
    streets = addresses(rest, known)
    if reader is None:
        return {p for c in streets if not c.sure for p in contexts(rest, c.start, c.end)}
    accepted = [(c.start, c.end) for c in streets if c.sure or any(p in reader.patterns["address"] for p in contexts(rest, c.start, c.end))]
    if accepted:
        rest = _blank(rest, accepted)
    found = {p for c in numbers(rest) for p in contexts(rest, c.start, c.end)}
    one = set(known)
    for c in names(rest):
        one |= {c.given, c.surname}
        found.update(contexts(rest, c.start, c.end))
    low = list(LOWER.finditer(rest))
    one.update(m.group() for m in low)
    for x, y in zip(low, low[1:]):
        gap = rest[x.end():y.start()]
        if len(gap) <= 12 and _BETWEEN.fullmatch(gap):
            found.update(contexts(rest, x.start(), y.end()))
    one.update(m.group(1).split()[-1] for m in _LOW_TITLE.finditer(rest))
    return found | one | {p for w in one if "-" in w for p in w.split("-")}


#: Between quoted parts: the value of a key, then marks, words of JSON and numbers too short to be an item.
_CALM = re.compile(r"\s*(?=[:,{}\[\]])(?::\s?-?\d+(?:\.\d+)?(?![ .\-/()]*\d))?(?:(?!\d[\d ().\-/]{5,})[\s:,{}\[\]\d.\-truefalsn])*")
#: What every e-mail address, number, name and address of more than one word has.
_STIR = re.compile(rf"[^\W\d_]\S*\s\S|[@＠\\]|%40|{_BRACKETED_AT.pattern.replace('at', '[aA][tT]')}|\d[\d ().\-/]{{5,}}|[A-Z]\d|(?:{DIGIT_WORDS})-(?:{DIGIT_WORDS})-")
_BLANK = re.compile(r"\s")


class Gate:
    """Tells texts that can hold nothing: all their quoted parts are short known strings without a candidate."""

    MOST = 50_000

    def __init__(self):
        self.calm: set[str] = set()

    def opening(self, text: str) -> tuple[int, int] | None:
        """Where the text can hold items: from the key before the first part in doubt to the end of the last. None: nowhere."""
        calm, at, starts, first, last = self.calm, 0, [], None, 0
        for part in text.split('"'):
            starts.append(at)
            quote = '"' if at else ""  # what is before the part
            at += len(part) + 1
            if quote and part in calm:
                continue
            if not (quote and _CALM.fullmatch(part)) and _STIR.search(part) and not self._plain(part, quote):
                if first is None:
                    first = starts[-3] if len(starts) > 2 else 0
                last = at - 1
            elif quote and len(part) <= 40 and len(calm) < self.MOST:
                calm.add(part)
        return None if first is None else (max(0, first - 1), last + 1)

    @staticmethod
    def _plain(part: str, quote: str) -> bool:
        if "\\" in part:
            return False
        if _BLANK.search(part):
            return len(part) <= 40 and not (emails(part) or numbers(quote + part) or names(part) or addresses(part) or LOWER.search(part))
        return not (emails(part) or numbers(quote + part))  # names and addresses have blanks


def items(text: str, gate: Gate, reader: Reader) -> list[tuple[int, int, str]]:
    """(start, end, kind) in the text as it is, escapes and all."""
    span = gate.opening(text)
    if span is None:
        return []
    plain, places = unescape(text[span[0]:span[1]])
    found = reader.read(plain)
    if places is not None:
        found = [(places[a], places[b - 1] + 1 if places[b] == places[b - 1] + 1 else places[b], k) for a, b, k in found]
    return [(a + span[0], b + span[0], k) for a, b, k in found]


def redact(text: str, gate: Gate, reader: Reader) -> str:
    """The text with placeholders, everything else as it was."""
    out, last = [], 0
    for a, b, kind in items(text, gate, reader):
        out += [text[last:a], PLACEHOLDER[kind]]
        last = b
    return "".join(out) + text[last:]

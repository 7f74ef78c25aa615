"""Personal information inside free text (problem 10).

Method: generators with high recall propose overlapping spans for each kind; boosted trees judge each span by its format
and its context; spans above the calibrated threshold of their kind are replaced by placeholders that name the kind.

The trees are fitted on sentences made by :mod:`.pii_lessons` (``LESSONS`` of them, from a fixed seed), once for each
driver; the executors get the fitted trees.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
#: Sentences that the trees are fitted on.
LESSONS = 8000
#: Recall weighs so many times as much as precision when thresholds are set: a name left in costs more than a word taken out.
BETA = 2.0

# Given names that are common in several languages.
GIVEN = frozenset("""
Adam Ahmed Aisha Akira Alan Alejandro Alex Alexander Ali Alice Amara Amina Ana Andrea Andrei Angela Anna Anne Antonio Arjun Astrid Barbara Beatriz Benjamin
Bruno Carla Carlos Carmen Carol Catherine Charles Charlotte Chidi Chloe Christine Clara Claire Daniel David Deepa Diana Diego Dmitri Edward Elena Elif
Elizabeth Emily Emma Eric Esther Eva Fatima Felix Fiona Frank Gabriel George Grace Greta Hana Hannah Hans Hassan Helen Helena Henry Hiro Hugo Ibrahim Ingrid
Irene Isabel Ivan Jack Jacob James Jan Jane Javier Jean John Jonas Jorge Jose Joseph Juan Julia Karin Karl Kate Kenji Kofi Lars Laura Leila Lena Leon Linda
Lucia Lucy Lukas Luis Magnus Marco Maria Marie Mario Mark Marta Martin Mary Maya Mei Mehmet Michael Miguel Miriam Mohammed Monika Nadia Natalia Nicolas Nils
Nina Noah Nora Olga Oliver Omar Oskar Pablo Patricia Paul Paula Pavel Pedro Peter Petra Priya Rachel Rafael Ravi Rebecca Richard Robert Rosa Samira Samuel Sara
Sarah Sofia Sophie Stefan Stephen Susan Sven Tariq Teresa Thomas Tomas Ulrich Vera Victor Walter Wei William Yuki Yusuf Zofia
""".split())
# Forms of address before a family name.
TITLES = "Mr Mrs Ms Miss Dr Prof Professor Frau Herr Mme Madame Monsieur Señor Señora Sr Sra Sir Doctor Dra Dott Ing".split()
# Words of places, works and results that bear names.
NAMED_THINGS = frozenset("""
basin sea river lake bay mountain mountains valley theorem lemma conjecture equation inequality transform law effect street road lane avenue square bridge
island islands glacier desert hills range plateau strait gulf coast peninsula university institute college museum library algorithm model distribution process
number numbers prize award map school group method survey view formation crater plain creek falls forest park station airport county province district
""".split())

_CAP = r"[A-ZÀ-ÖØ-Þ][\w’']*[a-zß-öø-ÿ][\w’']*(?:-[A-ZÀ-ÖØ-Þ][\w’']+)?"
_PARTICLE = r"(?:van der|van den|van de|van|von|de la|de|del|della|di|da|dos|bin|al|el|le|la|ter|zu)"
_FAMILY = rf"(?:{_PARTICLE}[ ])?{_CAP}"
_TITLE = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\b\.?[ ]+(?:{_CAP}(?:[ ][A-Z]\.)?(?:[ ]{_FAMILY})?|[A-Z]\.[ ]{_FAMILY}|{_FAMILY}(?:,[ ]{_CAP})?)")
# A capitalised word of any script, small letters or not; an initial; words of scripts that have no capitals.
_UPPER = r"\p{Lu}[\p{L}\p{M}’']*(?:-\p{Lu}[\p{L}\p{M}’']*)?"
_RUN = regex.compile(rf"(?<![\p{{L}}\p{{N}}@.])(?:\p{{Lu}}\.[ ]?|{_UPPER}[ ])(?:\p{{Lu}}\.[ ]?){{0,2}}(?:{_PARTICLE}[ ])?{_UPPER}(?:[ ](?:{_PARTICLE}[ ])?{_UPPER}){{0,2}}(?![\p{{L}}\p{{N}}@])")
_COMMA_NAME = regex.compile(rf"(?<![\p{{L}}\p{{N}}@.])(?:{_PARTICLE}[ ])?{_UPPER},[ ]{_UPPER}(?:[ ]\p{{Lu}}\.)?(?![\p{{L}}\p{{N}}@])")
_UPPER_START = regex.compile(r"(?<=[ ])\p{Lu}")
_SPACED = re.compile(r"[ .]\S")
# Words before and behind persons' names, in several languages.
_CUE_WORDS = (
    *"signed|thanks to|thank you|thanks|spoke with|spoke to|talk to|according to|cc|bcc|attn|author|name|user|reader|patient|customer|speaker|contact|photo|dear|hello|hi|love|sincerely|regards|wishes|truly".split("|"),
    *(f"{x} by" for x in "written reviewed edited posted checked noted translated compiled text photo photograph left".split()),
    *"merci à|danke an|gracias a|laut|selon|según|auskunft von|auteur|autor|verfasst von|firmado|firmado por|signé|подпись|автор|署名|作者".split("|"),
)
_STRONG = "|".join(sorted(_CUE_WORDS, key=lambda x: (-len(x), x)))
_CUED = regex.compile(rf"\"?[ ]*[:：=,(\"]*[ ]*(?P<n>(?:\p{{Lu}}\.[ ]?){{0,2}}{_UPPER}(?:[ ](?:{_PARTICLE}[ ])?{_UPPER}){{0,3}}|\p{{Lo}}[\p{{Lo}}\p{{M}}]+(?:[ ·]\p{{Lo}}[\p{{Lo}}\p{{M}}]+){{0,3}})(?![\p{{L}}\p{{N}}@])")
_STRONG_AHEAD = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?i:{_STRONG})\"?[ ]*[:：=,(\"]*[ ]*$")
_MARK_AHEAD = re.compile(r"(?:[\w\"][ ]?[:：=]\s*\"?|^-- ?)$")
_PERSON_VERB = r"asked|told|met|meet|thank|thanked|called|heard|knows?|knew|saw|invited|interview(?:ed)? with|helped|emailed|letter from|house of|addressed to|letters? (?:to|for)|parcels? (?:to|for)|interview with|talk with|chat with|conversation with|neighbou?r|friend|colleague|grateful to|indebted to|but|that|what"
_VERB_AHEAD = re.compile(rf"\b(?:{_PERSON_VERB}|\w+(?:ed|en|wn|ght|ade|ung) by|(?:send|give|hand|post|mail|write|wrote|sent|gave|bring|brought|deliver(?:ed)?|ship|forward|return)\b[^.]{{0,24}} to)[ ]$", re.I)
_PLACE_AHEAD = re.compile(r"\b(?:in|at|near|outside|inside|of|on|around|between|north|south|east|west|visit|visited|travelled|traveled|towards|beyond|across|under|within|en|à|in der|bei|the|every|each|some|most|university|city|mount|table|figure|chapter|species|genus)[ ](?:the[ ])?$", re.I)
_NAME_BEHIND = re.compile(r"[ ]*\((?:born|retired|\d)|,[ ](?:personal|in conversation|aged|\d{1,4}[A-Za-z]?,?[ ])|['’]s[ ]|,?[ ](?:who|asked|disagree[sd]|left|wrote|writes|said|says|told|thinks|thought|agree[sd]|replie[sd]|noted|kept|had|has|will|was born|lives|works|explained|argued|added|called|and the others)\b")
# Capitalised words that begin sentences and headings and no names.
_OPENERS = frozenset("""
a above according after against all an and another around as at auf aus because before behind below between beyond both but by das dear der des die during ein eine el en end every following for from
her his how if im in inside la las le les los main most near no not of old on our outside over sin since some such table thanks that the their these this those to un una under une unlike until we when
where which while whose with within without contact signed photo merci regards saint auskunft brief nachricht steuer-id steuer id ni passport reisepass ssn dni nie notes telephone téléphone phone tel fax mobile email mail address
""".split())
_EMAIL = re.compile(
    r"[^\W_][\w.+%\-]*@[\w\-]+(?:\.[\w\-]+)*|[^\W_][\w.+%\-]*[ ]@[ ][\w\-]+(?:\.[\w\-]+)*"
    r"|[^\W_][\w.+%\-]*[ ]?(?:\(at\)|\[at\]|\{at\}|<at>|\(@\)|&#64;|%40|＠)[ ]?[\w\-]+(?:[ ]?(?:\.|\(dot\)|\[dot\]|\{dot\})[ ]?[\w\-]+)+"
    r"|[^\W_][\w.+%\-]*[ ](?:at|arroba)[ ][\w\-]+(?:[ ](?:dot|punto)[ ][\w\-]+)+|(?<!\w)@\w+", re.IGNORECASE)
#: Strings one of which every candidate of a kind holds; looked for before the patterns, as plain strings are found faster.
_EMAIL_SIGNS = ("@", "＠", "&#64;", "%40", "(at)", "[at]", "{at}", "<at>", " dot ", " punto ", "(AT)", "[AT]", "{AT}", " DOT ")
_ADDRESS_SIGNS = ("Street", "Road", "Lane", "Avenue", "Drive", " Close", "Court", " Way", "Boulevard", "Square", "Place", "Terrace", "Crescent", "Gardens", " St,", " St.", " St ", " St\n", " Rd", " Ave", " Blvd", " Ln", " rue ", " avenue ", " boulevard ", " place ", " chemin ", " impasse ", " allée ", " quai ", "Calle ", "Avenida ", "Avda", "Plaza ", "Paseo ", "Camino ", "Via ", "Viale ", "Piazza ", "Corso ", "Rua ", "Travessa ", "straße ", "strasse ", "weg ", "platz ", "gasse ", "allee ", "ufer ", "damm ", "str. ", "ул", "просп", "пер.")
_ADDRESS_SIGNS += tuple(x.upper() for x in _ADDRESS_SIGNS if x.isascii())
_TITLE_SIGNS = tuple(f"{t}{e}" for t in TITLES for e in (" ", "."))


def _automaton(words: dict[str, object]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w, v in words.items():
        a.add_word(w, v)
    a.make_automaton()
    return a


#: All signs are looked for in one pass over a text, all cues in one over its small letters.
_SIGNS = _automaton({**dict.fromkeys(_ADDRESS_SIGNS, "address"), **dict.fromkeys(_TITLE_SIGNS, "title"), **dict.fromkeys(_EMAIL_SIGNS, "email")})
_CUE_FINDER = _automaton({w: len(w) for w in (*_CUE_WORDS, "by")})


def _small(text: str) -> str:
    """Small letters, each in the place of its own."""
    t = text.lower()
    return t if len(t) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


_DIGITS = re.compile(r"\d[\dA-Z ().\-/]{3,}[\dA-Z]")
_NUMBER = re.compile(
    r"(?<![\w.,/\-])(?:tel:)?(?:\+\d{1,3}[ .\-]?(?:\d[ .\-])?|00\d{2}[ .\-]?(?:\d[ .\-])?|0?\d[ .](?=\d\d[ .]))?(?:\(0?\d{1,4}\)[ .\-/]?)?\d{2,12}(?:[ .\-/]\d{2,11}){0,6}(?:,?[ ](?:ext|extension|poste|Durchwahl|x)\.?[ ]?\d{1,5})?(?![\w])"
    r"|(?<![\w.,/\-])(?:tel:)?\(\d{2,5}\)[ .\-/]?\d{2,12}(?:[ .\-/]\d{2,11}){0,6}(?:,?[ ](?:ext|x)\.?[ ]?\d{1,5})?(?![\w])")
_CODE = re.compile(r"(?<![\w./\-])[A-Z]{0,5}[ \-]?\d[A-Z0-9]*(?:[ .\-]\d[A-Z0-9]*){0,6}(?:[ \-][A-Z])?(?![\w])")
_STREET = r"(?:Street|Road|Lane|Avenue|Drive|Close|Court|Way|Boulevard|Square|Place|Terrace|Crescent|Gardens|St|Rd|Ave|Blvd|Ln)"
_ADDRESS = re.compile(
    rf"(?:(?:Flat|Apt|Apartment|Unit|Suite)\.?[ ]\d+[A-Z]?,[ ])?\b\d{{1,5}}[A-Za-z]?[ ](?:{_CAP}[ ]){{0,4}}{_STREET}\b(?:\.?,[ ](?:Flat|Apt|Apartment|Unit|Suite)\.?[ ]\d+[A-Z]?\b)?"
    rf"|\b\d{{1,5}}[A-Z]?[ ](?:(?!(?:THE|AN|OF|ON|IN|AND|TO|FOR|BY|PER|AT|FROM|WITH)[ ])[A-ZÀ-Þ’'-]{{2,}}[ ]){{1,4}}{_STREET.upper()}\b(?:\.?,[ ](?:FLAT|APT|APARTMENT|UNIT|SUITE)\.?[ ]\d+[A-Z]?\b)?"
    r"|\b\d{1,4}(?:[ ]?(?:bis|ter))?,?[ ](?:rue|avenue|boulevard|place|chemin|impasse|allée|quai)[ ](?:de[ ]la[ ]|de[ ]l[’']|de[ ]|du[ ]|des[ ]|d[’'])?[A-ZÀ-Þ][\w’'\-]+"
    r"|\b(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Via|Viale|Piazza|Corso|Rua|Travessa)[ ](?:de[ ]la[ ]|de[ ]|del[ ])?[A-ZÀ-Þ][\w’'\-]+,?[ ](?:n\.?º?[ ]?)?\d{1,5}[A-Za-z]?\b"
    r"|\b[A-ZÄÖÜ][\wäöüß\-]*(?:straße|strasse|weg|platz|gasse|allee|ufer|damm|str\.)[ ]\d{1,4}[ ]?[a-z]?\b"
    r"|(?:ул\.|улица|просп\.|проспект|пер\.)[ ][А-Я][\w\-]+,?[ ](?:д\.[ ]?)?\d{1,4}")

# Words that often stand near data of each kind.
_CUES = {
    "phone": r"phone|call|ring|mobile|cell|\btel|fax|téléphone|telefon|teléfono|dial|whatsapp|sms|text me|reach|hotline",
    "id": r"ssn|social security|tax id|steuer|passport|passeport|reisepass|pasaporte|\bdni\b|\bnie\b|\bnif\b|ni number|national insurance|identity|id card|ausweis|licen[cs]e|permis|insurance|taxpayer|national id|\bid no|personal no|codice fiscale|insee",
    "other": r"isbn|issn|doi|arxiv|version|release|checksum|accession|grant|coordinates|table|figure|page|chapter|section|order|invoice|ticket|weight|score|seed|commit|hash|build|model|serial|catalogue|edition|volume|lot|batch|token|value|pp\.",
    "address": r"address|adresse|anschrift|dirección|deliver|letters|moved|lives|return to|collected|visit|ship|send|mail to|post it|post to|located|residence",
    "name": r"thanks|merci|danke|gracias|signed|according|laut|selon|según|author|autor|auteur|written by|reviewed|edited|photo|spoke|contact|name|reader|patient|cc|by|dear|regards|wishes|sincerely|deliver|send|communication|from|met|told|asked|saludos",
}
_CUE = {k: re.compile(v, re.I) for k, v in _CUES.items()}
#: The cues that bear on a kind; others are not looked at for it.
_CUES_OF = {"email": (), "phone": ("phone", "id", "other"), "id_number": ("phone", "id", "other"), "address": ("other", "address"), "name": ("other", "address", "name")}
_ALNUM_PART = re.compile(r"[A-Za-z0-9]+")


def _digit_windows(text: str) -> list[tuple[int, int]]:
    """Where numbers of five signs or more stand, with room for what may belong to them, apart from each other."""
    out: list[tuple[int, int]] = []
    for m in _DIGITS.finditer(text):
        lo, hi = max(0, m.start() - 12), m.end() + 24
        while hi < len(text) and text[hi - 1].isalnum():
            hi += 1
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, min(hi, len(text))))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of every span that might be personal data; spans may overlap, within a kind too."""
    out: list[tuple[str, int, int]] = []
    mails: list[tuple[int, int]] = []
    signs = {kind for _, kind in _SIGNS.iter(text)}
    if "email" in signs:
        for m in _EMAIL.finditer(text):
            mails.append(m.span())
            out.append(("email", *m.span()))
    for lo, hi in _digit_windows(text):
        for m in _NUMBER.finditer(text, lo, hi):
            if sum(map(str.isdigit, m.group())) >= 7:
                out.append(("phone", *m.span()))
        for m in _CODE.finditer(text, lo, hi):
            s = m.group()
            if len(s) >= 6 and sum(map(str.isdigit, s)) >= 5:
                lead = len(s) - len(s.lstrip(" -"))
                out.append(("id_number", m.start() + lead, m.end()))
    if "address" in signs:
        out += [("address", *m.span()) for m in _ADDRESS.finditer(text)]
    inside = lambda a: any(x <= a < y for x, y in mails)
    seen = set()
    for m in _TITLE.finditer(text) if "title" in signs else ():
        if not inside(m.start()) and m.span() not in seen:
            seen.add(m.span())
            out.append(("name", *m.span()))
    for m in _RUN.finditer(text):
        # every run, and what is left of it without words that it begins or ends with
        starts = [m.start(), *(y.start() for y in _UPPER_START.finditer(text, m.start() + 1, m.end()))]
        ends = [*(y - 1 for y in starts[2:]), m.end()]
        for x in starts:
            for y in ends:
                if (x, y) not in seen and _SPACED.search(text, x, y) and not inside(x):
                    seen.add((x, y))
                    out.append(("name", x, y))
    for m in _COMMA_NAME.finditer(text) if "," in text else ():
        if m.span() not in seen and not inside(m.start()):
            seen.add(m.span())
            out.append(("name", *m.span()))
    for last, size in _CUE_FINDER.iter(_small(text)):
        before = last - size
        if before >= 0 and text[before].isalnum() or last + 1 == len(text):
            continue
        m = _CUED.match(text, last + 1)
        if m and m.span("n") not in seen and not inside(m.start("n")):
            seen.add(m.span("n"))
            out.append(("name", *m.span("n")))
    return out


FEATURES = 47


def _folded(word: str) -> str:
    """A word without accents, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).lower()


_GIVEN_FOLDED = frozenset(map(_folded, GIVEN))


_NEXT = re.compile(r"[\s,]*([\w\-]+)")
_AT = re.compile(r"@|＠|&#64;|%40|\(at\)|\[at\]|\{at\}|<at>|\(@\)| at | AT | arroba ")
_DOT = re.compile(r"[.\s]|\(dot\)|\[dot\]|\{dot\}")
_IS_TITLE = re.compile(rf"(?:{'|'.join(TITLES)})\b")
_EXT = re.compile(r"ext|poste|x ?\d")
_THE = re.compile(r"\b[Tt]he $")
_UNITS = re.compile(r"as checksum|tokens|units|per |edition")
_MARK = re.compile(r"[=:(\"]\s*$")


_CAP_AHEAD = regex.compile(r"\p{Lu}[\p{L}’'.-]*[ ]$")
_CAP_BEHIND = regex.compile(r"[ ]\p{Lu}")
_REACH = re.compile(r"@|＠|\(at\)|\[at\]|\d{3}[ \-.]\d{3,}")


def _name_features(s: str, words: list[str], ahead: str, behind: str, alone: bool, after: str, next_word: str) -> list[float]:
    """What tells names outside any list: their form, and the words just before and after."""
    around = [c for c in ahead + behind if c.isalpha()]
    return [
        any(_folded(w) in _GIVEN_FOLDED for w in words), bool(_STRONG_AHEAD.search(ahead)), bool(_NAME_BEHIND.match(behind)), len(words[0].rstrip(".")) == 1 and s[1:2] == ".", s.isupper() and len(s) > 3,
        sum(c.isupper() for c in around) / max(1, len(around)), words[0].lower() in _OPENERS, not ahead.strip(), any(w.lower() in NAMED_THINGS for w in words) + 2 * any(w.lower() in _OPENERS for w in words[1:]),
        bool(_MARK_AHEAD.search(ahead)), bool(_VERB_AHEAD.search(ahead)), bool(_PLACE_AHEAD.search(ahead)), alone,
        bool(_CAP_AHEAD.search(ahead)), bool(_CAP_BEHIND.match(behind)), next_word in _OPENERS, bool(_REACH.search(after)),
    ]


def features(text: str, kind: str, a: int, z: int) -> list[float]:
    """Format and context of one span, as :data:`FEATURES` numbers."""
    s = text[a:z]
    ahead = text[max(0, a - 45) : a]
    cut = max(ahead.rfind("\n"), ahead.rfind(". "), -1)
    ahead = ahead[cut + 1 :]
    behind = text[z : z + 28].split("\n")[0]
    near = ahead[-22:]
    words = s.replace(",", " ").split()
    cues = [float(bool(c.search(near))) + float(bool(c.search(ahead))) if k in _CUES_OF[kind] else 0.0 for k, c in _CUE.items()]
    nxt = _NEXT.match(behind)
    next_word = nxt.group(1).lower() if nxt else ""
    if kind == "name":
        line = not text[max(0, a - 1) : a].strip(" ") or text[a - 1] == "\n"
        format_ = [0.0, float(len(s)), float(len(words)), *[0.0] * 6, s.count("."), s.count("-"), s.count(" "), 0.0, 0.0, 0.0]
        own = _name_features(s, words, ahead, behind, line and not behind.strip(), text[z : z + 60], next_word) if words else [0.0] * 17
        domain, tail = [""], ""
    else:
        parts = _ALNUM_PART.findall(s)
        digits = sum(c.isdigit() for c in s)
        letters = sum(c.isalpha() for c in s)
        format_ = [
            digits, letters, len(parts), len(parts[0]) if parts else 0, len(parts[-1]) if parts else 0, max(map(len, parts), default=0),
            s.startswith(("+", "tel:+")), s.startswith("00"), "(" in s, s.count("."), s.count("-"), s.count(" "), bool(_EXT.search(s)), s[:1].isalpha(), s[-1:].isalpha()]
        own = [0.0] * 17
        domain = _AT.split(s)
        tail = _DOT.split(domain[-1].strip())[-1] if len(domain) > 1 else ""
    return [
        *format_, *cues,
        any(w in GIVEN for w in words), bool(_IS_TITLE.match(s)), sum(w[:1].isupper() for w in words), bool(_THE.search(ahead)), next_word in NAMED_THINGS,
        next_word.split("-")[0] in NAMED_THINGS or next_word in ("changes", "closures", "level"), behind.startswith("-"), len(domain) > 1 and tail.isalpha() and len(tail) >= 2 and len(domain[0].strip()) > 0,
        bool(_UNITS.search(behind)), float(bool(_MARK.search(ahead))),
        *own,
    ]


@functools.lru_cache(maxsize=1)
def fitted(lessons: int = LESSONS) -> dict:
    """The calibrated trees of each kind; a fourth of the lessons is held out for calibration."""
    from .boosting import Calibrated
    from .pii_lessons import lesson

    rng = np.random.default_rng(20240117)
    xs: dict[str, list] = {k: [] for k in KINDS}
    ys: dict[str, list] = {k: [] for k in KINDS}
    for _ in range(lessons):
        text, gold = lesson(rng)
        for kind, a, z in candidates(text):
            hit = any(k == kind and min(z, y) - max(a, x) > (0.9 if kind == "name" else 0.6) * max(y - x, z - a) for k, x, y in gold)
            xs[kind].append(features(text, kind, a, z))
            ys[kind].append(float(hit))
    out = {}
    for k in KINDS:
        x, y = np.array(xs[k], float), np.array(ys[k])
        out[k] = Calibrated().fit(x, y, np.arange(len(y)) % 4 == 0, BETA)
    return out


def find_spans(texts: list[str | None], models: dict) -> list[list[tuple[str, int, int]]]:
    """The chosen spans of each text, in order and apart from each other: of overlapping ones the surest stays.

    A span that is only part of a chosen longer one of another kind does not count: digits of a phone number are no identity
    number, a name inside an address of electronic mail is no name.
    """
    found: list[tuple[int, str, int, int]] = []
    rows: dict[str, list] = {k: [] for k in KINDS}
    of: dict[str, list] = {k: [] for k in KINDS}
    for i, t in enumerate(texts):
        for kind, a, z in candidates(t) if t else ():
            of[kind].append(len(found))
            rows[kind].append(features(t, kind, a, z))
            found.append((i, kind, a, z))
    p = np.zeros(len(found))
    keep = np.zeros(len(found), bool)
    for k in KINDS:
        if rows[k]:
            q = models[k].probability(np.array(rows[k], float))
            p[of[k]] = q
            keep[of[k]] = q >= models[k].threshold
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for j in sorted(np.flatnonzero(keep), key=lambda j: (found[j][0], -round(p[j], 2), -(found[j][3] - found[j][2]), found[j][2])):
        i, kind, a, z = found[j]
        if not any(a < y and x < z for _, x, y in out[i]):
            out[i].append((kind, a, z))
    return [sorted(x, key=lambda s: s[1]) for x in out]


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """``text`` with each span replaced by its kind in brackets and capitals."""
    if not text or not spans:
        return text
    out, last = [], 0
    for kind, a, z in spans:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = z
    return "".join(out) + text[last:]


def redacted(docs: DataFrame, key: str, text: str, models: dict | None = None) -> DataFrame:
    """``(key, clean, kinds)`` of every row: the text with placeholders, and the distinct kinds replaced.

    Null and empty texts stay as they are with no kinds; keys may be null or repeated, other columns are ignored.
    """
    models = fitted() if models is None else models
    shared = docs.sparkSession.sparkContext.broadcast(models)  # about 0.1 MB, whatever the data
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["_t"]]
            spans = find_spans(texts, shared.value)
            yield pd.DataFrame({"_k": b["_k"], "clean": [redact(t, s) for t, s in zip(texts, spans)], "kinds": [sorted({k for k, _, _ in s}) for s in spans]})

    got = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t")).mapInPandas(run, f"_k {kind}, clean string, kinds array<string>")
    return got.withColumnRenamed("_k", key)

"""Made-up labelled sentences that the judge of personal data learns from.

Each lesson strings a few pieces together: personal data of each kind in several formats, with or without a cue, and
look-alikes that are none.  All names, numbers and addresses come from a generator.
"""

from __future__ import annotations

import string

import numpy as np

from .pii import GIVEN, TITLES

_GIVEN = sorted(GIVEN)
# Syllables of invented family and place names.
_SYLLABLES = "ba bel cor da del fen gar ha hol in jo ka kel la lun ma mer mo na nor ol pe pol qua ra rin sa ser sol ta tor ul va ver wen yar zel zim".split()
_THINGS = "rivers engines beetles novels proteins castles numbers meadows sensors markets violins orchards".split()
# Given names beside the list of the generator, with accents, in other scripts, and families that go with them.
_OTHER = "Jonathan Siobhán José Zoë Łukasz Øyvind Bjørn Renée Sören Thandiwe Nguyễn Çağla Rhiannon Gunther Percival Dorothea Anneliese Bartholomew Xochitl Wanjiru".split()
_SCRIPTS = [("Анна", "Петрова"), ("Сергей", "Волков"), ("Νίκος", "Παππάς"), ("Ελένη", "Δήμου"), ("Ольга", "Миронова"), ("Արամ", "Սարոյան")]
_UNCASED = ["田中太郎", "王小明", "محمد علي", "דוד כהן", "김민수", "राम शर्मा"]
# Frames for each kind, {} being the personal thing, and for texts without any; {f} and {g} are invented words, {t} a plural.
_NAME_FRAMES = """Kind regards,\\n{} ~ Best wishes, {} ~ Sincerely,\\n{} ~ Love, {} ~ Signed: {} ~ signed, {} ~ Yours truly\\n{} ~ -- {} ~ My neighbour {} was ill. ~ We met {} in Paris last week. ~ Yesterday {} told us the news. ~ {} said so twice.
{} wrote back at once. ~ {} thinks we should wait. ~ {}, aged 41, works at the mill. ~ {} was born in 1962. ~ Please ask {} about the keys. ~ I asked {} for help. ~ Talk to {} before Friday. ~ The interview with {} took an hour. ~ Interview with {} on farming ~ The band was founded by {} in spring. ~ a map drawn by {} ~ The prize was given by {}. ~ Give this to {}, please. ~ Mail the form to {} first. ~ A chat with {} about bread. ~ The baker, {}, said no. ~ Our teacher, {}, has left. ~ The letter to {} came back. ~ Parcels addressed to {} are kept here. ~ Many thanks to {} for reading a draft.
We are grateful to {} for comments. ~ Photo: {} ~ Photograph by {} ~ Text by {}. ~ Reviewed by {} ~ Edited by {}, second printing. ~ by {} ~ By {}\\n ~ Author: {} ~ author = {} ~ author={}; ~ "author": "{}", ~ "name": "{}" ~ name: {} ~ Name: {} ~ Full name: {} ~ user={}; ~ Patient: {} ~ Customer: {}
From: {} ~ To: {} ~ Cc: {} ~ cc {} ~ Attn: {} ~ Dear {}, ~ Hello {}, ~ Hi {}! ~ {}'s phone was off. ~ The house of {} was sold. ~ a letter from {} to her aunt ~ According to {}, rain is due. ~ as {} noted in an earlier message ~ ({}, personal communication) ~ ({}, in conversation)
The jury heard {} on Tuesday. ~ {} replied that nothing was missing. ~ {} disagrees with the plan. ~ {} and the others left early. ~ nobody but {} has the code ~ Meeting notes: {} will call the bank. ~ Spoke to {} today ~ Danke an {} für die Hilfe. ~ Merci à {} pour son aide. ~ Gracias a {} por la ayuda. ~ Laut {} ist alles fertig. ~ Ein Brief von {} kam an. ~ Nachricht von {} erhalten. ~ Auskunft von {}: keine. ~ Carta de {} recibida. ~ Selon {}, rien ne manque. ~ Según {}, no falta nada.
Verfasst von {} ~ Autor: {} ~ Auteur : {} ~ Contact {} with questions. ~ Contact: {} ~ Speaker: {} ~ the notes that {} kept ~ what {} asked us to do ~ the box {} had left in the hall ~ {} (retired) ~ {} (born 1970) ~ {}""".replace("\n", " ~ ").replace("\\n", "\n").split(" ~ ")
_SINGLE_FRAMES = "Signed, {} ~ signed: {} ~ Love, {} ~ author={}; ~ \"author\": \"{}\", ~ cc {} ~ Written by {}. ~ Edited by {} ~ Dear {}, ~ Hello {}, ~ Name: {} ~ name: {} ~ Kind regards,\n{}".split(" ~ ")
_EMAIL_FRAMES = "Write to {} today. ~ mail {} ~ E-mail: {} ~ ({}) ~ mailto:{} ~ email={}; ~ {} ~ Send the form to {}, please. ~ Escriba a {}. ~ <{}> ~ Bcc: {}".split(" ~ ")
_PHONE_FRAMES = "Call {} after six. ~ Phone: {} ~ Mobile {} ~ Tel. {} ~ {} ~ Our number is {}. ~ Téléphone : {} ~ please ring {} if late ~ Fax {} ~ text me on {} ~ Telefon {} ~ The shop ({}) is closed on Sundays. ~ The waiting room ({}) is upstairs. ~ The front office ({}) takes bookings. ~ WhatsApp: {}".split(" ~ ")
_ID_FRAMES = "Her card shows {}. ~ ({}) ~ Remove {} from that record. ~ On the form: {} ~ x=1;{};y=2 ~ My {} has changed. ~ {} ~ Applicant, {}, resident since 1999.".split(" ~ ")
_ADDRESS_FRAMES = "Address: {}, {} ~ Post it to {}, {}. ~ She moved from {}, {} to a farm. ~ {}, {} ~ He lives at {}, {}. ~ Anschrift: {}, {} ~ Return to {}, {}. ~ Dirección: {}, {}".split(" ~ ")
_PLAIN = """Near {f}, {t} are common. ~ Outside {f} {g} the road ends. ~ In {f}, {t} and {t} are sold. ~ Die {T} von {f} sind alt. ~ En {f} hay {t}. ~ À {f}, on trouve des {t}. ~ between {t} and {f} {g} {t} of the north ~ {t} fill {f} around {T} {g}. ~ ### {T_} ### ~ {F_} {G_} {T_} ~ ALL {T_} OF {F_} ARE FINITE ~ {T_} CURRENTS, WAVES AND {F_} {T_} ~ IN {F_} {G_} {T_} {T_} WERE COUNTED ~ SEE {T_} {T_} BELOW ~ don't they'll IT'S I'd ~ Notes Phone ~ shaped by {f} {t} and wind
{t} bounded by {f} and {g}. ~ {T} {g}\\n\\n{f} {t} ~ Main {T}: {f} {T} ~ # {f} {g}\\n{t} in {f} ~ # {T} in {f} ~ Since 1{d}, {f} has had {t}. ~ The city of {f} {g} lies inland. ~ University of {f} {g} ~ {f} University press ~ Ministry of {T}, {f} ~ on the {f} {g} coast ~ north of {f} {g} ~ from {f} {g} to {g} ~ set apart from {f}\\n> {t} ~ it follows from {f} {T} ~ THIS FOLLOWS FROM {F_} {T_}, AT LEAST FOR {T_} ~ ACCORDING TO THE {F_} STUDY ~ tell {t} from {f} ~ von {f} nach {g} ~ Berichte von {T} und {f} ~ Every {f} {T} is compact.
Table {n}: {T} in {f} ~ Figure {n} {f} {T} ~ Chapter {n}. {f} {T} ~ According to the {f} {T}, yields fall. ~ {T} According to Size ~ Mount {f} is snowy. ~ Saint {f} Church stands there. ~ the {n}th {f} {T} Congress ~ New {f} is larger than Old {g}. ~ The {f} of {g} by night ~ Under {f} {g}, {t} grow faster. ~ After {f} came {g}. ~ {f} -> {g} {T} -> {T} of {f} ~ {f} {T} -> {g} {T}
{f} {T}, {g} {T}, {f} {g} ~ {f} is a genus of {t}. ~ {f} {g} is a species of {t}. ~ Most {t} in Upper {f} are wild. ~ By {f} standards this is low. ~ By {t}, by {f} or by {g} ~ This holds by {f} {g} duality. ~ sold by {f} {T} Ltd ~ translated from {f} by machine ~ These {t} came from {f} {g}. ~ Visit {f} {g} in spring. ~ We travelled to {f} {g}. ~ Dear Reader, ~ Dear all, ~ signed a treaty with {f} ~ {t}, contact and trade in {f}
With {f} {t}, costs rise. ~ Lower {f} and Upper {f} were joined. ~ Some {f} {T} and Other {T} ~ In {f} and {g}, Monday is free. ~ {f} Street Market opens early. ~ The name {f} means hill. ~ named after {f} the hill ~ name of the {f} {t} ~ author of {f} guides ~ Photo of {f} {g} bridge ~ editor: none ~ Thanks to {f} {t}, prices fell. ~ Thanks to {t} from {f}. ~ The {f} effect and {f} {g} model""".replace("\n", " ~ ").replace("\\n", "\n").split(" ~ ")


class _Maker:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def pick(self, xs):
        return xs[int(self.rng.integers(len(xs)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def n(self, lo: int, hi: int) -> int:
        return int(self.rng.integers(lo, hi + 1))

    def digits(self, k: int) -> str:
        return "".join(str(self.n(0, 9)) for _ in range(k))

    def capitals(self, k: int) -> str:
        return "".join(self.pick(string.ascii_uppercase) for _ in range(k))

    def family(self) -> str:
        return "".join(self.pick(_SYLLABLES) for _ in range(self.n(2, 4))).capitalize()

    def name(self) -> str:
        g, f = self.pick(_GIVEN), self.family()
        t = self.pick(TITLES) + self.pick([".", "", "."])
        return self.pick([f"{g} {f}", f"{g} {f}", f"{g} {self.capitals(1)}. {f}", f"{g} {self.pick(['van', 'de', 'von'])} {f}", f"{g} {f}-{self.family()}", f"{f}, {g}", f"{t} {g} {f}", f"{t} {f}", f"{t} {f}", f"{t} {self.capitals(1)}. {f}"])

    def other_name(self) -> str:
        """A name that no list gives away."""
        g, f = (self.pick(_OTHER), self.family()) if self.chance(0.5) else (self.family(), self.family())
        if self.chance(0.2):
            g, f = self.pick(_SCRIPTS)
        i = self.capitals(1)
        return self.pick([f"{g} {f}", f"{g} {f}", f"{g} {i}. {f}", f"{i}. {f}", f"{i}. {f}", f"{i}. {self.capitals(1)}. {f}", f"{g} {f}".upper(), f"{self.pick(_GIVEN)} {f}".upper(), f"{g} {self.pick(['van', 'de', 'von'])} {f}", f"{g} {f}-{self.family()}"])

    def email(self) -> str:
        f = self.family().lower()
        user = self.pick([f, f"{self.pick(_GIVEN).lower()}.{f}", f"{f}{self.n(1, 99)}", f"{f[0]}_{f}", f"{f}+list", "info", "contact"])
        at, dot = self.pick([("@", ".")] * 4 + [(" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("＠", "."), ("%40", ".")])
        host = dot.join([*([self.pick(["mail", "lab", "dept"])] if self.chance(0.4) else []), self.family().lower(), self.pick(["com", "org", "example", "invalid", "de", "net", "co"])])
        return user + at + host

    def phone(self) -> str:
        d = self.digits
        return self.pick([
            f"+1 {d(3)} 555 {d(4)}", f"({d(3)}) 555-{d(4)}", f"({d(3)}) 555 {d(4)}", f"{d(3)}-555-{d(4)}", f"+1.{d(3)}.555.{d(4)}", f"+49 {d(2)} {d(5)} {d(3)}", f"0049-{d(2)}-{d(8)}", f"020 {d(4)} {d(4)}", f"0{d(3)} {d(6)}", f"+44 20 {d(4)} {d(4)}",
            f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 900 {d(3)} {d(3)}", f"tel:+1{d(10)}", f"{d(3)} 555 {d(4)} ext. {d(3)}", f"+1 ({d(3)}) 555-{d(4)}", f"(0{d(2)}) {d(4)} {d(4)}", f"(0{d(3)}) {d(6)}", f"0{d(2)} {d(6)}", f"0{d(2)} {d(8)}", f"0{d(4)} {d(6)}", f"{d(3)} {d(3)} {d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"+86 1{d(10)}"])

    def id_number(self) -> tuple[str, str]:
        d, c = self.digits, self.capitals
        return self.pick([
            ("SSN", f"9{d(2)}-{d(2)}-{d(4)}"), ("social security number", f"{d(3)} {d(2)} {d(4)}"), ("tax ID", f"{d(3)}-{d(2)}-{d(4)}"), ("tax ID", f"{d(2)}-{d(7)}"), ("passport no.", f"{c(2)}{d(7)}"), ("passport number:", f"{c(1)}{d(8)}"), ("Reisepass", f"{c(1)}{d(8)}"),
            ("DNI", f"{d(8)}-{c(1)}"), ("DNI", f"{d(8)}{c(1)}"), ("NI number", f"{c(2)} {d(2)} {d(2)} {d(2)} {c(1)}"), ("ID card", f"{d(4)}-{d(4)}-{d(2)}"), ("identity card", f"{c(3)}{d(6)}"), ("Steuer-ID", f"{d(2)} {d(3)} {d(3)} {d(3)}"), ("national identity number", f"{d(6)}-{d(5)}"),
            ("driving licence", f"{c(5)}{d(6)}{c(1)}{d(1)}{c(2)}"), ("driver's license", f"{c(1)}{d(7)}"), ("passport=", f"{c(2)}{d(7)}"), ("insurance number", f"{d(2)}{d(6)}{c(1)}{d(3)}"), ("numéro INSEE", f"1 {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}")])

    def address(self) -> str:
        f = self.family()
        return self.pick([
            f"{self.n(1, 250)} {f} {self.pick(['Street', 'Road', 'Lane', 'Avenue', 'Drive', 'Close'])}", f"{self.n(1, 99)}{self.pick('ABC')} {f} Street", f"Flat {self.n(1, 30)}, {self.n(1, 200)} Old {f} Road", f"{self.n(1, 90)}, rue de {f}",
            f"{self.n(1, 90)} rue {f}", f"Calle {f}, {self.n(1, 90)}", f"Avenida de {f} {self.n(1, 90)}", f"{f}straße {self.n(1, 90)}", f"{f}weg {self.n(1, 90)}", f"Via {f} {self.n(1, 90)}",
            f"{self.n(1, 300)} {f.upper()} {self.pick(['ROAD', 'STREET', 'AVE', 'BLVD', 'LANE'])}, APT {self.n(1, 40)}{self.pick('ABC')}", f"{self.n(1, 300)} {f} {self.pick(['Road', 'St', 'Ave'])}, Apt {self.n(1, 40)}"])

    def plain(self) -> str:
        """A sentence with places, headings and the like, and nothing personal."""
        t, f, g = self.pick(_THINGS), self.family(), self.family()
        if self.chance(0.2):
            f = self.pick(_GIVEN)
            return self.pick(["The {f} {x} is steep.", "near the {f} {x}", "by the {f} {x}, we are done", "the {f} {x} and its {t}", "Saint {f} {x}", "Proof of the {f} {x}"]).format(f=f, x=self.pick(["Basin", "River", "Valley", "Bay", "Bridge", "theorem", "lemma", "conjecture", "Lake", "equation", "Museum", "Island"]), t=t)
        return self.pick(_PLAIN).format(f=f, g=g, t=t, T=t.capitalize(), F_=f.upper(), G_=g.upper(), T_=t.upper(), n=self.n(1, 40), d=self.digits(3))

    def numbers(self) -> str:
        """A sentence with numbers, codes or signs that name nobody."""
        d, c, f, t = self.digits, self.capitals, self.family(), self.pick(_THINGS)
        return self.pick([
            f"ISBN 978-3-{d(2)}-{d(6)}-{d(1)}", f"ISBN 978-0-{d(2)}-{d(6)}-{d(1)} (cloth)", f"ISSN {d(4)}-{d(4)}", f"accession number {c(3)}-{d(6)}, 20{d(2)}-0{self.n(1, 9)}-{self.n(10, 28)}", f"funded by grant {c(2)}-{d(4)}-{d(2)}", f"{d(2)}.{d(4)} N, {d(2)}.{d(4)} E", f"at {d(2)}.{d(5)}, -{d(2)}.{d(5)}",
            f"release {self.n(1, 20)}.{self.n(0, 9)}.{self.n(0, 9)}, checksum {d(3)}-{d(4)}", f"{self.n(1, 9)} {d(3)} {d(3)} units @ 3 per box", f'{{"key": {d(5)}, "value": {d(2)}.{d(4)}}}', f"arXiv:{d(4)}.{d(5)}v{self.n(1, 9)}, doi:10.{d(4)}/{f.lower()}.{d(3)}", f"doi:10.{d(4)}/{d(3)}", f"https://doi.org/10.{d(4)}/{d(6)}", f"order {c(2)}{d(7)} has arrived", f"invoice no. {d(4)}-{d(4)}-{d(2)}",
            f"between {d(4)} and {d(4)}, {d(5)} {t}", f"{self.n(1, 9)} {d(3)} {d(3)} {t} a year", f"Table {d(1)} gives {d(3)} {d(3)} {d(4)}", f"{t} {d(4)} {d(4)}, {t}", f"in 1{d(3)} {d(4)} {d(5)} {t}", f"{f} {d(4)} {d(4)} {t}", f"{self.n(1, 9)} {self.pick(['Lane', 'Street', 'Road'])} closures per month", f"Table {self.n(1, 9)} {self.pick(['Street', 'Road'])}-level data",
            f"{self.n(1, 90)} HIGH {self.pick(['ROAD', 'LANE'])} CLOSURES PER MONTH", f"hey @{f.lower()} see above", f"thanks @{f.lower()}!", f"1{d(3)}-1{d(3)}: {t}", f"pp. {d(3)}-{d(3)}", f"commit {d(7)}", f"room {d(3)}, shelf {c(1)} {d(4)} {d(3)}", f"20{d(2)}-0{self.n(1, 9)}-{self.n(10, 28)} {self.n(10, 23)}:{self.n(10, 59)}:{self.n(10, 59)}"])

    def piece(self) -> tuple[str, list[tuple[str, str]]]:
        """A sentence, and the kinds and strings in it that are personal."""
        k = self.n(0, 19)
        if k <= 4 and self.chance(0.12):  # signatures
            x, mail, tel = self.name() if self.chance(0.5) else self.other_name(), self.email(), self.phone()
            frame = self.pick(["--\n{x}\n{p}", "--\n{x}\n{p}\n{m}", "--\n{x}\n{m}", "{x} <{m}>", "{x} ({m})", "-- {x} ({m})", "* {x} ({m})", "{x}, {m}", "{x}, {p}", "Regards\n{x}\n{m}"])
            return frame.format(x=x, m=mail, p=tel), [("name", x), *([("phone", tel)] if "{p}" in frame else []), *([("email", mail)] if "{m}" in frame else [])]
        if k <= 4:
            x = self.name() if k <= 1 else self.other_name() if k <= 3 or self.chance(0.5) else self.pick(_UNCASED)
            if x in _UNCASED:
                return self.pick(_SINGLE_FRAMES).format(x), [("name", x)]
            return self.pick(_NAME_FRAMES).format(x), [("name", x)]
        if k == 5:
            x = self.family() if self.chance(0.7) else self.pick(_GIVEN)
            return self.pick(_SINGLE_FRAMES).format(x), [("name", x)]
        if k == 6:
            x = self.email()
            return self.pick(_EMAIL_FRAMES).format(x), [("email", x)]
        if k <= 8:
            x = self.phone()
            return self.pick(_PHONE_FRAMES).format(x), [("phone", x)]
        if k <= 10:
            cue, x = self.id_number()
            return self.pick(_ID_FRAMES).format(cue + ("" if cue.endswith("=") else " ") + x), [("id_number", x)]
        if k == 11:
            x, y = self.address(), self.family()
            if self.chance(0.3):
                who = self.name() if self.chance(0.5) else self.other_name()
                return self.pick(["Send it to {w}, {x}, {y}.", "Bring this to {w}, {x}, {y}", "{w}, {x}, {y}", "For {w}, {x}"]).format(w=who, x=x, y=y), [("name", who), ("address", x)]
            return self.pick(_ADDRESS_FRAMES).format(x, y), [("address", x)]
        return (self.numbers() if k <= 14 else self.plain()), []


def lesson(rng: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """``(text, [(kind, start, end)])``."""
    m = _Maker(rng)
    text, gold = "", []
    for _ in range(m.n(1, 4)):
        s, xs = m.piece()
        for kind, x in xs:
            at = s.index(x)
            gold.append((kind, len(text) + at, len(text) + at + len(x)))
        text += s + m.pick([" ", "\n", " ", "\n\n", ". "])
    return text, gold

"""Personal data with a shape of its own: register entries, accounts, phone numbers, streets, towns, companies.

A loose pattern finds where one may stand, and functions check what stands around
it. Each finder gives (category, start, end) of its matches in a text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from logquarry.functions.words import PARTICLES, Phrases, Token, blank, fold, is_name, tokens

Found = tuple[str, int, int]

# Fixed values.
LEGAL_FORMS = [
    "GmbH & Co. KG", "GmbH & Co KG", "GmbH&Co. KG", "GmbH & Co.KG", "gGmbH", "GmbH", "mbH", "AG", "KGaA", "KG", "OHG", "GbR", "UG (haftungsbeschränkt)", "UG",
    "e. K.", "e.K.", "e. V.", "e.V.", "eG", "SE", "Ltd.", "Ltd", "Limited", "Inc.", "Inc", "LLC", "Corp.", "Corp", "S.A.", "B.V.", "S.r.l.", "S.p.A.",
]
STREET_ENDINGS = "straße strasse str. weg allee gasse chaussee".split()
STREET_WORDS = "Straße Strasse Str. Weg Allee Platz Gasse Ring Damm Ufer Chaussee Markt Graben Steig Stieg Pfad Kamp".split()
COUNTRIES = "D DE A AT CH".split()
TOWN_WORDS = "am an im in ob vor der dem den bei".split()
COURTS = ["Amtsgericht", "Registergericht"]
REGISTERS = "HRB HRA GnR VR".split()
# Words before a phone number, those that need a colon, and words that follow a number that isn't a postcode.
PHONE_WORDS = "tel telefon fon fax telefax mobil mobilfunk mobile handy phone durchwahl zentrale".split()
PHONE_COLON_WORDS = "toll-free,toll free,tollfree,local,direct,direkt,main,office,büro,cell,hotline,switchboard".split(",")
COUNTED = (
    "bytes byte kb mb gb tb dateien datei files file messages message nachrichten nachricht mails "
    "einträge zeilen sekunden minuten stunden tage fehler benutzer user users items objekte ordner"
).split()


def _joins(text: str, at: int) -> bool:
    """Whether a word goes on at ``at``."""
    return text[at : at + 1].isalnum() or text[at : at + 1] == "_"


def _opens(text: str, at: int, also: str = "") -> bool:
    """Whether a word can begin at ``at``: not inside one, but at a capital glued to a small letter."""
    before = text[at - 1 : at]
    if not (before.isalnum() or before == "_" or before and before in also):
        return True
    return before.islower() and text[at : at + 1].isupper()


# Companies

_FORM = re.compile(r"[ \t](?:" + "|".join(re.escape(f) for f in sorted(LEGAL_FORMS, key=len, reverse=True)) + r")(?!\w)")
_FORM_ENDS = tuple(f" {f}" for f in LEGAL_FORMS)
_SIGNS = frozenset("&.+'-_")


def ends_in_form(value: str) -> bool:
    """Whether a value is, or ends in, a legal form."""
    value = value.replace("\t", " ")
    return value in LEGAL_FORMS or value.endswith(_FORM_ENDS)


def companies(text: str) -> Iterator[Found]:
    """Up to four words before a legal form, one blank apart; each begins with a capital or a digit."""
    last = 0
    for form in _FORM.finditer(text):
        start, at = None, form.start()
        for _ in range(4):
            begin = at
            while begin > last and (text[begin - 1].isalnum() or text[begin - 1] in _SIGNS):
                begin -= 1
            word = begin
            # A word may begin at a capital glued to a small letter.
            while word < at and not ((text[word].isupper() or text[word].isdigit()) and _opens(text, word, "&@.")):
                word += 1
            if word == at:
                break
            start = word
            if word > begin or begin < last + 2 or text[begin - 1] not in " \t" or text[begin - 2] in " \t":
                break
            at = begin - 1
        if start is not None:
            last = form.end()
            yield "Company", start, last


# Streets

_STREET = re.compile(r"(?:" + "|".join(re.escape(w) for w in sorted({*STREET_ENDINGS, *map(str.lower, STREET_WORDS)}, key=len, reverse=True)) + r")[ \t]?(?=\d)", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")


def _house(text: str, at: int) -> int | None:
    """Where a house number ends: up to four digits, a letter, and a second number behind a dash or slash."""
    number = _DIGITS.match(text, at)
    if not number or len(number[0]) > 4:
        return None
    end = number.end()
    letter = end + (text[end : end + 1] in (" ", "\t"))
    if text[letter : letter + 1].isascii() and text[letter : letter + 1].isalpha() and not _joins(text, letter + 1):
        end = letter + 1
    mark = end + (text[end : end + 1] in (" ", "\t"))
    if text[mark : mark + 1] and text[mark] in "-–/":
        second = _DIGITS.match(text, mark + 1 + (text[mark + 1 : mark + 2] in (" ", "\t")))
        if second and len(second[0]) <= 4:
            stop = second.end()
            stop += text[stop : stop + 1].isascii() and text[stop : stop + 1].isalpha() and not _joins(text, stop + 1)
            if not _joins(text, stop):
                return stop
    return None if _joins(text, end) else end


def _word_start(text: str, at: int) -> int:
    """Where the hyphened word that ends at ``at`` begins."""
    while at and (text[at - 1].isalpha() or text[at - 1] == "-"):
        at -= 1
    return at


def streets(text: str) -> Iterator[Found]:
    """A name and a word for a street, or a word that ends so, and a house number."""
    last = 0
    for m in _STREET.finditer(text):
        end = _house(text, m.end())
        word = m[0].rstrip(" \t")
        begin = _word_start(text, m.start())
        stem = text[begin : m.start()]
        if end is None or begin < last:
            continue
        start = None
        if word.islower() and word in STREET_ENDINGS and stem[:1].isupper() and all(p[1:].islower() or len(p) == 1 for p in stem.split("-") if p):
            start = begin
        elif word in STREET_WORDS and stem.endswith("-") and is_name(stem.rstrip("-")):
            start = begin
        elif word in STREET_WORDS and not stem and text[begin - 1 : begin] in (" ", "\t"):
            before = len(text[:begin].rstrip(" \t"))
            first = _word_start(text, before)
            if is_name(text[first:before]):
                start = first
        if start is not None and not _joins(text, start - 1 if start else len(text)) and text[start - 1 : start] != "-":
            last = end
            yield "Street", start, end


# Towns

_POSTCODE = re.compile(r"(?<![\w-])(?:(?:" + "|".join(COUNTRIES) + r")-\d{4,5}|\d{5})[ \t]+(?=[^\W\d_])")


def town_end(found: list[Token], i: int) -> int:
    """The token behind a town's name: a capitalized word and up to three more, among them small words that another follows."""
    if i >= len(found) or not (found[i].name or is_name(found[i].text)):
        return i
    end = i + 1
    for _ in range(3):
        if end >= len(found):
            break
        small = found[end].text in TOWN_WORDS and end + 1 < len(found) and blank(found[end + 1].gap)
        if not blank(found[end].gap, single=True) or not (found[end].name or small):
            break
        end += 1
    return end


def towns(text: str) -> Iterator[Found]:
    """A postcode, with a country or where a line or a part of one begins, and a town."""
    for m in _POSTCODE.finditer(text):
        before = text[: m.start()].rstrip(" \t")
        if m[0][0].isdigit() and not (not before or before[-1] in "\n\r,|;" and m.start() - len(before) <= (1 if before[-1] in ",|;" else m.start())):
            continue
        found = tokens(text[m.end() : m.end() + 120])
        end = town_end(found, 0)
        while end > 1 and (is_stop(found[end - 1].text) or found[end - 1].text.islower()):
            end -= 1
        if end and found[0].start == 0 and fold(found[0].text) not in _COUNTED and not is_stop(found[0].text):
            yield "City", m.start(), m.end() + found[end - 1].end


_COUNTED = {fold(w) for w in COUNTED}


# Register entries

_ENTRY = re.compile(r"(?:" + "|".join(REGISTERS) + r")[ \t]?\d{1,6}|DE[ \t]?\d{9}|ATU[ \t]?\d{8}|CHE[- \t]?\d{3}[. \t]?\d{3}[. \t]?\d{3}")
_COURT = re.compile("|".join(COURTS))


def registers(text: str) -> Iterator[Found]:
    """Entries of a commercial register, with the court before them, courts alone, and VAT numbers."""
    entries = []
    for m in _ENTRY.finditer(text):
        end = m.end()
        if m[0].startswith(tuple(REGISTERS)):
            letters = end + (text[end : end + 1] in (" ", "\t"))
            stop = letters
            while stop < len(text) and "A" <= text[stop] <= "Z" and stop - letters < 3:
                stop += 1
            if 1 <= stop - letters <= 2 and not _joins(text, stop):
                end = stop
        after = text[end : end + 1]
        # A capital glued on is the next word.
        if _opens(text, m.start()) and not (after.isdigit() or after.islower() or after == "_"):
            entries.append((m.start(), end))
    last = 0
    for m in _COURT.finditer(text):
        found = tokens(text[m.end() : m.end() + 120])
        if not _opens(text, m.start()) or not found or not blank(found[0].gap) or not found[0].name:
            continue
        k = 1
        for small in (("am",), ("an", "der"), ("im",), ("in",), ("ob",)):
            j = k + len(small)
            if j < len(found) and tuple(t.text for t in found[k:j]) == small and found[j].name and all(blank(t.gap, single=True) for t in found[k : j + 1]):
                k = j + 1
                break
        end = m.end() + found[k - 1].end
        after = end
        while after < len(text) and text[after] in " \t,:":
            after += 1
        own = next((e for e in entries if e[0] == after and after > end and text[after : after + 3].startswith(tuple(REGISTERS[:3]) + ("VR",))), None)
        if own:
            entries.remove(own)
        entries.append((m.start(), own[1] if own else end))
    for start, end in sorted(entries):
        if start >= last:
            last = end
            yield "Register", start, end


# Accounts

_COUNTRY_CODE = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?=[ \t]?[A-Z0-9])")
_GROUP = re.compile(r"[ \t]?([A-Z0-9]+)(?!\w)")


def is_iban(compact: str) -> bool:
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def accounts(text: str) -> Iterator[Found]:
    """Groups of digits and capitals behind a country's code: the longest row of them whose checksum is right."""
    last = 0
    for m in _COUNTRY_CODE.finditer(text):
        if m.start() < last:
            continue
        first = re.compile(r"[A-Z0-9]*(?!\w)").match(text, m.end())
        if not first:
            continue
        compact, end, best = m[0] + first[0], first.end(), None
        while len(compact) <= 34:
            if is_iban(compact):
                best = end
            group = _GROUP.match(text, end)
            if not group:
                break
            compact, end = compact + group[1], group.end()
        if best:
            last = best
            yield "Account", m.start(), best


# Phone numbers

_PHONE_WORD = re.compile(
    rf"(?:{'|'.join(sorted(map(re.escape, [*PHONE_WORDS, *PHONE_COLON_WORDS]), key=len, reverse=True))}|[tfmp])(?=[\W\d]|$)",
    re.IGNORECASE,
)
#: At most 25 characters of a dialled number.
_DIALLED = re.compile(r"(?=\+?\(?\d)[+(]{0,2}[\d \t./()-]{1,23}")
_ABROAD = re.compile(r"(?<![\w+])(?:\+|00)(?=[1-9])")


def is_date(value: str) -> bool:
    """Whether a number begins as a date of our time, year first or last."""
    parts = re.split(r"[-./]", value.lstrip("+("), maxsplit=2)
    if len(parts) < 3 or not all(p[:2].isdigit() for p in parts):
        return False
    parts[2] = re.match(r"\d+", parts[2])[0]
    sizes, years = [len(p) for p in parts], (parts[0], parts[2][:4])
    year = years[0] if sizes[:2] == [4, 2] and sizes[2] >= 2 else years[1] if sizes[:2] == [2, 2] and sizes[2] >= 4 else ""
    return year[:2] in ("19", "20") and 1 <= int(parts[1]) <= 12


def is_phone(value: str) -> bool:
    return 7 <= sum(c.isdigit() for c in value) <= 15 and not is_date(value)


def labelled_phones(text: str) -> Iterator[Found]:
    """Numbers behind a word for a phone, or behind one of the letters T, F, M and P with a colon."""
    for m in _PHONE_WORD.finditer(text):
        word, at = m[0].lower(), m.end()
        if not _opens(text, m.start()):
            continue
        if word in PHONE_WORDS and text[at : at + 1] == ".":
            at += 1
        rest = text[at:].lstrip(" \t")
        if rest[:1] != ":" and (word in PHONE_COLON_WORDS or word in "tfmp" or not rest):
            continue
        if len(word) == 1 and not m[0].isupper():
            continue
        rest = rest[1:] if rest[:1] in (".", ":") else rest
        rest = rest.lstrip(" \t")
        number = _DIALLED.match(rest)
        if number and is_phone(value := number[0].rstrip(" \t./()-")):
            start = len(text) - len(rest)
            yield "Phone", start, start + len(value)


def phones_abroad(text: str) -> Iterator[Found]:
    """Numbers with a country's code: single signs may stand between digits, and a zero in brackets behind the code."""
    last = 0
    for m in _ABROAD.finditer(text):
        if m.start() < last:
            continue
        at = m.end()
        zeros = m[0] == "00"
        code = at
        while text[code : code + 1].isdigit() and code - at < 3:
            code += 1
        if zeros and not any(text[k : k + 1] in (" ", "/", ".", "-") for k in range(at + 1, code + 1)):
            continue
        trunk = text.find("(0)", at, code + 4)
        count, end = 0, at
        k = at
        while k < len(text):
            if k == trunk or (text[k] in " ./-" and k + 1 == trunk):
                k = trunk + 3
            elif text[k].isdigit():
                count, k = count + 1, k + 1
                end = k
            elif text[k] in " ./-" and text[k + 1 : k + 2].isdigit():
                k += 1
            else:
                break
        if 7 <= count <= 17 and not _joins(text, end) and is_phone(text[m.start() : end]):
            last = end
            yield "Phone", m.start(), end


#: Finders in the order of their passes, each with a test that every line with a match passes.
FINDERS: list[tuple[Callable[[str], Iterator[Found]], re.Pattern]] = [
    (registers, re.compile("HR|VR|GnR|DE|ATU|CHE|gericht")),
    (accounts, re.compile("iban|konto|account|bankverbindung", re.IGNORECASE)),
    (labelled_phones, re.compile(r"\d")),
    (phones_abroad, re.compile(r"\+|00")),
    (streets, re.compile(r"\d")),
    (towns, re.compile(r"\d{4,5}")),
    (companies, _FORM),
]


# Words that are never part of a name (Jan, a month too, is one): those of the phrases that names stand behind (see ``learning``), names of days and
# months, and these.
_NEVER = """
fräulein damen herren freundlichen freundlichem freundliche herzliche schöne viele dank vielen gesendet datum betreff sent subject
date web www e-mail email mail internet team support service services lead customer kunde kunden kundin firma hrb hra ust ustid
sitz abteilung technik vertrieb buchhaltung einkauf verwaltung admin administrator postmaster info zentrale hinweise datenschutz
datenschutzerklärung impressum ihr ihre ihnen sie euch dir du wir uns unser unsere die das dem des ein eine einer und oder für bei im
am ja nein ok okay bitte ticket tickets anfrage re aw wg fw fwd ich es er kollege kollegen kollegin kolleginnen alle zusammen leute
gesellschafter director directors manager head of the and dach europe germany deutschland sir madam everyone colleague colleagues
truly yours many warm kindest cordiali distinti toll free international intl all both again guys folks sehr geehrte geehrter nochmal
nochmals vorab beaucoup mille tante muchas much lots you thx saludos saluti groet groeten thanks thank best kind
""".split()
MONTHS = """
januar februar märz april mai juni juli august september oktober november dezember feb mär mar apr jun jul aug sep sept okt oct nov
dez dec may march june july october december
""".split()
DAYS = "montag dienstag mittwoch donnerstag freitag samstag sonntag monday tuesday wednesday thursday friday saturday sunday mon tue wed thu fri sat sun".split()

# Phrases that names stand behind.
ADDRESS_FORMS = Phrases(
    "Herr,Herrn,Frau,Hr.,Fr.,Mr,Mr.,Mrs,Mrs.,Ms,Ms.,Miss,Mx,Mx.,Monsieur,Madame,Mme,Mme.,Mlle,Mlle.,"
    "Signora,Signor,Sig.,Sig.ra,Señora,Señor,Sra.,Sr.,Dhr.,Mevr.,Meneer,Mevrouw".split(",")
)
GREETINGS = Phrases(
    "Hallo,Hello,Hi,Hey,Moin,Servus,Lieber,Liebe,Dear,Guten Morgen,Guten Tag,Guten Abend,Good morning,Good afternoon,Good evening,"
    "Bonjour,Buongiorno,Buonasera,Ciao,Gentile,Caro,Cara,Hola,Estimado,Estimada,Beste,Hej,Hoi,"
    "Thanks,Thank you,Thx,Danke,Vielen Dank,Merci,Grazie,Gracias,Bedankt,Tack".split(",")
)
CLOSINGS = Phrases(
    "mit freundlichen Grüßen,mit freundlichem Gruß,freundliche Grüße,viele Grüße,beste Grüße,liebe Grüße,herzliche Grüße,schöne Grüße,"
    "best regards,kind regards,kindest regards,warm regards,warmest regards,best wishes,many thanks,yours sincerely,yours faithfully,"
    "yours truly,sincerely,cordiali saluti,distinti saluti,cordialement,bien cordialement,saludos cordiales,un saludo,atentamente,"
    "met vriendelijke groet,met vriendelijke groeten,med vänliga hälsningar".split(",")
)
#: These only where a line or a sentence begins.
SHORT_CLOSINGS = Phrases("Grüße,Gruß,mfg,MfG,lg,vg,regards,cheers,saluti,saludos,groeten,mvg".split(","))
BOTH_LANGUAGES = Phrases(["kind regards", "best regards"])
ROLES = Phrases(
    "Geschäftsführer,Geschäftsführerin,Geschäftsführung,geschäftsführender Gesellschafter,geschäftsführende Gesellschafter,"
    "geschäftsführende Gesellschafterin,geschäftsführenden Gesellschafter,Vorstand,Vorstandsvorsitzende,Vorstandsvorsitzender,"
    "Vorstandsvorsitzenden,Inhaber,Inhaberin,Ansprechpartner,Ansprechpartnerin,Sachbearbeiter,Sachbearbeiterin,Bearbeiter,Bearbeiterin,"
    "Aufsichtsratsvorsitzende,Aufsichtsratsvorsitzender,managing director,managing directors,CEO,CTO,Kontakt,contact".split(",")
)
SEATS = Phrases(["Sitz", "Sitz der Gesellschaft", "Firmensitz", "registered office"])
HEADERS = Phrases("von an cc bcc from to absender empfänger".split())
STOP = frozenset(
    {fold(w) for w in [*_NEVER, *MONTHS, *DAYS, *PHONE_WORDS, *COURTS, *(p for w in PHONE_COLON_WORDS for p in w.split())]}
    | set().union(*(p.words for p in (ADDRESS_FORMS, GREETINGS, CLOSINGS, SHORT_CLOSINGS, HEADERS)))
    | {fold(w) for w in "Geschäftsführer Geschäftsführerin Geschäftsführung Vorstand Inhaber Ansprechpartner".split()}
    | set(PARTICLES & {"von", "der", "den", "zum", "zur"})
)


def is_stop(word: str) -> bool:
    """Whether a word is never part of a name; of a hyphened one all parts must be."""
    return all(fold(p) in STOP for p in word.split("-") if p)

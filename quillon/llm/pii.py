"""Personal information in free text: found, and replaced by typed placeholders that hold format-preserving pseudonyms.

Finding: one automaton with every fixed word (names of a list, titles, street words, roles, greetings) passes over a text; around its hits, and
around signs such as @, short patterns decide. Names that are on no list are told by their shape, by the words before them, and by a public
vocabulary: a word whose lower-case form is a token there is a common word. Identity numbers are validated by the check digits of their
scheme, where it has them. Replacing: numbers and dates are permuted by a keyed Feistel network within their own format. The permutation
works on the canonical number (country and subscriber, issuer and digits), which is written back in the text's spelling, so that equal values
stay linked across spellings and documents and a holder of the key can go back; other values get a keyed number. The rest stays as it is.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import hmac
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.tokens import TOKENIZERS
from quillon.plans.partitioning import at_most

EMAIL, PHONE, ID_NUMBER, ADDRESS, NAME, DATE = "email", "phone", "id_number", "address", "name", "date"

# --- numbers -----------------------------------------------------------------------------------------------------------

GAP = r"[ \u00a0\u2007\u2009\u202f.\-\u2010\u2011\u2012\u2013]"
S = GAP + "?"
BEFORE = r"(?<![A-Za-z0-9_+])(?<!\d[./\-\u2010\u2011 \u00a0])"
AFTER = r"(?![A-Za-z0-9_])(?![.\-/\u2010\u2011]\d)"
#: National numbers without their leading 0, by country.
NATIONAL = {
    "61": rf"(?:[2378]{S}\d{{4}}{S}\d{{4}}|4\d\d{S}\d{{3}}{S}\d{{3}})",
    "1": rf"\(?[2-9]\d\d\)?{S}[2-9]\d\d{S}\d{{4}}",
    "44": rf"(?:20{S}\d{{4}}{S}\d{{4}}|[17]\d{{3}}{S}\d{{3}}{S}\d{{3}}|1\d\d{S}\d{{3}}{S}\d{{4}})",
    "49": rf"(?:[1-9]\d{{1,3}}{S}\d{{3,6}}{S}\d{{2,4}})",
    "33": rf"(?:[1-9](?:{S}\d\d){{4}})",
}
ABROAD = "|".join(rf"{c}{S}(?:\(0\){S})?{n}" for c, n in NATIONAL.items())
OTHER_ABROAD = rf"(?!(?:61|1|44|49|33)(?!\d))[1-9]\d{{0,2}}(?:{GAP}(?:\(0\){S})?\d{{1,5}}){{2,5}}"
AT_HOME = "|".join([
    rf"(?:\(0[2378]\)|0[2378]){S}\d{{4}}{S}\d{{4}}",
    rf"(?:\(04\d\d\)|04\d\d){S}\d{{3}}{S}\d{{3}}",
    rf"(?:\(020\)|020){S}\d{{4}}{S}\d{{4}}",
    rf"(?:\(0[17]\d{{3}}\)|0[17]\d{{3}}){S}\d{{3}}{S}\d{{3}}",
    rf"(?:\(0[1-9]\)|0[1-9])(?:{S}\d\d){{4}}",
    rf"(?:\(0[1-9]\d{{1,3}}\)|0[1-9]\d{{1,3}}){S}\d{{5,6}}{S}\d{{2,4}}",
    rf"(?:\([2-9]\d\d\){S}|[2-9]\d\d{S})[2-9]\d\d{S}\d{{4}}",
])
PHONES = re.compile(rf"(?=[+(\d]){BEFORE}(?:(?:\+|00)(?:{ABROAD}|{OTHER_ABROAD})|{AT_HOME}){AFTER}")
#: Personal numbers by format: staff and pilot numbers, French social security, US, German and Australian tax, passports, Spanish identity.
ID_NUMBERS = re.compile(
    r"(?=[0-9A-Za-z])(?<![A-Za-z0-9_\-./+])(?<!\d[ \u00a0])(?:"
    r"(?:EMP|ARN|RPL|emp|arn|rpl|Emp|Arn|Rpl)-\d{4,8}"
    r"|[1-4][ \u00a0]\d\d[ \u00a0]\d\d[ \u00a0]\d\d[ \u00a0]\d{3}[ \u00a0]\d{3}[ \u00a0]\d\d"
    r"|9\d\d-\d\d-\d{4}|(?!000|666)\d{3}-(?!00)\d\d-(?!0000)\d{4}"
    r"|\d\d[ \u00a0]\d{3}[ \u00a0]\d{3}[ \u00a0]\d{3}"
    r"|\d{3}[ \u00a0]\d{3}[ \u00a0]\d{3}"
    r"|[A-Z]\d{7,8}"
    r"|\d{8}-?[A-HJ-NP-TV-Z]"
    r")(?![A-Za-z0-9_])(?![\-/.]\d)(?![ \u00a0]\d{3}(?!\d))"
)
#: Words before a number that counts or measures something.
COUNTED = re.compile(r"(?i:\b(?:counter|count|counts|total|sum|stood|read|reads|at|of|offset|bytes|points|records|zähler|stand|compteur|total|contador|счётчик)[:=]?[ \u00a0]+)$")
#: The same after a label, where more shapes are sure.
ID_LABELS = "passport passeport pasaporte reisepass licence license permis badge ausweis steuernummer steuer-id dni nie nif cpf ssn tfn sociale ident identity identification identidad".split() + ["tax number", "tax id", "tax file number", "national id", "id card"]
LABELLED = re.compile(
    r"\s?(?:no\.?|number|nr\.?|n[º°])?(?:(?:[ \u00a0][^\W\d_]+){1,5}?\s?:|\s?:)?\s?"
    r"([A-Za-z]{1,3}-?\d{4,10}|\d{8}-?[A-Za-z]|\d{3}-\d\d-\d{4}|\d{1,3}(?:[ \u00a0]\d{2,3}){2,6}|\d{9,15})(?![A-Za-z0-9_])(?![\-/.]\d)"
)

#: Shapes that counters have too: ranges given out to persons begin with 9 (nine digits) or 0 (eleven, in tests); others need a valid check digit.
GROUPED = re.compile(r"(?:\d\d[ \u00a0])?\d{3}[ \u00a0]\d{3}[ \u00a0]\d{3}")


def _check(letters: str, digits: list[int]) -> tuple[list[int], str] | None:
    """The check part of a number by its scheme, computed from its other digits: (digits or nothing, letter or nothing)."""
    n = len(digits)
    if len(letters) == 1 and n == 8:  # Spanish identity number
        return [], "TRWAGMYFPDXBNJZSQVHLCKE"[int("".join(map(str, digits))) % 23]
    if letters:
        return None
    if n == 15:  # French social security: two digits
        r = 97 - int("".join(map(str, digits[:13]))) % 97
        return [r // 10, r % 10], ""
    if n == 11:  # German tax identity: ISO 7064, mod 11, 10
        p = 10
        for d in digits[:10]:
            p = ((d + p) % 10 or 10) * 2 % 11
        return [(11 - p) % 10], ""
    if n == 9:  # Australian tax file number: weights 1 4 3 7 5 8 6 9 10, sum divisible by 11; the last digit, where there is one
        total = sum(w * d for w, d in zip((1, 4, 3, 7, 5, 8, 6, 9), digits, strict=False)) % 11
        return ([total], "") if total < 10 else None
    return None


def _split(value: str) -> tuple[str, list[int]]:
    return "".join(c for c in value.upper() if "A" <= c <= "Z"), [int(c) for c in value if "0" <= c <= "9"]


def valid(value: str) -> bool:
    """Whether an identity number has the check digits or letter of its scheme."""
    letters, digits = _split(value)
    check = _check(letters, digits)
    return check is not None and (letters == check[1] if check[1] else digits[len(digits) - len(check[0]) :] == check[0])


# --- email -------------------------------------------------------------------------------------------------------------

LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
AT = r"(?:[ \u00a0]?[@＠][ \u00a0]?|[ \u00a0]?[\[({<][ ]?(?i:at)[ ]?[\])}>][ \u00a0]?|[ \u00a0](?:AT|at)[ \u00a0](?=[^\n]{1,40}[ \u00a0](?:DOT|dot)[ \u00a0]))"
DOT = r"(?:\.|[ \u00a0]?[\[({<][ ]?(?i:dot)[ ]?[\])}>][ \u00a0]?|[ \u00a0](?:DOT|dot)[ \u00a0])"
SIGN = "A-Za-zÀ-ÖØ-öø-ɏ0-9"
EMAILS = re.compile(rf"(?<![{SIGN}._%+\-/])[{SIGN}](?:[{SIGN}._%+\-]*[{SIGN}_])?{AT}(?:{LABEL}{DOT})+[A-Za-z]{{2,24}}(?![A-Za-z0-9\-@])")
#: The signs that stand before the @.
LOCAL_SIGNS = frozenset(chr(c) for c in range(0x250) if re.match(rf"[{SIGN}._%+\-]", chr(c)))
EMAIL_SIGN = re.compile(r"[@＠]|[\[({<] ?(?:at|At|AT) ?[\])}>]| (?:AT|at) (?=[A-Za-z0-9\-]{2,30} (?:DOT|dot) )")

# --- addresses ---------------------------------------------------------------------------------------------------------

#: Words that end an English street name, and that begin a French, Spanish or Portuguese one.
STREETS_EN = "Street St Road Rd Avenue Ave Lane Ln Drive Dr Court Ct Crescent Cres Close Cl Way Terrace Tce Boulevard Blvd Parade Pde Place Pl Square Sq Highway Hwy Grove Gr Walk Circuit Cct Esplanade".split()
STREETS_FR = "rue avenue av. bd boulevard impasse chemin allée place quai route cours square passage".split()
STREETS_ES = "Calle C/ Avda. Avda Avenida Paseo Plaza Camino Carretera Ronda Travesía Rua Travessa Praça Alameda".split()
STREETS_DE = "weg straße strasse str. gasse platz allee ring damm ufer steig pfad steinbruch".split()
UP = r"[A-ZÀ-ÖØ-Þ]"
WORD = r"[A-ZÀ-ÖØ-Þ][\w’'\-]*"
UNIT = r"(?:Unit|Flat|Apt\.?|Apartment|Suite|Level|Shop|Room)[ \u00a0]?\d{1,4}[A-Za-z]?"
EN = re.compile(rf"(?<![\w/.,\-])(?i:{UNIT}(?:,[ \u00a0]|/|[ \u00a0]))?(?:\d{{1,4}}[A-Za-z]?/)?\d{{1,5}}(?:[\-\u2013]\d{{1,5}})?[A-Za-z]?[ \u00a0](?:[NSEW]\.?[ \u00a0])?(?:{WORD}[ \u00a0]){{1,4}}?(?:{'|'.join([*STREETS_EN, *map(str.upper, STREETS_EN)])})\b(?:(?:[ \u00a0](?:{'|'.join([*STREETS_EN, *map(str.upper, STREETS_EN)])}))\b)?(?:,[ \u00a0](?:{UNIT}|Floor[ ]\d+|\d+(?:st|nd|rd|th)[ ]floor))?")
FR = re.compile(rf"(?<![\w/.\-])\d{{1,4}}(?:[ \u00a0](?i:bis|ter|quater))?,?[ \u00a0](?:{'|'.join(map(re.escape, [*STREETS_FR, *map(str.title, STREETS_FR), *map(str.upper, STREETS_FR)]))})[ \u00a0](?i:(?:de[ \u00a0]la|des|du|de[ \u00a0]l’|de[ \u00a0]l'|de|d’|d')[ \u00a0]?)?{WORD}(?:[ \u00a0](?:(?:de|du|des|la)[ \u00a0])*{WORD}(?=,|[ \u00a0]and[ \u00a0]))?(?:,[ \u00a0](?:appt\.?|app\.?|bât\.?|étage|porte|esc\.?)[ \u00a0]?[\w]+|,[ \u00a0]\d+(?:er|e|ème)[ \u00a0]étage)?")
ES = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, [*STREETS_ES, *map(str.upper, STREETS_ES)]))})[ \u00a0](?i:(?:de[ \u00a0]la|del|de[ \u00a0]los|de[ \u00a0]las|de|da|do|das|dos)[ \u00a0])?{WORD}(?:[ \u00a0](?i:(?:de|del|la|el)[ \u00a0])*{WORD}){{0,3}},?[ \u00a0]\d{{1,4}}[A-Za-z]?\b(?:,[ \u00a0](?i:bajo|ático|\d{{1,2}}[.]?[º°ª][ \u00a0]?[A-Z]?\b|piso[ \u00a0]\d+|puerta[ \u00a0]\w+|local[ \u00a0]\d+|apto\.?[ \u00a0]\d+))*")
DE = re.compile(rf"(?<![\w\-])(?:(?:An der|An den|Am|AM|Im|Zum|Zur|In der|Auf dem|Auf der)[ \u00a0]{WORD}|(?:(?:Alte|Alter|Altes|Neue|Neuer|Große|Kleine|Obere|Untere|Hohe|Lange)[ \u00a0])?{UP}[\w\-]*(?i:weg|straße|strasse|str\.|gasse|platz|allee|ring|damm|ufer|steig|pfad)|(?:{WORD}[ \u00a0])?(?:Straße|Weg|Gasse|Platz|Allee|Ring))[ \u00a0]\d{{1,4}}(?:[\-\u2013]\d{{1,4}})?(?:[ \u00a0]?[a-z](?![\w’']))?(?:,[ \u00a0](?:\d{{1,2}}\.[ \u00a0](?:OG|Stock|Etage)|EG|Whg\.?[ \u00a0]\d+|Hinterhaus))?")
#: What an address may be recognised by; the automaton looks for them in lower case.
STREET_SIGNS = {
    "en": [f" {w.lower()}" for w in STREETS_EN],
    "fr": [f" {w} " for w in STREETS_FR],
    "es": [f"{w.lower()} " for w in STREETS_ES],
    "de": [*(f"{w} " for w in STREETS_DE), "am ", "an der ", "an den ", "im ", "zum ", "zur ", "in der ", "auf dem ", "auf der "],
}

DIGIT_BEFORE = re.compile(r"\d(?:[ \u00a0](?i:bis|ter|quater))?,?$")

# --- names -------------------------------------------------------------------------------------------------------------

#: Words before a family name that aren't part of it.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Herrn Frau Mme Mlle Monsieur Madame señor señora Señor Señora Sr Sra senhor senhora Senhor Senhora doutor".split()
#: Roles that a label, a field or an apposition gives a person.
ROLES = "operator pilot driver author contact reviewer reporter owner manager supervisor engineer technician surveyor witness operador operadora piloto conductor conductora autor autora contacto contato responsable responsável encargado fahrer fahrerin bediener bedienerin pilotin ansprechpartner opérateur pilote conducteur auteur оператор водитель пилот автор инженер".split()
#: Verbs that take a person, and what greetings, thanks, signatures and introductions say before a name.
VERBS = "met meet thank thanks ask asked call called tell told phone visit joined".split()
SAID = ["thanks to", "thank you", "my name is", "this is", "i am", "regards", "kind regards", "best wishes", "sincerely", "dear", "hello", "hi", "cheers", "cc", "attn", "je m'appelle", "je suis", "cordialement", "bonjour", "merci à", "me llamo", "soy", "saludos", "atentamente", "hola", "gracias a", "ich heiße", "ich bin", "mit freundlichen grüßen", "viele grüße", "hallo", "liebe", "lieber", "danke an", "obrigado", "abraços", "olá"]
#: Words that begin sentences or stand in for names; beyond these, a word counts as common if its lower-case form is a token of the vocabulary.
NO_NAME = set("the a an and or no not if in on at by to of for from with i it he she they his her their this that we you la le les el los las der die das den dem ein eine um nach bei am im an zu bitte herr frau mme mr mrs ms dr señora señor à às os o as um uma na no nas nos em в на он она и не monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december".split()) | set(ROLES) | set(VERBS)
PLACE_BEFORE = set("lake mount port upper lower villa saint san santa fort point cape north south east west new".split())
PLACE_AFTER = {w.lower().rstrip(".") for w in STREETS_EN} | set("flat vale spit ridge hill creek bay river valley park bridge station island beach forest mountain lake county city town village university institute department ministry company limited ltd inc gmbh team project".split())
SPACE = r"(?:[ \u00a0]{1,2}|[ \u00a0]?\u200b[ \u00a0]?)"
LETTERS = r"[^\W\d_]"
BASE = rf"(?:{UP}(?:{LETTERS}|[’']{UP})*|{UP}[’']{UP}{LETTERS}*)"
PARTICLE = rf"(?:(?:van[ ](?:der|den|de)|von[ ](?:der|dem)|de[ ]la|de[ ]los|van|von|du|de|del|della|di|da|dos|le|la|VAN[ ](?:DER|DEN|DE)|VON|DU|DE[ ]LA|DE|DEL|VAN|Van[ ]der|Von|Du|De[ ]la){SPACE})"
PARTICLES = set("van der den de von dem du del della di da dos le la los".split())
FAMILY = rf"{PARTICLE}?{BASE}(?:[\-\u2010\u2011]{PARTICLE}?{BASE})*"
GIVEN = rf"{BASE}(?:-{BASE})?"
INITIAL = rf"{UP}\."
FULL = re.compile(rf"(?P<rev>(?P<f1>{FAMILY}),{SPACE}(?P<g1>{GIVEN}(?:{SPACE}{INITIAL})?|{INITIAL})(?![\w@+])(?!\.\w))|(?P<full>(?P<g2>{GIVEN}){SPACE}(?:{INITIAL}{SPACE})?(?P<f2>{FAMILY}))|(?P<ini>(?:{INITIAL}{SPACE}?){{1,2}}(?P<f3>{FAMILY}))|(?P<gi>(?P<g4>{GIVEN}){SPACE}{INITIAL})|(?P<alone>{FAMILY})")
CYRILLIC = re.compile(r"[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?(?: [А-ЯЁ]\.)?(?: [А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?){1,2}|[А-ЯЁ]\. [А-ЯЁ][а-яё]+")
ASK = re.compile(rf"\bask{SPACE}((?:{LETTERS}[\w’'\-]*\.?{SPACE}){{0,4}}{LETTERS}[\w’'\-]+|{LETTERS}[\w’'\-]+,{SPACE}{LETTERS}[\w’'\-]+\.?)(?={SPACE}about\b)")
NAMED = rf"(?:{UP}|(?:van|von|du|de|del|da|di) )"
#: What stands between such a word and the name.
AFTER_CUE = {
    "role": re.compile(rf"(?:[\"']?\s?[:=,]\s?[\"']?|{SPACE})(?={NAMED}|[А-ЯЁ])"),
    "verb": re.compile(rf"(?:{SPACE}for)?{SPACE}(?={NAMED}|[А-ЯЁ])"),
    "said": re.compile(rf"[,:]?\s{{1,3}}(?={NAMED}|[А-ЯЁ])"),
    "by": re.compile(rf"(?:{SPACE}|:\s?)(?={NAMED})"),
}
SIGNED = "signed signé signiert firmado firmó".split()
DONE_BY = re.compile(rf"(?:{LETTERS}(?:ed|en|ld|de)(?:{SPACE}(?:for|off|out|up|in))?{SPACE}|-)$")
#: What may be a person anywhere: two capitalised words, or an initial and one, in either order.
PAIR = re.compile(rf"(?<![\w@.’'+/°\-])(?:{UP}(?:\.|[\w’'\-]+,?)|(?:van|von|du|de|del|di)(?= (?:\w{{2,3}} )?{UP}[\w’'\-]*,))(?={SPACE}(?:{UP}|van|von|de|du|del|della|der|den|la|di|da|dos))")
CYRILLIC_PAIR = re.compile(r"(?<![\w@.\-])[А-ЯЁ](?:\.|[а-яё\-]+) [А-ЯЁ]")
LOWER_FAMILY = rf"(?:(?:van der|von|du|de la|van|de){SPACE})?{LETTERS}[\w’']*(?:-{LETTERS}[\w’']*)*"


WORD_BEFORE = re.compile(rf"({UP}[\w’'\-]*)\.?[ \u00a0]$")
WORD_AFTER = re.compile(rf"[ \u00a0]({UP}\w*)")


@lru_cache(maxsize=4)
def vocabulary(folder: str = TOKENIZERS, names: tuple[str, ...] = ("byte_bpe_50k", "byte_bpe_multi_50k")) -> frozenset[bytes]:
    """The tokens of public vocabularies: of fixed size, read once in each worker process."""
    return frozenset(base64.b64decode(line.split()[0]) for n in names for line in Path(folder, f"{n}.tiktoken").read_bytes().splitlines())


class Finder:
    """Finds personal information; names are (name, role) rows, role given or family, words the tokens that tell common words."""

    def __init__(self, names: Iterable[tuple[str, str]], words: frozenset[bytes] | None = None):
        import ahocorasick

        self.words = vocabulary() if words is None else words

        self.given, self.family = set(), set()
        for name, role in names:
            if name:
                (self.given if role == "given" else self.family).add(name.lower())
        self.automaton = ahocorasick.Automaton()
        words: dict[str, tuple[str, int, int]] = {}  # kind, length, and signs after it that belong to the key only

        def watch(kind: str, some: Iterable[str], ends: tuple[str, ...] = ("",)) -> None:
            words.update({w + end: (kind, len(w), len(end)) for w in some for end in ends})

        for language, signs in STREET_SIGNS.items():
            watch(language, signs)
        watch("label", ID_LABELS)
        watch("by", ["by"], (" ", ":", "\u00a0"))
        watch("said", SAID, (" ", ",", ":", "\n", "\u00a0"))
        watch("verb", [*VERBS, *SIGNED], (" ", "\u00a0"))
        watch("role", ROLES, (" ", ":", ",", "=", '"', "'", "\u00a0"))
        watch("title", [w.lower() + end for w in TITLES for end in (" ", ". ")])
        watch("family", self.family)
        watch("given", self.given)
        for w, v in words.items():
            self.automaton.add_word(w, v)
        self.automaton.make_automaton()

    # Each method below adds (start, end, kind) to the spans taken so far, unless they overlap.

    def spans(self, text: str, names: Iterable[tuple[str, str]] | None = None, dates: bool = False) -> list[tuple[int, int, str]]:
        """Where personal information stands, in order, without overlaps: email before address before number before name.

        names: those of a long list that the text holds (then the finder itself has none); dates: whether dates of birth count.
        """
        taken = _Taken()
        last = 0
        for m in EMAIL_SIGN.finditer(text):
            if m.start() < last:
                continue
            at = m.start() - (m.start() > last and text[m.start() - 1] in " \u00a0")
            while at > last and text[at - 1] in LOCAL_SIGNS:
                at -= 1
            e = EMAILS.match(text, at)
            if e and e.start() <= m.start() < e.end() and taken.add(e.start(), e.end(), EMAIL):
                last = e.end()
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        hits = [(end + 1 - size - more, end + 1 - more, kind) for end, (kind, size, more) in self.automaton.iter(low)]
        if names is not None:
            self.given, self.family = ({n.lower() for n, role in names if (role == "given") == given} for given in (True, False))
            for w in self.given | self.family:
                hits += [(m.start(), m.end(), "given" if w in self.given else "family") for m in re.finditer(re.escape(w), low)]
            hits.sort(key=lambda h: (h[1], h[0]))
        if dates:
            for m in BORN.finditer(text):
                taken.add(m.start(1), m.end(1), DATE)
        last = 0
        labels = []
        for s, e, kind in hits:
            if kind == "label":
                labels.append(e)
            elif kind in STREET_SIGNS and s >= last:
                last = self._address(text, s, e, last, kind, taken)
        for e in labels:
            if m := LABELLED.match(text, e):
                taken.add(m.start(1), m.end(1), ID_NUMBER)
        for m in ID_NUMBERS.finditer(text):
            if not GROUPED.fullmatch(m.group()) or m.group()[0] == ("9" if len(m.group()) == 11 else "0") or valid(m.group()) and not COUNTED.search(text, _back(text, m.start(), 1), m.start()):
                taken.add(m.start(), m.end(), ID_NUMBER)
        for m in PHONES.finditer(text):
            value = m.group()
            if 9 <= sum(c.isdigit() for c in value) - 2 * value.startswith("00") <= 16 - 2 * value.startswith("00"):
                taken.add(m.start(), m.end(), PHONE)
        self._names(text, low, hits, taken)
        return taken.sorted()

    def _address(self, text: str, s: int, e: int, last: int, language: str, taken: _Taken) -> int:
        """Take the address about this sign; returns where it ends, or last."""
        if language == "en":
            if not text[s + 1].isupper() or e < len(text) and text[e].isalnum():
                return last
            pattern, low, high = EN, _back(text, s, 9, last), _ahead(text, e, 7)
        elif language == "fr":
            low = _back(text, s, 2, last)
            if not DIGIT_BEFORE.search(text, low, s):
                return last
            pattern, high = FR, _ahead(text, e, 14)
        elif language == "es":
            if not text[s].isupper() or s and text[s - 1].isalnum():
                return last
            pattern, low, high = ES, s, _ahead(text, e, 18)
        else:
            begins = text[s].isupper()
            if not (begins and not (s and text[s - 1].isalnum())) and not (e < len(text) and text[e].isdigit()):
                return last
            pattern, low, high = DE, s if begins else _back(text, s, 2, last), _ahead(text, e, 8)
        for a in pattern.finditer(text, low, high):
            if a.start() <= s + 1 and a.end() >= e - 1:
                return a.end() if taken.add(*a.span(), ADDRESS) else last
        return last

    def _names(self, text: str, low: str, found: list[tuple[int, int, str]], taken: _Taken) -> None:
        hits = []
        for s, e, kind in found:
            if kind in AFTER_CUE:
                if (not (s and low[s - 1].isalnum()) if kind != "by" else DONE_BY.search(text, max(0, s - 9), s)) and (m := AFTER_CUE[kind].match(text, e)):
                    hits.append((m.end(), m.end(), "frame"))
            elif kind == "title":
                if s == 0 or not low[s - 1].isalnum():
                    hits.append((e, e, "title"))
            elif kind in ("given", "family") and not (s and low[s - 1].isalnum() or e < len(low) and low[e].isalnum()):
                hits.append((s, e, kind))
        for m in ASK.finditer(text) if "ask" in low else ():
            words = re.split(r"[ \u00a0,]+", m.group(1))
            if len(words) > 1 and not any(self._common(w) for w in words if w.lower() not in PARTICLES) or words[0].lower() in self.family:
                taken.add(*_trim_title(text, m.start(1), m.end(1)), NAME)
        for s, e, kind in sorted(hits):
            if taken.covers(s, max(e, s + 1)):
                continue
            if kind == "frame":
                self._framed(text, low, s, taken)
            elif kind == "title":
                m = re.compile(FAMILY).match(text, s)
                if m and not _stops(m.group()):
                    full = FULL.match(text, s)
                    if full and full.group("full") and (self._is_given(full.group("g2")) or self._is_family(full.group("f2")) or not self._common(full.group("f2"))):
                        m = full
                    taken.add(m.start(), m.end(), NAME)
            elif kind == "family":
                self._around_family(text, low, s, e, taken)
            else:
                self._after_given(text, low, s, e, taken)
        for m in PAIR.finditer(text):
            self._pair(text, m.start(), taken)
        for m in () if text.isascii() else CYRILLIC_PAIR.finditer(text):
            c = CYRILLIC.match(text, m.start())
            if c and not _stops(c.group()) and (c.group()[1] == "." or not _begins(text, m.start()) or not CYRILLIC_PAIR.match(text, c.end() - 1)):
                taken.add(c.start(), c.end(), NAME)

    def _common(self, word: str) -> bool:
        """Whether a word, in lower case, is one of the vocabulary, or stands for no name by itself."""
        words = [w for w in re.split(r"[\s\-\u2010\u2011.,]+", word.lower()) if len(w) > 1 and w not in PARTICLES]
        return not words or words[0] in NO_NAME or any((" " + w).encode() in self.words for w in words)

    def _pair(self, text: str, at: int, taken: _Taken) -> None:
        """Two words that look like a person's names, none of which is a common word; places and institutions are told by the words about them."""
        m = FULL.match(text, at)
        if not m or m.group("alone") or m.group("gi") or taken.covers(*m.span()) or re.compile(r"[\w@＠=/’'+]").match(text, m.end()):
            return
        before, after = WORD_BEFORE.search(text, _back(text, at, 1), at), WORD_AFTER.match(text, m.end())
        if before and before.group(1).lower() in PLACE_BEFORE or after and after.group(1).lower() in PLACE_AFTER:
            return
        first, second = (m.group(g) or "" for g in (("f1", "g1") if m.group("rev") else ("g2", "f2") if m.group("full") else ("f3", "f3")))
        if self._common(first) or self._common(second) and not second.endswith(".") or first.split("-")[0].lower() in PLACE_BEFORE or second.split()[-1].lower() in PLACE_AFTER:
            return
        if second.split()[-1].isupper() and not second.endswith(".") and not re.search(r"[AEIOUÄÖÜÁÉÍÓÚ]", second) or second.lower().endswith(tuple(STREETS_DE)):
            return
        if m.group("rev") and ((" " + first).encode() in self.words or not (_begins(text, at) or self._is_given(second))):
            return
        taken.add(*m.span(), NAME)

    def _framed(self, text: str, low: str, at: int, taken: _Taken) -> None:
        """A person named at this place, whose names may be unknown; after "we met", two of them."""
        while True:
            c = CYRILLIC.match(text, at)
            if c:
                taken.add(c.start(), c.end(), NAME)
                return
            t = re.compile(rf"(?:{'|'.join(TITLES)})\.?{SPACE}").match(text, at)
            if t:
                at = t.end()
            m = self._best(text, at)
            if not m:
                return
            taken.add(*m, NAME)
            go_on = re.compile(rf"{SPACE}and{SPACE}").match(text, m[1])
            if not go_on:
                return
            at = go_on.end()

    def _best(self, text: str, at: int) -> tuple[int, int] | None:
        """The reading of a name that begins at this place."""
        m = FULL.match(text, at)
        if not m:
            return None
        if m.group("rev"):
            first, second = m.group("f1"), m.group("g1")
            street = re.compile(r"[  ]+\d").match(text, m.end()) or second.lower().endswith(tuple(STREETS_DE))
            if not _stops(first) and (self._is_given(second) or second.endswith(".") or not _stops(second) and not street):
                return m.span()
            return self._single(text, at)
        if m.group("full"):
            g, f = m.group("g2"), m.group("f2")
            if _stops(g):
                return None
            if _stops(f) or self._is_family(g) and not self._is_family(f):
                i = re.compile(rf"{GIVEN}{SPACE}{INITIAL}").match(text, at)
                return i.span() if i and self._is_given(g) else self._single(text, at)
            return m.span()
        if m.group("gi") and not self._is_given(m.group("g4")):
            return self._single(text, at)
        if m.group("alone"):
            return self._single(text, at)
        return m.span()

    def _single(self, text: str, at: int) -> tuple[int, int] | None:
        m = re.compile(FAMILY).match(text, at)
        return m.span() if m and self._is_family(m.group()) else None

    def _is_given(self, word: str) -> bool:
        return word.split()[0].lower() in self.given

    def _is_family(self, word: str) -> bool:
        return any(w in self.family for w in re.split(r"[\s\-\u2010\u2011]+", word.lower()))

    def _around_family(self, text: str, low: str, s: int, e: int, taken: _Taken) -> None:
        """A known family name, with what belongs to it on either side."""
        if text[s:e].islower():  # in lower case only with a given name before it
            m = re.compile(rf"(?<![\w@.+\-])({LETTERS}+){SPACE}$").search(text, _back(text, s, 1), s)
            if m and m.group(1).lower() in self.given:
                f = re.compile(LOWER_FAMILY).match(text, s)
                taken.add(m.start(1), f.end() if f else e, NAME)
            return
        left = re.compile(rf"(?:{PARTICLE}?{BASE}[\-\u2010\u2011])+{PARTICLE}?$|{PARTICLE}$").search(text, _back(text, s, 3), s)
        if left and not (left.start() and text[left.start() - 1].isalnum()):
            s = left.start()
        right = re.compile(rf"(?:[\-\u2010\u2011]{PARTICLE}?{BASE})+").match(text, e)
        if right:
            e = right.end()
        nxt = re.compile(r"[ \u00a0](\w+)").match(text, e)
        prev = re.compile(rf"([\w’'\-]+\.?)({SPACE})$").search(text, _back(text, s, 1), s)
        if nxt and nxt.group(1).lower() in PLACE_AFTER and nxt.group(1)[0].isupper() or prev and prev.group(1).lower() in PLACE_BEFORE and prev.group(1)[0].isupper():
            return
        if e < len(text) and text[e] in "@＠" or s and text[s - 1] in "@.+/_" and text[s - 1 : s] != ".":
            return
        reverse = re.compile(rf",{SPACE}({GIVEN}(?:{SPACE}{INITIAL})?|{INITIAL})(?![\w@+])").match(text, e)
        if reverse and (self._is_given(reverse.group(1)) or reverse.group(1).endswith(".") and len(reverse.group(1)) == 2 or not self._common(reverse.group(1)) and not self._is_family(reverse.group(1))):
            after = reverse.group(1)
            more = re.compile(rf"{SPACE}{FAMILY}").match(text, reverse.end())
            if not (more and self._is_given(after) and not _stops(more.group().split()[-1]) and self._is_family(more.group())):  # else a list of people
                taken.add(s, reverse.end(), NAME)
                return
        if prev:
            word = prev.group(1)
            if re.fullmatch(INITIAL, word):
                s = prev.start(1)
                first = re.compile(rf"({BASE}){SPACE}$").search(text, _back(text, s, 1), s)
                if first and not _stops(first.group(1)) and first.group(1) not in TITLES and (self._is_given(first.group(1)) or len(first.group(1)) > 1):
                    s = first.start(1)
            elif word.rstrip(".") not in TITLES and not word.endswith(".") and word[0].isupper() and (word.lower() in self.given or not _stops(word) and word.isalpha() and len(word) > 2 and (word.istitle() or word.isupper() and text[e - 3 : e].isupper())):
                s = prev.start(1)
        taken.add(s, e, NAME)

    def _after_given(self, text: str, low: str, s: int, e: int, taken: _Taken) -> None:
        """A known given name, and a family name or initial after it."""
        if not text[s].isupper():
            m = re.compile(rf"{SPACE}({LOWER_FAMILY})").match(text, e)
            if m and any(w in self.family for w in re.split(r"[\s\-]+", m.group(1).lower())):
                taken.add(s, m.end(), NAME)
            return
        if s and text[s - 1] in "-.+_@/" or e < len(text) and text[e] in "-+_@＠":
            return
        m = re.compile(rf"{SPACE}(?:{INITIAL}{SPACE})?({FAMILY})").match(text, e)
        if m:
            nxt = re.compile(r"[ \u00a0](\w+)").match(text, m.end())
            if not _stops(m.group(1)) and not self._is_given(m.group(1)) and m.group(1).lower() not in PLACE_AFTER and not (nxt and nxt.group(1)[0].isupper() and nxt.group(1).lower() in PLACE_AFTER):
                if text[s:e].isupper() == m.group(1).split("-")[-1].split()[-1].isupper() or len(m.group(1)) > 3:
                    taken.add(s, m.end(), NAME)
                    return
        i = re.compile(rf"{SPACE}{INITIAL}(?!\w)").match(text, e)
        if i:
            taken.add(s, i.end(), NAME)


class _Taken:
    """Spans without overlaps."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.items: list[tuple[int, int, str]] = []

    def covers(self, s: int, e: int) -> bool:
        k = bisect_right(self.starts, s)
        return bool(k and self.items[k - 1][1] > s or k < len(self.items) and self.items[k][0] < e)

    def add(self, s: int, e: int, kind: str) -> bool:
        if e <= s or self.covers(s, e):
            return False
        k = bisect_right(self.starts, s)
        self.starts.insert(k, s)
        self.items.insert(k, (s, e, kind))
        return True

    def sorted(self) -> list[tuple[int, int, str]]:
        return self.items


BLANKS = " \u00a0\u200b\n\r\t"


def _back(text: str, at: int, words: int, floor: int = 0) -> int:
    """Where so many words before a place begin."""
    for _ in range(words):
        while at > floor and text[at - 1] in BLANKS:
            at -= 1
        while at > floor and text[at - 1] not in BLANKS:
            at -= 1
    return at


def _ahead(text: str, at: int, words: int) -> int:
    """Where so many words after a place end."""
    n = len(text)
    for _ in range(words):
        while at < n and text[at] in BLANKS:
            at += 1
        while at < n and text[at] not in BLANKS:
            at += 1
    return at


def _begins(text: str, at: int) -> bool:
    """Whether a sentence, a line or a field begins here."""
    while at and text[at - 1] in " \u00a0\u200b":
        at -= 1
    return not at or text[at - 1] in ".!?:;>})]|*-\n\r\t"


def _stops(word: str) -> bool:
    return re.split(r"[\s\-,]+", word.strip())[0].lower().rstrip(".") in NO_NAME


def _trim_title(text: str, s: int, e: int) -> tuple[int, int]:
    m = re.compile(rf"(?i:{'|'.join(TITLES)})\.?{SPACE}").match(text, s, e)
    return (m.end() if m else s), e


# --- pseudonyms --------------------------------------------------------------------------------------------------------

ROUNDS = 10


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "|".join(map(str, parts)).encode(), hashlib.sha256).digest()[:16], "big")


def feistel(symbols: list[int], radix: int, key: bytes, tweak: str, back: bool = False) -> list[int]:
    """A keyed permutation of all strings of so many symbols of a radix."""
    n = len(symbols)
    if n == 1:
        shift = _number(key, tweak, "one") % radix
        return [(symbols[0] + (-shift if back else shift)) % radix]
    u = n // 2
    a, b = symbols[:u], symbols[u:]
    to_int = lambda d: int("".join(map(str, d)), 10) if radix == 10 else sum(v * radix**i for i, v in enumerate(reversed(d)))

    def of_int(x: int, size: int) -> list[int]:
        out = []
        for _ in range(size):
            x, r = divmod(x, radix)
            out.append(r)
        return out[::-1]

    x, y, p, q = to_int(a), to_int(b), radix ** len(a), radix ** len(b)
    rounds = range(ROUNDS)
    for i in reversed(rounds) if back else rounds:  # the halves take turns in being added to
        if i % 2 == 0:
            f = _number(key, tweak, n, i, y)
            x = (x - f if back else x + f) % p
        else:
            f = _number(key, tweak, n, i, x)
            y = (y - f if back else y + f) % q
    return of_int(x, len(a)) + of_int(y, len(b))


def permute_format(value: str, key: bytes, tweak: str, back: bool = False) -> str:
    """Digits become digits; all other signs stay where they are."""
    at = [i for i, c in enumerate(value) if "0" <= c <= "9"]
    return _with_digits(value, at, feistel([int(value[i]) for i in at], 10, key, tweak, back)) if at else value


def _with_digits(value: str, at: list[int], digits: list[int]) -> str:
    out = list(value)
    for i, d in zip(at, digits, strict=True):
        out[i] = str(d)
    return "".join(out)


#: Country and digits that are kept (area or mobile prefix) of a national number, by how it begins without its leading 0.
AREAS = [("61", r"4\d{8}", 2), ("61", r"[2378]\d{8}", 1), ("44", r"20\d{8}", 2), ("44", r"7\d{9}", 4), ("44", r"1\d{8,9}", 3), ("1", r"[2-9]\d{9}", 3), ("33", r"[1-9]\d{8}", 1), ("49", r"[1-9]\d{6,11}", 3)]


def _phone(value: str) -> tuple[str, list[int], int]:
    """Country, places of the national digits in the text, and how many of them are kept: the same number for each of its spellings."""
    skip = re.search(r"\(0\)", value)
    at = [i for i, c in enumerate(value) if "0" <= c <= "9" and not (skip and i == skip.start() + 1)]
    abroad = value.lstrip("( ").startswith(("+", "00"))
    if abroad:
        at = at[2:] if not value.lstrip("( ").startswith("+") else at
        digits = "".join(value[i] for i in at)
        for country, form, kept in AREAS:
            if digits.startswith(country) and re.fullmatch(form, digits[len(country) :]):
                return country, at[len(country) :], kept
        return "", at, 4  # a country whose numbers aren't known here: its code and what follows are kept
    trunk = value[at[0]] == "0"
    at = at[1:] if trunk else at
    digits = "".join(value[i] for i in at)
    spaced = re.fullmatch(r"\(?0?[1-9]\)?(?:\D?\d\d){4}", value) is not None
    for country, form, kept in AREAS:
        if (country == "1") != trunk and re.fullmatch(form, digits) and not (spaced and country in ("61", "44")):
            return country, at, kept
    return "", at, 2


def permute_phone(value: str, key: bytes, back: bool = False) -> str:
    """The subscriber's digits permuted; country, area or mobile prefix and the spelling stay, and all spellings of a number have one image."""
    country, at, kept = _phone(value)
    kept = min(kept, max(0, len(at) - 4))
    tweak = f"phone|{country}|{''.join(value[i] for i in at[:kept])}"
    return _with_digits(value, at[kept:], feistel([int(value[i]) for i in at[kept:]], 10, key, tweak, back))


def permute_id(value: str, key: bytes, back: bool = False) -> str:
    """The digits permuted within their scheme, whatever the spelling: letters of issuers stay; valid numbers become valid ones, others stay invalid."""
    letters, digits = _split(value)
    at = [i for i, c in enumerate(value) if "0" <= c <= "9"]
    if not at:
        return value
    if valid(value):
        check = _check(letters, digits)
        free = len(digits) - len(check[0])
        body = digits[:free]
        while True:  # walk on where no check digit exists
            body = feistel(body, 10, key, f"id|valid|{'' if check[1] else letters}|{len(digits)}", back)
            new = _check(letters, body + digits[free:])
            if new is not None:
                break
        out = _with_digits(value, at, body + new[0])
        if new[1]:
            k = next(i for i, c in enumerate(value) if c.upper() == letters)
            out = out[:k] + (new[1] if value[k].isupper() else new[1].lower()) + out[k + 1 :]
        return out
    while True:  # walk on until the number is as invalid as before
        digits = feistel(digits, 10, key, f"id|{letters}|{len(digits)}", back)
        out = _with_digits(value, at, digits)
        if not valid(out):
            return out


FIRST_DAY, DAYS = dt.date(1900, 1, 1), 73_049  # to the end of 2099


def permute_date(day: dt.date, key: bytes, back: bool = False) -> dt.date:
    """A keyed permutation of the days from 1900 to 2099; other days stay. Walks the cycle of five digits until a day is met."""
    n = (day - FIRST_DAY).days
    if not 0 <= n < DAYS:
        return day
    while True:
        n = int("".join(map(str, feistel([int(c) for c in f"{n:05d}"], 10, key, "date", back))))
        if n < DAYS:
            return FIRST_DAY + dt.timedelta(days=n)


#: A date of birth: a word for it, then a date in one of three forms.
BORN = re.compile(r"(?i:\b(?:born(?: on)?|date of birth|d\.?o\.?b\.?|birth date|birthday|geboren am|geb\.|geburtsdatum|née? le|date de naissance|nacid[oa] el|fecha de nacimiento|nascid[oa] em|дата рождения|родился|родилась))[ \u00a0]?:?[ \u00a0]?(\d{4}-\d\d-\d\d|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?!\d)(?![./-]\d)")


def permute_written_date(value: str, key: bytes) -> str:
    """permute_date in the form of the text (year-month-day, day.month.year, day/month/year); what is no date stays."""
    parts = [int(p) for p in re.split(r"[-./]", value)]
    year, month, day = parts if "-" in value else parts[::-1]
    try:
        new = permute_date(dt.date(year, month, day), key)
    except ValueError:
        return value
    return new.isoformat() if "-" in value else new.strftime("%d.%m.%Y" if "." in value else "%d/%m/%Y")


def placeholder(kind: str, value: str, key: bytes) -> str:
    """<PHONE:...>, <ID_NUMBER:...> and <DATE:...> hold a permuted value of the same format, the others a keyed number of 96 bits; equal values give equal ones."""
    if kind in (PHONE, ID_NUMBER, DATE):
        new = permute_phone(value, key) if kind == PHONE else permute_id(value, key) if kind == ID_NUMBER else permute_written_date(value, key)
        return f"<{kind.upper()}:{new}>"
    same = " ".join(value.casefold().split())
    return f"<{kind.upper()}:{_number(key, kind, same) % 2**96:024x}>"


# --- operators ---------------------------------------------------------------------------------------------------------

#: Rows of a list of names that each task holds as a whole (about 100 bytes each); a longer list is joined to the texts.
NAMES_LIMIT = 200_000


def _with_names(df: DataFrame, known: DataFrame, id: str, text: str, limit: int) -> tuple[DataFrame, list[tuple[str, str]] | None]:
    """(id, text, names): each text with the names of the list that it holds, or with null and the list itself if that is short."""
    rows = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    listed = known.select("name", "role").dropna(subset=["name"]).distinct()
    kind = "array<struct<name:string,role:string>>"
    if at_most(listed, limit):
        return rows.withColumn("names", F.lit(None).cast(kind)), [(r[0], r[1]) for r in listed.collect()]
    # Each different text is met by its words, each name by its first word; a name's other words are checked where it is looked for.
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{M}]+"))
    key = F.sha2("text", 256).alias("_key")
    texts = rows.select(key, "text").dropDuplicates(["_key"]).select("_key", F.explode(words(F.col("text"))).alias("_word")).filter("_word <> ''")
    first = listed.withColumn("_word", F.element_at(F.filter(words(F.col("name")), lambda w: w != ""), 1))
    held = texts.join(first, "_word").groupBy("_key").agg(F.collect_set(F.struct("name", "role")).alias("names"))
    return rows.withColumn("_key", key).join(held, "_key", "left").select("id", "text", F.coalesce("names", F.array().cast(kind)).alias("names")), None


def find_personal(df: DataFrame, known_names: DataFrame, id: str = "doc_id", text: str = "text", *, dates: bool = False, folder: str = TOKENIZERS, names_limit: int = NAMES_LIMIT) -> DataFrame:
    """(id, kind, found): one row for each different string of a text that is personal information, exactly as it stands there.

    kind is email, phone, id_number, address or name, and with dates=True date (of birth). known_names(name, role) is a list of given and family
    names; other names are found by their shape and by words of the public vocabularies in folder (a common word is no name), in general after
    roles, greetings, "... by" and the like, else only given and family name together. Null and empty texts give no rows; repeated rows of df give
    repeated rows. Nothing is shuffled, unless the list of names has more than names_limit rows.
    """
    ready, names = _with_names(df, known_names, id, text, names_limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(names or [], folder)
        for b in batches:
            ids, kinds, found = [], [], []
            for i, t, own in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if t:
                    for kind, value in dict.fromkeys((k, t[s:e]) for s, e, k in finder.spans(t, _pairs(own), dates)):
                        ids.append(i)
                        kinds.append(kind)
                        found.append(value)
            yield pa.record_batch([pa.array(ids, b.schema.field(0).type), pa.array(kinds, pa.string()), pa.array(found, pa.string())], ["id", "kind", "found"])

    return ready.mapInArrow(run, f"id {ready.schema['id'].dataType.simpleString()}, kind string, found string").withColumnRenamed("id", id)


def replace_personal(df: DataFrame, known_names: DataFrame, key: str, id: str = "doc_id", text: str = "text", *, dates: bool = False, folder: str = TOKENIZERS, names_limit: int = NAMES_LIMIT) -> DataFrame:
    """(id, text): each text with its personal information (see find_personal) replaced by placeholders, all else unchanged; null stays null."""
    ready, names = _with_names(df, known_names, id, text, names_limit)
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(names or [], folder)
        for b in batches:
            out = []
            for t, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if t:
                    parts, at = [], 0
                    for s, e, k in finder.spans(t, _pairs(own), dates):
                        parts += [t[at:s], placeholder(k, t[s:e], secret)]
                        at = e
                    t = "".join([*parts, t[at:]])
                out.append(t)
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], ["id", "text"])

    return ready.mapInArrow(run, f"id {ready.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id)


def _pairs(names: list[dict] | None) -> list[tuple[str, str]] | None:
    return None if names is None else [(n["name"], n["role"]) for n in names]


_FINDERS: dict[tuple, Finder] = {}


def _finder(names: list[tuple[str, str]], folder: str) -> Finder:
    """One for each list of names in a worker process."""
    key = frozenset(names), folder
    if key not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[key] = Finder(names, vocabulary(folder))
    return _FINDERS[key]

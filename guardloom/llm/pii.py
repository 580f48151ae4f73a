"""Personal information in free text: found, and replaced by typed placeholders.

Patterns find candidates in a folded copy of the text (widths, invisible
characters and look-alike letters undone, with the way back to the original
positions), and check digits decide where a format alone does not. Numbers and
dates are replaced by keyed Feistel permutations of themselves within their
format, check digits worked out anew, so equal values stay equal across
documents; other items get a keyed tag.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left as bisect
from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardloom.llm.common import spread
from guardloom.llm.identity import permuted, scheme_of
from guardloom.llm.lookalike import LOOKALIKES

KINDS = ("email", "phone", "identity_number", "street_address", "person_name")

# --- folding ------------------------------------------------------------------------

_ODD = re.compile("[^\\x00-\\x7f¡-ɏ‘-„–—…€]|[ª²³¹º­]")
_LATIN_OF = {a: b for src, dst in LOOKALIKES.items() for a, b in zip(src, dst)}
_fold_of: dict[str, str] = {}


def _fold_char(c: str) -> str:
    got = _fold_of.get(c)
    if got is None:
        if unicodedata.category(c) in ("Cf", "Cc", "Mn") and c not in "\n\t\r":
            got = ""
        elif unicodedata.category(c) == "Zs":
            got = " "
        elif c in "‐‑‒−":
            got = "-"
        else:
            got = c if c in "ªº²³¹" else unicodedata.normalize("NFKC", c)
            if not _FOREIGN.match(got):
                got = "".join(_LATIN_OF.get(x, x) for x in got)
        if len(_fold_of) < 100_000:
            _fold_of[c] = got
    return got


#: Words with letters of the scripts that have look-alikes of Latin ones.
_FOREIGN = re.compile("[^\\W\\d_]*[\u0370-\u058f\u1f00-\u1fff][^\\W\\d_]*")
_LATIN_LETTER = re.compile("[A-Za-z\u00c0-\u024f]")


def _to_latin(m: re.Match) -> str:
    """A word in look-alike letters as the Latin word it is drawn as; real words of other scripts stay.

    It is one if it has Latin letters too, or nothing but look-alikes.
    """
    w = m[0]
    if _LATIN_LETTER.search(w) or all(c in _LATIN_OF for c in w):
        return "".join(_LATIN_OF.get(c, c) for c in w)
    return w


def fold(text: str) -> tuple[str, list[int] | None]:
    """The text with odd characters undone, and the original position of each character."""
    if text.isascii() or not _ODD.search(text):
        return text, None
    out, at = [], []
    for i, c in enumerate(text):
        f = c if c < "\x7f" and c >= " " else _fold_char(c)
        out.append(f)
        at += [i] * len(f)
    at.append(len(text))
    return _FOREIGN.sub(_to_latin, "".join(out)), at


# --- patterns -----------------------------------------------------------------------

_HOST = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_EMAIL = re.compile(
    rf"(?<![\w@/.+-])[a-z0-9][\w.+%'-]*(?: ?@ ?{_HOST}(?:\.{_HOST})*\.[a-z]{{2,24}}(?![\w@/])"
    rf"| ?[\[({{]at[\])}}] ?{_HOST}(?: ?(?:\.|[\[({{](?:dot|punkt|point|punto)[\])}}]) ?{_HOST})*(?:\.| ?[\[({{](?:dot|punkt|point|punto)[\])}}] ?)[a-z]{{2,24}}\b"
    rf"| at {_HOST}(?: dot {_HOST})* dot [a-z]{{2,24}}\b)",
    re.I,
)

_CUE_PHONE = re.compile(r"\b(?:tel|phone|telefon|t[ée]l[ée]phone|tel[ée]fono|m[óo]vil|mobile|mobil|handy|fax|call|ring|llamar|llame|joignable|erreichen|anrufen|reach me|al|au|en el|unter)(?:\"?[ :./=]{1,3}\"?)(?:\w{1,3} )?$", re.I)
_NOT_PHONE = re.compile(r"(?<![a-zà-ÿ])(?:invoice|order|ticket|ref|serial|build|version|phase|id|no|number|commande|bestellung|pedido|rechnung|factura|facture|#)\W{0,3}$", re.I)
_ORDER = re.compile(r"(?<![a-zà-ÿ])(?:invoice|order|ticket|serial|build|version|commande|bestellung|pedido|rechnung|factura|facture)\W{0,3}$", re.I)
_PHONES = [
    re.compile(p)
    for p in (
        r"(?<![\w.+-])(?:\+?1[ .-]?)?(?:\([2-9][0-8]\d\) ?|[2-9][0-8]\d[ .-])[2-9]\d\d[ .-]\d{4}(?: ?(?:ext\.?|x|Durchwahl) ?\d{1,5})?(?![\w-])",
        r"(?<![\w.+-])\+\d{1,3}(?:[ ./-]?\(?\d{1,5}\)?){2,6}(?: ?(?:ext\.?|x) ?\d{1,5})?(?![\w-])",
        r"(?<![\w.+-])00[1-9]\d(?:[ ./-]\d{2,8}){2,5}(?![\w-])",
        r"(?<![\w.+-])\(0\d{1,4}\) ?\d{3,8}(?:[ -]\d{2,6}){0,3}(?![\w-])",
        r"(?<![\w.+-])0\d{1,4}[ /]\d{3,8}(?:[ -]\d{2,6}){0,2}(?![\w-])",
        r"(?<![\w.+-])0[1-9](?:[ .-]?\d\d){4}(?![\w-])",
        r"(?<![\w.+-])07\d{9}(?![\w-])",
        r"(?<![\w.+-])[6-9]\d\d(?: \d\d){3}(?![\w-])",
        r"(?<![\w.+-])[6-9]\d\d \d{3} \d{3}(?![\w-])",
    )
]
_PHONE_LOCAL = re.compile(r"(?<![\w.+/-])(?<!\d )\d{3}-\d{4}(?: ?(?:ext\.?|x) ?\d{1,5})?(?![\w-])")
_PHONE_PLAIN = re.compile(r"(?<![\w.+-])[2-9]\d{8,9}(?![\w-])")

_ID_CUE = re.compile(
    r"(?:\b(?:NHS|NINO|NI|SSN|SIN|ITIN|TIN|NIR|DNI|NIF|NIE|CPF|BSN|PESEL)\b|soc(?:ial|\.)? ?sec(?:urity|\.)?|national (?:id|identity|insurance)|passport|driv(?:ing|er'?s?) licen[cs]e|identity (?:card|document)|id card|tax(?:payer)? (?:id|ident\w*|number)"
    r"|Steuer-?ID|Steuer(?:identifikations)?nummer|Steuer-?Nr|Sozialversicherungs(?:nummer|-?Nr)|(?:Personal)?ausweis(?:nummer|-?Nr)?|Reisepass(?:nummer)?|Führerschein(?:nummer)?|Versichertennummer"
    r"|carte d['’]identit[ée]|passeport|permis de conduire|s[ée]curit[ée] sociale|numéro fiscal|documento de identidad|pasaporte|permiso de conducir|seguridad social|tarjeta sanitaria|cédula"
    r"|codice fiscale|carta d['’]identità|passaporto|patente di guida|tessera sanitaria|contribuinte|cartão de cidadão|bilhete de identidade|passaporte|carta de condução|segurança social"
    r"|burgerservicenummer|sofinummer|rijbewijs(?:nummer)?|paspoort(?:nummer)?|identiteitskaart|dow[óo]d(?:u)? osobist(?:y|ego)|paszport(?:u)?|prawo jazdy|\bNIP\b|СНИЛС|ИНН|паспорт(?:а|е|ом)?|водительск\w+ удостоверени\w+|полис(?:а)? ОМС)"
    r"(?:[ .:#]{0,2}(?:number|num|nummer|numer|numero|numéro|número|номер|no|nr|n°|nº|№|núm|is|est|es|ist|lautet|è|é|to)\b\.?|[ .:#]{0,2}n[°º])?[ .:#=]{0,3}"
    r"(?P<v>(?-i:(?:[A-Z]{1,3} ?)?\d(?:[ .\-/]?[0-9]){4,20}(?:[ -]?[A-Z]{1,2}(?![a-zà-ÿ])(?: ?\d{3})?)?))",
    re.I,
)
_IDS = [
    re.compile(r"(?<![\w.+-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])"),
    re.compile(r"(?<![\w-])[A-CEGHJ-PQR-TW-Z][A-CEGHJ-NPQR-TW-Z] ?\d\d ?\d\d ?\d\d ?[A-D](?![\w-])"),
    re.compile(r"(?<![\w.+-])[12] ?\d\d ?\d\d ?\d\d ?\d{3} ?\d{3} ?\d\d(?![\w-])"),
    re.compile(r"(?<![\w.+-])\d\d \d{6} [A-Z] \d{3}(?![\w-])"),
]
#: Formats that other numbers share: a check digit decides.
_CHECKED = re.compile(
    "|".join((
        r"(?<![\w.+-])(?:\d{8}|[XYZ][- ]?\d{7})[- ]?[A-HJ-NP-TV-Z](?![\w-])",
        r"(?<![\w.+-])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\w-])",
        r"(?<![\w.+-])\d{3}-\d{3}-\d{3}[ -]\d{2}(?![\w-])",
        r"(?<![\w.+-])[A-Z]{6} ?\d\d[A-EHLMPRST]\d\d ?[A-Z]\d{3}[A-Z](?![\w-])",
    ))
)
_ID_NHS = re.compile(r"(?<![\w.+-])\d{3}[ -]?\d{3}[ -]?\d{4}(?![\w-])")
#: Telephone numbers of North America: area codes whose second digit is 9 are not given out.
_NANP = re.compile(r"[2-9][0-8]\d[ -]?[2-9]\d\d[ -]?\d{4}")

_STREET_EN = r"(?:street|st|road|rd|avenue|ave|av|lane|ln|close|crescent|cres|row|drive|dr|court|ct|way|place|pl|terrace|square|sq|boulevard|blvd|gardens|grove|mews|walk|parade|hill|yard|alley|quay|bend)"
_STREETS = [
    re.compile(p, re.I)
    for p in (
        rf"(?<![\w.-])(?:(?:flat|apt|apartment|unit|suite) ?\d{{1,4}}\w?, ?)?(?:no\.? ?)?\d{{1,5}}[a-z]?,? (?:(?!(?:and|or|of|the|is|are|in|on|to|at) )[a-zà-ÿ'’-]+ ){{1,3}}{_STREET_EN}\b\.?(?:,? (?:apt|flat|unit|suite)\.? ?\d{{1,4}}\w?)?(?:,? [a-zà-ÿ'’-]+(?: [a-zà-ÿ'’-]+)?(?:,? [a-z]{{1,2}}\d{{0,2}}[a-z]? ?\d[a-z]{{2}}|,? [a-z]{{2}},? \d{{5}}|,? \d{{5}})|(?=[,;.\n]|$| ))",
        r"(?<!\w)(?:am|an der|im|in der|auf dem|zum|zur|alte|neue|kleine|große|obere|untere)? ?[a-zäöüß-]+(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|ring|damm|graben|markt|steig|berg|pfad) ?\d{1,4}(?: ?[a-z](?!\w))?(?:(?:,? ?(?:hinterhaus|vorderhaus))?,? (?:in )?\d{5} [a-zäöüß-]+(?: (?:am|an|im|a\.) [a-zäöüß]+)?)?",
        r"(?<!\w)\d{1,4}(?: ?(?:bis|ter|quater|[a-d]))?,? (?:rue|avenue|av\.|impasse|boulevard|bd|place|chemin|allée|quai|route|cours|square|passage|ruelle|sentier)(?: (?:de|du|des|la|le|les)| d['’]| l['’])* ?[a-zà-ÿ'’-]+(?:[ -][a-zà-ÿ'’-]+){0,2}(?:,? bât\. ?\w)?(?:,? \d{5} [a-zà-ÿ'’-]+)?",
        r"(?<!\w)(?:calle|c/|avda\.?|avenida|plaza|pza\.?|paseo|p\.º|camino|carrer|ronda|travesía|glorieta|cuesta)(?: (?:de|del|la|las|los|el))* ?[a-zà-ÿ'’-]+(?: (?:de |del |la |los )?[a-zà-ÿ'’-]+){0,3},? (?:n[oº°]\.? ?|núm\.? ?)?\d{1,4}(?:, ?\d{1,2}\.? ?[oºa]? ?[a-z]\b)?(?:,? \d{5} [a-zà-ÿ'’-]+)?",
    )
]
_UP, _DOWN = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĘĚĞĻŁŃŇŐŘŚŠŤŮŰŹŻŽА-ЯЁ", "a-zà-öø-ÿāăąćčďęěğļłńňőřśšťůűźżžа-яё"
_PLACE = rf"[{_UP}][{_DOWN}{_UP}'’-]+"
_STREETS += [
    re.compile(p)
    for p in (
        rf"(?<!\w)(?:(?:Via|Viale|Piazza|Piazzale|Corso|Largo|Vicolo|Strada)|(?<=[ai]n )(?:via|viale|piazza|corso|largo|vicolo))(?: (?:del|della|dello|dei|degli|delle|di|san|santa|dell['’]))*(?: ?{_PLACE}){{1,3}},? (?:n\.? ?)?\d{{1,4}}(?:/?[a-zA-Z]\b)?(?:,? \d{{5}} {_PLACE})?",
        rf"(?<!\w)(?:[Rr]ua|[Tt]ravessa|[Pp]raça|[Ee]strada|[Aa]lameda|Largo|Avenida|Av\.)(?: (?:de|do|da|dos|das))* {_PLACE}(?: (?:(?:de|do|da|dos|das) )?{_PLACE}){{0,3}},? (?:n\.?º? ?)?\d{{1,4}}(?:,? \d\.?º)?(?:,? \d{{4,5}}-\d{{3}} {_PLACE})?",
        rf"(?<!\w)(?:{_PLACE} )?[{_UP}]?[{_DOWN}]+(?:straat|laan|plein|gracht|kade|dijk|singel|steeg) \d{{1,4}}(?: ?[a-zA-Z]\b)?(?:,? \d{{4}} ?[A-Z]{{2}} {_PLACE})?",
        rf"(?<!\w)(?:[Uu]l\.|[Uu]lica|[Uu]licy|[Aa]l\.|[Aa]leja|[Aa]lei|[Pp]l\.|[Pp]lac|[Oo]s\.) (?:{_PLACE} ){{1,3}}\d{{1,4}}[a-zA-Z]?(?:/\d{{1,4}}| m\. ?\d{{1,4}})?(?:,? \d\d-\d{{3}} {_PLACE})?",
        rf"(?<!\w)(?:(?:[Уу]л\.|[Уу]лица|[Уу]лице|[Пп]р\.|[Пп]роспект|[Пп]роспекте|[Пп]ер\.|[Пп]ереулок|[Пп]л\.|[Пп]лощадь|[Шш]оссе|[Бб]ульвар|[Нн]аб\.) (?:{_PLACE} ?){{1,3}}),? ?(?:д\.|дом)? ?\d{{1,4}}[а-я]?(?:,? (?:кв\.|корп\.|стр\.|квартира) ?\d{{1,4}})*",
    )
]
#: Words without one of which a pattern need not be tried.
_STREET_WORDS = (
    tuple(f" {w}" for w in ("street", "st.", "st ", "st,", "road", "rd", "ave", "lane", "ln", "close", "cres", "row", "drive", "dr", "court", "ct", "way", "place", "pl", "terrace", "square", "sq", "boulevard", "blvd", "gardens", "grove", "mews", "walk", "parade", "hill", "yard", "alley", "quay", "bend")),
    ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ufer", "ring", "damm", "graben", "markt", "steig", "berg", "pfad"),
    ("rue ", "avenue", "av.", "impasse", "boulevard", "bd ", "place", "chemin", "allée", "quai", "route", "cours", "square", "passage", "ruelle", "sentier"),
    ("calle", "c/", "avda", "avenida", "plaza", "pza", "paseo", "p.º", "camino", "carrer", "ronda", "travesía", "glorieta", "cuesta"),
    ("via ", "viale ", "piazza", "corso ", "largo ", "vicolo", "strada "),
    ("rua ", "travessa", "praça", "estrada", "alameda", "largo ", "avenida", "av. "),
    ("straat", "laan ", "plein", "gracht", "kade", "dijk", "singel", "steeg"),
    ("ul. ", "ulic", "al. ", "alej", "alei", "pl. ", "plac ", "os. "),
    ("ул. ", "улиц", "пр. ", "проспект", "пер. ", "переулок", "пл. ", "площадь", "шоссе", "бульвар", "наб. "),
)

_CAP = r"[A-ZÀ-ÖØ-Þ](?:[a-zà-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+)(?:['’-][A-ZÀ-ÖØ-Þ][a-zA-Zà-öø-ÿÀ-Þ]+)?"
_LOW = r"[a-zà-öø-ÿ]{2,}(?:-[a-zà-öø-ÿ]{2,})?"
_TITLE = r"(?:Mrs?|Ms|Miss|Dr|Prof|Herrn?|Frau|M|Mme|Mlle|Monsieur|Madame|Sra?|Srta|Señora?|Don|Doña)"
_NAME = rf"(?:{_TITLE}\.? )?(?:{_CAP}, (?!Flat|Apt|Unit|Suite|No\b){_CAP}|[A-Z]\. ?(?:[A-Z]\. ?)?{_CAP}|{_CAP} (?:[A-Z]\. )?{_CAP})|{_TITLE}\.? {_CAP}"
_ANY = rf"(?:{_NAME}|{_LOW},? {_LOW})"
_NAME_CUES = [
    # greetings, signatures and fields: a name in any case follows
    (('regards', 'sincerely', 'yours ', 'signed', 'freundlichen', 'grüße', 'grusse', 'saludos', 'atentamente', 'cordialement', 'bien à vous'), re.compile(rf"(?:(?:[Kk]ind |[Bb]est |[Ww]arm )?[Rr]egards|[Ss]incerely(?: yours)?|[Yy]ours \w+|[Ss]igned(?: by)?|[Mm]it freundlichen Gr[üu](?:ß|ss)en|[Vv]iele Grüße|[Ll]iebe Grüße|[Ss]aludos(?: cordiales)?|[Aa]tentamente|[Cc]ordialement|[Bb]ien à vous),\s+(?P<n>{_ANY})")),
    (('name', 'user', 'nombre', 'nom', 'customer', 'patient', 'kunde', 'client'), re.compile(rf"(?<!\w)(?:[Nn]ame|[Uu]ser|[Nn]ombre|[Nn]om|[Cc]ustomer|[Pp]atient|[Kk]unde|[Cc]liente?)\"? ?[:=] ?\"?(?P<n>{_ANY})(?=[\",;.\n(]| [A-ZÀ-Þ¿¡А-Я(#\[]| ticket| id=| ref|$)")),
    (('record: ', 'file: '), re.compile(rf"(?:[Cc]ustomer|[Pp]atient|[Ee]mployee|[Pp]ersonnel) (?:record|file): (?P<n>{_ANY})(?=[;,])")),
    (('my name is', 'heiße', 'name ist', "m'appelle", 'm’appelle', 'mon nom', 'llamo', 'nombre es'), re.compile(rf"(?:[Mm]y name is|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]on nom est|[Mm]e llamo|[Mm]i nombre es) (?P<n>{_NAME}|{_LOW} {_LOW}(?= (?:and|und|et|y)\b))")),
    # verbs: what follows the name tells it from other words
    (('this is ',), re.compile(rf"\b[Tt]his is (?P<n>{_ANY})(?= (?:from|of|speaking|calling|at)\b)")),
    ((' to ',), re.compile(rf"\b(?:[Dd]eliver|[Ss]end it|[Ff]orward (?:the \w+|it|this)|[Hh]and (?:the \w+|it)|[Ss]how it|[Aa]ssign (?:the \w+|it)) to (?P<n>{_NAME}|{_LOW},? {_LOW}(?=[,.;\n]|$))")),
    ((' belongs to', ' registered to', ' of '), re.compile(rf"\b(?:account|car|house|phone|number|card|file|policy) (?:belongs to|is registered to|of) (?P<n>{_NAME}|{_LOW},? {_LOW}(?= ?[(,;.]))")),
    (('meeting', 'met with', 'spoke ', 'talk'), re.compile(rf"\b(?:[Mm]eeting (?:was|is) with|[Mm]et with|[Ss]poke (?:to|with)|[Tt]alk(?:ed)? (?:to|with)) (?P<n>{_NAME}|{_LOW},? {_LOW}(?= and\b))")),
    (('meeting',), re.compile(rf"\b[Mm]eeting (?:was|is) with (?:\S+ ){{2,4}}and (?P<n>{_NAME}|{_LOW},? {_LOW}(?=[.,;\n]|$))")),
    (('call ', 'ring ', 'phone ', 'contact ', 'reach '), re.compile(rf"\b(?:[Cc]all|[Rr]ing|[Pp]hone|[Cc]ontact|[Rr]each) (?P<n>{_ANY})(?= (?:at|on|under) [+(\d])")),
    (('ask ',), re.compile(rf"\b[Aa]sk (?P<n>{_ANY})(?= (?:whether|if|for|about|to)\b)")),
    ((' asked ', ' asks ', ' wants ', ' requested ', ' called ', ' wrote ', ' moved ', ' lives ', ' works ', ' said '), re.compile(rf"(?:^|[.!?\n] ?|\) |\] |\d )(?P<n>{_ANY})(?= (?:asked|asks|wants|requested|called|wrote|moved|lives|works|said) )")),
    (('ich bin ',), re.compile(rf"\b[Ii]ch bin (?P<n>{_ANY})(?= und\b)")),
    (('konto geh',), re.compile(rf"\bKonto geh[öo]rt (?P<n>{_ANY})(?=[,.;(])")),
    (('fragen sie ',), re.compile(rf"\b[Ff]ragen Sie (?P<n>{_ANY})(?=, (?:Telefon|Tel))")),
    (('au nom de ',), re.compile(rf"\bau nom de (?P<n>{_ANY})(?=[,.;(])")),
    (('demandez ',), re.compile(rf"\b[Dd]emandez (?P<n>{_ANY})(?= au\b)")),
    (('soy ',), re.compile(rf"\b[Ss]oy (?P<n>{_ANY})(?= y\b)")),
    (('cuenta es de ',), re.compile(rf"\bcuenta es de (?P<n>{_ANY})(?=[,.;(])")),
    (('pregunte por ',), re.compile(rf"\b[Pp]regunte por (?P<n>{_ANY})(?= en\b)")),
]
_FULL = rf"{_PLACE}(?: (?:de|van|von|der|den|di|da|do|dos|del|della|la|le|ter|ten|el|al)){{0,2}}(?: {_PLACE}){{1,2}}"
_NAME_CUES += [
    (("mi chiamo", "mio nome", "signor", "dott"), re.compile(rf"(?<!\w)(?:[Mm]i chiamo|[Ii]l mio nome è|[Ss]ignora?|[Dd]ott\.(?:ssa)?) (?P<n>{_FULL}|(?<=ra ){_PLACE}|(?<=or ){_PLACE})")),
    (("chamo-me", "me chamo", "meu nome", "senhor"), re.compile(rf"(?<!\w)(?:[Cc]hamo-me|[Mm]e chamo|[Mm]eu nome é|[Ss]enhora?) (?P<n>{_FULL})")),
    (("mijn naam", "ik heet", "meneer", "mevrouw", "dhr.", "mevr."), re.compile(rf"(?<!\w)(?:[Mm]ijn naam is|[Ii]k heet|[Mm]eneer|[Mm]evrouw|[Dd]hr\.|[Mm]evr\.) (?P<n>{_FULL}|(?:de |van ){{0,2}}{_PLACE})")),
    (("nazywam", "na imię", "pan ", "pani "), re.compile(rf"(?<!\w)(?:[Nn]azywam się|[Mm]am na imię|Pani?) (?P<n>{_FULL}|{_PLACE})")),
    (("зовут", "моё имя", "мое имя", "г-н ", "г-жа ", "господин", "госпожа"), re.compile(rf"(?<!\w)(?:[Мм]еня зовут|[Мм]о[её] имя|[Гг]-н|[Гг]-жа|[Гг]осподин|[Гг]оспожа) (?P<n>{_FULL}|{_PLACE})")),
]
#: Common given names of the nine languages; a capitalised word after one is a surname.
_GIVEN = """James John Robert Michael William David Richard Thomas Daniel Matthew Anthony Andrew Joshua Kevin Brian George Edward Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Emily Laura Emma Olivia Rachel
Hans Peter Klaus Jürgen Wolfgang Stefan Andreas Markus Jens Uwe Ursula Monika Petra Sabine Claudia Katrin Anja Heike Jean Pierre Michel Philippe Alain Nicolas Laurent Marie Nathalie Isabelle Sylvie Catherine Françoise Camille
José Antonio Manuel Francisco Juan Javier Carlos Miguel Alejandro Pablo María Carmen Ana Isabel Lucía Elena Pilar Giuseppe Giovanni Luigi Marco Paolo Matteo Francesca Giulia Chiara Alessandra Valentina João Pedro Tiago Rui Inês Beatriz Joana
Jan Pieter Willem Johannes Sander Daan Femke Sanne Anouk Marieke Piotr Krzysztof Andrzej Tomasz Paweł Marcin Anna Katarzyna Agnieszka Małgorzata Joanna Иван Александр Сергей Дмитрий Алексей Андрей Анна Мария Елена Ольга Наталья Татьяна""".split()
_GIVEN_SET = frozenset(_GIVEN)
_GIVEN_NAME = re.compile(rf"(?<![\w-])(?P<n>(?:{'|'.join(_GIVEN)}) (?:[{_UP}]\. )?(?:(?:de|van|von|der|den|di|da|dos|del|la) ){{0,2}}(?!(?:The|And|Or|Of|Street|Road|Avenue)\b){_PLACE})(?!\w)")
_TITLED = re.compile(rf"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? (?P<n>{_CAP}(?: {_CAP})?)(?![\w@])")
_TITLES = ("mr", "ms ", "ms.", "dr ", "dr.", "prof", "herr ", "frau ", "mme", "sr ", "sr.", "sra ", "sra.")
#: Words that begin a sentence or a lower-case pair and are no names.
_NOT_NAMES = frozenset(
    """the a an this that these those it he she we they you who what back later me my your our his her their someone everyone nobody anybody
    and or but not no yes please to for of in on at by with from as is are was were be been has have had will would can could if when while then than
    support sales security team help desk night front field design training school office library kitchen lab warehouse customer service manager moderator
    der die das ein eine ich wir sie er es und oder nicht kein le la les un une des je nous vous il elle et ou ne pas el los las una yo tú él ella y o no mi tu su
    people users customers reviewer assistant colleague server filter page question answer""".split()
)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


#: A run of digits and their separators, and those of plain record references.
_RUN = re.compile(r"[(+]?\d(?:[ .()/-]{0,2}\d){7,}")
_REFERENCE = re.compile(r"\(?\d{4}-\d{5}|\(?\d{9}")
_ID_WORDS = ("nhs", "nino", " ni n", " ni ", "ssn", " sin ", " tin ", "itin ", "nir ", "dni", "nif", " nie ", "cpf", "bsn", "pesel", "soc. sec", "soc sec", "social sec", "national i", "passport", "ing licen", "er licen", "er's licen", "ers licen", "identity c", "identity d", "id card", "tax id", "taxpayer", "tax number", "steuer", "sozialv", "ausweis", "reisepass", "führerschein", "versicherten", "d'identit", "d’identit", "passeport", "permis de cond", "sécurité soc", "securite soc", "numéro fiscal", "documento de id", "pasaporte", "seguridad soc", "permiso de cond", "tarjeta san", "cédula",
    "codice fisc", "carta d'ident", "carta d’ident", "passaporto", "patente di", "tessera san", "contribuinte", "cartão de cid", "bilhete de id", "passaporte", "carta de cond", "segurança soc", "burgerservice", "sofinummer", "rijbewijs", "paspoort", "identiteitsk", "dowód", "dowod", "paszport", "prawo jazdy", "nip ", "снилс", "инн", "паспорт", "водительск", "полис")


#: Words without one of which a group of patterns need not be tried: identity numbers, titles, streets, names.
_GATES = [_ID_WORDS, _TITLES, *_STREET_WORDS, *(w for w, _ in _NAME_CUES)]
_automaton: list = []


def _open_gates(low: str) -> int:
    """Bit k is set if a word of _GATES[k] occurs; one scan, where the library for it is there."""
    if not _automaton:
        bits: dict[str, int] = {}
        for k, words in enumerate(_GATES):
            for w in words:
                bits[w] = bits.get(w, 0) | 1 << k
        try:
            import ahocorasick

            found = ahocorasick.Automaton()
            for w, b in bits.items():
                found.add_word(w, b)
            found.make_automaton()
            _automaton.append(found)
        except ImportError:
            _automaton.append(bits)
    known, out = _automaton[0], 0
    if isinstance(known, dict):
        for w, b in known.items():
            if w in low:
                out |= b
    else:
        for _, b in known.iter(low):
            out |= b
    return out


def _near(p: re.Pattern, t: str, runs: list[tuple[int, int]]) -> Iterator[re.Match]:
    """The matches of a pattern of eight digits or more: those about the runs of digits."""
    upto = 0
    for a, b in runs:
        end = b + 32
        for m in p.finditer(t, max(upto, a - 8), end):
            if m.end() >= end:
                m = p.match(t, m.start()) or m
            upto = m.end()
            yield m


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the items in a text, in order, without overlaps.

    Earlier kinds win where spans overlap, then longer ones. Every pattern is
    behind a test for a word or a run of digits that it cannot do without.
    """
    t, at = fold(text)
    low = t.lower()
    spans: list[tuple[int, int, str]] = []  # in order, without overlaps

    def add(start: int, end: int, kind: str) -> None:
        i = bisect(spans, (start, end))
        if (i == len(spans) or end <= spans[i][0]) and (i == 0 or start >= spans[i - 1][1]):
            spans.insert(i, (start, end, kind))

    gates = _open_gates(low)

    if "@" in t or "(at" in low or "[at" in low or "{at" in low or " dot " in low:
        for m in _EMAIL.finditer(t):
            add(*m.span(), "email")
    if gates & 1:
        for m in _ID_CUE.finditer(t):
            if 6 <= len(_digits(m["v"])) <= 16:
                add(*m.span("v"), "identity_number")
    for m in _IDS[1].finditer(t):
        add(*m.span(), "identity_number")
    for m in _CHECKED.finditer(t):
        if scheme_of(m[0]):
            add(*m.span(), "identity_number")
    runs = [m.span() for m in _RUN.finditer(t) if not _REFERENCE.fullmatch(m[0])]
    if runs:
        for p in (_IDS[0], _IDS[2], _IDS[3]):
            for m in _near(p, t, runs):
                if not _ORDER.search(t, max(0, m.start() - 14), m.start()):
                    add(*m.span(), "identity_number")
        for m in _near(_ID_NHS, t, runs):
            near = low[max(0, m.start() - 40) : m.end() + 20]
            told = "nhs" in near or "health" in near or not _NANP.fullmatch(m[0])
            if told and (s := scheme_of(m[0])) and s.name == "nhs" and not _CUE_PHONE.search(t, max(0, m.start() - 24), m.start()):
                add(*m.span(), "identity_number")
        for p in _PHONES:
            for m in _near(p, t, runs):
                if 8 <= len(_digits(m[0])) <= 20 and not _NOT_PHONE.search(t, max(0, m.start() - 14), m.start()):
                    add(*m.span(), "phone")
    if "-" in t:
        for m in _PHONE_LOCAL.finditer(t):
            if not _NOT_PHONE.search(t, max(0, m.start() - 14), m.start()):
                add(*m.span(), "phone")
    for m in _PHONE_PLAIN.finditer(t):
        if _CUE_PHONE.search(t, max(0, m.start() - 24), m.start()):
            add(*m.span(), "phone")
    for k, p in enumerate(_STREETS, 2):
        if gates >> k & 1:
            for m in p.finditer(t):
                add(*m.span(), "street_address")
    for k, (_, p) in enumerate(_NAME_CUES, 2 + len(_STREETS)):
        if gates >> k & 1:
            for m in p.finditer(t):
                if not _NOT_NAMES.intersection(x for x in re.findall(r"[^\W\d_]{2,}", m["n"].lower())):
                    add(*m.span("n"), "person_name")
    if gates & 2:
        for m in _TITLED.finditer(t):
            add(*m.span("n"), "person_name")
    if not _GIVEN_SET.isdisjoint(t.split()):
        for m in _GIVEN_NAME.finditer(t):
            add(*m.span("n"), "person_name")
    return spans if at is None else [(at[a], at[b - 1] + 1, k) for a, b, k in spans]


# --- pseudonyms ---------------------------------------------------------------------


def _prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), key=key, digest_size=16).digest(), "big")


def feistel_digits(key: bytes, digits: str, tweak: str = "", rounds: int = 8, back: bool = False) -> str:
    """A keyed permutation of the digit strings of one length (and its inverse).

    Alternating Feistel network: the two halves, of lengths that may differ by
    one, are added to modulo a power of ten. One digit is shifted by the key.
    """
    n = len(digits)
    if n == 0:
        return digits
    if n == 1:
        s = _prf(key, "one", tweak) % 10
        return str((int(digits) + (-s if back else s)) % 10)
    u = n // 2
    a, b = int(digits[:u]), int(digits[u:])
    sizes = (10**u, 10 ** (n - u))
    order = range(rounds - 1, -1, -1) if back else range(rounds)
    for i in order:
        sign = -1 if back else 1
        if i % 2 == 0:
            a = (a + sign * _prf(key, tweak, n, i, b)) % sizes[0]
        else:
            b = (b + sign * _prf(key, tweak, n, i, a)) % sizes[1]
    return f"{a:0{u}d}{b:0{n - u}d}"


def permute_number(key: bytes, value: str, tweak: str = "", back: bool = False) -> str:
    """Digits permuted as one string; signs, blanks and letters stay where they are."""
    new = iter(feistel_digits(key, _digits(value), tweak, back=back))
    return "".join(next(new) if c.isdigit() else c for c in value)


def permute_identity(key: bytes, value: str, back: bool = False) -> str:
    """An identity number as another one of its scheme, check digits or letters worked out anew."""
    return permuted(value, lambda d: feistel_digits(key, d, "identity_number", back=back))


#: Dates are permuted among the days of this span.
_FIRST, _DAYS = date(1900, 1, 1), 73_049


def permute_date(key: bytes, value: date, back: bool = False) -> date:
    """A keyed permutation of the days from 1900 to 2099 (cycle walking); others stay."""
    d = (value - _FIRST).days
    if not 0 <= d < _DAYS:
        return value
    while True:
        d = int(feistel_digits(key, f"{d:05d}", "date", back=back))
        if d < _DAYS:
            return _FIRST + timedelta(days=d)


def placeholder(key: bytes, kind: str, value: str) -> str:
    """``[PHONE 000 111 2222]`` for numbers, ``[EMAIL ...]`` with a tag of 128 bits for the rest.

    Numbers that differ only in their signs and blanks get the same digits.
    """
    plain, _ = fold(value)
    if kind == "identity_number":
        return f"[IDENTITY_NUMBER {permute_identity(key, plain)}]"
    if kind == "phone":
        return f"[PHONE {permute_number(key, plain, kind)}]"
    same = re.sub(r"[\W_]+", " ", plain.casefold()).strip()
    return f"[{kind.upper()} {_prf(key, kind, same):032x}]"


_BORN = r"(?:born(?: on)?|date of birth|dob|geb(?:oren|\.)(?: am)?|née? le|nacid[oa] el|nat[oa] il|nascid[oa] (?:em|a)|geboren op|urodzon[ay]|родил(?:ся|ась))"
_DATE_CUE = re.compile(rf"{_BORN}\W{{1,3}}(?:(\d{{4}})([-./])(\d\d)\2(\d\d)|(\d\d)([-./])(\d\d)\6(\d{{4}}))\b", re.I)


def _births(text: str, key: bytes) -> tuple[str, int]:
    """Dates of birth permuted in the order they are written in; years first or last."""
    n = 0

    def put(m: re.Match) -> str:
        nonlocal n
        y, a, b, first = (m[1], m[3], m[4], True) if m[1] else (m[8], m[7], m[5], False)
        try:
            d = permute_date(key, date(int(y), int(a), int(b)))
        except ValueError:
            return m[0]
        n += 1
        begin = (m.start(1) if first else m.start(5)) - m.start()
        new = f"{d:%Y{m[2]}%m{m[2]}%d}" if first else f"{d:%d{m[6]}%m{m[6]}%Y}"
        return f"{m[0][:begin]}[DATE {new}]"

    return _DATE_CUE.sub(put, text), n


def pseudonymize(text: str, key: bytes) -> tuple[str, list[tuple[str, str]]]:
    """The text with every item replaced, and (kind, placeholder) of each; what lies between is unchanged."""
    out, at, items = [], 0, []
    for a, b, kind in find(text):
        put = placeholder(key, kind, text[a:b])
        items.append((kind, put))
        out += [text[at:a], put]
        at = b
    text, n = _births("".join([*out, text[at:]]), key)
    return text, items + [("date", "")] * n


def redact(text: str, key: bytes) -> str:
    return pseudonymize(text, key)[0]


# --- operators ----------------------------------------------------------------------


def redacted(df: DataFrame, id_cols: list[str], text_col: str, key: str) -> DataFrame:
    """id columns, redacted, n_items and kinds (distinct, in order); whole texts.

    Null stays null and the empty text stays empty, without items. Dates of
    birth are replaced and counted, but no kind.
    """
    secret = key.encode()

    @F.pandas_udf("struct<redacted string, n_items int, kinds array<string>>")
    def mask(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            done = [pseudonymize(t, secret) if t else (t, []) for t in s]
            yield pd.DataFrame({
                "redacted": pd.Series([t for t, _ in done], dtype=object),
                "n_items": pd.Series([len(x) for _, x in done], dtype="int32"),
                "kinds": pd.Series([sorted({k for k, _ in x} - {"date"}) for _, x in done], dtype=object),
            })

    rows = spread(df.select(*id_cols, F.col(text_col).alias("__text")))
    return rows.select(*id_cols, mask("__text").alias("__m")).select(*id_cols, "__m.*")


def found_kinds(df: DataFrame, id_cols: list[str], text_col: str, key: str) -> DataFrame:
    """id columns and kind: one row per text and kind of item that ``redacted`` replaced in it."""
    done = redacted(df.filter(F.col(text_col).isNotNull()), id_cols, text_col, key)
    # the outer form: for the inner one a filter on the kinds is inferred, which runs the Python code twice
    return done.select(*id_cols, F.explode_outer("kinds").alias("kind")).filter("kind is not null")

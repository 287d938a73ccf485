"""Personal information in free text, found and replaced by placeholders (problem 9).

Three steps, all within a row, so there is no shuffle:

1. Generators with high recall propose spans that may overlap: email addresses (also spelt out), phone
   numbers, identity numbers, street addresses and personal names.  Any two or three capitalised words of a
   line are a proposed name, and so are signs of scripts without letter case between a cue and a mark.
2. Gradient-boosted trees score every span from its format and its context: cue words before it and
   how far off they are, what stands right before and after, check digits and letters, whether its words also
   stand in lower case in the text, whether an address for mail behind it holds the family name, whether the given name is in a
   lexicon of common ones.  They are trained from seeded made-up sentences (``EXAMPLES`` of them, a fixed bound) when a session
   first needs them; most names in these are made up as well, so the lexicon is a hint and no condition.
3. Thresholds, calibrated for each kind on made-up sentences held out of training, select the spans;
   a span within a longer one goes, and of spans that overlap otherwise the surest, then the longest, stays.

Defined results: null, empty and blank texts hold nothing and stay as they are.  Offsets count code
points, ends are exclusive.  A text is read whole, whatever its length.  Bank account numbers are no phone numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("name", "email", "phone", "id_number", "address")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
#: Made-up sentences the trees are trained and calibrated on.
EXAMPLES = 6_000

GIVEN = frozenset(
    """adam adriana agnes ahmed aisha alan albert alejandro alexander alexandra alfred alice amelia amina amir ana anders andrea andrew angela anita
    anna anne anne-marie anthony antonio anton arthur astrid barbara beatrice benjamin bernard boris bruno camille carlos carmen caroline catherine
    charles charlotte chiara chloe christian christine claire clara claudia daniel david deborah diana diego dima dimitri dmitri dorothy edith eduardo
    edward ekaterina elena elisabeth elizabeth ella emil emily emma eric erik esther eva fatima felix fernando frances francisco frank franz frida
    gabriel george gerhard giovanni giulia giuseppe greta gustav gwendolyn hannah hans harold heinrich helen helena henrietta henry hiroko hugo ifeoma
    igor ingrid irene isabel ivan jack jacob jacqueline james jana jane jean jean-luc jennifer joan johann johannes john jonas jorge jose joseph juan
    julia julian karen karin karl katherine katya kenji klaus laura lars leonora linda louis lucas lucia lucy luis magdalena marc margaret maria marie
    mario mark martha martin mary matteo matthew max mehmet michael miguel milena mohammed monica natalia nicolas nicole nils nina noah olga oksana olivia
    omar oscar otto pablo patricia paul pedro peter philip pierre priya quentin rachel rahul raj ravi rebecca rene richard robert rosa ruth samuel sandra
    sara sarah sergei simon sofia sonia soren stefan stephen susan sven tamara tatiana teresa theodora theresa thomas tobias tomas ulrike ursula valentina
    vera victor viktor vikram walter wei werner william xenia yan yasmin ying yuki yusuf zoe zoltan""".split()
)  # a lexicon of common given names, without accents

_UP = r"A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĶĹĻĽŁŃŅŇŐŒŔŘŚŞŠŢŤŪŮŰŹŻŽΑ-ΩА-ЯЁ"
_CAP = rf"[{_UP}](?:[^\W\d_]|['’](?=[^\W\d_])|[-‐‑](?=[^\W\d_])|[\x80-\xbf€ƒ„†‡ˆ‰Š‹ŒŽ•™š›œž](?=[^\W\d_]))+"
_PART = r"(?:(?i:de|der|den|van|von|del|della|di|da|dos|du|le|la|los|las|ter|ten|zu|bin|ibn|al|el)\s+){0,3}"
_LONG_PART = r"(?:(?i:de\s+la|de\s+los|de\s+las|van\s+der|van\s+den|van|von\s+der|von|della|del)\s+)?"
_FAMILY = _PART + _CAP
_AFTER_GIVEN = re.compile(rf"(?:\s+[{_UP}]\.)*\s+({_FAMILY})(?![\w@])")
_CAPITAL = re.compile(rf"(?<![\w'’@./-])[{_UP}](?:\.|(?:[^\W\d_]|(?<=[ÃÄÅ])[\x80-\xbf¡-¿]|['’-](?=[^\W\d_]))+)")
_INNER_DOT = re.compile(r"(?:^|[^\w])[a-zà-ÿ]\.\s*$")
_AT = re.compile(r"[@＠]|[(\[{]\s?[aA][tT]\s?[)\]}]")
_AT_WORD = re.compile(r"(?<=\s)at(?=\s)|[(\[]at[)\]]", re.I)
_DOT = re.compile(r"\sdot\s", re.I)
#: What phone and id numbers hold: seven digits or more, a country code, or a form with letters.
_DIGITS = re.compile(
    r"[\d+A-Z](?:(?<=\d)(?:[\s().\-–‑/]{0,3}\d){6}|(?<=\+)\d|(?<=0)(?<!\d0)0[1-9]|(?<=[1-478])\s?\d\d\s?\d\d\s?\d[AB](?:\s?\d){8}|(?<=[A-Z])(?:[A-Z]-\d{6}|\d\d[A-Z]\d{5}|[A-Z]\s?\d\d\s?\d\d\s?\d\d\s?[A-D]))(?:[\s().\-–‑/]{0,3}\d)*"
)
_POSTCODE = re.compile(r",\s+\d{5}\s+(?=[^\W\d_])")
_MORE_INITIALS = re.compile(rf"\s+[{_UP}]\.(?:(?:\s+|[-‐‑])?[{_UP}]\.)*(?!\w)")
_CITY = re.compile(r"Washington,\s+D\.\s?C\.")
_PARTICLES_BEFORE = re.compile(r"(?<![\w'’@.-])(?:de\s{1,3}la|de\s{1,3}los|de\s{1,3}las|van\s{1,3}der|van\s{1,3}den|van|von\s{1,3}der|von|della|del)\s{1,3}$", re.I)
_COMMA = re.compile(r",\s+")
_BLANK = re.compile(r"\s+")
#: What may stand between the words of a name that no lexicon knows: blanks with at most one line break.
_WITHIN = re.compile(rf"[^\S\n\r]*(?:[^\S\n\r]|\r?\n)[^\S\n\r]*(?:[{_UP}]\.[^\S\n\r]+)*")
#: Names in scripts without letter case: signs between a cue and a mark or honorific.
_HONORIFIC = "さん|氏|様|先生|教授|博士|씨|님"
_UNCASED = re.compile(
    r"(?:連絡先|担当者?|責任者|氏名|著者|謝辞|联系人|姓名|负责人|作者|感谢|患者|문의|연락처|담당자?|저자|성명)\s*[:：]?\s*"
    rf"((?:(?!{_HONORIFIC})[\u4e00-\u9fff\uac00-\ud7a3]){{1,4}}[ \u3000・]?(?:(?!{_HONORIFIC})[\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7a3]){{1,5}}?)(?={_HONORIFIC}|[、,，。．.;；\s（(<]|$)"
)
_INITIALS = re.compile(rf"\s+[{_UP}]\.(?:(?:\s+|[-‐‑])?[{_UP}]\.)*(?!\w)")
_CITY = re.compile(r"Washington,\s+D\.\s?C\.")
_BEFORE_COMMA = re.compile(rf"(?<![\w'’@.-])({_LONG_PART}{_CAP}),\s+$")
_BEFORE_BLANK = re.compile(rf"(?<![\w'’@.-])({_LONG_PART}{_CAP})\s+$")
_INITIALS = re.compile(rf"(?<![\w.@'’-])(?:[{_UP}]\.[\s-]?){{1,3}}\s*({_FAMILY})(?![\w@])")
_EMAIL = re.compile(r"(?<![\w.+%-])[A-Za-z0-9](?:[\w.+%-]*[\w+-])?\s?(?:@|＠|\(\s?at\s?\)|\[\s?at\s?\]|\{\s?at\s?\})\s?[A-Za-z0-9-]+(?:\s?(?:\.|\(\s?dot\s?\)|\[\s?dot\s?\])\s?[A-Za-z0-9-]+)*(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[A-Za-z]{2,24}(?![A-Za-z0-9-])", re.ASCII)
_EMAIL_SPELT = re.compile(r"(?<![\w.+%-])[A-Za-z0-9](?:[\w.+%-]*[\w+-])?(?:\s+dot\s+[\w+-]+)*(?:\s+at\s+|\s*[\[(]at[\])]\s*)[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+)+(?![\w-])", re.ASCII | re.I)
_EXT = r"(?:,?\s*(?:ext|x|poste|Durchwahl|DW|Apparat)\.?\s*\d{1,5})?"
_ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}\d\d(?:\s?[A-Z0-9]{4}){3,7}(?:\s?[A-Z0-9]{1,3})?(?!\w)")
_EXTENSION = re.compile(rf"\)?{_EXT}")
_END = r"(?![\w/]|[-.](?=\w))"
_S = r"[\s.\-–‑]"
_PHONES = [
    re.compile(rf"(?<![\w+.(/-])\+\d{{1,3}}(?:{_S}?\(?\d{{1,9}}\)?){{1,6}}{_EXT}{_END}"),
    re.compile(rf"(?<![\w+.(/-])00[1-9]\d{{0,2}}(?:{_S}?\(?\d{{1,9}}\)?){{1,6}}{_EXT}{_END}"),
    re.compile(rf"(?<![\w+./-])\(\d{{2,5}}\)\s?\d{{3,5}}{_S}?\d{{3,5}}(?:{_S}\d{{2,5}})?{_EXT}{_END}"),
    re.compile(rf"(?<![\w+./-])0\d{{2,4}}\s\d{{3,4}}\s\d{{3,4}}{_EXT}{_END}"),
    re.compile(rf"(?<![\w+./-])(?:\d{_S})?\d{{3}}{_S}\d{{3}}{_S}\d{{4}}{_EXT}{_END}"),
    re.compile(rf"(?<![\w+./-])\d{{3}}[-–‑]\d{{4}}{_EXT}{_END}"),
    re.compile(rf"(?<![\w+./-])0\d(?:{_S}\d\d){{4}}{_EXT}{_END}"),
    re.compile(rf"(?<![\w+./-])\d{{3}}(?:[-\s]\d\d){{3}}{_EXT}{_END}"),
    re.compile(rf"(?<![\w+./-])0\d{{2,4}}\s?/\s?\d{{4,8}}(?:[-\s]\d{{1,5}})?{_EXT}{_END}"),
    re.compile(rf"(?<![\w+./-])0\d{{1,3}}[-\s]\d{{6,8}}{_EXT}{_END}"),
]
_IDS = [
    re.compile(rf"(?<![\w+./-])\d{{3}}[-\s]\d\d[-\s]\d{{4}}{_END}"),
    re.compile(rf"(?<![\w+./-])[A-Z]{{2}}-\d{{6,8}}{_END}"),
    re.compile(rf"(?<![\w+./-])[1-478]\s?\d\d\s?\d\d\s?\d[\dAB]\s?\d{{3}}\s?\d{{3}}\s?\d\d{_END}"),
    re.compile(rf"(?<![\w+./-])\d\d\s\d{{3}}\s\d{{3}}\s\d{{3}}{_END}"),
    re.compile(rf"(?<![\w+./-])[A-Z]\d\d[A-Z]\d{{5}}{_END}"),
    re.compile(rf"(?<![\w+./-])(?:\d{{8}}|\d\d\.\d{{3}}\.\d{{3}}|[XYZ]-?\d{{7}})[-\s]?[A-Z]{_END}"),
    re.compile(rf"(?<![\w+./-])[A-Z]{{2}}\s?\d\d\s?\d\d\s?\d\d\s?[A-D]{_END}"),
]
#: Labels of numbers without a form of their own, and such a number.
_ID_LABEL = re.compile(r"(?<![^\W_])(?:passport|passeport|pasaporte|reisepass(?:nummer)?|identity card|id card|personalausweis|driving licence|driver'?s license|insurance|social security|patient|medical record|tax)(?:\s+(?:number|no\.?|nr\.?|num[ée]ro|n[°º]|id))?\s*[:#]?\s+[A-Z]{0,2}$", re.I)
_NAMED_ID = re.compile(rf"[A-Z]{{0,2}}\d{{7,9}}{_END}")
_TOWN = rf"{_CAP}(?:[\s-]{_CAP}(?=[\s,.;]))?"
_POST = r"(?:\s+\d{4,5}(?:-\d{4})?(?!\w)|\s+[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b)?"
_STREET = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Yard|Court|Ct|Square|Sq|Place|Pl|Way|Close|Terrace|Boulevard|Blvd|Row|Gardens|Crescent|Mews|Walk|Quay|STREET|ROAD|AVENUE|LANE|DRIVE|YARD)"
_ADDRESSES = [
    re.compile(rf"(?<![\w.,/-])\d{{1,5}}[A-Za-z]?\s+(?:[NSEW]\.?\s+)?(?:{_CAP}\s+){{1,3}}{_STREET}\b\.?(?:,?\s+(?:Apt|Flat|Suite|Unit|Room|Apartment|No|APT|FLAT)\.?\s*#?\w{{1,5}})?,\s+{_CAP}(?:(?:\s|-){_CAP}(?=\s+\d))?(?:,?\s+[A-Z]{{2}}(?=\s\d))?{_POST}"),
    re.compile(rf"(?<![\w.,/-])\d{{1,4}}(?:\s+(?:bis|ter|quater))?,?\s+(?:rue|avenue|av\.?|bd\.?|boulevard|place|pl\.?|chemin|impasse|allée|quai|cours|route|square|passage|RUE|AVENUE|BD|BOULEVARD)\s+[^,;\d]{{2,50}},\s+(?:[^,;]{{1,20}},\s+)?\d{{5}}\s+{_CAP}(?:-[^\W\d_]+)*"),
    re.compile(rf"(?<![\w.,/-])(?:[{_UP}][^\W\d_]*(?:[-\s][{_UP}]?[^\W\d_]+)?(?:stra(?:ß|ss)e|str\.|gasse|allee|weg|platz|ufer|damm|ring|hof|markt|steig|graben|Straße|Str\.|Allee|Weg|Platz)|(?:Am|An\s+der|An\s+den|Auf\s+dem|Auf\s+der|Im|In\s+der|Zum|Zur|Unter\s+den|Hinter\s+der|Vor\s+dem)(?:\s+{_CAP}){{1,3}}|[{_UP}]\S{{1,20}}(?:stra\S{{1,3}}e|str\.|gasse|allee))\s+\d{{1,4}}\s?[a-zA-Z]?(?:,\s+[^,;]{{1,20}})?,\s+\d{{5}}\s+{_CAP}(?:-[^\W\d_]+)*"),
    re.compile(rf"(?<![\w.,/-])(?:Calle|C/|Avda\.?|Avenida|Av\.|Plaza|Pza\.?|Pl\.|Paseo|P\.º|Ronda|Camino|Carretera|Ctra\.?|Travesía|CALLE|AVDA\.?)\s*(?:(?:de|del|la|los|las|el)\s+){{0,2}}{_CAP}(?:\s+(?:(?:de|del|la|los|las|el|y)\s+){{0,2}}{_CAP}){{0,3}},?\s+(?:n\.?º\s*)?\d{{1,4}}(?:,\s+[^,;]{{1,14}}){{0,2}},\s+\d{{5}}\s+{_CAP}(?:-[^\W\d_]+)*"),
]
_ADDRESSES.append(re.compile(rf"(?<![\w.,/-])(?:Via|Viale|Piazza|Corso|Largo|Vicolo|Strada)\s+(?:(?:di|del|della|dei|delle|d['’])\s*)?{_CAP}(?:\s+{_CAP}){{0,3}},?\s+\d{{1,4}}(?:/?[a-zA-Z])?,\s+\d{{5}}\s+{_CAP}(?:\s+{_CAP})?"))
_ADDRESSES.append(re.compile(rf"(?<![\w.,/-])[{_UP}][^\W\d_]*(?:straat|laan|plein|gracht|kade|singel|dijk)\s+\d{{1,4}}(?:\s?[a-zA-Z])?,\s+\d{{4}}\s?[A-Z]{{2}}\s+{_CAP}"))
_DUTCH = re.compile(r",\s+\d{4}\s?[A-Z]{2}\s+(?=[^\W\d_])")
_STREETS = re.compile(rf"\s{_STREET}\b\.?,")

#: Cue words, looked for in the stretch before a span; lower case, at the end of a word.
_CUES = {
    "name": "correspondence|korrespondenz|correspondance|correspondencia|contact|thank|thanks|danken|dank|remercions|agradecemos|participants?|patients?|volunteers?|subjects?|donors?|dr\\.|prof\\.|mr\\.|mrs\\.|ms\\.|go to|written to|sent by|sent to|belongs to|gehört|appartient|es de|von|nurse|interview(?:s|ed|er)?|named|name|signed|asked|attn|author|проф\\.|grateful to|mme|mlle|herrn?|frau|sra?\\.|dra\\.|dott\\.|person|ansprechpartner(?:in)?|patientin|paciente|patiente|betreuer|chair|contacto|contatto|ringraziamo|remerciements|gracias a|dankbar|благодарим|контактное лицо|контакт|автор|профессор|investigator|reviewers?|editors?|advis[eo]r|supervisor|technician|secretary|coordinator|colleagues?|widow|son|daughter",
    "email": "e-?mail|mail|courriel|correo|contact|write|écrire|escriba|to|an|tel|連絡先|联系|контакт|rückfragen",
    "phone": "tel|telefon|teléfono|téléphone|phone|fax|call|appeler|joignable|erreichbar|unter|llame|mobile|cell|ring|oder|reach(?:ed|able)?|lists|or|and|anrufen|numéro",
    "id_number": "id|ssn|ssan|nir|dni|nie|dossier|akte|expediente|lists|passport|patient|record|steuer-?id|insurance|sécu|identity|number|nhs|licence no|citizen|file|mrn",
    "address": "correspondence|korrespondenz|correspondance|correspondencia|address|adresse|dirección|posted to|sent to|lives at|wohnhaft|habite|domicilio|lists|and|anschrift|mail to|home",
}
_NOT = "lot|batch|grant|grants|accession|registry|issn|isbn|doi|firmware|version|ref\\.|fig\\.|tab\\.|figure|table|catalogue|cat\\.|serial|model|order|protocol|charge|project|award|no\\.|samples?|ward|part|section|trial|mean|sd|ratio|from the|funded by|cohort"
_CUE = {k: re.compile(rf"(?<![\w])(?:{v})(?!\w)", re.I) for k, v in _CUES.items()}
_NOT_CUE = re.compile(rf"(?<![\w])(?:{_NOT})(?!\w)", re.I)
_INSTITUTION = re.compile(r"[\s,]{1,3}(?:foundation|institut\w*|universit\w*|hospital|fund|college|school|laborator\w*|centre|center|stiftung|fondation|fundación|inc|ltd|gmbh|prize|award|society|trust|clinic|klinik|memorial|lecture|consortium|group|company|press|library|museum|street|road|test|method|syndrome|disease|distribution|model|algorithm)\b", re.I)
_ET_AL = re.compile(r"[\s,]{1,3}(?:et\.?\s+al|und\s+kollegen|and\s+colleagues|et\s+coll)", re.I)
_YEAR = re.compile(r",?\s*\(?(?:19|20)\d\d[a-z]?\b|\s+(?:and|et|und|y|&)\s+\S+,?\s+\(?(?:19|20)\d\d\b")
_NOT_FAMILY = frozenset(
    """abstract introduction methods results discussion references the this that these in on at and for from with we it is a an our data code batch firmware accession
    ethical values each mean odds samples correspondence contact funding participant forms requests one résumé introduction méthodes résultats zusammenfassung einleitung
    methoden ergebnisse diskussion resumen introducción métodos resultados discusión foundation earlier furthermore no doses under after before during per lot january february
    march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday die der das le les la el los und et table
    fig figure part section chapter appendix ward abb tab abs vgl im am ein eine einer einem nach unter uber bei mit fur ohne vor zu zum zur aus wie als wenn ob hat ist selon chez dans en sur avec pour sans par
    apres voir que qui segun tras sobre entre con sin por hasta desde vease unlike past like as after when where while since until about between among within without over near outside inside both any
    some most many few other such only not but or nor so if then than thus hence how why what which who whose there here he she they you i his her their its are was were be has have had do does did
    can may might must should could would will yes see se ni below above vers toward towards upon along beside beyond against amid except yes use used using given based according despite although because however therefore moreover also still yet just even once data""".split()
)
_PLAIN = str.maketrans("áàâäãåéèêëíìîïóòôöõøúùûüñçýŠšžćčńśłğ", "aaaaaaeeeeiiiioooooouuuuncyssz" + "ccnslg")


def _plain(word: str) -> str:
    if word.isascii():
        return word.lower()
    if "Ã" in word or "Ä" in word or "Å" in word:  # letters decoded the wrong way
        try:
            word = word.encode("cp1252").decode("utf-8")
        except UnicodeError:
            pass
    return word.lower().translate(_PLAIN).replace("’", "'")


def _begin(text: str, a: int) -> int:
    """Where a family name that begins at ``a`` begins with its particles."""
    low = max(0, a - 14)  # the longest particles
    found = _PARTICLES_BEFORE.search(text[low:a])
    return low + found.start() if found else a


def _names(text: str, out: list[tuple[int, int, int, int]]) -> None:
    # Forms: 0 given family, 1 family comma given, 2 family given, 3 initials family, 4 family comma initials; without a
    # known given name 5 two words, 6 comma between, 7 three words; 8 without letter case
    done = -1
    last: tuple[int, int] | None = None  # the capitalised word before this one
    for m in _CAPITAL.finditer(text):
        a, b = m.span()
        before, last = last, (a, b)
        if text[b - 1] == ".":
            last = None
            if a < done:
                continue
            if text[max(0, a - 60) : a].rstrip()[-1:] == "." and _INNER_DOT.search(text, max(0, a - 60), a):
                continue  # a further letter of an abbreviation
            if (found := _INITIALS.match(text, a)) and len(found.group(1)) > 2 and _plain(found.group(1).split()[-1]) not in _NOT_FAMILY:
                out.append((a, found.end(), 0, 3))
                done = found.end()
            elif before and _COMMA.fullmatch(text, before[1], a) and _plain(text[before[0] : before[1]]) not in _NOT_FAMILY:
                initials = _MORE_INITIALS.match(text, a - 1)
                begin = _begin(text, before[0])
                if not _CITY.match(text, begin):
                    out.append((begin, initials.end() if initials else b, 0, 4))
            continue
        if text[b : b + 1] in ("@", "/"):
            last = None
            continue
        word = m.group()
        if word.lower() not in GIVEN and (word.isascii() and "-" not in word or _plain(word) not in GIVEN and ("-" not in word or _plain(word).split("-")[0] not in GIVEN)):
            following = text[b : b + 1]
            if (following == "," or following.isspace()) and a >= done and not word.isupper() and _plain(word) not in _NOT_FAMILY and (len(word) > 2 or word[1:].islower()):
                done = max(done, _unknown(text, a, b, out))
            continue
        if (after := _AFTER_GIVEN.match(text, b)) and _plain(after.group(1)) not in _NOT_FAMILY and (_plain(after.group(1)) not in GIVEN or not _AFTER_GIVEN.match(text, after.end())):
            out.append((a, after.end(), 0, 0))
            done = after.end()
            _longer(text, a, after.end(), out)
            continue
        initials = _MORE_INITIALS.match(text, b)
        if before and _COMMA.fullmatch(text, before[1], a):
            if _plain(text[before[0] : before[1]]) not in _NOT_FAMILY and _plain(text[before[0] : before[1]]) not in GIVEN:
                out.append((_begin(text, before[0]), initials.end() if initials else b, 0, 1))
                done = b + 2
        elif before and _BLANK.fullmatch(text, before[1], a) and _plain(text[before[0] : before[1]]) not in _NOT_FAMILY and _plain(text[before[0] : before[1]]) not in GIVEN:
            out.append((_begin(text, before[0]), b, 0, 2))
    if not text.isascii():
        out += [(m.start(1), m.end(1), 0, 8) for m in _UNCASED.finditer(text)]


_NEXT_WORD = re.compile(rf"({_PART})({_CAP})(?![\w@/])")


def _family_at(text: str, at: int) -> int:
    """End of the capitalised word at ``at``, particles before it included; -1 if there is none that may be a family name."""
    found = _NEXT_WORD.match(text, at)
    return found.end() if found and not found.group(2).isupper() and _plain(found.group(2)) not in _NOT_FAMILY else -1


def _longer(text: str, a: int, b: int, out: list[tuple[int, int, int, int]]) -> None:
    """The same with a third name on the same line."""
    if text[b : b + 1] == " " and (end := _family_at(text, b + 1)) > 0 and not text[a:b].isupper():
        out.append((a, end, 0, 7))


def _unknown(text: str, a: int, b: int, out: list[tuple[int, int, int, int]]) -> int:
    """Names that begin with a word no lexicon knows; gives the end of what was proposed."""
    if text[b] != ",":
        gap = _WITHIN.match(text, b)
        if gap and (end := _family_at(text, gap.end())) > 0 and not _CUE["name"].fullmatch(text, a, b):
            if "\n" in gap.group() and not text[text.rfind("\n", 0, a) + 1 : a].strip(" \t\xa0#*.0123456789"):
                return -1  # a heading and the line below it
            out.append((a, end, 0, 5))
            _longer(text, a, end, out)
            return end
        return -1
    gap = _COMMA.match(text, b)
    if gap and "\n" not in gap.group() and (end := _family_at(text, gap.end())) > 0 and not _CUE["name"].fullmatch(text, a, b):
        initials = _MORE_INITIALS.match(text, end)
        out.append((_begin(text, a), initials.end() if initials else end, 0, 6))
    return -1


def _near(pattern: re.Pattern, text: str, windows: list[tuple[int, int]], kind: int, form: int, out: set[tuple[int, int, int, int]]) -> None:
    for low, high in windows:
        for m in pattern.finditer(text, low, high):
            out.add((m.start(), m.end(), kind, form))


def _windows(starts: list[tuple[int, int]], before: int, after: int, size: int) -> list[tuple[int, int]]:
    """Stretches around anchors, put together where they meet."""
    out: list[tuple[int, int]] = []
    for a, b in starts:
        low, high = max(0, a - before), min(size, b + after)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _paragraphs(text: str, anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The paragraphs that hold anchors."""
    out: list[tuple[int, int]] = []
    for a, b in anchors:
        if out and b <= out[-1][1]:
            continue
        high = text.find("\n\n", b)
        out.append((max(text.rfind("\n\n", 0, a) + 1, out[-1][1] if out else 0), len(text) if high < 0 else high))
    return out


_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.+%-")


def _dotted(text: str, at: int) -> int:
    """Where the word begins that stands before ``at`` with a spelt-out dot between, else ``at``."""
    here = at
    while here > 0 and text[here - 1].isspace():
        here -= 1
    if here == at or here < 5 or text[here - 3 : here].lower() != "dot" or not text[here - 4].isspace():
        return at
    here -= 4
    while here > 0 and text[here - 1].isspace():
        here -= 1
    end = here
    while here > 0 and text[here - 1] in _LOCAL:
        here -= 1
    return here if here < end else at


def _mail(text: str, anchors: Iterator[re.Match], pattern: re.Pattern, form: int, out: set[tuple[int, int, int, int]]) -> None:
    """Addresses whose sign for "at" is an anchor: each begins where the run of signs before it does."""
    for m in anchors:
        at = m.start()
        while at > 0 and text[at - 1].isspace():
            at -= 1
        end = at
        while at > 0 and text[at - 1] in _LOCAL:
            at -= 1
        while form and (dotted := _dotted(text, at)) < at:
            at = dotted
        if at < end and (found := pattern.match(text, at)):
            out.add((*found.span(), 1, form))


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, form) of every span worth a look; they may overlap.

    Each generator looks only around its anchors (a sign for "at", the digits of a number, a street word or
    postcode, a capital), which every span it can propose has; so the text is read a few times only.
    """
    out: set[tuple[int, int, int, int]] = set()
    size = len(text)
    low = text.lower()
    if "@" in text or "＠" in text or any(sign in low for sign in ("at)", "at ]", "at]", "at )", "at}", "at }")):
        _mail(text, _AT.finditer(text), _EMAIL, 0, out)
    if "dot" in low and _DOT.search(text):
        _mail(text, _AT_WORD.finditer(text), _EMAIL_SPELT, 1, out)
    # An anchor holds all digits of a number but those of an extension; the rest is a few signs on each side.
    if runs := [(m.start(), _EXTENSION.match(text, m.end()).end()) for m in _DIGITS.finditer(text)]:
        near = _windows(runs, 16, 16, size)
        for form, pattern in enumerate(_PHONES):
            _near(pattern, text, near, 2, form, out)
        for form, pattern in enumerate(_IDS):
            _near(pattern, text, near, 3, form, out)
        for a, _ in runs:
            if label := _ID_LABEL.search(text[max(0, a - 80) : a]):
                begin = a - len(label.group()) + len(label.group().rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                if number := _NAMED_ID.match(text, begin):
                    out.add((*number.span(), 3, len(_IDS)))
        if any(c[2] in (2, 3) for c in out) and (accounts := [m.span() for m in _ACCOUNT.finditer(text)]):
            out = {c for c in out if c[2] not in (2, 3) or not any(x <= c[0] and c[1] <= y for x, y in accounts)}
    if found := [m.span() for m in _STREETS.finditer(text)]:
        _near(_ADDRESSES[0], text, _paragraphs(text, found), 4, 0, out)
    if found := [m.span() for m in _POSTCODE.finditer(text)]:
        near = _paragraphs(text, found)
        for form in (1, 2, 3, 4):
            _near(_ADDRESSES[form], text, near, 4, form, out)
    if found := [m.span() for m in _DUTCH.finditer(text)]:
        _near(_ADDRESSES[5], text, _paragraphs(text, found), 4, 5, out)
    out = {c for c in out if c[2] != 2 or 7 <= sum(ch.isdigit() for ch in text[c[0] : c[1]]) <= 19}
    listed = sorted(out)
    _names(text, listed)
    return listed


def _checked(text: str, kind: int, form: int) -> int:
    """Whether a check digit or letter holds: 1 yes, 0 no, -1 there is none."""
    if kind != 3:
        return -1
    if form == 5:
        digits = re.sub(r"\D", "", text.replace("X", "0", 1).replace("Y", "1", 1).replace("Z", "2", 1) if text[0] in "XYZ" else text)
        return int("TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == text[-1])
    if form == 2:
        digits = re.sub(r"\s", "", text).replace("2A", "19").replace("2B", "18")
        return int(digits.isdigit() and len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:]))
    return -1


def features(text: str, span: tuple[int, int, int, int]) -> list[float]:
    """Format and context of a span."""
    a, b, kind, form = span
    body = text[a:b]
    before = text[max(0, a - 48) : a]
    after = text[b : b + 40]
    near = far = 60
    for m in _CUE[KINDS[kind]].finditer(before):
        near = len(before) - m.end()
    for m in _NOT_CUE.finditer(before):
        far = len(before) - m.end()
    line_a = text.rfind("\n", 0, a) + 1
    line_b = text.find("\n", b)
    line_b = len(text) if line_b < 0 else line_b
    # a line with much else in it is no line of names, and is not read
    line = text[line_a:line_b].strip() if line_b - line_a - len(body) < 1000 else text[a:b] + "." * 99
    rest = line.replace(body, "", 1)
    alone = len(rest) < 90 and not re.search(r"\d|[.:;!?](?!\s*$)(?<![A-Z]\.)|(?<![^\W\d_])[a-z]{4,}", rest) if kind == 0 else len(rest) < 3
    if kind == 0 and alone:
        far = 60  # a line of names; what is before it is another line
    following = after.lstrip()[:1]
    leading = before.rstrip()[-1:]
    return [
        kind * 10 + form,
        kind,
        sum(c.isdigit() for c in body),
        len(body) if kind else 0,
        _checked(body, kind, form),
        near,
        far,
        1.0 if _INSTITUTION.match(after) else 0.0,
        1.0 if _ET_AL.match(after) else 0.0,
        1.0 if kind == 0 and _YEAR.match(after) else 0.0,
        1.0 if kind == 0 and body.isupper() else 0.0,
        1.0 if alone else 0.0,
        float(",.;:()<>[]".find(following) if following else -2),
        float(",.;:()<>[]".find(leading) if leading else -2),
        1.0 if re.search(r"(?:dr|prof|mr|mrs|ms|mme|sr|sra|herr|frau|проф)\.?\s+$", before, re.I) else 0.0,
        1.0 if re.search(r"(?:^|[.!?]\s+)$", before) else 0.0,
        1.0 if re.search(r"(?i)\bthe\W+(?:\w\W+)*$|<i>the</i>\s*$", before) else 0.0,
        *(_name_features(text, a, b, before, after) if kind == 0 else (0.0,) * 8),
    ]


#: Words that may stand between a cue and a name.
_LINKED = re.compile(rf"(?<![^\W_])(?>(?:(?:with|by|to|for|from|and|was|were|is|named|called|mit|von|an|bei|con|a|à|avec|par|und|et|y|и|dr|prof|mr|mrs|ms|mme|sra?|herrn?|frau|dott)\.?[\s,:(]+)|(?-i:[{_UP}][\w’'-]*\.?[\s,]+))*+$", re.I)
_CUE_END = re.compile(rf"(?<![\w])(?:{_CUES['name']})[\s,:(]*$", re.I)
_CAPITAL_BEFORE = re.compile(rf"(?<![^\W_])[{_UP}]\w*[^\S\n]+$")
_PLACED = re.compile(r"(?<![^\W_])(?:in|at|from|near|of|across|around|inside|outside|through|via|aus|in|im|bei|en|à|dans|desde|cerca de|unlike|nach|selon|según|according to)\s+(?:the\s+)?$", re.I)
def _stands(text: str, word: str) -> bool:
    """Whether a word in lower case stands in the text."""
    at = text.find(word)
    while at >= 0:
        if not (at and text[at - 1].isalnum()) and not text[at + len(word) : at + len(word) + 1].isalnum():
            return True
        at = text.find(word, at + 1)
    return False


def _cued(text: str, a: int) -> bool:
    """Whether a cue stands before the place, apart from linking words and other names of a list."""
    before = text[max(0, a - 120) : a]
    at = _LINKED.search(before).start()
    # a cue with a capital or a linking word may itself be in the stretch that was passed over
    return bool(_CUE_END.search(before, 0, at)) or _CUE["name"].search(before, at) is not None


def _name_features(text: str, a: int, b: int, before: str, after: str) -> tuple[float, ...]:
    words = [w for w in re.findall(r"[^\W\d_]{2,}", text[a:b]) if not w.islower()]
    family = max((_plain(w) for w in words), key=len, default="")
    mail = text[b : b + 160].lower()
    return (
        float(sum(_plain(w) in GIVEN for w in words)),
        float(sum(_stands(text, w.lower()) for w in words)),
        1.0 if len(family) > 3 and family in mail and ("@" in mail or "at" in mail) else 0.0,
        1.0 if re.match(rf"\s{{1,2}}[{_UP}]", after) else 0.0,
        float(len(words)),
        1.0 if _CAPITAL_BEFORE.search(before) else 0.0,
        1.0 if _PLACED.search(before) else 0.0,
        1.0 if _cued(text, a) else 0.0,
    )


#: Frames of made-up sentences.  N, M, L: names; J: a name without letter case; E, P, I, A: the other kinds; n, i, p: what looks like
#: them but belongs to nobody; t, u: places; y: a year; d: a number; w: a word in upper case.
FRAMES = (
    "For questions please reach {N} at {E}.", "Please address letters to {N}, {A}; e-mail: {E}.", "Our thanks go to Dr. {N} for reading the draft.", "We also thank Prof. {N} and {M} for remarks.", "We are grateful to {N} for the slides.",
    "We thank {N}, {M} and {L} for their time.", "Mrs. {N} was interviewed twice; her number is {I}.", "The patient {N}, born 1961, was seen (file {I}).", "Patient {N} (record {I}) went home.", "The nurse {N} signed the sheet.", "Signed: {N}",
    "Name: {N}\nPhone: {P}\nAddress: {A}", "Contact person: {N} ({E}, {P}).", "Contact: {N}, {E}", "Corresponding author {N} <{E}>", "Subject {N} asked to be left out.", "The donor, {N}, lives at {A}.", "The letter sent by {N} came late.", "The sample belongs to {N}, phone {P}.",
    "Ansprechpartner: {N}, Telefon {P}.", "Unser Dank gilt Frau {N} und Herrn {M}.", "Die Patientin {N} (Nr. {I}) wohnt in {A}.", "Herr {N} ist unter {P} erreichbar.", "Nos remerciements vont à Mme {N}, tél. {P}.", "La patiente {N} habite {A}.", "Merci à {N} et {M}.",
    "Damos las gracias a {N}.", "La Dra. {N} vive en {A}.", "El paciente {N} (DNI {I}) llamó al {P}.", "Ringraziamo il dott. {N}, {A}.", "Благодарим {K} за помощь.", "Контактное лицо: {K}, {E}", "Проф. {K} прочитал текст.",
    "連絡先：{J}、{E}", "担当 {J}さん、電話 {P}", "联系人：{J}，电话 {P}", "문의: {J}님, {E}", "Send mail to {E}.", "Phone or fax: {P}.", "Telephone {P} in the morning, {Q} at night.", "Her passport number is {I}.", "SSN {I}, mobile {P}.", "Home: {A}.", "Llámenos al {P}.", "Marque el {P} o escriba a {E}.", "Rufen Sie {P} an.", "Appelez le {P}.", "Ring {P} or write to {E}.", "Tel./fax {P}", "{E}; {P}", "Teléfono móvil: {P}.", "Anrufe bitte an {P}.", "Par téléphone au {P}.", "They moved to {A} in May.", "ID {I} and address {A} were on the form.",
    "{N}, {M} and {L}\n\nSummary", "On the drift of salts\n\n{N}\n\nSummary", "Slow yields\n{N}, {M}\nBackground", "A note on jars\r\n\r\n{N}\r\n\r\nWe looked at jars.", "{N} wondered about it (mail {E}).",
    # no personal information
    "The {n} Institute opened in {t} {u}.", "They met in {t} {u}, near the {u} River.", "Unlike {t} it was warm.", "According to {t} {u}, it was warm.", "{w} {t} was chosen as the site.", "Part {r} and Table {d} give the values.", "{t} {u}\n\nThe cells were kept.", "Materials and Methods\n\nStatistical Analysis\n\nData Availability",
    "{n} et al. ({y}) found it.", "As {n} ({y}) wrote, it holds.", "The {n} Scale was used.", "Paid by the {n} Foundation and the {t} {u} Council.", "A {n} Fellowship paid for it.", "It was sent to {t} {u} Hospital.", "{w} {w} {t} {u} {w}", "We used {t} {u} kits, lot {i}.", "{u}, {t} is a port.", "We thank the {t} {u} Centre for rooms.",
    "Written to disk at {t} {u}.", "See {n} {y}; {n} {y}.", "In {t} {u} and {u} {t} the samples were dry.", "The samples came from {t}, {u} and {t} {u}.", "Die Proben aus {t} kamen im Mai {y}.", "Im Mittel lag {t} {u} vorn.", "Selon {t}, il pleut.", "Según {t} {u}, llueve.", "Nach {t} {u} und {t} regnet es.",
    "Lot {i} and batch {i} failed.", "Grant {p}, accession {i}.", "Registry {i}; protocol {p}.", "Order no. {i} was kept, serial {p}.", "ISSN {s} and ref. {i}.", "Model {p}, part {i}.", "The setting was Unit {w}. Batch work went on.", "The account is {b}.", "Cohort {t} {u} had a mean of {d}.", "Samples {i} of trial {p}.",
)
_SYLLABLES = "ba ke lo mi ru sta ven dor hal ter gri pon ao fe wa kwa shi nga zhu thi ola ife bri osh ann ye tun del mor sa li".split()
_ENDS = "son er ova sen itz ez a i o n ko ry lle sh ard ić".split()


def _name_parts(rng: np.random.Generator) -> tuple[str, str, str]:
    """A given name, known or made up, a family name and an initial."""
    pick = lambda x: x[rng.integers(len(x))]
    word = lambda low, high: "".join(pick(_SYLLABLES) for _ in range(rng.integers(low, high)))
    given = pick(sorted(GIVEN)) if rng.random() < 0.4 else word(1, 3) + pick(["", "", *_ENDS])
    return given.title(), (word(2, 4) + pick(_ENDS)).title(), pick("ABCDEFGHJKLMNPRST")


def _written_name(rng: np.random.Generator) -> str:
    given, family, letter = _name_parts(rng)
    other = _name_parts(rng)[1]
    forms = [f"{given} {family}"] * 4 + [f"{family}, {given}"] * 2 + [f"{letter}. {family}", f"{given} {letter}. {family}", f"{family}, {letter}.", f"{given} de la {family}", f"{given} van {family}", f"{given} {family}-{other}", f"{given} {other} {family}", f"{letter}. {letter}. {family}"]
    name = forms[rng.integers(len(forms))]
    return name.upper() if given.lower() in GIVEN and rng.random() < 0.08 else name


def _made_up(rng: np.random.Generator, frames: tuple[str, ...] = FRAMES) -> tuple[str, list[tuple[int, int, int]]]:
    """A made-up sentence with the spans of personal information in it."""
    pick = lambda *x: x[rng.integers(len(x))]
    digits = lambda n: "".join(str(rng.integers(10)) for _ in range(n))

    def number() -> str:
        letter = pick(*"ABCDEFGHJKLMNPRST")
        nir = pick("1", "2") + digits(2) + "0" + str(rng.integers(1, 10)) + digits(8)
        nir += f"{97 - int(nir) % 97:02d}"
        dni = digits(8)
        check = "TRWAGMYFPDXBNJZSQVHLCKE"[int(dni) % 23]
        return pick(f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(3)} {digits(2)} {digits(4)}", f"{pick('MR', 'PT', 'KX')}-{digits(7)}", " ".join([nir[0], nir[1:3], nir[3:5], nir[5:7], nir[7:10], nir[10:13], nir[13:]]), f"{digits(2)} {digits(3)} {digits(3)} {digits(3)}", f"{letter}0{digits(1)}X{digits(5)}", f"{pick('AB', 'QX')} {digits(2)} {digits(2)} {digits(2)} {pick(*'ABCD')}", dni + pick("", "-") + check, f"{dni[:2]}.{dni[2:5]}.{dni[5:]}-{check}")

    def phone() -> str:
        return pick(f"+1-{digits(3)}-555-{digits(4)}", f"({digits(3)}) 555-{digits(4)}", f"555-{digits(4)}", f"+44 20 7946 {digits(4)}", f"020 7946 {digits(4)}", f"1.{digits(3)}.555.{digits(4)}", f"+33 1 {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"0033 1 {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"01.{digits(2)}.{digits(2)}.{digits(2)}.{digits(2)}", f"+33199 {digits(6)}", f"030/{digits(5)}-{digits(3)}", f"+49 30 {digits(5)} {digits(3)}", f"0049 (0)30 {digits(8)}", f"(030) {digits(5)} {digits(3)}", f"+34 555 {digits(2)} {digits(2)} {digits(2)}", f"0034 555{digits(6)}", f"555-{digits(2)}-{digits(2)}-{digits(2)}", f"+1 555 {digits(4)}", f"1.312.555.{digits(4)} ext. {digits(3)}", f"06-{digits(8)}")

    given, family, letter = _name_parts(rng)
    town, place = (pick("Harrow", "Lenz", "Molle", "Quint", "Sarre", "Tolva", "Old", "Beacon", "Salt", "North", "Heron", "Mill") + pick("", "ford", "burg", "ville", "mar") for _ in range(2))
    street, post, no = _name_parts(rng)[1], "0" + digits(4), str(rng.integers(1, 300))
    ascii_given, ascii_family = (w.encode("ascii", "ignore").decode().lower() for w in (given, family))
    written = _written_name(rng)
    if rng.random() < 0.5:  # the one whose mail it is
        written = f"{given} {family}"
    made = {
        "N": lambda: written, "M": lambda: _written_name(rng), "L": lambda: _written_name(rng),
        "J": lambda: pick("".join(pick(*"田中山本王李張佐木川高") for _ in range(2)) + pick("", " ") + "".join(pick(*"太郎花子明美健一") for _ in range(rng.integers(1, 3))), "".join(pick(*"김이박최정") for _ in range(1)) + "".join(pick(*"철수영희민준서") for _ in range(2))),
        "K": lambda: pick(*"Анна Иван Пётр Ольга Глеб Рита".split()) + pick("а", "") + " " + "".join(pick(*"пе тро со ко ле ми ва но".split()) for _ in range(3)).title() + pick("в", "ва", "ин"),
        "E": lambda: pick(f"{ascii_given}.{ascii_family}@mail.example.org", f"{ascii_family}{digits(2)}(at)lab.example.net", f"{ascii_given[:1]}{ascii_family} [at] uni-{town.lower()} [dot] example", f"{ascii_family.upper()}@{town.lower()}.example", f"{ascii_given}+list{digits(1)} at lab dot example dot org", f"office{digits(2)}@{town.lower()}.example"),
        "P": phone, "Q": phone, "I": number,
        "A": lambda: pick(f"{no} {street} {pick('Street', 'Road', 'Ln.', 'Ave', 'Drive', 'Yard')}, {pick('', 'Apt 3B, ', 'Flat 12, ')}{town}{pick('', ' ' + post)}", f"{no}{pick('', ' bis')}, {pick('rue', 'avenue', 'bd')} des {street}s, {post} {town}", f"{street}{pick('straße', 'gasse', 'allee', 'str.', 'weg')} {no}{pick('', 'a')}, {post} {town}", f"Am Alten {street} {no}, {post} {town}", f"{pick('Calle del', 'Avda. de los', 'C/')} {street} {no}, {pick('bajo', '3.º B', '1.º')}, {post} {town}", f"Via {street} {no}, {post} {town}", f"{street}straat {no}, {digits(4)} {pick('AB', 'CK')} {town}"),
        "n": lambda: pick(f"{given} {family}", f"{letter}. {family}", family, f"{family} and {street}"), "t": lambda: town, "u": lambda: place, "i": lambda: pick(number(), f"{digits(3)}-{digits(2)}-{digits(4)}"), "p": lambda: pick(phone(), f"555-{digits(4)}"), "y": lambda: f"{pick(19, 20)}{digits(2)}",
        "d": lambda: digits(1), "w": lambda: pick("DRY", "WET", "A", "OLD", "ONE", "LAMPS"), "r": lambda: pick("II", "III", "IV"), "s": lambda: f"{digits(4)}-{digits(4)}", "b": lambda: f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}",
    }
    frame = pick(*frames)
    text, spans = pick("", "The jars were kept cold. ", "It rained (Fig. 3). ", "\n\n", "Mean drift was low, as sent to disk. "), []
    at = 0
    for m in re.finditer(r"\{(\w)\}", frame):
        text += frame[at : m.start()]
        key = m.group(1)
        body = made[key]()
        kind = {"N": 0, "M": 0, "L": 0, "J": 0, "K": 0, "E": 1, "P": 2, "Q": 2, "I": 3, "A": 4}.get(key, -1)
        if kind >= 0:
            spans.append((len(text), len(text) + len(body), kind))
        text += body
        at = m.end()
    text += frame[at:] + pick("", " The drift was low.", "\n\nMethods\n\nWe measured it.", " [3] Others et al. (2003).", " Yields of jars and salts went up.")
    return text, spans


@lru_cache(maxsize=1)
def model(examples: int = EXAMPLES, seed: int = 29) -> tuple[object, tuple[float, ...]]:
    """The trained trees, and the threshold of each kind."""
    from veritrove.llm.boosting import Boosted

    rng = np.random.default_rng(seed)
    rows, answers, kinds = [], [], []
    for _ in range(examples):
        text, spans = _made_up(rng)
        truth = set(spans)
        for c in candidates(text):
            rows.append(features(text, c))
            answers.append((c[0], c[1], c[2]) in truth)
            kinds.append(c[2])
    x, y, kind = np.array(rows), np.array(answers, float), np.array(kinds)
    held = np.arange(len(y)) % 4 == 0
    trees = Boosted().fit(x[~held], y[~held])
    p = trees.predict(x[held])
    thresholds = []
    for k in range(len(KINDS)):
        own = kind[held] == k
        grid = np.linspace(0.2, 0.8, 25)
        score = []
        for t in grid:
            yes = p[own] >= t
            hit = float((yes & (y[held][own] == 1)).sum())
            score.append(2 * hit / max(1.0, yes.sum() + (y[held][own] == 1).sum()))
        best = np.flatnonzero(np.array(score) >= max(score) - 1e-9)
        thresholds.append(float(grid[best[len(best) // 2]]))
    return trees, tuple(thresholds)


def find(texts: list[str | None], trained: tuple[object, tuple[float, ...]]) -> list[tuple[int, int, int, int]]:
    """(text, start, end, kind) of the personal information in a batch of texts."""
    trees, thresholds = trained
    spans, rows = [], []
    for k, text in enumerate(texts):
        if text:
            for c in candidates(text):
                spans.append((k, *c[:3]))
                rows.append(features(text, c))
    if not rows:
        return []
    p = trees.predict(np.array(rows))
    chosen = sorted((k, -round(float(s), 3), a - b, a, b, kind) for (k, a, b, kind), s in zip(spans, p, strict=True) if s >= thresholds[kind])
    out: list[tuple[int, int, int, int]] = []
    text_at, taken = -1, []
    whole: dict[int, list[tuple[int, int]]] = {}
    for k, _, _, a, b, _ in chosen:
        whole.setdefault(k, []).append((a, b))
    for k, _, _, a, b, kind in chosen:
        if k != text_at:
            text_at, taken = k, []
        if any(x <= a and b <= y and y - x > b - a for x, y in whole[k]):
            continue  # part of a longer piece, as a name in an address
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            out.append((k, a, b, kind))
    return sorted(out)


def detect(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, ``pii_kind``, ``start_at``, ``end_at`` of every piece."""
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    trained = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = find(batch.column(1).to_pylist(), trained)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([g[0] for g in got], pa.int64())), pa.array([KINDS[g[3]] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())],
                names=["_id", "pii_kind", "start_at", "end_at"],
            )

    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_id {kind}, pii_kind string, start_at int, end_at int").withColumnRenamed("_id", id_col)


def redact(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, ``text`` with a typed placeholder for every piece, and ``n_pieces``; null texts stay null."""
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    trained = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            count = [0] * len(texts)
            for k, a, b, kind in reversed(find(texts, trained)):
                texts[k] = texts[k][:a] + PLACEHOLDER[KINDS[kind]] + texts[k][b:]
                count[k] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(count, pa.int32())], names=["_id", "text", "n_pieces"])

    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_id {kind}, text string, n_pieces int").withColumnRenamed("_id", id_col)

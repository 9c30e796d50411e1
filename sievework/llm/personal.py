"""Problem 9: personal information inside free text, found by kind and replaced by keyed surrogates."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from sievework.llm.files import last_delivered
from sievework.llm.names import PARTICLES, WORD, NameModel, train
from sievework.shared import materialise, spread, table

# Bound of the labelled sample that the name classifier is fitted on, and of the length of a text in it.
SAMPLE_ROWS = 2_000
SAMPLE_CHARS = 4_000
# The dictionary of given names is broadcast; more are refused.
MOST_GIVEN = 2_000_000

_GAP = r"(?:[ \t]+|[ \t]*\r?\n[ \t]*(?:[>*#|\-]+[ \t]*)?)"


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str
    family_first: bool = False  # a name whose last word is the given name, without a comma to tell


# ---- mail

_AT = r"(?:@|[(\[{<][ \t]?(?:at|@|ät)[ \t]?[)\]}>]|(?<= )at(?= ))[ \t]?"
_LABEL = r"[\w\-]+(?:\.|[ \t]?[(\[{<][ \t]?(?:dot|punkt|punto|point)[ \t]?[)\]}>][ \t]?| dot )"
_MAIL = re.compile(rf"(?<![\w.+\-/@:%])(?:mailto:)?([\w][\w.%+\-]*)[ \t]?{_AT}((?:{_LABEL})+[A-Za-z]{{2,}})(?![\w@])", re.I)
# The part that every match has; it is looked for first, since that is cheap.
_MAIL_SIGN = re.compile(_AT + _LABEL, re.I)
# Words that name a role or a machine, in four languages. Fixed values.
_ROLES = frozenset(
    "abuse accounts admin administrator alert alerts api backup billing bot bounce bounces build builds buzon careers ci compliance contact contacto contributors cron daemon deploy dependabot dev devnull developers donotreply ebay events facturacion feedback finance git github gitlab hello help helpdesk hg hilfe hostmaster hr info inbox invoice invoices it jenkins jobs kontakt legal list lists mail mailer mailer-daemon maintainers marketing media monitor monitoring news newsletter no-reply noc noreply notification notifications office ops orders payments postfach postmaster press privacy renovate reply robot root runner sales security server service service-account services shop ssh staff status subscribe support svc svn sysadmin system team test tickets unsubscribe user users webmaster www".split()
)


def mails(text: str) -> Iterator[Entity]:
    if not _MAIL_SIGN.search(text):
        return
    for m in _MAIL.finditer(text):
        local = m.group(1).lower()
        if local in _ROLES or re.split(r"[+]", local)[0] in _ROLES or re.match(r"(?:no|do-?not)[._\-]?reply|.*(?:bot|daemon|-ci|noreply)$", local) or re.split(r"[._\-]", local)[0] in ("noreply", "support", "git", "bot"):
            continue
        if " at " in m.group() and " dot " not in m.group() and "@" not in m.group() and "(" not in m.group() and "[" not in m.group():
            continue
        yield Entity(m.start(1), m.end(), "email")


# ---- numbers

_PHONE_GAP = r"(?:[ .\-/]|\r?\n(?:> ?)?)"
_NUMBER = re.compile(
    rf"(?<![\w.\-/#@+])(?:"
    rf"(?P<plus>(?:\+|00)(?=[1-9])\d{{1,3}}(?:{_PHONE_GAP}?\(0\))?{_PHONE_GAP}?(?:\(\d{{1,5}}\)|\d+)(?:{_PHONE_GAP}?\d{{2,}})*)"
    rf"|(?P<paren>\(\d{{3}}\)[ ]?\d{{3}}[ .\-]\d{{4}}|\(0\d{{1,5}}\){_PHONE_GAP}?\d{{3,}}(?:{_PHONE_GAP}\d{{2,}})*)"
    rf"|(?P<nanp>[2-9]\d\d(?P<ns>[.\-])\d{{3}}(?P=ns)\d{{4}})"
    rf"|(?P<pairs>0[1-9](?:(?P<ps>[ .\-])\d\d)(?:(?P=ps)\d\d){{3}})"
    rf"|(?P<trunk>0[1-9]\d{{1,4}}(?:[ /\-]\d{{2,8}}){{1,4}})"
    rf"|(?P<threes>[6-9]\d\d(?P<ts>[ \-])\d{{3}}(?P=ts)\d{{3}})"
    rf"|(?P<ssn>\d{{3}}-\d\d-\d{{4}})"
    rf"|(?P<insee>[12](?P<is>[ ])\d\d(?P=is)\d\d(?P=is)(?:\d\d|2[AB])(?P=is)\d{{3}}(?P=is)\d{{3}}(?P=is)\d\d|[12]\d{{4}}(?:\d\d|2[AB])\d{{8}})"
    rf"|(?P<idnr>\d\d \d{{3}} \d{{3}} \d{{3}})"
    rf"|(?P<nif>(?:\d{{8}}|[XYZ]\d{{7}})-?[A-Z])"
    rf"|(?P<nino>[A-Z]{{2}} \d\d ?\d\d ?\d\d ?[A-D]|(?:QQ|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z])\d{{6}}[A-D])"
    rf"|(?P<card>[3-6]\d{{3}}(?:[ \-]?\d{{4}}){{2}}[ \-]?\d{{1,7}}|3\d{{3}}[ \-]?\d{{6}}[ \-]?\d{{4,5}})"
    rf")(?![\w@]|[.\-/:]\d)"
)
_KEYED = re.compile(
    r"(?i)(?<![\w])(?:(?P<mrn>MRN|medical[ ]record(?:[ ](?:no\.?|number|nr\.?|id|#))?|patient(?:en)?[ \-]?(?:id|nr\.?|number|no\.?)|health[ ]record[ ]no\.?)|(?P<ssn>SSN|social[ ]security(?:[ ](?:no\.?|number|#))?|tax[ ](?:id|no\.?|number)|TIN|ITIN|EIN|steuer(?:-?id|nummer|[ \-]?idnr\.?|identifikationsnummer)|id-?nr\.?|NIF|NIE|DNI|NIR|insee|num[ée]ro[ ]fiscal|sozialversicherungsnummer|svnr\.?|national[ ]insurance(?:[ ](?:no\.?|number))?|NINO|personalausweis(?:[ \-]?nr\.?)?|ausweis(?:nr\.?|nummer)|c[ée]dula|carte[ ]d'identit[ée])|(?P<pass>passport|reisepass|pasaporte|passeport))"
    r"(?:[ \-]?(?:no\.?|nr\.?|number|nummer|num\.?|n[º°o]\.?|#))?[ \t]*[:=#]?\s{0,2}(?P<value>[A-Z0-9][A-Z0-9 .\-/]{4,20}[A-Z0-9])(?![\w@])"
)
_NOT_PERSONAL = re.compile(r"(?i)(?:\b(?:order|orders|build|ticket|tickets|run|job|checksum|commit|version|release|invoice|sha|hash|issue|pr|line|port|pid|bestellung|auftrag|pedido|commande|factura|facture|rechnung|trace|request|batch|serial|sku|isbn|tracking)(?: (?:no\.?|nr\.?|number|id|#))?[ :#=\-]{1,3})$")


# A run of digits that can hold a number of any kind, and keywords of which one precedes a value without form.
_RUN = re.compile(r"[+(]?\d(?:[\d ().\-/+AB]|\r?\n(?:> ?)?){5,30}[\dA-Z]")
_DATE = re.compile(r"(?:\d{4}-\d\d-\d\d(?![\d\-])|\d{1,3}\.\d{1,3}\.\d{1,3}(?:\.\d+)? ?-)")
_KEYWORDS = ("medical rec", "health rec", "social sec", "tax id", "tax no", "tax number", "steuer", "idnr", "id-nr", "insee", "fiscal", "sozialvers", "svnr", "national ins", "ausweis", "cédula", "cedula", "identit", "passport", "reisepass", "pasaporte", "passeport", "patient")
# The short ones are words or parts of words too, so a digit has to stand near; a value of any kind begins with one or with
# up to nine letters.
_SHORT_KEYWORD = re.compile(r"(?i)(?<!\w)(?:mrn|ssn|i?tin|ein|nif|nie|dni|nir|nino|id-?nr)(?:[ \-]?(?:no\.?|nr\.?|number|nummer|num\.?|n[º°o]\.?|#))?\.?[ \t]*[:=#]?\s{0,2}[A-Z0-9 .\-/]{0,12}\d")


def _has_keyword(text: str) -> bool:
    low = text.lower()
    return any(k in low for k in _KEYWORDS) or bool(_SHORT_KEYWORD.search(text))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def _nif(s: str) -> bool:
    bare = s.replace("-", "").upper()
    number = int(bare[:-1].translate(str.maketrans("XYZ", "012")))
    return "TRWAGMYFPDXBNJZSQVHLCKE"[number % 23] == bare[-1]


def _insee(s: str) -> bool:
    bare = s.replace(" ", "")
    body = bare[:-2].replace("2A", "19").replace("2B", "18")
    return body.isdigit() and 97 - int(body) % 97 == int(bare[-2:])


def _idnr(digits: str) -> bool:
    """Check digit by ISO 7064 Mod 11,10."""
    product = 10
    for c in digits[:10]:
        total = (int(c) + product) % 10 or 10
        product = total * 2 % 11
    return (11 - product) % 10 == int(digits[10])


def _candidates(text: str) -> Iterator[re.Match]:
    """Matches of the number forms; only runs of digits that are long enough are looked at."""
    at = 0
    while True:
        run = _RUN.search(text, at)
        if not run:
            return
        low, high = run.span()
        if _DATE.match(text, low):
            at = _DATE.match(text, low).end()
            continue
        at = high
        # six digits suffice where letters belong to the number
        if sum(c.isdigit() for c in run.group()) < (6 if run.group()[-1].isalpha() else 7):
            continue
        place = max(0, low - 4)
        while True:
            m = _NUMBER.search(text, place, min(len(text), high + 24))
            if not m or m.start() >= high:
                break
            yield m
            place = m.end()
            at = max(at, m.end())


def numbers(text: str) -> Iterator[Entity]:
    """Phones and identity numbers; a value behind a keyword needs no check digit, a bare one does where it has one."""
    taken: list[tuple[int, int]] = []
    for m in _KEYED.finditer(text) if _has_keyword(text) else ():
        value = m.group("value")
        low = m.start("value")
        if m.group("pass"):
            v = re.match(r"[A-Z0-9]{6,9}\b", value)
            if not v or not re.search(r"\d", v.group()):
                continue
        elif m.group("mrn"):
            v = re.match(r"(?:[A-Z]{1,3}-?)?\d{5,12}\b", value)
        else:
            v = re.match(r"(?:[XYZ]?\d{7,8}-?[A-Z]\b|\d(?:[ .\-/]?\d){6,14}\b|[A-Z]{2}(?: ?\d\d){3} ?[A-D]\b|[A-Z0-9]{9,11}\b(?=.*))", value)
            if v and not re.search(r"\d{2}", v.group()):
                continue
        if v:
            taken.append((low, low + v.end()))
            yield Entity(low, low + v.end(), "id_number")
    for m in _candidates(text):
        if any(a < m.end() and m.start() < b for a, b in taken) or _NOT_PERSONAL.search(text, max(0, m.start() - 24), m.start()):
            continue
        kind, s = m.lastgroup, m.group()
        for name in ("plus", "paren", "nanp", "pairs", "trunk", "threes", "ssn", "insee", "idnr", "nif", "nino", "card"):
            if m.group(name):
                kind = name
                break
        digits = _digits(s)
        if kind in ("plus", "paren", "nanp", "pairs", "trunk", "threes"):
            if kind == "plus" and s.startswith("00") and not re.search(r"[ .\-/]", s) and len(digits) < 11:
                continue
            if 9 <= len(digits) <= 15:
                yield Entity(m.start(), m.end(), "phone")
        elif kind == "ssn":
            if s[:3] not in ("000", "666") and s[4:6] != "00" and s[7:] != "0000":
                yield Entity(m.start(), m.end(), "id_number")
        elif kind == "insee":
            if _insee(s):
                yield Entity(m.start(), m.end(), "id_number")
            elif len(digits) == 15 and " " not in s and luhn(digits):
                yield Entity(m.start(), m.end(), "id_number")
        elif kind == "idnr":
            if _idnr(digits):
                yield Entity(m.start(), m.end(), "id_number")
        elif kind == "nif":
            if _nif(s):
                yield Entity(m.start(), m.end(), "id_number")
        elif kind == "nino":
            yield Entity(m.start(), m.end(), "id_number")
        elif 13 <= len(digits) <= 19 and luhn(digits):
            yield Entity(m.start(), m.end(), "id_number")


# ---- addresses

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’\-]*"
_EN_TYPES = r"(?i:street|st|road|rd|avenue|ave|boulevard|blvd|lane|ln|drive|dr|close|court|ct|way|place|pl|square|sq|terrace|crescent|gardens|grove|hill|highway|hwy|parkway|pkwy|row|mews|walk|park|green|circle|trail)"
_ADDRESS = re.compile(
    rf"(?<![\w.\-/])(?:"
    rf"(?:(?i:flat|apt|apartment|unit|suite)\.?{_GAP}\d+\w?,{_GAP})?\d{{1,5}}[a-zA-Z]?{_GAP}(?:[NSEW]{{1,2}}\.?{_GAP})?{_CAP}(?:{_GAP}{_CAP}){{0,2}}?{_GAP}{_EN_TYPES}(?:\.|\b)(?:,?{_GAP}(?i:apt|flat|unit|suite|apartment|#)\.?[ ]?\w+)?,{_GAP}{_CAP}(?:[ ]{_CAP})*?(?:{_GAP}(?:[A-Z]{{1,2}}\d[\dA-Z]?[ ]\d[A-Z]{{2}}|[A-Z]{{2}}[ ]\d{{5}}(?:-\d{{4}})?))?"
    rf"|\d{{1,4}}(?:[ ]?(?i:bis|ter|quater|[a-d]))?,?{_GAP}(?i:rue|avenue|av\.|bd|boulevard|place|chemin|impasse|all[ée]e|quai|route|cours|passage|square|sentier)(?!\w){_GAP}[\w'’\-]+(?:{_GAP}(?!\d)[\w'’\-]+){{0,4}},{_GAP}\d{{5}}{_GAP}{_CAP}"
    rf"|(?i:calle|c/|avda\.?|avenida|plaza|paseo|camino|ronda|carretera|ctra\.|travesía|callejón|pza\.)(?!\w){_GAP}[\w'’\-]+(?:{_GAP}(?!\d)[\w'’\-]+){{0,4}},?{_GAP}(?:n\.?º{_GAP}?)?\d{{1,4}}(?:,{_GAP}[^,\n]{{1,12}})?,{_GAP}\d{{5}}{_GAP}{_CAP}"
    rf"|{_CAP}(?:(?i:straße|strasse|str\.|weg|platz|gasse|allee|ring|ufer|damm|steig|stieg|pfad|chaussee|hof|berg|markt|graben)|{_GAP}(?i:straße|strasse|str\.|weg|platz|gasse|allee|ring|ufer|damm)){_GAP}\d{{1,4}}[ ]?[a-z]?(?:[ ]?-[ ]?\d+[a-z]?)?,{_GAP}\d{{5}}{_GAP}{_CAP}"
    rf")"
)
# What every match has: a postcode of five digits with a town, or house number, street and type.
_ZIP = re.compile(rf"\d{{5}}{_GAP}{_CAP}")
_HOUSE = re.compile(rf"\d[a-zA-Z]?{_GAP}(?:[NSEW]{{1,2}}\.?{_GAP})?{_CAP}(?:{_GAP}{_CAP}){{0,2}}?{_GAP}{_EN_TYPES}(?:\.|\b)")


def addresses(text: str) -> Iterator[Entity]:
    if not _ZIP.search(text) and not _HOUSE.search(text):
        return
    for m in _ADDRESS.finditer(text):
        yield Entity(m.start(), m.end(), "address")


# ---- names

_BEFORE = re.compile(rf"(?<![\w@.\-/])((?:[^\W\d_](?:[\w'’\-]*\w)?)|[^\W\d_]\.(?:[ \-]?[^\W\d_]\.)*){_GAP}(?:[^\W\d_]\.{_GAP})?((?:(?:{'|'.join(sorted(PARTICLES))}){_GAP}){{0,2}})$", re.I)
_PARTICLE_BEFORE = re.compile(rf"(?<![\w@.\-/])(?:(?:{'|'.join(sorted(PARTICLES))}){_GAP}){{1,2}}$", re.I)
_AFTER_COMMA = re.compile(rf"(?:{_GAP}[^\W\d_][\w'’\-]*)?,{_GAP}((?:[^\W\d_]\.(?=\W))|[^\W\d_](?:[\w'’\-]*\w)?)(?![\w@]|\.\w)")
_AFTER = re.compile(rf"{_GAP}([^\W\d_](?:[\w'’\-]*\w)?)(?![\w@]|\.\w)")
_INITIAL = re.compile(r"(?:[^\W\d_]\.[ \-]?)+$")


def names(text: str, model: NameModel, covered: list[Entity]) -> Iterator[Entity]:
    """A given name or initial together with a family name, in any order and case."""
    families = model.families_in(text)
    if not families:
        return
    spans: list[tuple[int, int]] = []
    found = re.compile(r"(?<![\w@.\-/+])(?:" + "|".join(sorted(map(re.escape, families), key=len, reverse=True)) + r")(?![\w@]|[.+\-]\w)")
    places = [(m.start(), m.end()) for m in found.finditer(text)]
    for low, high in places:
        if any(c.start < high and low < c.end for c in covered) or any(a <= low < b for a, b in spans):
            continue
        m = _BEFORE.search(text, max(0, low - 60), low)
        if m and not _INITIAL.match(m.group(1)) and not model.is_given(m.group(1)):
            m = _BEFORE.search(text, m.end(1), low)  # what seemed a middle initial may be all there is
        if m:
            word = m.group(1)
            if _INITIAL.match(word) and word[0].isupper() or not _INITIAL.match(word) and word.lower() not in PARTICLES and model.is_given(word):
                if not any(a < m.end(1) and m.start(1) < b for a, b in spans) and not any(c.start <= m.start(1) < c.end for c in covered):
                    end = high
                    nxt = _AFTER.match(text, high)
                    if nxt and model.is_family(nxt.group(1)):
                        end = nxt.end(1)
                    spans.append((m.start(1), end))
                    yield Entity(m.start(1), end, "person_name")
                    continue
            # a second family name, or one in front of it
        start = low
        particle = _PARTICLE_BEFORE.search(text, max(0, low - 24), low)
        if particle:
            start = particle.start()
        m = _AFTER_COMMA.match(text, high)
        if m:
            word = m.group(1)
            if _INITIAL.match(word) and word[0].isupper() or model.is_given(word) and (word.lower() in model.given or word[0].isupper()) and not model.is_family(word):
                spans.append((start, m.end(1)))
                yield Entity(start, m.end(1), "person_name")
                continue
        m = _AFTER.match(text, high)
        if m and m.group(1).lower() in model.given and not model.is_family(m.group(1)):
            spans.append((start, m.end(1)))
            yield Entity(start, m.end(1), "person_name", family_first=True)


def entities(text: str, model: NameModel) -> list[Entity]:
    """Personal data of a text in order of position; an address or a mail address holds no further name."""
    if not text:
        return []
    found = [*mails(text)]
    found += [n for n in numbers(text) if not any(c.start < n.end and n.start < c.end for c in found)]
    where = [a for a in addresses(text) if not any(c.start < a.end and a.start < c.end and c.kind == "email" for c in found)]
    found = [n for n in found if not any(a.start < n.end and n.start < a.end for a in where)] + where
    found += names(text, model, found)
    return sorted(found, key=lambda e: (e.start, -e.end))


# ---- the operator

def fit_names(documents: DataFrame, given_names: DataFrame, sample_rows: int = SAMPLE_ROWS) -> NameModel:
    """Fits the name classifier on about ``sample_rows`` texts with mail addresses (twice as many at most), those whose keys'
    hashes lie below the share that makes so many, so that the choice does not depend on the order of rows and only the
    sample reaches the driver; all texts are then searched with it. The list of given names is a dictionary and used whole;
    one of more than ``MOST_GIVEN`` names is refused instead of swamping the executors."""
    slim = documents.where(F.col("text").contains("@") & F.length("text").between(1, SAMPLE_CHARS))
    share = min(1.0, sample_rows / max(slim.count(), 1))
    sample = slim.where(F.xxhash64(F.col("doc_id").cast("long"), F.lit("sample")) <= min(int((share - 0.5) * 2**64), 2**63 - 1))
    texts = [r[0] for r in sample.select("text").limit(2 * sample_rows).collect()]
    lines = [line for text in texts for line in text.split("\n") if "@" in line or "at)" in line or "at]" in line]
    given = [r[0] for r in given_names.where(F.col("given_name").isNotNull()).select("given_name").distinct().limit(MOST_GIVEN + 1).collect()]
    if len(given) > MOST_GIVEN:
        raise ValueError("too many given names to send to every task")
    return train(texts, lines, given)


def detected(documents: DataFrame, model: NameModel) -> DataFrame:
    """One row per entity: doc_id, line_no, kind, entity, place in characters, whether a name is family-first without comma, and its normalised form.

    Texts are read whole where they are stored and never shuffled. Of a text delivered again the last delivery holds.
    Null and empty texts give no rows; a null key gives none; extra columns are ignored.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded: a fixed number of weights and the words of a bounded sample
    schema = "doc_id long, ingested_at timestamp, found array<struct<line_no int, kind string, entity string, start int, stop int, family_first boolean, norm string>>"
    struct = pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string()), ("entity", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("family_first", pa.bool_()), ("norm", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_model = shared.value
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                out.append([{"line_no": text.count("\n", 0, e.start) + 1, "kind": e.kind, "entity": text[e.start : e.end], "start": e.start, "stop": e.end, "family_first": e.family_first, "norm": normalised(e.kind, text[e.start : e.end], e.family_first)} for e in entities(text, names_model)] if text else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, type=struct)], names=["doc_id", "ingested_at", "found"])

    slim = spread(documents.select("doc_id", F.col("ingested_at").cast("timestamp").alias("ingested_at"), "text"), "doc_id")
    rows = slim.mapInArrow(run, schema)
    return last_delivered(rows, "doc_id").select("doc_id", F.inline("found"))


# ---- surrogates

_KEY = "sievework"
_SYLLABLES = "ba be bi bo da de di do fa fe fi ga ge go ka ke ki ko la le li lo ma me mi mo na ne no pa pe po ra re ri ro sa se si so ta te ti to va ve vi".split()


def _stream(key: str, *parts: str) -> Iterator[int]:
    counter = 0
    while True:
        yield from hmac.new(key.encode(), "\0".join([*parts, str(counter)]).encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        counter += 1


# Letters of the syllables above in other scripts, and runs of letters for scripts without such a table. Fixed values.
_LATIN = "abdefgiklmnoprstv"
_SCRIPTS = {"CYRILLIC": "абдефгиклмнопрств", "GREEK": "αβδεφγικλμνοπρστω"}
_RUNS = {"ARABIC": (0x0628, 0x063A), "HEBREW": (0x05D0, 0x05EA), "DEVANAGARI": (0x0915, 0x0939), "HANGUL": (0xAC00, 0xD7A3), "HIRAGANA": (0x3042, 0x3093), "KATAKANA": (0x30A2, 0x30F3), "CJK": (0x4E00, 0x9FA5), "THAI": (0x0E01, 0x0E2E), "ARMENIAN": (0x0561, 0x0586), "GEORGIAN": (0x10D0, 0x10F0)}
# Given names whose last letter tells the gender wrong. Fixed values.
_MASCULINE = frozenset("andrea luca nicola joshua mike george pierre jose uwe rené rene enrique felipe jorge jaime vicente lorenze philippe etienne maxime alexandre antoine guillaume stephane kyle luke blake duane wayne malte arne sönke helge ole".split())
_FEMININE = frozenset("carmen isabel beatriz ruth ingrid birgit karin astrid margaret elizabeth heidi raquel pilar dolores mercedes ines inés kirsten kerstin gudrun iris doris agnes judith edith muriel carol ann kim megan helen kathryn susan lauren heather hannah sarah leah marion manon margot".split())


def _script(word: str) -> str:
    letter = next((c for c in word if c.isalpha()), "a")
    return unicodedata.name(letter, "LATIN").split(" ")[0].split("-")[0]


def _feminine(word: str) -> bool:
    return word in _FEMININE or word not in _MASCULINE and word.endswith(("a", "e", "α", "η", "а", "я"))


def _word_like(word: str, stream: Iterator[int], feminine: bool | None = None, more: int = 0) -> str:
    """A word of syllables in the script of ``word``, longer by ``more`` syllables."""
    script = _script(word)
    length = max(2, min(4, len(word) // 3 + 1)) + more
    if script in _RUNS:
        low, high = _RUNS[script]
        return "".join(chr(low + (next(stream) << 8 | next(stream)) % (high - low + 1)) for _ in range(max(1, len(word)) + more))
    out = "".join(_SYLLABLES[next(stream) % len(_SYLLABLES)] for _ in range(length))
    out = out if feminine is None else out.rstrip("aeiou") + ("a" if feminine else "o")
    return out.translate(str.maketrans(_LATIN, _SCRIPTS[script])) if script in _SCRIPTS else out


def _permuted(digits: str, key: str, tag: str) -> str:
    """A keyed permutation of the digit strings of one length: distinct ones stay distinct. An unbalanced Feistel network."""
    if not digits:
        return digits
    left, right = digits[: len(digits) // 2], digits[len(digits) // 2 :]
    for i in range(8):
        seen, changed = (right, left) if i % 2 == 0 else (left, right)
        shift = int.from_bytes(hmac.new(key.encode(), f"{tag}\0{len(digits)}\0{i}\0{seen}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest()[:12], "big")
        new = str((int(changed or "0") + shift) % 10 ** len(changed)).zfill(len(changed)) if changed else ""
        left, right = (new, right) if i % 2 == 0 else (left, new)
    return left + right


def _cased(out: str, word: str) -> str:
    """``out`` in the case of ``word``."""
    return out.upper() if word.isupper() and len(word) > 1 else out.title() if word[:1].isupper() else out


_NAME_PART = re.compile(r"\w+(?:['’\-]\w+)*")
_POSSESSIVE = re.compile(r"['’]s(?![\w'’\-])", re.I)


def _name_parts(entity: str, family_first: bool = False) -> tuple[list[re.Match], int]:
    """The words of a name as they are written, without a possessive ending, and how many of them stand in front of the
    given name."""
    places = [m for m in _NAME_PART.finditer(_POSSESSIVE.sub("  ", entity))]
    if "," in entity:
        return places, sum(m.start() < entity.index(",") for m in places)
    return places, len(places) - 1 if family_first else 0


def normalised(kind: str, entity: str, family_first: bool = False) -> str:
    """What two mentions of the same entity share: numbers without separators, the words of names in lower case with the
    given name in front."""
    if kind in ("phone", "id_number"):
        return re.sub(r"[^0-9A-Za-z+]", "", entity).upper()
    if kind == "person_name":
        places, before = _name_parts(entity, family_first)
        words = [m.group().lower().replace("’", "'") for m in places]
        return " ".join(words[before:] + words[:before])
    bare = re.sub(rf"{_GAP}|\s+", " ", entity).strip().lower()
    if kind == "email":
        bare = re.sub(r"\s*[(\[{]\s*(?:at|ät)\s*[)\]}]\s*", "@", bare)
        bare = re.sub(r"\s*[(\[{]\s*(?:dot|punkt|punto|point)\s*[)\]}]\s*", ".", bare)
    return bare


def _name_surrogate(norm: str, stream: Iterator[int], more: int) -> list[str]:
    """A word in lower case for every word of a normalised name, in its script; the given name is the first and gets the
    ending of its gender."""
    out: list[str] = []
    for i, word in enumerate(norm.split(" ")):
        if word in PARTICLES:
            out.append(word)
        elif len(word) == 1:
            out.append(_word_like(word, stream, None, more) if more else chr(ord("a") + next(stream) % 26))
        else:
            out.append(_word_like(word, stream, _feminine(word) if i == 0 else None, more))
    return out


def surrogate(kind: str, entity: str, key: str = _KEY, attempt: int = 0, family_first: bool = False) -> str:
    """A keyed replacement of the same type and form: digits for digits (with a right check digit for cards), words of
    the same case and number, a given name with the ending of the same gender, a mail address in a reserved domain.

    What is drawn depends on the normalised entity only; a mention adds its order, case and separators."""
    norm = normalised(kind, entity, family_first)
    s = _stream(key, kind, norm, str(attempt))
    more = attempt // 4  # a space that is too small for its entities grows
    if kind == "email":
        return "".join(_SYLLABLES[next(s) % len(_SYLLABLES)] for _ in range(5 + more)) + f"{next(s)}@example.net"
    if kind in ("phone", "id_number"):
        # the country code stays, of which 1 and 7 have one digit; the rest is permuted, so that numbers of one form differ
        keep = re.match(r"\+(?:[17]|\d{1,2})|00(?:[17]|\d\d)", norm)
        kept = len(_digits(keep.group())) if keep and kind == "phone" else 0
        own = _digits(entity)
        card = kind == "id_number" and 13 <= len(own) <= 19 and luhn(own)
        letters = re.sub(r"[0-9]", "0", norm)
        new = own[:kept] + _permuted(own[kept : len(own) - card], key, f"{kind}\0{letters}\0{own[:kept]}\0{card}\0{attempt}")
        if card:
            new += next(last for last in "0123456789" if luhn(new + last))
        fresh, out = iter(new), list(entity)
        for i, c in enumerate(out):
            if c.isdigit():
                out[i] = next(fresh)
            elif c.isascii() and c.isalpha() and kind == "id_number":
                letter = chr(ord("A") + next(s) % 26)
                out[i] = letter if c.isupper() else letter.lower()
        return "".join(out)
    if kind == "person_name":
        places, before = _name_parts(entity, family_first)
        words = _name_surrogate(norm, s, more)
        n, at, made = len(places), 0, []
        for i, m in enumerate(places):
            new, word = words[(i - before) % n], m.group()
            made += [entity[at : m.start()], word if word.lower() in PARTICLES else new.upper() if len(word) == 1 and len(new) == 1 else _cased(new, word)]
            at = m.end()
        return "".join([*made, entity[at:]])

    def change(m: re.Match) -> str:
        word = m.group()
        if word.lower() in PARTICLES or kind == "address" and re.fullmatch(_EN_TYPES + r"|(?i:rue|avenue|bd|place|chemin|calle|avda|plaza|paseo|bis|apt|flat|unit|de|du|la|bajo)", word):
            return word
        return _cased(_word_like(word, s, None, more), word) if len(word) > 1 else chr(ord("A") + next(s) % 26)

    text = re.sub(r"\d", lambda m: str(next(s) % 10), entity) if kind == "address" else entity
    return WORD.sub(change, text)


def _mapped(df: DataFrame, added: str, make: Callable[..., object], *columns: str) -> DataFrame:
    """``df`` with a column made from others, one Arrow batch at a time."""
    field = _parse_datatype_string(added).fields[0]
    kind = to_arrow_schema(StructType([field])).field(0).type
    names = [*df.columns, field.name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(df_columns[c]).to_pylist() for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([make(*row) for row in zip(*values)], type=kind)], names=names)

    df_columns = {c: i for i, c in enumerate(df.columns)}
    return df.mapInArrow(run, StructType([*df.schema.fields, field]))


def _with_norm(found: DataFrame) -> DataFrame:
    """``found`` with the columns family_first and norm; where the first is not known, no name stands family-first without a
    comma."""
    if "family_first" not in found.columns:
        found = found.withColumn("family_first", F.lit(False))
    return found if "norm" in found.columns else _mapped(found, "norm string", normalised, "kind", "entity", "family_first")


def surrogates(found: DataFrame, key: str = _KEY, attempts: int = 64) -> DataFrame:
    """(kind, norm, attempt) for every entity, such that distinct entities of a kind get distinct surrogates.

    Collisions are looked for over all data: of the entities with one surrogate all but the first are tried again, with a
    longer one after some attempts, so that the space grows until it suffices. Numbers of one form never collide.
    """

    # the normalised form stands for all mentions, whose surrogates differ from its own in order, case and separators only
    def form(kind: str, norm: str, attempt: int) -> str:
        words = re.findall(r"\w+", surrogate(kind, norm, key, attempt).lower())
        return " ".join(sorted(words)) if kind == "person_name" else "".join(words)

    entity = _with_norm(found).select("kind", "norm").distinct().withColumn("attempt", F.lit(0))
    settled = materialise(_mapped(entity, "form string", form, "kind", "norm", "attempt"), "surrogates")
    for attempt in range(1, attempts + 1):
        # an aggregate that combines first; only the few forms that several entities share are joined back
        shared = settled.groupBy("kind", "form").agg(F.count(F.lit(1)).alias("_n"), F.min_by("norm", F.struct("attempt", "norm")).alias("_first")).where("_n > 1")
        again = settled.join(shared, ["kind", "form"]).where(F.col("norm") != F.col("_first")).select("kind", "norm", F.lit(attempt).alias("attempt"))
        again = materialise(_mapped(again, "form string", form, "kind", "norm", "attempt"), "collisions")
        if again.isEmpty():
            return settled.select("kind", "norm", "attempt")
        settled = materialise(settled.join(again.select("kind", "norm"), ["kind", "norm"], "left_anti").unionByName(again), "surrogates")
    raise RuntimeError("surrogates still collide; their space is too small for these entities")


def assigned(found: DataFrame, key: str = _KEY) -> DataFrame:
    """``found`` with the surrogate of each mention. Almost all entities keep their first one, so that only those that had
    to be tried again are joined."""
    found = materialise(_with_norm(found), "personal-data")
    again = surrogates(found, key).where("attempt > 0").withColumnRenamed("attempt", "_again")
    tried = found.join(again, ["kind", "norm"], "left").withColumn("attempt", F.coalesce("_again", F.lit(0))).drop("_again")
    return _mapped(tried, "surrogate string", lambda kind, entity, attempt, first: surrogate(kind, entity, key, attempt, first), "kind", "entity", "attempt", "family_first")


def replaced(documents: DataFrame, found: DataFrame, key: str = _KEY) -> DataFrame:
    """(doc_id, n_replaced, text): every entity replaced by ``[KIND surrogate]``, the rest of the text unchanged."""
    # the spans of one text only; their number is bounded by its length
    spans = assigned(found, key).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind", "surrogate"))).alias("spans"))
    latest = last_delivered(documents.select("doc_id", "ingested_at", "text"), "doc_id")

    def splice(text: str | None, spans: list | None) -> dict:
        out, at, n = [], 0, 0
        for s in spans or () if text is not None else ():
            if s["start"] >= at:
                out += [text[at : s["start"]], f"[{s['kind'].upper()} {s['surrogate']}]"]
                at = s["stop"]
                n += 1
        return {"n_replaced": n, "text": text if text is None else "".join([*out, text[at:]])}

    spliced = _mapped(latest.join(spans, "doc_id", "left").select("doc_id", "text", "spans"), "_s struct<n_replaced: int, text: string>", splice, "text", "spans")
    return spliced.select("doc_id", "_s.n_replaced", "_s.text")


def _detected(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return detected(documents, fit_names(documents, table(spark, folder, "given_names")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with personal data, read off the mentions that have got a surrogate."""
    return assigned(_detected(spark, folder)).where(F.col("surrogate").isNotNull()).select("doc_id", "line_no", "kind").distinct()


def p9_replaced(spark: SparkSession, folder: str) -> DataFrame:
    """Each text with its personal data replaced."""
    return replaced(table(spark, folder, "documents"), _detected(spark, folder))


QUERIES = {"p9_found": p9_found, "p9_replaced": p9_replaced}
SQL: dict[str, str] = {}

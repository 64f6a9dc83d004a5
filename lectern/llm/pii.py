"""Problem 9: personal information in free text.

Method: aggregation of weak supervision.  Patterns propose spans of each kind;
labelers (formats, a gazetteer of given names, words before and behind, what a
number is said to number) vote for or against a span or abstain; expectation
maximisation over the votes estimates how reliable each labeler is and how
likely each span is a case; a logistic span classifier is trained on these
likelihoods with features that reach beyond the labelers, and decides.

Words and phrases that are no names are counted over all documents, by the share
of documents that have them.  Only the fit is on at most ``TRAIN_DOCS`` documents
(least key hashes); every document is searched in full where it is read, without a
shuffle.  The gazetteer is a
table of given names that doesn't grow with the corpus; more than ``MAX_NAMES``
raises ValueError.

Results: null, empty and blank texts hold nothing and come out as they are.  A piece
that overlaps another is dropped for the one of the surer kind (email, street, id, phone, person).
"""

from __future__ import annotations

import collections
import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.tables import bounded_sample, in_batches

TRAIN_DOCS = 6000
MAX_NAMES = 100_000
DIM = 1 << 16
KINDS = ["email", "street", "id", "phone", "person"]

# candidates; patterns begin with a set of signs, so that a search skips what none can begin with, and look behind after it

_AT = re.compile(r"@| ?[(\[{] ?at ?[)\]}] ?| at ", re.I)
_AT_SIGNS = (" at ", "at)", "at]", "at}", "at )", "at ]", "at }")
_LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_])?$|[A-Za-z0-9]$")
_HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:(?:\.| ?[(\[{] ?dot ?[)\]}] ?| dot )[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+", re.I)

_NUMBER = re.compile(r"[+(\d](?<![A-Za-zÀ-ÿ0-9_.@/-].)(?:(?<=\d)|(?<=[+(])\d)(?:[\d().\-/‐-–‑   ]{4,24})\d(?![A-Za-zÀ-ÿ0-9_@])")
_CODE = re.compile(r"[A-Z0-9](?<![A-Za-zÀ-ÿ0-9_/@.-].)(?:(?<=\d)|(?=[A-Z0-9 -]{0,3}\d))(?:[A-Z0-9ÑÄÖÜ]|[ -](?=[A-Z0-9])){5,24}(?![A-Za-zÀ-ÿ0-9_@])")

_CAP = r"[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÿ'’]*"
_STREET = re.compile(
    rf"\d(?<![A-Za-zÀ-ÿ0-9_.-].)\d{{0,3}}(?:[A-Z]?(?: [NSEW]\.?)?(?: {_CAP}(?:-{_CAP})*){{1,4}}? (?:Street|St|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Boulevard|Blvd\.?|Close|Drive|Court|Crescent|Terrace|Way|Place|Square|Row|Gardens|Mews|Parkway|Highway|STREET|ST|ROAD|RD\.?|AVENUE|LANE|BOULEVARD|CLOSE|DRIVE)(?![A-Za-zÀ-ÿ0-9_])"
    rf"|(?: (?:bis|ter|quater))?,? (?:rue|avenue|boulevard|bd\.?|chemin|place|allée|impasse|quai|route|cours|passage|square|ruelle|sentier|faubourg)(?: (?:de la|de l['’]|du|des|de|d['’]|le|la|les|aux?))? ?{_CAP}(?:[ -]{_CAP})*)"
)
_STREET_ES = re.compile(rf"[CAPRT](?<![A-Za-zÀ-ÿ0-9_].)(?:(?<=C)(?:alle|/|a(?:mino|rrera|rretera|llejón))|(?<=A)v(?:enida|da\.?|\.)|(?<=P)(?:laza|za\.?|aseo|º)|(?<=R)onda|(?<=T)ravesía)(?: (?:de la|de los|de las|del|de|la|el))? ?{_CAP}(?:[ -]{_CAP})*,? (?:n\.?º ?)?\d{{1,4}}(?![A-Za-zÀ-ÿ0-9_])")
_HOUSE = re.compile(r" \d{1,4}(?: ?[a-z](?![A-Za-zÀ-ÿ0-9_]))?(?![A-Za-zÀ-ÿ0-9_])")
_STREET_DE = re.compile(r"(?i)(?:stra(?:ß|ss)e|str\.|gasse|weg|platz|allee|ring|damm|ufer|pfad|steig|chaussee)$")
_STREET_DE_HEAD = re.compile(r"(?<![A-Za-zÀ-ÿ0-9_-])(?:(?:Am|An der|An den|In der|Im|Auf der|Auf dem|Zum|Zur|Unter den|Hinter der) )?(?:[A-ZÄÖÜ][A-Za-zÀ-ÿ]*[- ]?)*$")
_GIVEN = r"(?:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+(?:-[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+)*|[A-ZÀ-ÖØ-Þ]{3,}(?:-[A-ZÀ-ÖØ-Þ]{2,})*)"
_FAMILY = (
    r"(?:(?:(?:von der|van der|van den|de la|de los|von|van|de|del|di|da|du|le|la|zu|ter|ten|bin|al) )*(?:[OD]['’]|Mc|Mac)?[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+(?:-(?:[OD]['’])?[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+)*"
    r"|(?:(?:VON|VAN|DE LA|DE|DEL|DI|DA|DU|LE|LA) )*(?:[OD]['’]|MC|MAC)?[A-ZÀ-ÖØ-Þ]{3,}(?:-(?:[OD]['’])?[A-ZÀ-ÖØ-Þ]{3,})*)"
)
_INITIAL = r"[A-ZÀ-ÖØ-Þ]\."
_INITIALS = rf"(?: {_INITIAL}(?:-?{_INITIAL})?)*"
_EDGE = r"(?<![A-Za-zÀ-ÿ0-9_'’@-])"
_PERSON = re.compile(rf"{_EDGE}(?P<last>{_FAMILY}), (?P<first>(?:{_GIVEN}|{_INITIAL}){_INITIALS})(?![A-Za-zÀ-ÿ0-9_@-])|{_EDGE}(?P<given>{_GIVEN}|{_INITIAL}(?: ?{_INITIAL})*){_INITIALS} (?P<family>{_FAMILY})(?![A-Za-zÀ-ÿ0-9_@-])")
#: Two capitalised words side by side; only there a name is looked for.
_PAIR = re.compile(rf"{_EDGE}(?P<word>[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÿ.'’-]*),? (?:(?:von|van|der|den|de|la|los|del|di|da|du|le|zu|ter|ten|bin|al) )*(?:[OD]['’])?[A-ZÀ-ÖØ-Þ]")
_PARTICLES = re.compile(r"(?<![A-Za-zÀ-ÿ0-9_'’@-])(?:(?:von|van|der|den|de|la|los|del|di|da|du|le|zu|ter|ten|bin|al) )+$")
#: Titles, which are no part of a name.
TITLES = frozenset("Dr Mr Mrs Ms Miss Prof Professor Sir Herr Frau Hr Fr M Mme Mlle Mr Me Sr Sra Srta Don Doña Ing Dipl Mag".split())

#: Words that begin sentences or lead up to a name.
LEADS = frozenset(
    "a an and any as ask at before both by but call cc contact dear each even every for form from how if in is it its level merci my no not nothing of on once or our send since so some text than that the their then there these this those to under unlike use version we when where which while with you your according most do does "
    "der die das den dem des ein eine einer eines am an auf aus bei mit nach von vor zu zum zur wenn ob wie was wer für über unter und oder nicht kein keine ältere größere jede jeder jedes "
    "le la les un une des du de au aux si quand chaque après avant mais ou et donc pour par sur sans mon ma mes son sa ses "
    "el los las una unos unas al del cuando cada según si no por para con sin mi su gracias fragen bitte envoyez écrivez escriba llame tel working chapter build order ticket clone between".split()
)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    for m in _AT.finditer(text):
        a = max(0, m.start() - 80)
        local = _LOCAL.search(text[a : m.start()])
        host = _HOST.match(text, m.end())
        if not local or not host:
            continue
        # " at " alone is a word like any other, unless it stands out in capitals or the dots are spelled out too
        if m.group() in {" at ", " At "} and not re.search(r" dot |[(\[{] ?dot", host.group(), re.I):
            continue
        if host.group()[-1].isdigit() and m.group() != "@":
            continue
        yield a + local.start(), host.end()


def _persons(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while (pair := _PAIR.search(text, at)) is not None:
        word = pair.group("word")
        at = pair.end("word")
        bare = word.rstrip(".")
        if bare.lower() in LEADS and not (len(bare) == 1 and word[-1] == "."):
            continue
        start = pair.start()
        if bare in TITLES and (len(bare) > 1 or _PERSON.match(text, at + 1)):
            continue  # a title: the name begins behind it
        if text[at : at + 1] == "," and (p := _PARTICLES.search(text, max(0, start - 24), start)):
            start = p.start()
        m = _PERSON.match(text, start)
        if m is not None:
            yield m.span()
            at = m.end()


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans of all kinds; they may overlap."""
    out = []
    low = text.lower()
    if "@" in text or any(sign in low for sign in _AT_SIGNS):
        out += [("email", a, b) for a, b in _emails(text)]
    out += [("street", *m.span()) for p in (_STREET, _STREET_ES) for m in p.finditer(text)]
    for m in _HOUSE.finditer(text):
        a = max(0, m.start() - 60)
        if text[m.start() - 1] in "eEgGzZrRmMtTdD." and (word := _STREET_DE.search(text, m.start() - 9 if m.start() > 9 else 0, m.start())):
            head = _STREET_DE_HEAD.search(text[a : word.start()])
            if head and (head.group() or text[word.start()].isupper()):
                out.append(("street", a + head.start(), m.end()))
    for m in _NUMBER.finditer(text):
        a, b = m.span()
        digits = sum(c.isdigit() for c in m.group())
        if 7 <= digits <= 15:
            out.append(("phone", a, b))
    for m in _CODE.finditer(text):
        a, b = m.span()
        # words of capitals before the number are its label
        while (w := re.match(r"[A-ZÄÖÜ]{3,}[ -]|ID |NO |NR ", text[a:b])) is not None:
            a += w.end()
        # a word of capitals behind the number isn't part of it
        b = next((e for e in [b, *(i for i in range(b - 1, a + 6, -1) if text[i] == " ")] if _ID_FORM.match(text[a:e])), b)
        if sum(c.isdigit() for c in text[a:b]) >= 6 and b - a >= 7:
            out.append(("id", a, b))
    out += [("person", a, b) for a, b in _persons(text)]
    return out


# labelers: 1 for, -1 against, 0 abstains

_ID_WORD = re.compile(r"(?i)(?:\bssn|social[- ]security|\bsocial sec|national insurance|\bnino\b|tax(?:payer)?[- ]?(?:id|number|no)|passport|passeport|pasaporte|reisepass|driv(?:ing|er'?s) licen[cs]e|führerschein|permis de conduire|permiso de conducir|identity (?:card|no|number)|id card|ausweis|steuer-?id|steuernummer|sozialversicherung|versicherungsnummer|sécurité sociale|\bnir\b|\bdni\b|\bnie\b|\bnif\b|carte d'identité|identidad|numéro fiscal|身份证|护照|パスポート)[^\n]{0,32}$")
_THING_WORD = re.compile(r"(?i)\b(?:order|ticket|part|part no\.?|case|isbn|issn|build|version|release|commit|serial|sku|invoice|record|chapter|level|line|page|port|server at|clone|number of|figure|table|step|rev(?:ision)?|model|batch|lot|item|artikel|bestellung|commande|pedido|nr\. of)[\s:#.\"(]*(?:[A-Z]{1,4}[- ]?)?$")
_THING_BEHIND = re.compile(r"(?i)^(?:[^\n.;]{0,12} )?(?:is the \w+ record|record id|replaces|was closed|answers|copies|took|holds|moved|is the \w+ manual)")
_PHONE_WORD = re.compile(r"(?i)(?:\btel(?:ef[oó]n\w*|ephone|éphone|\.)?|phone|call(?: me)?(?: on| at)?|text(?: me)?(?: on)?|mobile|cell|fax|on call(?: tonight)?|joignable au|appele[rz](?: le| au)?|llame al|llamar al|unter|rufen sie|erreichbar unter|电话|電話)[\s:=.]*$")
_PHONE_FORM = re.compile(r"^(?:\+\d{1,3}[\d\s ().\-/‐-–]{6,}|00\d{2}[\d\s().\-/]{6,}|\(?0\d{1,5}\)?[\s ./\-()]\s?\d[\d\s .\-/]{4,}|(?:1[\s.-]?)?\(?\d{3}\)?[\s.\-‐-–]\s?\d{3}[\s.\-‐-–]\d{4})$")
_DATE = re.compile(r"^\d{4}-\d\d-\d\d|^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|^\d+\.\d+\.\d+\s*\(|^\d{1,2}[./]\d{1,2}[./]\d{2,4}")
_ID_FORM = re.compile(r"^(?:\d{3}[- ]\d\d[- ]\d{4}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[12] \d\d \d\d \d\d \d{3} \d{3} \d\d|\d\d \d{3} \d{3} \d{3}|\d\d \d{6} [A-Z] \d{3}|\d{8}-?[A-ZÑ]|[XYZ]-?\d{7}-?[A-Z]|[A-Z]{2}\d{6,7}|\d\d[A-Z]{2}\d{5}|[A-Z]{2}\d{6}[A-Z]\d{3}|\d{9})$")
_PERSON_BEFORE = re.compile(r"(?i)(?:\bby|\bcc|\bask|author:|from:|to:|contact:|regards,|grüßen,?|cordialement,?|saludos,?|written by|merci à|gracias a|danke an|dank an|mr\.?|mrs\.?|ms\.?|dr\.?|prof\.?|herr|frau|\bm\.|mme|sra?\.?|as dr\.|signed|attn\.?|dear|von|par|por|作者[:：]?|审校[:：]?|编辑[:：]?|著者[:：]?|査読は|担当は|联系)\s*$")
_PERSON_BEHIND = re.compile(r"(?i)^,?\s*(?:noted|reviewed|wrote|said|asked|about|in one night|replied|reported|revisó|escribió|hat\b|kennt|schrieb|a relu|a écrit|conoce|connaît|pour la|por la|no reply|; no reply|·|が担当|さん|先生)")
_PLACE_BEHIND = re.compile(r"^\s*(?:Street|St\b|Road|Rd|Avenue|Lane|Boulevard|Map|Gateway|Button|release|notes|took|,? press|Works|Cloud|[Nn]umber|no\.|Insurance|Security)")
_PLACE_BEFORE = re.compile(r"(?:\b(?:In|At|of|the|names|On|Version|Level|Chapter|Working with|How|Build \d+ of)\s+(?:the\s+)?|\d\s+)$")


def _votes(kind: str, text: str, a: int, b: int, names: frozenset[str], common: frozenset[str]) -> list[int]:
    span, before, behind = text[a:b], text[max(0, a - 60) : a], text[b : b + 40]
    if kind == "email":
        local, host = re.split(r"(?i)@| ?[(\[{] ?at ?[)\]}] ?| at ", span, maxsplit=1)
        last = re.split(r"(?i)\.| ?[(\[{]? ?\bdot\b ?[)\]}]? ?", host)[-1]
        return [
            1 if re.fullmatch(r"[A-Za-z]{2,}", last) else -1,
            -1 if behind[:1] == ":" and behind[1:2].strip() else 0,
            -1 if re.fullmatch(r"(?i)git|svn|hg", local) else 0,
            1 if re.search(r"(?i)(?:contact|write to|mail(?:to)?|questions go to|reply-to|e-?mail|sent to|escriba a|kontakt|fragen|schreiben|écri\w+ à|联系|連絡)[\s:=<a]*(?:bitte an )?$", before) else 0,
            -1 if re.fullmatch(r"[\d.]+", host) else 1 if "." in local or "+" in local or any(c.isdigit() for c in local) else 0,
        ]
    if kind == "street":
        return [
            1 if re.match(r"\d", span) else 0,
            -1 if re.match(r"\s*(?:Map|button|maps|Station|Journal|release)", behind) else 1,
            1 if re.search(r"(?i)(?:address|anschrift|adresse|dirección|moved to|meeting is at|copy to|copie au|liegen in der|está en|lives? at|oficina|bureau)[\s:]*(?:in )?$", before) or not before.strip(" \t") or before.endswith("\n") else 0,
            -1 if re.search(r"(?i)(?:chapter|level|page|version|part|section|figure|step)\s*$", before) else 0,
        ]
    if kind == "phone":
        return [
            1 if _PHONE_FORM.match(span) else -1,
            1 if _PHONE_WORD.search(before) else 0,
            -1 if _ID_WORD.search(before) else 0,
            -1 if _THING_WORD.search(before) or _THING_BEHIND.match(behind) or (before[-1:] == "-") else 0,
            -1 if _DATE.match(span) or behind[:2] in {"%", ":0"} else 0,
            1 if span[0] in "+(" else 0,
        ]
    if kind == "id":
        return [
            1 if _ID_WORD.search(before) else -1,
            1 if _ID_FORM.match(span) else -1,
            -1 if _THING_WORD.search(before) or _THING_BEHIND.match(behind) or before[-1:] == "-" else 0,
            -1 if _PHONE_WORD.search(before) or _DATE.match(span) else 0,
        ]
    m = _PERSON.fullmatch(span)
    given = ((m.group("given") or m.group("first")) if m else span).split(" ")[0]
    family = ((m.group("family") or m.group("last")) if m else span).split(" ")[-1]
    initial = given.endswith(".")
    line = text[text.rfind("\n", 0, a) + 1 : b + 60].split("\n")[0]
    alone = (before[-1:] in {"\n", ""} or before.endswith("\n")) and behind[:1] in {"\n", "", "\r"}
    return [
        1 if given in names or given.split("-")[0] in names or given.isupper() and given.capitalize() in names else 0,
        1 if _PERSON_BEFORE.search(before) else 0,
        1 if _PERSON_BEHIND.match(behind) else 0,
        -1 if given.lower() in common else 0,
        -1 if family.lower() in common or any(p.lower() in common for p in family.split("-")) else 0,
        -1 if _PLACE_BEHIND.match(behind) or _PLACE_BEFORE.search(before) else 0,
        1 if alone and not initial else 0,
        -1 if span in common else 0,
        -1 if span.isupper() and line.isupper() and len(line) > len(span) + 2 else 0,
        1 if initial and not before.rstrip().endswith((".", "!", "?")) and before.strip() else 0,
    ]


def features(kind: str, text: str, a: int, b: int, names: frozenset[str], common: frozenset[str]) -> list[str]:
    """Features of a span: its words and the ends of its words, its shape, its surroundings, and the votes."""
    span = text[a:b]
    before, behind = re.findall(r"\w+|[^\w\s]", text[max(0, a - 40) : a])[-2:], re.findall(r"\w+|[^\w\s]", text[b : b + 30])[:2]
    shape = re.sub(r"[A-ZÀ-Þ]", "A", re.sub(r"[a-zà-ÿ]+", "a", re.sub(r"\d", "9", span)))
    out = [f"k={kind}", f"{kind} s={shape[:24]}", f"{kind} -1={before[-1].lower() if before else '^'}", f"{kind} +1={behind[0].lower() if behind else '$'}", f"{kind} -2={' '.join(before).lower()}", f"{kind} +2={' '.join(behind).lower()}"]
    out += [f"{kind} v{i}={v}" for i, v in enumerate(_votes(kind, text, a, b, names, common)) if v]
    out.append(f"{kind} nl={text[a - 1 : a] in {'', chr(10)}}/{text[b : b + 1] in {'', chr(10), chr(13)}}")
    if kind == "person":
        words = re.findall(r"[\w'’]+", span)
        comma = "," in span
        given, family = (words[-1], words[0]) if comma else (words[0], words[-1])
        for w, role in ((given, "g"), (family, "f")):
            low = w.lower()
            out += [f"p {role}4={low[-4:]}", f"p {role}3={low[-3:]}", f"p {role}^={low[:4]}", f"p {role}#={min(len(low), 12)}", f"p {role}={low}"]
            # clusters of consonants tell coined words from names
            out.append(f"p {role}c={bool(re.search(r'[^aeiouyà-ÿ]{3}', low))}/{bool(re.search(r'[^aeiouyà-ÿ]{2}', low))}")
        out.append(f"p n={len(words)}/{comma}")
    return out


# expectation maximisation over the votes


def reliabilities(votes: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Likelihood that each row is a case, from votes in {-1, 0, 1}: two classes, each labeler with its own rates of votes per class."""
    n, k = votes.shape
    p = np.clip(0.5 + 0.22 * votes.sum(1), 0.04, 0.96)
    onehot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    for _ in range(rounds):
        share = np.clip(p.mean(), 0.02, 0.98)
        yes = (np.einsum("i,ikv->kv", p, onehot) + 0.5) / (p.sum() + 1.5)
        no = (np.einsum("i,ikv->kv", 1 - p, onehot) + 0.5) / ((1 - p).sum() + 1.5)
        odds = math.log(share / (1 - share)) + np.einsum("ikv,kv->i", onehot, np.log(yes) - np.log(no))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % DIM


class Finder:
    """The trained span classifier."""

    def __init__(self, weights: np.ndarray, names: frozenset[str], common: frozenset[str]) -> None:
        self.weights, self.names, self.common = weights, names, common
        self.known: dict[str, float] = {}

    def __reduce__(self):
        return Finder, (self.weights.astype(np.float32), self.names, self.common)

    def score(self, kind: str, text: str, a: int, b: int) -> float:
        total = 0.0
        if len(self.known) > 500_000:
            self.known.clear()
        for f in features(kind, text, a, b, self.names, self.common):
            w = self.known.get(f)
            if w is None:
                w = self.known[f] = float(self.weights[_bucket(f)])
            total += w
        return total

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the pieces of a text, in order, none overlapping."""
        if not text:
            return []
        good = []
        for kind, a, b in candidates(text):
            s = self.score(kind, text, a, b)
            # the exact check: what is said to number a thing is no number of a person's
            if s > 0 and not (kind in {"id", "phone"} and _THING_WORD.search(text, max(0, a - 60), a)):
                good.append((KINDS.index(kind), -s, a, b))
        # a number is what it scores higher as
        good.sort(key=lambda g: (g[0] if g[0] not in {2, 3} else 2, g[1]))
        taken: list[tuple[int, int, str]] = []
        for k, _, a, b in good:
            if all(b <= x or y <= a for x, y, _ in taken):
                taken.append((a, b, KINDS[k]))
        return sorted(taken)


def fit(rows: list[list[str]], goal: np.ndarray, rounds: int = 80, rate: float = 0.2, penalty: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels, Adam, with a quadratic penalty."""
    of = np.repeat(np.arange(len(rows)), [*map(len, rows)])
    used, local = np.unique(np.array([_bucket(f) for r in rows for f in r]), return_inverse=True)
    w, first, second = np.zeros(len(used)), 0.0, 0.0
    for r in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[local], len(rows)), -30, 30)))
        g = np.bincount(local, (goal - p)[of], len(used)) / len(rows) - penalty * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w + rate * (first / (1 - 0.9**r)) / (np.sqrt(second / (1 - 0.99**r)) + 1e-8)
    weights = np.zeros(DIM)
    weights[used] = w
    return weights


# what the corpus says of words and phrases

_LOWER = re.compile(r"(?<![\w@.'’-])[a-zà-öø-ÿ]{2,}(?![\w@])")
_HEAD = re.compile(r"(?<![\w'’-])[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+(?![\w'’-])")
#: Documents out of which one must have a word in lower case, a capitalised word, a pair of words; and documents at least.
WORD, HEAD, PHRASE = (2000, 3), (100 / 3, 8), (600, 4)
_OPEN_COUNTS = 200_000


class Pieces(dict):
    """What stands in a piece of text without blanks: its words in lower case ("w") and capitalised ("h")."""

    def __missing__(self, piece: str) -> tuple[tuple[str, str], ...]:
        self[piece] = words = (*(("w", w) for w in _LOWER.findall(piece)), *(("h", w.lower()) for w in _HEAD.findall(piece)))
        return words


class Counter:
    """In how many documents words stand in lower case ("w") and capitalised ("h"), and pairs that look like names, but don't begin with a given one, stand ("p") and are said to be persons' ("q")."""

    def __init__(self, names: frozenset[str]) -> None:
        self.given = {n.lower() for n in names}
        self.counts: collections.Counter[tuple[str, str]] = collections.Counter()
        self.known = Pieces()

    def add(self, text: str) -> None:
        if len(self.known) > 500_000:
            self.known.clear()
        # no word reaches beyond the blanks around it
        found = set(chain.from_iterable(map(self.known.__getitem__, set(text.split()))))
        for a, b in _persons(text):
            span = text[a:b]
            if span.split()[0].lower() in self.given:
                continue  # no phrase, however often it stands
            found.add(("p", span))
            if ("q", span) not in found and (_PERSON_BEHIND.match(text, b) or _PERSON_BEFORE.search(text[max(0, a - 20) : a])):
                found.add(("q", span))
        self.counts.update(found)


def common_words(counts: dict[tuple[str, str], int], documents: int, names: frozenset[str]) -> frozenset[str]:
    """Words and phrases that are no names, by the share of all documents that have them."""
    low, often, again = (max(least, documents / n) for n, least in (WORD, HEAD, PHRASE))
    given = {n.lower() for n in names}
    # words that also stand in lower case are no names; capitalised words that stand in a good part of all documents belong to the language, not to a person
    common = {w for (k, w), n in counts.items() if k == "w" and n >= low or k == "h" and n >= often} - given
    # a pair of words that recurs in many documents is a fixed phrase, unless half of them say that it is a person
    return frozenset(common | {w for (k, w), n in counts.items() if k == "p" and n >= again and 2 * counts.get(("q", w), 0) < n})


def counted(documents: DataFrame, names: frozenset[str], key: str = "doc_id", text: str = "text") -> frozenset[str]:
    """``common_words`` of all documents.  Counts are summed up where the texts are read; only what reaches its share comes to the driver, which is as much for any number of documents."""
    texts = documents.select(key, text).where(F.length(text) > 0)
    if not texts.groupBy(key).count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates([key])
    n = texts.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(names)

        def rows() -> pa.RecordBatch:
            kinds, words = zip(*counter.counts, strict=True) if counter.counts else ((), ())
            out = pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(words, pa.string()), pa.array([*counter.counts.values()], pa.int64())], names=["kind", "word", "n"])
            counter.counts.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                counter.add(t)
                if len(counter.counts) > _OPEN_COUNTS:
                    yield rows()
        yield rows()

    sums = in_batches(texts.select(text), run, "kind string, word string, n bigint").groupBy(F.when(F.col("kind") == "q", "p").otherwise(F.col("kind")).alias("kind"), "word")
    sums = sums.agg(F.sum(F.when(F.col("kind") != "q", F.col("n"))).alias("n"), F.sum(F.when(F.col("kind") == "q", F.col("n"))).alias("said"))
    least = {"w": WORD, "h": HEAD, "p": PHRASE}
    reached = sums.where(" or ".join(f"kind = '{k}' and n >= {max(m, n / part)}D" for k, (part, m) in least.items()))
    counts: dict[tuple[str, str], int] = {}
    for kind, word, m, said in reached.collect():
        counts[kind, word] = m
        if said:
            counts["q", word] = said
    return common_words(counts, n, names)


def train(texts: list[str], names: frozenset[str], common: frozenset[str] | None = None) -> Finder:
    """``common`` is what ``common_words`` gives for the whole corpus; without it the texts are taken for the corpus."""
    if common is None:
        counter = Counter(names)
        for t in texts:
            counter.add(t)
        common = common_words(counter.counts, len(texts), names)
    rows: dict[str, list[list[str]]] = {k: [] for k in KINDS}
    votes: dict[str, list[list[int]]] = {k: [] for k in KINDS}
    for t in texts:
        for kind, a, b in dict.fromkeys(candidates(t)):
            votes[kind].append(_votes(kind, t, a, b, names, common))
            rows[kind].append(features(kind, t, a, b, names, common))
    every, goal = [], []
    for kind in KINDS:
        if rows[kind]:
            every += rows[kind]
            goal.append(reliabilities(np.array(votes[kind])))
    return Finder(fit(every, np.concatenate(goal)) if every else np.zeros(DIM), names, common)


def trained(documents: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", column: str = "given_name") -> Finder:
    rows = names.select(column).where(f"{column} is not null").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names")
    sample = bounded_sample(documents.select(key, text), key, TRAIN_DOCS)
    given = frozenset(r[0].strip() for r in rows)
    return train([r[text] for r in sample if r[text]], given, counted(documents, given, key, text))


def found(documents: DataFrame, finder: Finder, key: str = "doc_id", text: str = "text", replaced: bool = False) -> DataFrame:
    """(key, pieces: array of (kind, found)), and on demand the text with placeholders such as [EMAIL]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, texts = [], []
            for t in batch.column(1).to_pylist():
                spans = finder.find(t)
                pieces.append([{"kind": k, "found": t[a:b]} for a, b, k in spans])
                if replaced:
                    out, at = [], 0
                    for a, b, k in spans:
                        out += [t[at:a], f"[{k.upper()}]"]
                        at = b
                    texts.append("".join([*out, t[at:]]) if spans else t)
            arrays = [batch.column(0), pa.array(pieces, pa.list_(pa.struct([("kind", pa.string()), ("found", pa.string())])))]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(texts, pa.string())] if replaced else []), names=[key, "pieces"] + ([text] if replaced else []))

    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, pieces array<struct<kind:string,found:string>>" + (f", `{text}` string" if replaced else "")
    return in_batches(documents.select(key, text), run, schema)

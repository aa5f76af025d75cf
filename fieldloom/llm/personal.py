"""Personal data in free text: found by a skip-chain conditional random field, replaced by typed placeholders.

Units of a text (what is written like an e-mail address, a street address or a long
number, and every capitalised word) are the nodes of a random field with the labels
none, name, e-mail, phone, identity number, street address. Node potentials are
log-linear in spelling, shape, context and corpus statistics. Neighbours share chain
potentials; repeated or alike words of a text, however far apart, share skip
potentials. Loopy message passing over whole texts settles the labels, so that one
clear mention decides the unclear ones.

No labels are given, so training bootstraps: contexts that name their content ("Mrs",
"passport", "phone") label a bounded sample (``SAMPLE_DOCS`` whole texts), with
contexts dropped from half of the training rows so that spelling alone is learned too;
a second round adds what the first is sure of. The last round trains node and edge
potentials together, by the pseudo-likelihood of the field.

E-mail and street addresses are proposed by one pattern each, which is wide; the field
can only refuse them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.words import DIGIT, EDGE, LETTER, LINE, SIGN, TABLES, Texts, word_hash
from fieldloom.runtime import stage

#: Texts that the field is trained on.
SAMPLE_DOCS = 4_000
LABELS = ("none", "person_name", "email", "phone", "identity_number", "street_address")
NONE, NAME, MAIL, PHONE, IDENTITY, ADDRESS = range(6)
HASHES = 1 << 18
ROUNDS = 6
#: Share of all words that small spellings of a word must reach to be counted: at most 1 / WORD_SHARE words are.
WORD_SHARE = 1.5e-5
#: Share of small spellings from which a word is a common one.
COMMON = 0.3
#: Log prior for what is spelled like an e-mail or street address.
SPELLED = 3.0
#: Largest edge potential.
BOUND = 2.0
#: Texts of a batch of message passing.
TEXTS = 400
#: Widespread given names of several languages: a feature, and a hint in training. Words that are more than names are left out.
GIVEN = frozenset(
    """alexander alice amelie andrea andreas andrew anna anne antoine antonio barbara beatriz bernard brigitte camille carlos carmen caroline catherine
    charlotte chloe christina christine christoph claire claudia daniel david diego dimitri dorothy elena elisabeth elizabeth emily emma eric eva fatima
    fernando francisco françois frank friedrich gabriel george georg giulia giuseppe hannah hans heinrich helen helena henri hugo ibrahim igor ingrid
    isabel ivan jacques james jan javier jean jennifer jessica joachim johann johannes john jorge josé joseph juan julia julie jürgen karen karin karl
    katharina laura lena léa louis louise lucas lucía luis luisa manuel margaret maria maría marie marta martha martin mary matthias michael michel miguel
    mohammed monika natalia nathalie nicolas nicole nikolai nina olga oliver oscar pablo patricia patrick paul pedro peter petra philipp philippe pierre
    pilar rachel raúl rebecca renate richard robert rosa sabine sandra sarah sergei simon sofia sophie stefan stephanie stephen susan susanne svetlana
    tatiana teresa theresa thomas ursula valentina véronique viktor vladimir walter werner william wolfgang yuki αλέξανδρος γιώργος ελένη κώστας μαρία
    νίκος анна иван мария ольга сергей""".split()
)

_UP = "A-ZÀ-ÖØ-ÞŁŚŠŽČĆĐŐŰ"
_TOWN = rf"[{_UP}][\w'’-]+(?: [{_UP}][\w'’-]+)?"
_AT = r"(?:@|\(at\)|\[at\])"
_DOT = r"(?:\.|\(dot\)|\[dot\])"
EMAIL = rf"[\w.+%-]*\w ?{_AT} ?[a-z0-9-]+(?: ?{_DOT} ?[a-z0-9-]+)* ?{_DOT} ?[a-z]{{2,}}\b|\b[\w.+-]+ at [a-z0-9-]+(?: dot [a-z0-9-]+)* dot [a-z]{{2,}}\b"
_EN = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Boulevard|Blvd|Close|Terrace|Drive|Court|Way|Place|Square|Crescent|Row|Hill)"
_FR = r"(?:rue|avenue|allée|chemin|quai|place|boulevard|impasse|route|cours|square|Rue|Avenue|Allée|Chemin|Quai|Place|Boulevard|Impasse)"
_PART = r"(?:de la |de l['’]|des |du |de |d['’]|del |de los |de las )?"
_POST = r"(?:,? (?:[A-Z]{1,2}\d[\dA-Z]?(?: \d[A-Z]{2})?|[A-Z]{2} \d{5}(?:-\d{4})?)\b)?"
_CITY = rf"(?:,? (?:\d{{4,5}} {_TOWN}|{_TOWN} \d{{4,5}}\b|{_TOWN}))"
STREET = (
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit) \d+\w?, )?\b\d+[A-Za-z]?,? (?:[{_UP}][\w.'’]+ ){{1,3}}{_EN}\b\.?(?:,[ \n](?:Apt|Flat|Unit)\.? ?\d+\w?)?(?:, {_TOWN}(?: \d{{4,5}}\b)?{_POST}|,?\n{_TOWN} \d{{4,5}}\b)?"
    rf"|\b(?:P\. ?O\. ?Box|PO Box|Box|Postfach|Apartado|B\.P\.) \d+(?:, {_TOWN}(?: \d{{4,5}}\b)?|, \d{{4,5}} {_TOWN})?"
    rf"|\b\d+(?: ?bis| ?ter)?,? {_FR} {_PART}[{_UP}][\w'’-]*(?: [{_UP}][\w'’-]*)?(?:, \d{{4,5}} {_TOWN})?"
    rf"|\b(?:Calle|Avda\.?|Avenida|Plaza|Paseo|Ronda|Camino|C/) ?{_PART}[{_UP}][\w'’-]*(?: [{_UP}][\w'’-]*)?,? \d+(?:, (?:\d+º ?\w|bajo|ático))?(?:, \d{{4,5}} {_TOWN})?"
    rf"|\b(?:(?:Am|An der|An den|Im|Zum|Zur|Auf dem|Auf der|In der|Unter den) (?:[{_UP}]\w+ ?){{1,2}}|[{_UP}]\w*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm)) ?\d+(?: ?[a-z])?\b(?:, \d{{4,5}} {_TOWN})?"
)
NUMBER = r"(?<![\w.@/+-])(?:(?!(?:SSN|NHS|DNI|NIF|TIN|NIN|ID|NO|NR|TEL|FAX)[- ])[A-Z]{1,4}[- ]?(?=\d))?\(?\+?\(?\d+\)?(?:[ ./-]?\(?\d+\)?)*(?:[- ]?[A-Z]\b)?(?: ext\.? ?\d+)?(?![\w@])"
_NUMBER = re.compile(NUMBER)
_STREET = re.compile(STREET)
#: What a text must hold for the slower patterns to be tried.
_DIGIT = re.compile(r"\d")
_NUMBER_SIGN = re.compile(r"\d(?:[ ./()+-]{0,3}(?: ext\.? ?)?\d){5}")
#: Words beside which a street address can stand, and endings of German ones.
_STREET_WORDS = tuple(re.findall(r"[\w.]+", "Street St Road Rd Lane Ln Avenue Ave Boulevard Blvd Close Terrace Drive Court Way Place Square Crescent Row Hill rue avenue allée chemin quai place boulevard impasse route cours square Rue Allée Chemin Quai Impasse Box Postfach Apartado B Calle Avda Avenida Plaza Paseo Ronda Camino C Am An Im Zum Zur Auf In Unter"))
_STREET_ENDS = ("straße", "strasse", "str", "weg", "gasse", "platz", "allee", "ring", "ufer", "damm", "strasze")
#: Characters that are read around a sign of a street, mail address or number: more than one takes.
_REACH = 140
_EXTENSION = ("ext", "extension", "durchwahl", "poste", "extensión", "anexo")
_PARTICLES = ("van", "der", "den", "von", "de", "la", "los", "del", "di", "da", "dos", "le", "ter", "zu")
_MAIL = re.compile(EMAIL, re.I)
_MAIL_SIGN = re.compile(r"@|[(\[]at[)\]]| dot ", re.I)
#: Forms of address. M. is left out: it is an initial far oftener.
_TITLES = frozenset("dr prof mr mrs ms miss frau herr herrn mme mlle sra sr srta don doña".split())
_PARTICLE = r"(?:van der|van den|van|von der|von|de la|de los|del|de|di|da|dos|la|le|ter|zu)"
_GAP = re.compile(rf" (?:[{_UP}]\. ?)*(?:{_PARTICLE} )*|-|’|'")
_COMMA = re.compile(rf", (?:[{_UP}]\. )?(?:{_PARTICLE} )?")
_LEFT = re.compile(rf"(?:(?<![\w.])(?:[{_UP}]\.[ -]?)+)?(?:(?<!\w)(?:{_PARTICLE} )+)?$")
_NAME_CUE = re.compile(r"(?:\b(?:participant|interviewer|reviewer|patient|my doctor|teilnehmerin|teilnehmer|participante|paciente|entrevistadora?|joindre|contact person|raised by|assigned to|please contact|contacte a|an|durch)|:\s*reviewer)[: ]+$", re.I)
_SIGN_OFF = re.compile(r"(?:regards|wishes|thanks|cordialement|grüße|saludos|sincerely)[,!.]?\s*\n\s*$", re.I)
_ID_CUE = re.compile(r"(?:national id|passport(?: no\.?)?|insurance (?:no\.?|number)|patient record|tax (?:id|no\.?|number)|versichertennummer|steuernummer|numéro d['’]assuré|documento|dni|ssn|nhs number)[: ]*$", re.I)
_PHONE_CUE = re.compile(r"(?:phone|tel\.?|call|mobile|fax|extension is|number is now|confirm with|unter|under|rufen|\bau|teléfono[^\n]{0,60}:)[: ]*$", re.I)
_OTHER_CUE = re.compile(r"(?:barcode|code|codes|version|grant|field id|section|factor|cluster|line|kandidat|element|wave|release|versión|erschien am|date du|publicó el|released on|row|batch|lot|sample|tube)[: ]*$", re.I)
_DATE = re.compile(r"9999-99-99|9{1,2}[./]9{1,2}[./]9{4}")


KINDS = "manw"
#: Context features, then those of the unit itself, the first of which is its identity.
AROUND, OWN = 11, 13
def _hashes(words) -> np.ndarray:
    return np.sort(np.array([word_hash(w) for w in words], np.uint64))


def _in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


_H = {"titles": _hashes(_TITLES), "particles": _hashes(_PARTICLES), "Streets": _hashes(w for w in _STREET_WORDS if w[0].isupper()), "streets": _hashes(w for w in _STREET_WORDS if w[0].islower()), "extension": _hashes(_EXTENSION), "given": _hashes(GIVEN)}
_DOT_, _COMMA_, _DASH, _STOPS = np.uint64(word_hash(".")), np.uint64(word_hash(",")), np.uint64(word_hash("-")), _hashes(".?!")


def _feature(template: int, *h: np.ndarray) -> np.ndarray:
    """Places in the weights, from a template and one or two hashes."""
    x = np.full_like(np.asarray(h[0], np.uint64), np.uint64(template * 2654435761 + 12345))
    for y in h:
        x = (x ^ np.asarray(y, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return (x >> np.uint64(64 - 18)).astype(np.int32)


@dataclass
class Units:
    """Nodes of some texts: doc, place in the joined text, kind (place in KINDS), label where a context tells it (-1: it doesn't)."""

    texts: Texts
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    word: np.ndarray  # hash of the small spelling
    feats: np.ndarray  # AROUND + OWN places in the weights; HASHES for none
    weak: np.ndarray
    edges: np.ndarray  # node, node, type: 0 tight, 1 comma, 2 repeated, 3 alike

    def text(self, i: int) -> str:
        return self.texts.text[self.start[i] : self.end[i]]


def _mask(s: str) -> str:
    return re.sub("[A-Z]", "A", re.sub(r"\d", "9", re.sub(r" ext\.? ?\d+", " ext", s)))


def _mails(text: str) -> list[tuple[int, int, int]]:
    found, last = [], 0
    for m in _MAIL_SIGN.finditer(text):
        if m.start() >= last and (k := _MAIL.search(text, max(last, m.start() - _REACH), m.end() + _REACH)) and k.start() < m.start() < k.end():
            found.append((*k.span(), 0))
            last = k.end()
    return found


def _spans(t: Texts) -> list[tuple[int, int, int]]:
    """What is written like a mail address, a street address or a long number; earlier kinds win where two overlap."""
    text, mails, streets, numbers = t.text, _mails(t.text), [], []
    signs = np.where(t.big, _in(t.hash, _H["Streets"]), _in(t.hash, _H["streets"]))
    ends = np.nonzero(t.big & (t.end - t.start > 4) & ~signs & (t.kind == LETTER))[0]
    for end in _STREET_ENDS:
        signs[ends] |= (t.end[ends] - t.start[ends] > len(end)) & (t.span(t.end[ends] - len(end), t.end[ends]) == np.uint64(word_hash(end)))
    digit = np.concatenate([[0], np.cumsum(t.kind == DIGIT)])
    at = np.nonzero(signs)[0]
    near = digit[np.minimum(at + 16, len(t.start))] > digit[np.maximum(at - 12, 0)]
    last = 0
    for a in t.start[at[near]].tolist():
        if a < last:
            continue
        for m in _STREET.finditer(text, max(last, a - _REACH), a + _REACH):
            if m.start() > a:
                break
            if m.end() > a:
                streets.append((*m.span(), 1))
                last = m.end()
    last = 0
    for sign in _NUMBER_SIGN.finditer(text):
        if sign.start() < last:
            continue
        for m in _NUMBER.finditer(text, max(last, sign.start() - 12), sign.end() + _REACH):
            if m.start() > sign.end():
                break
            n, (s, e) = m[0], m.span()
            last = e
            if not 6 <= sum(map(str.isdigit, n)) <= 20:
                continue
            if n[0].isdigit() or n[0] in "(+":  # a letter behind a blank belongs to numbers that open with letters
                k = re.search(r" [A-Z]$", n)
                e -= len(k[0]) if k else 0
            numbers.append((s, e, 2))
    # A short number is a phone's extension.
    for i in np.nonzero(_in(t.hash, _H["extension"]))[0]:
        for j in range(i + 1, min(i + 3, len(t.start))):
            s, e = int(t.start[j]), int(t.end[j])
            if t.kind[j] == DIGIT and 3 <= e - s < 6 and (j == i + 1 or t.hash[j - 1] == _DOT_) and not text[s - 1] == "_" and not re.match(r"[\w@]|[.-]\w", text[e : e + 2]):
                numbers.append((s, e, 2))
    out: list[tuple[int, int, int]] = []
    for part in (mails, streets, sorted(numbers)):
        taken = np.array([(s, e) for s, e, _ in out], np.int64).reshape(-1, 2)
        for s, e, k in part:
            at = int(np.searchsorted(taken[:, 1], s, "right"))
            if at == len(taken) or taken[at, 0] >= e:
                out.append((s, e, k))
        out.sort()
    return out


def units(texts: list[str | None], lower: tuple[np.ndarray, np.ndarray], learn: bool = False) -> Units:
    """Nodes, features and edges of ``texts``. ``lower`` gives the share of small spellings of words (sorted hashes, shares): a feature, whatever it is."""
    t = Texts(texts)
    spans = _spans(t)
    sp = np.array(spans, np.int64).reshape(-1, 3)
    # Words: capitalised, of two letters or more, not part of an address or of a code.
    w = np.nonzero((t.kind == LETTER) & t.big & (t.end - t.start > 1))[0]
    before, behind = t.code[t.start[w] - 1], t.code[t.end[w]]
    kinds = TABLES[0][0]
    keep = (kinds[before] != DIGIT) & (kinds[behind] != DIGIT) & ~np.isin(before, [64, 46, 43, 45, 95]) & ~np.isin(behind, [64, 95]) & ~_in(t.hash[w], _H["titles"])
    if len(sp):
        at = np.minimum(np.searchsorted(sp[:, 1], t.start[w], "right"), len(sp) - 1)
        keep &= ~((sp[at, 0] < t.end[w]) & (sp[at, 1] > t.start[w]))
    w = w[keep]
    start, end = np.concatenate([sp[:, 0], t.start[w]]), np.concatenate([sp[:, 1], t.end[w]])
    kind = np.concatenate([sp[:, 2], np.full(len(w), 3)])
    i = np.concatenate([np.searchsorted(t.start, sp[:, 0]), w])
    j = np.concatenate([np.searchsorted(t.start, sp[:, 1]), w + 1])
    by = np.argsort(start, kind="stable")
    start, end, kind, i, j = start[by], end[by], kind[by], i[by], j[by]
    n, word = len(start), kind == 3
    # Initials and particles belong to a name: what stands before them is its context.
    particle = _in(t.hash, _H["particles"]) & ~t.big
    single = t.big & (t.end - t.start == 1) & (t.kind == LETTER)
    b, lead = i - 1, np.zeros(n, np.int64)
    for _ in range(6):
        back = np.where(word & particle[b], 1, np.where(word & (t.hash[b] == _DOT_) & single[np.maximum(b - 1, 0)], 2, 0))
        if not back.any():
            break
        b, lead = b - back, lead + (back > 0)
    edge = t.kind == EDGE
    p1 = t.hash[b]
    p2 = np.where(edge[b], p1, t.hash[np.maximum(b - 1, 0)])
    n1 = t.hash[j]
    n2 = np.where(edge[j], n1, t.hash[np.minimum(j + 1, len(t.hash) - 1)])
    dotted = (p1 == _DOT_) & _in(p2, _H["titles"])
    titled = word & (dotted | (_in(p1, _H["titles"]) & (t.kind[b] == LETTER)))
    p1 = np.where(dotted, p2 ^ np.uint64(0x5555), p1)
    opens = edge[b] | (t.kind[b] == LINE) | ((t.hash[b] == _DASH) & ~(t.kind[np.maximum(b - 1, 0)] <= SIGN))
    closes = edge[j] | (t.kind[j] == LINE)
    blank = t.code[np.minimum(end, len(t.code) - 1)] == 32
    flags = [titled, opens, closes, opens | _in(t.hash[b], _STOPS), t.big[j] & blank & (t.kind[j] == LETTER), lead > 0]
    h = t.span(start, end)
    doc = t.doc(start)
    length = np.minimum(end - start, 12)
    mailed = np.zeros(n, bool)
    mails = {}
    for k in np.nonzero(kind == 0)[0]:
        mails.setdefault(int(doc[k]), []).append(re.split(r" ?(?:@|[(\[]at)| at ", t.text[start[k] : end[k]])[0].lower())
    if mails:
        for k in np.nonzero(word & np.isin(doc, list(mails)) & (end - start > 3))[0]:
            local = "\n".join(mails[int(doc[k])])
            mailed[k] = any(x in local for x in re.split("[-'’]", t.text[start[k] : end[k]].lower()) if len(x) > 3)
    capitals, joins = t.capitals[end] - t.capitals[start], t.joins[end] - t.joins[start]
    shape = np.where(capitals == end - start - joins, 1, np.where(capitals == 1, 0, np.where(capitals == 1 + joins, 2, 3)))
    known, share = lower
    at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    small = np.where(known[at] == h, share[at], 0.0) if len(known) else np.zeros(n)
    given = _in(h, _H["given"])
    feats = np.full((n, AROUND + OWN), HASHES, np.int32)
    k = kind.astype(np.uint64)
    feats[:, 0], feats[:, 1], feats[:, 2], feats[:, 3] = _feature(1, p1, k), _feature(2, p1, p2 ^ k), _feature(3, n1, k), _feature(4, n1, n2 ^ k)
    for f, x in enumerate([*flags, opens + 2 * closes]):
        feats[word, 4 + f] = _feature(10 + f, x[word].astype(np.uint64))
    own = [h, t.span(start, np.minimum(start + 3, end)), t.span(start, np.minimum(start + 4, end)), t.span(np.maximum(end - 3, start), end), t.span(np.maximum(end - 4, start), end), t.span(np.maximum(end - 2, start), end)]
    own += [x.astype(np.uint64) for x in (shape, mailed, small > 0.02, small > COMMON, length, given)]
    for f, x in enumerate(own):
        feats[word, AROUND + f] = _feature(20 + f, x[word])
    feats[:, AROUND + OWN - 1] = _feature(40, k)
    numbers = np.nonzero(kind == 2)[0]
    if len(numbers):
        written = [t.text[start[x] : end[x]] for x in numbers]
        own = np.array([[word_hash(z) for z in (m, re.sub("[^9A]", "", m), m[:3], str(m.count("9")), w2[:2])] for w2, m in zip(written, map(_mask, written), strict=True)], np.uint64)
        for f in range(5):
            feats[numbers, AROUND + f] = _feature(50 + f, own[:, f])
    # Edges: neighbours over blanks, initials and particles, or over a comma; then repeated and alike words of a text.
    parts = []
    token = np.where(word, i, -9)
    follows = np.nonzero(word[1:] & word[:-1])[0]
    tight, comma = b[follows + 1] == token[follows], (t.hash[b[follows + 1]] == _COMMA_) & (b[follows + 1] - 1 == token[follows])
    for kind_, m in ((0, tight), (1, comma)):
        parts.append(np.column_stack([follows[m], follows[m] + 1, np.full(m.sum(), kind_)]))
    skip = np.nonzero(kind >= 2)[0]
    o = skip[np.lexsort((skip, h[skip], kind[skip], doc[skip]))]
    same = (h[o][1:] == h[o][:-1]) & (doc[o][1:] == doc[o][:-1]) & (kind[o][1:] == kind[o][:-1])
    parts.append(np.column_stack([o[:-1][same], o[1:][same], np.full(same.sum(), 2)]))
    new = np.concatenate([[True], ~same])[: len(o)]
    f = o[new]
    f = f[word[f] & (end[f] - start[f] > 5)]
    stem = t.span(start[f], np.minimum(start[f] + 6, end[f]))
    o = np.lexsort((f, stem, doc[f]))
    alike = (stem[o][1:] == stem[o][:-1]) & (doc[f[o]][1:] == doc[f[o]][:-1])
    parts.append(np.column_stack([f[o][:-1][alike], f[o][1:][alike], np.full(alike.sum(), 3)]))
    u = Units(t, doc, start, end, kind, h, feats, np.full(n, -1), np.concatenate(parts).astype(np.int64))
    if learn:
        for x in range(n):
            u.weak[x] = _weak(t.text, int(start[x]), int(t.start[b[x] + 1]), "manw"[kind[x]], u.text(x), bool(titled[x]), bool(mailed[x]), float(small[x]), bool(given[x]))
    return u


def _weak(text: str, s: int, lead: int, kind: str, t: str, titled: bool, mailed: bool, small: float, given: bool) -> int:
    """The label that a context tells, for training; -1 where it tells none."""
    if kind in "ma":
        return MAIL if kind == "m" else ADDRESS
    before = text[max(0, (lead if kind == "w" else s) - 56) : lead if kind == "w" else s].rsplit("\0", 1)[-1]
    if kind == "n":
        if _DATE.fullmatch(_mask(t)) or _OTHER_CUE.search(before):
            return NONE
        if _ID_CUE.search(before):
            return IDENTITY
        return PHONE if _PHONE_CUE.search(before) else -1
    mixed = bool(re.search("[^\\W\\d_][^\\W\\d_a-zà-ÿ'’-]", t)) and not t.isupper()
    cued = bool(_NAME_CUE.search(before) or _SIGN_OFF.search(before))
    if small > COMMON:  # cues stand before common words too; a form of address doesn't
        return NAME if titled else -1 if cued else NONE
    if titled or cued or (mailed and not mixed):
        return NONE if mixed else NAME
    if mixed or re.search(r"(?i)(?:^|\W)(?:the|das|le|el|la|dem|der|element|kandidat)\W*$", before):
        return NONE
    return NAME if given else -1


@dataclass
class Field:
    weights: np.ndarray  # feature by label; the last row, of no feature, is zero
    pair: np.ndarray  # edge type by label by label, log potentials
    lower: tuple[np.ndarray, np.ndarray]  # sorted word hashes, shares of small spellings

    def save(self, spark, path: str) -> None:
        """Write the field as a one-row table."""
        row = tuple(bytearray(np.ascontiguousarray(x).tobytes()) for x in (self.weights, self.pair, *self.lower))
        spark.createDataFrame([row], "weights binary, pair binary, words binary, shares binary").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> Field:
        r = [bytes(x) for x in spark.read.parquet(path).select("weights", "pair", "words", "shares").first()]
        n = len(LABELS)
        return Field(np.frombuffer(r[0], np.float32).reshape(-1, n), np.frombuffer(r[1]).reshape(4, n, n), (np.frombuffer(r[2], np.uint64), np.frombuffer(r[3])))


def scores(u: Units, weights: np.ndarray) -> np.ndarray:
    """Node potentials: one gather for all units."""
    out = np.empty((len(u.doc), len(LABELS)))
    for s in range(0, len(out), 4096):
        out[s : s + 4096] = weights[u.feats[s : s + 4096]].sum(axis=1)
    return _restrict(u.kind, out)


#: Labels a unit of a kind can have.
_ALLOWED = ((NONE, MAIL), (NONE, ADDRESS), (NONE, PHONE, IDENTITY), (NONE, NAME))
_PRIOR = np.full((4, len(LABELS)), -30.0)
for _k, _ls in enumerate(_ALLOWED):
    _PRIOR[_k, list(_ls)] = 0.0
_PRIOR[0, MAIL] = _PRIOR[1, ADDRESS] = SPELLED


def _restrict(kinds: np.ndarray, potentials: np.ndarray) -> np.ndarray:
    return potentials + _PRIOR[kinds]


def _softmax(s: np.ndarray) -> np.ndarray:
    s = np.exp(s - s.max(axis=1, keepdims=True))
    return s / s.sum(axis=1, keepdims=True)


def propagate(scores: np.ndarray, edges: list[tuple[int, int, int]] | np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Label probabilities after loopy message passing along all edges, both ways at once."""
    if not len(edges):
        return _softmax(scores)
    e = np.array(edges)
    src, dst, kind = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]]), np.concatenate([e[:, 2], e[:, 2]])
    n = len(e)
    pots = np.concatenate([pair[e[:, 2]], np.transpose(pair[e[:, 2]], (0, 2, 1))])
    back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    msg = np.zeros((2 * n, scores.shape[1]))
    for _ in range(ROUNDS):
        belief = scores.copy()
        np.add.at(belief, dst, msg)
        out = belief[src] - msg[back]
        new = out[:, :, None] + pots
        top = new.max(axis=1, keepdims=True)
        new = np.log(np.exp(new - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        msg = 0.5 * msg + 0.5 * new
    belief = scores.copy()
    np.add.at(belief, dst, msg)
    return _softmax(belief)


def settle(u: Units, scores: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The label of each unit. Words have two labels and share edges with words alone, so their messages are log odds."""
    best = scores.argmax(axis=1)
    e = u.edges
    if not len(e):
        return best
    word = u.kind == 3
    of_words = word[e[:, 0]]
    other = e[~of_words]
    if len(other):
        at = np.unique(other[:, :2])
        near = np.column_stack([np.searchsorted(at, other[:, :2]), other[:, 2]])
        best[at] = propagate(scores[at], near, pair).argmax(axis=1)
    e = e[of_words]
    if len(e):
        src, dst, kind = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]]), e[:, 2]
        n = len(e)
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        two = pair[:, [[NONE], [NAME]], [NONE, NAME]]
        pots = np.concatenate([two[kind], two[kind].transpose(0, 2, 1)])  # of source and target
        odds = scores[:, NAME] - scores[:, NONE]
        msg = np.zeros(2 * n)
        for _ in range(ROUNDS):
            out = (odds + np.bincount(dst, msg, len(odds)))[src] - msg[back]
            new = np.logaddexp(pots[:, 0, 1], out + pots[:, 1, 1]) - np.logaddexp(pots[:, 0, 0], out + pots[:, 1, 0])
            msg = 0.5 * msg + 0.5 * new
        best[word] = np.where((odds + np.bincount(dst, msg, len(odds)))[word] > 0, NAME, NONE)
    return best


def _fit(u: Units, labels: np.ndarray, rng: np.random.Generator, rounds: int = 4, start: np.ndarray | None = None, edges: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights by AdaGrad over rows with labels; half of the rows lose context or identity.

    With ``edges`` it is the pseudo-likelihood of the field: each label given those of
    its neighbours, so that edge potentials are trained with the node potentials.
    """
    n = len(LABELS)
    rows = np.nonzero(labels >= 0)[0]
    w = np.zeros((HASHES + 1, n), np.float32) if start is None else start
    g2 = np.full((HASHES + 1, n), 1e-2, np.float32)
    pair, p2 = np.zeros((4, n, n)), np.full((4, n, n), 1e-2)
    near = None
    if edges is not None and len(edges):
        both = np.concatenate([edges, edges[:, [1, 0, 2]]])
        side = np.repeat([0, 1], len(edges))
        keep = (labels[both[:, 1]] >= 0) & (labels[both[:, 0]] >= 0)
        both, side = both[keep], side[keep]
        by = np.argsort(both[:, 0], kind="stable")
        both, side = both[by], side[by]
        near = np.searchsorted(both[:, 0], np.arange(len(labels) + 1))
    for _ in range(rounds):
        rng.shuffle(rows)
        for s in range(0, len(rows), 256):
            part = rows[s : s + 256]
            drop = rng.random(len(part))
            used = u.feats[part].astype(np.int64)
            used[drop < 0.35, :AROUND] = HASHES
            used[(drop >= 0.35) & (drop < 0.6), AROUND] = HASHES
            if near is not None:  # some keep their kind alone, so that edges are learned too
                used[drop > 0.8, :-1] = HASHES
            score = w[used].sum(axis=1).astype(np.float64)
            if near is not None:
                count = near[part + 1] - near[part]
                where = np.repeat(np.arange(len(part)), count)
                e = np.repeat(near[part] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                kind, other, right = both[e, 2], labels[both[e, 1]], side[e] == 1
                np.add.at(score, where, np.where(right[:, None], pair[kind, other], pair[kind, :, other]))
            p = _softmax(_restrict(u.kind[part], score))
            p[np.arange(len(part)), labels[part]] -= 1.0
            flat, back = np.unique(used.ravel(), return_inverse=True)
            of = np.repeat(np.arange(len(part)), used.shape[1])
            step = np.empty((len(flat), n))
            square = np.empty((len(flat), n))
            for k in range(n):
                step[:, k] = np.bincount(back, p[of, k], len(flat))
                square[:, k] = np.bincount(back, p[of, k] ** 2, len(flat))
            g2[flat] += square
            w[flat] -= 0.15 * step / np.sqrt(g2[flat])
            w[HASHES] = 0
            if near is not None and len(e):
                g = np.zeros_like(pair)
                np.add.at(g, (kind[right], other[right]), p[where[right]])
                np.add.at(g.transpose(0, 2, 1), (kind[~right], other[~right]), p[where[~right]])
                g[2:] = (g[2:] + g[2:].transpose(0, 2, 1)) / 2  # repeated and alike words have no first and second
                p2 += g * g
                pair = np.clip(pair - 0.05 * g / np.sqrt(p2), -BOUND, BOUND)
    return w, pair


def small_words(documents: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, shares): the share of small spellings of each word that is written both ways, over all texts without their e-mail addresses.

    Only for words whose small spellings are ``WORD_SHARE`` of all words, so that the
    size of the corpus changes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        total = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, back = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return h, *(np.bincount(back, np.concatenate([x[k] for x in held]), len(h)).astype(np.int64) for k in (1, 2))

        for batch in batches:
            for s in range(0, batch.num_rows, TEXTS):
                t = Texts(batch.column(0).slice(s, TEXTS).to_pylist())
                size = t.end - t.start
                use = (t.kind == LETTER) & (size > 1) & (size < 25)
                spans = np.array(_mails(t.text), np.int64).reshape(-1, 3)
                if len(spans):
                    at = np.minimum(np.searchsorted(spans[:, 1], t.start, "right"), len(spans) - 1)
                    use &= ~((spans[at, 0] < t.end) & (spans[at, 1] > t.start))
                h, back = np.unique(t.hash[use], return_inverse=True)
                big = np.bincount(back, t.big[use], len(h)).astype(np.int64)
                n = np.bincount(back, minlength=len(h))
                held.append((h, n - big, big))
                total += int(use.sum())
                if len(held) > 50:
                    held[:] = [merged()]
        if held:
            h, small, big = merged()
            # Hash 0 holds the number of all words.
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[0], h.view(np.int64)])), pa.array(np.concatenate([[total], small])), pa.array(np.concatenate([[0], big]))], names=["w", "s", "b"])

    both = stage(documents.select(text).mapInArrow(run, "w long, s long, b long").groupBy("w").agg(F.sum("s").alias("s"), F.sum("b").alias("b")), "words")
    total = both.where("w = 0").agg(F.sum("s")).first()[0] or 0
    often = both.where("w <> 0").where(F.col("s") >= WORD_SHARE * total).where("b > 0 and s > 0.02 * b").toArrow()
    h, small, big = (often.column(c).to_numpy() for c in ("w", "s", "b"))
    by = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[by], (small / np.maximum(small + big, 1))[by]


def train(documents: DataFrame, key: str = "doc_id", text: str = "text") -> Field:
    lower = small_words(documents, text)
    base = documents.select(F.xxhash64(F.col(key)).alias("h"), F.col(text).alias("text")).where("text is not null and text <> ''")
    rows = base.count()
    share = F.pmod("h", F.lit(1 << 32)) < F.lit(int((1 << 32) * min(1.0, SAMPLE_DOCS / max(rows, 1))))
    picked = (base.where(share) if rows > SAMPLE_DOCS else base).toArrow()
    order = np.argsort(picked.column("h").to_numpy(), kind="stable")
    texts = [picked.column("text")[int(i)].as_py() for i in order]
    rng = np.random.default_rng(5)
    u = units(texts, lower, learn=True)
    if not len(u.doc):
        return Field(np.zeros((HASHES + 1, len(LABELS)), np.float32), np.zeros((4, len(LABELS), len(LABELS))), lower)
    labels, word = u.weak.copy(), u.kind == 3
    # Reliable non-names: common words that no context calls a name, and what stands before one of them.
    seen, n = np.unique(u.word[word], return_counts=True)
    common = seen[(n >= max(6, len(texts) // 200)) & ~np.isin(seen, u.word[word & (u.weak == NAME)])]
    usual = word & _in(u.word, common)
    tight = u.edges[u.edges[:, 2] == 0]
    usual[tight[usual[tight[:, 1]], 0]] = True
    labels[usual & word & (labels < 0)] = NONE
    # A name cue also holds for what is tied to its word: Anna | Berg.
    for a, b in tight[:, :2]:
        if labels[a] == NAME and labels[b] < 0:
            labels[b] = NAME
    w, _ = _fit(u, labels, rng)
    p = _softmax(scores(u, w))
    second, best, sure = labels.copy(), p.argmax(axis=1), p.max(axis=1)
    fresh_ = (labels < 0) & (sure > 0.8)
    second[fresh_] = best[fresh_]
    w, _ = _fit(u, second, rng)
    full = np.where(labels >= 0, labels, scores(u, w).argmax(axis=1))
    w, pair = _fit(u, full, rng, 4, None, u.edges)
    return Field(w, pair, lower)


def mentions(texts: list[str | None], field: Field) -> list[tuple[int, int, int, int]]:
    """(doc, label, start, end) of every mention, from 0, ends excluded."""
    u = units(texts, field.lower)
    if not len(u.doc):
        return []
    label = settle(u, scores(u, field.weights), field.pair)
    hit = np.nonzero(label != NONE)[0]
    text, base = u.texts.text, u.texts.edge + 1
    tied = {b: (a, t) for a, b, t in u.edges[(u.edges[:, 2] < 2) & (label[u.edges[:, 0]] == NAME) & (label[u.edges[:, 1]] == NAME)].tolist()}
    onward = {a: b for b, (a, _) in tied.items()}
    out: list[tuple[int, int, int, int]] = []
    group: list[int] = []
    start, end, doc, kinds = u.start.tolist(), u.end.tolist(), u.doc.tolist(), label.tolist()

    def close() -> None:
        if not group:
            return
        s, e, d = start[group[0]], end[group[-1]], doc[group[0]]
        left = _LEFT.search(text[max(int(base[d]), s - 30) : s])
        if left and left[0]:
            lead = re.sub(rf"^(?:{'|'.join(x.capitalize() for x in sorted(_TITLES))})\.? ", "", left[0])
            s -= len(lead)
        out.append((d, NAME, s - int(base[d]), e - int(base[d])))
        group.clear()

    for i in hit.tolist():
        if kinds[i] == NAME:
            a, t = tied.get(i, (-1, -1))
            if not (group and group[-1] == a and (t == 0 or (len(group) == 1 and not (i in onward and tied[onward[i]][1] >= 0 and " " in text[start[a] : end[a]])))):
                close()
            group.append(i)
        else:
            close()
            b = int(base[doc[i]])
            out.append((doc[i], kinds[i], start[i] - b, end[i] - b))
    close()
    return out


def find(documents: DataFrame, key: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """(id, pii_type, start_at, end_at): every mention; places count characters from 1, both ends included.

    Null and empty texts hold none. Repeated texts and ids each give their own rows.
    Every text is read whole, however long.
    """
    field = field or train(documents, key, text)
    shared = documents.sparkSession.sparkContext.broadcast(field)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, TEXTS):
                part = batch.slice(s, TEXTS)
                found = mentions(part.column(1).to_pylist(), shared.value)
                if found:
                    d, l, a, e = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array([LABELS[x] for x in l]), pa.array([x + 1 for x in a], pa.int32()), pa.array(e, pa.int32())], names=["id", "pii_type", "start_at", "end_at"])

    return documents.select(key, text).mapInArrow(run, f"id {kind}, pii_type string, start_at int, end_at int")


def redact(documents: DataFrame, key: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """``documents`` with ``text`` in which every mention is replaced by its type in brackets, as [PHONE]."""
    field = field or train(documents, key, text)
    shared = documents.sparkSession.sparkContext.broadcast(field)
    at = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            cut: dict[int, list[tuple[int, int, str]]] = {}
            found = [(first + d, *m) for first in range(0, len(texts), TEXTS) for d, *m in mentions(texts[first : first + TEXTS], shared.value)]
            for d, l, s, e in found:
                cut.setdefault(d, []).append((s, e, f"[{LABELS[l].upper()}]"))
            for d, spans in cut.items():
                out, last = [], 0
                for s, e, name in sorted(spans):
                    if s >= last:
                        out += [texts[d][last:s], name]
                        last = e
                texts[d] = "".join([*out, texts[d][last:]])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return documents.mapInArrow(run, documents.schema)

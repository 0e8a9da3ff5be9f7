"""Problem 1: personal information in free text by a skip-chain conditional random field.

*Shapes.* Number groups, address shapes of several reaches, (disguised) e-mail
shapes and words beside given names or initials mark the stretches of a text on
which the field is run; elsewhere no feature of a kind is present.  Shapes are
wide - any word beside a given name, any town beside a street - and only features:
spans are the field's own runs of labels.  Family names, towns and further given
names are told by lexicons that the corpus itself gives (words that follow known
given names or initials, words beside postcodes), counted over all rows and looked
up by a join, so that they need no bound.
*Field.* Labels B/I of each kind and O; features of the token, its shapes and
their captions; a linear chain, trained by maximum likelihood on sentences put
together from parts in four languages, sound and misleading ones, with names of
the corpus' lexicons and invented ones.
*Skip edges.* Mentions of the same or a similar word (without accents), and of the
same digits however grouped, share a potential that favours the same kind; loopy
message passing alternates between chains and skip edges until no label of the
document changes, ``ROUNDS`` times at most.

Spans refer to the text after NFKC normalisation and removal of format
characters, and are mapped back for redaction, which leaves all else as it is.
Null and blank texts have no items and stay as they are.  An item named twice in
a text is listed once; rows delivered again count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallframe.llm.words import FORMAT, WORD
from recallframe.session import cut, spread, written

KINDS = ("email", "phone", "id_number", "address", "name")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
HASHED, SENTENCES, SEED, SKIP, SKIP_DIGITS, ROUNDS = 1 << 14, 3_000, 11, 4.0, 400.0, 10
#: Share of all texts in which a word must occur to be common; names of the lexicons that training sentences take.
COMMON_SHARE, TAUGHT = 1 / 4000, 2_000
JOINT, FORE = regex.compile(r"[-'’]"), regex.compile(r"^mc|^o['’]")
GAPS = {"space": regex.compile(r" {1,2}|\u00a0"), "dot": regex.compile(r"\. {0,2}| "), "comma": regex.compile(r", {0,2}")}

# ---------------------------------------------------------------- fixed values: words of the trade
STREET_EN = "road street avenue lane drive court walk row terrace close square crescent way hill gardens grove mews parade rise yard green".split()
STREET_DE = "straße strasse str. weg platz gasse allee ring damm ufer steig stieg graben markt hof".split()
STREET_ROMANCE = "rue avenue boulevard bd impasse chemin allée place quai route ruelle square cours passage calle avenida av. paseo plaza camino ronda carrera travesía c/".split()
PARTICLES = set("von van der de da di la del dos den zu ter ten du le el al bin ibn".split())
TITLES = set("dr mr mrs ms miss prof herr frau doktor doctor doctora señor señora sr sra don doña monsieur madame mme mlle docteur m".split())
ID_WORDS = set("sv passport passeport pasaporte reisepass reisepassnummer pass ausweis ausweisnummer personalausweis identity identité identidad id ssn nino ni nin social security sécu sécurité sociale seguridad dni nie nif nir cif tax steuer steuernummer national nationale sozialversicherungsnummer versicherungsnummer licence license führerschein".split())
OTHER_WORDS = set("order orders ticket tickets invoice isbn part parts build room ratio trace version v commit node ids seats total sheet step score bestellung rechnung commande facture pedido factura ping page phase case sku serial model batch token port lot".split())
PHONE_WORDS = set("phone tel tél telefon téléphone teléfono call ring text mobile mobil móvil fax voice contact number numéro número anrufen ruf appelle llámame reached emergency cell handy landline portable dial".split())
ADDRESS_WORDS = set("live lives live moved address anschrift wohne wohnt adresse dirección vivo habite ship deliver deliveries lieferung livrer entregar pickup home parcel rendez billing".split())
MAIL_WORDS = set("mail email e-mail correo courriel write schreiben escribe écris cc contact contacto kontakt login reached send".split())
NUMBER_WORDS = set("number numéro número nummer nr no num".split())
CAPTIONS = (("neg", OTHER_WORDS), ("id", ID_WORDS), ("phone", PHONE_WORDS), ("addr", ADDRESS_WORDS), ("mail", MAIL_WORDS), ("title", TITLES))
CAPTION_OF = {w: name for name, ws in reversed(CAPTIONS) for w in ws}

# ---------------------------------------------------------------- shapes of candidates
_LETTER, _L = r"\p{L}", r"[\p{L}'’]+"
_DOT = r"(?:\.|\s*[\(\[\{]\s*(?:dot|punkt|punto|point)\s*[\)\]\}]\s*|\s+(?:dot|punkt|punto|point)\s+)"
_SPELT_DOT = r"(?:\s+(?:dot|punkt|punto|point)\s+|\s*[\(\[\{]\s*(?:dot|punkt|punto|point)\s*[\)\]\}]\s*)"
_AT = r"(?:\s*@\s*|\s*[\(\[\{]\s*(?:at|arroba|arobase|ät)\s*[\)\]\}]\s*)"
_LOCAL = r"(?<![\p{L}\p{N}._+\-])[\p{L}\p{N}](?:[\p{L}\p{N}._+\-]*[\p{L}\p{N}])?"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?"
WORDS = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"\d")
EMAIL = regex.compile(rf"(?i){_LOCAL}(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})+|\s+(?:at|arroba|arobase)\s+{_LABEL}(?:{_SPELT_DOT}{_LABEL})+)")
HAS_AT = regex.compile(r"(?i)@|\bat\b|arroba|arobase")
NUMBER = re.compile(r"(?<![\w+.\-/#=])(?:\+\s?)?\(?\d(?:[ ]?[().\-/]?[ ]?\(?\d|\)[ ]?\d){6,17}(?![^\W_]|[.\-/]\d)")
CODED = re.compile(
    r"(?i)(?<![\w\-=/])(?:[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[A-Z]{1,2}\d{6,9}[A-Z]?|\d{8}[ -]?[A-Z]|\d\d[A-Z]{2}\d{5}|\d\d ?\d{6} ?[A-Z] ?\d{3}|[A-Z]\d[A-Z0-9]\d{6}|[A-Z]\d{2}[A-Z0-9]{6}\d?)(?![^\W_]|-\d)"
)
_POST = r"(?:\d{5}(?! ?\d)|[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}(?!\p{L}))"
_TOWN = rf"(?:{_LETTER}[\p{{L}}'’]+(?:-{_LETTER}+)*(?: {_LETTER}[\p{{L}}'’]+(?:-{_LETTER}+)*){{0,2}})"
_SEP = r"(?:,? *\r?\n *|, *| +)"
_FLAT = r"(?:(?:apt|flat|unit|apartment|suite|apto|piso|whg|wohnung)\.? *\d+[a-z]?)"
_DOOR = r"\d+ ?[ºªo]\.? ?[A-Z](?!\p{L})"
STREET = {
    "en": regex.compile(rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{_FLAT},? +)?\d{{1,4}}[a-z]?,? +(?:{_L} +){{1,3}}(?:{'|'.join(STREET_EN)})(?!\p{{L}})(?:,? +{_FLAT})?"),
    "de": regex.compile(
        rf"(?i)(?<![\p{{L}}\p{{N}}])(?:(?:(?:neue|alte|große|kleine|obere|untere|hintere|vordere|lange|kurze)[rns]? )?{_LETTER}+(?:{'|'.join(x.replace('.', '[.]') for x in STREET_DE)})|{_L} +(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|markt|hof)|(?:am|an der|im|zum|zur|auf dem|auf der|in der) +{_L}(?: +{_L})?) +\d{{1,4}} ?[a-z]?(?![\p{{L}}\p{{N}}:.\-/]\d)(?!\p{{L}})"
    ),
    "fr": regex.compile(rf"(?i)(?<![\p{{L}}\p{{N}}])\d{{1,4}}(?: (?:bis|ter))?,? +(?:rue|avenue|boulevard|bd|impasse|chemin|allée|place|quai|route|ruelle|square|cours|passage)(?!\p{{L}})(?: +(?:de la|de l['’]|des|du|de|d['’]|la|le|les))? *(?:{_L}(?:[ -]{_L}){{0,2}}?(?= *[,\n\r])|{_L}(?:-{_L})*)"),
    "es": regex.compile(rf"(?i)(?<![\p{{L}}\p{{N}}])(?:calle|avenida|av\.|paseo|plaza|camino|ronda|carrera|travesía|c/)(?: +(?:de la|de los|de las|del|de|la|el))? *{_L}(?: +{_L}){{0,2}},? +\d{{1,4}}(?:, *{_DOOR})?(?![\p{{N}}])"),
}
_ENGLISH, _ROMANCE = frozenset(STREET_EN), frozenset(STREET_ROMANCE)
_GERMAN = ("straße", "strasse", "weg", "platz", "gasse", "allee", "ring", "damm", "ufer", "steig", "stieg", "graben", "markt", "hof", "str")
_BY = re.compile(r"(?i)\b(?:am|an der|im|zum|zur|auf de[mr]|in der) +[^\W\d_]+(?: [^\W\d_]+)? +\d")


def street_languages(text: str) -> list[str]:
    """Languages in which the text may hold a street: it has a number and one of their words."""
    if not DIGITS.search(text):
        return []
    low = text.lower()
    words_ = set(WORDS.findall(low))
    romance = not words_.isdisjoint(_ROMANCE)
    german = any(w.endswith(_GERMAN) for w in words_) or _BY.search(text)
    return [k for k, has in (("en", not words_.isdisjoint(_ENGLISH)), ("de", german), ("fr", romance), ("es", romance or "c/" in low or "av." in low)) if has]


AFTER = {
    "en": regex.compile(rf"(?i){_SEP}(?P<town>{_TOWN})(?:,?{_SEP}(?P<post>{_POST}))?"),
    "other": regex.compile(rf"(?i){_SEP}(?:(?P<post>\d{{5}}) +)?(?P<town>{_TOWN})"),
}
POST_ONLY = regex.compile(rf"(?i){_SEP}(?P<post>{_POST})")
TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}]*|\p{N}+|[^\s\p{L}\p{N}]")
NAMEWORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
CAPITAL = re.compile(r"(?<![^\W\d_])(?<![^\W\d_]['’\-])(?=[^\W\d_])(?![a-zß-öø-ÿ])[^\W\d_]+(?:['’\-][^\W\d_]+)*")
INITIAL = re.compile(r"(?<![^\W\d_])[^\W\d_]\.")
SPELT = ("dot", "punkt", "punto", "point")


def may_mail(text: str) -> bool:
    return "@" in text or (any(w in text.lower() for w in SPELT) and bool(HAS_AT.search(text)))


LOG_LINE = regex.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ (?:[\w]+(?:=[\w.]+)?(?: |$))+")


def normalised(text: str) -> tuple[str, list[tuple[int, int]] | None]:
    """NFKC without format characters, and for each of its characters the span in ``text`` (None: the same)."""
    if text.isascii() or (unicodedata.is_normalized("NFKC", text) and not FORMAT.search(text)):
        return text, None
    out, at, i = [], [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and unicodedata.combining(text[j]):
            j += 1
        part = "".join(c for c in unicodedata.normalize("NFKC", text[i:j]) if unicodedata.category(c) != "Cf")
        out.append(part)
        at += [(i, j)] * len(part)
        i = j
    return "".join(out), at


class Lexicon:
    """What the corpus says of the words of some texts: given names, family names, towns; common words and name endings of all."""

    def __init__(self, given: set[str], common: set[str], family: dict[str, int], towns: dict[str, int], heads: set[str] | None = None, tails: set[str] | None = None):
        self.given, self.common, self.family, self.towns = given, common, family, towns
        self.heads, self.tails = affixes(family) if heads is None else (heads, tails)

    def family_sort(self, low: str) -> str:
        """k: seen as a family name, a: made like the ones seen, u: unknown, '' for common words and given names."""
        if self.family.get(low, 0) >= 2:
            return "k"
        if len(low) < 3 or low in self.common or low in self.given:
            return ""
        return "a" if len(low) > 3 and self.alike(low) else "u"

    def alike(self, low: str) -> bool:
        return all(p in self.family or (p[:3] in self.heads and p[-3:] in self.tails) for p in JOINT.split(FORE.sub("", low)) if p)


def affixes(family: dict[str, int]) -> tuple[set[str], set[str]]:
    """First and last letters that several family names share."""
    heads, tails = Counter(w[:3] for w in family), Counter(w[-3:] for w in family)
    return {h for h, c in heads.items() if c >= 3}, {t for t, c in tails.items() if c >= 3}


# ---------------------------------------------------------------- candidates
def _shape(text: str) -> str:
    return DIGITS.sub("9", WORDS.sub(lambda m: "a" * len(m.group()), text))


def _fit_town(lex: Lexicon, town: str) -> str | None:
    """The longest beginning of a town match that the corpus knows as a town."""
    parts = town.split(" ")
    for n in (3, 2, 1):
        if n <= len(parts) and lex.towns.get(" ".join(parts[:n]).lower(), 0) >= 2:
            return " ".join(parts[:n])
    return None


def addresses(text: str, lex: Lexicon) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for lang in street_languages(text):
        for m in STREET[lang].finditer(text):
            start, end, form = m.start(), m.end(), lang
            if lang == "es":  # the street's name may not swallow what follows a sentence end
                if regex.search(r"[.!?]\s", m.group().rstrip(".")) and "av." not in m.group().lower():
                    continue
            tail = AFTER["en" if lang == "en" else "other"].match(text, end)
            town = None
            if tail:
                raw = tail.group("town")
                known = _fit_town(lex, raw)
                if not known and not tail.group("post") and text[end : end + 1] in ",\n\r" and raw[:1].isupper():  # a town never seen: for the field to decide
                    out.append((start, tail.start("town") + len(raw.split(" ")[0]), form + "?"))
                if known or tail.group("post"):
                    town = known or (raw if lang == "en" else raw.split(" ")[0])
                    if lang == "en":
                        end = tail.start("town") + len(town)
                        post = regex.compile(rf"(?i),?{_SEP}({_POST})").match(text, end)
                        if post:
                            end, form = post.end(), form + "p"
                    else:
                        end = tail.start("town") + len(town)
                        form += "p" if tail.group("post") else ""
                    form += "t"
            if town is None:
                post = POST_ONLY.match(text, end)
                if post and lang == "en":
                    end, form = post.end(), form + "p"
            if lang == "de" and form == "de" and not regex.search(r"(?i)(straße|strasse|str\.|weg|platz|gasse|allee|damm|ufer)\b|str\.", m.group()):
                form += "w"
            out.append((start, end, form))
    return out


def names(text: str, lex: Lexicon) -> list[tuple[int, int, str]]:
    """Given name or initial beside any word that may be a family name, in either order, with how well that is known."""
    if not INITIAL.search(text) and lex.given.isdisjoint(NAMEWORD.findall(text.lower())):
        return []
    ms = [(m.start(), m.end(), m.group()) for m in NAMEWORD.finditer(text)]
    lows = [w.lower() for _, _, w in ms]
    n = len(ms)
    initial = lambda i: len(ms[i][2]) == 1 and text[ms[i][1] : ms[i][1] + 1] == "."
    anchors = [i for i in range(n) if lows[i] in lex.given or initial(i)]
    if not anchors:
        return []
    out: list[tuple[int, int, str]] = []
    shout: dict[int, bool] = {}

    def shouting(i: int) -> bool:
        """Whether the words around are all in one case, so that case says nothing."""
        if i not in shout:
            near = [w for _, _, w in ms[max(0, i - 5) : i + 6] if len(w) > 2]
            shout[i] = all(w.isupper() for w in near) or all(w.islower() for w in near)
        return shout[i]

    def gap(i: int, kind: str) -> bool:
        between = text[ms[i][1] : ms[i + 1][0]]
        return between == " " if kind == "space" and len(between) == 1 else bool(GAPS[kind].fullmatch(between))

    def family(i: int, beside_given: bool = False) -> tuple[int, str]:
        """The word after the family name's last part that starts at i (0: none), and how well the name is known."""
        j = i
        while j < n and lows[j] in PARTICLES and j + 1 < n and gap(j, "space") and j - i < 3:
            j += 1
        sort = lex.family_sort(lows[j]) if j < n else ""
        if not sort or (sort == "u" and not ms[j][2][0].isupper()):
            return 0, ""
        return (j + 1, sort + ("c" if ms[j][2][0].isupper() else "s")) if ms[j][2][0].isupper() or beside_given or shouting(j) else (0, "")  # small letters do only beside a given name

    starts = sorted({j for a in anchors for j in range(max(0, a - 4), a + 1)})
    reached = 0
    for i in starts:
        if i < reached:
            continue
        known = lows[i] in lex.given
        if known or initial(i):
            j, form = i + 1, "G" if known else "I"
            while j < n and initial(j) and gap(j - 1, "space" if lows[j - 1] in lex.given else "dot"):
                j += 1
                form += "I"
            if j < n and gap(j - 1, "dot" if initial(j - 1) else "space"):
                k, sort = family(j, True)
                if k:
                    out.append((ms[i][0], ms[k - 1][1], form + sort))
                    reached = k
                    continue
        k, sort = family(i)
        if k and k + 1 < n and gap(k - 1, "comma"):
            j = k
            while j + 1 < n and (initial(j) or j == k) and gap(j, "dot" if initial(j) else "space"):
                j += 1
                if not initial(j):
                    break
            if j > k and family(j, True)[1][:1] in ("k", "a"):
                continue  # what stands before the comma is no part of the name behind it
        if k and k < n and gap(k - 1, "comma") and (lows[k] in lex.given or initial(k)):
            end, form = ms[k][1], sort + "," + ("G" if lows[k] in lex.given else "I")
            j = k + 1
            while j < n and initial(j) and gap(j - 1, "space" if lows[j - 1] in lex.given else "dot"):
                end, j = ms[j][1], j + 1
            out.append((ms[i][0], end, form))
            reached = j
            continue
        if k and k < n and gap(k - 1, "space") and lows[k] in lex.given and sort[0] != "u" and not (k + 1 < n and gap(k, "space") and family(k + 1)[0]):
            out.append((ms[i][0], ms[k][1], sort + "G"))
            reached = k + 1
    return out


def candidates(text: str, lex: Lexicon) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, form)"""
    out: list[tuple[int, int, str, str]] = []
    if may_mail(text):
        out += [(m.start(), m.end(), "email", "plain" if "@" in m.group() else "spelt") for m in EMAIL.finditer(text)]
    taken = [(a, b) for a, b, *_ in out]
    digits = len(DIGITS.findall(text))
    for pattern in (NUMBER, CODED) if digits > 5 else ():
        for m in pattern.finditer(text):
            shape = _shape(m.group())
            many = shape.count("9")
            if many > 15 or any(a < m.end() and m.start() < b for a, b in taken):
                continue
            if pattern is NUMBER:
                out.append((m.start(), m.end(), "phone", shape))
            out.append((m.start(), m.end(), "id_number", shape))
    if digits:
        out += [(a, b, "address", form) for a, b, form in addresses(text, lex)]
    out += [(a, b, "name", form) for a, b, form in names(text, lex) if not any(x < b and a < y for x, y in taken)]
    return out


# ---------------------------------------------------------------- features and the field
def _caption(text: str, start: int) -> str:
    """What the nearest captioning word of the same sentence before ``start`` announces."""
    before = text[max(0, start - 70) : start]
    before = regex.split(r"\n|[!?]\s|(?<![Nn]o|[Tt][eé]l|Nr|[Dd]r)\.\s", before)[-1]
    weak = "-"
    for w in reversed(WORD.findall(before.lower())):
        if w in NUMBER_WORDS:
            weak = "num"  # says that a number follows, not of which kind
        elif w in CAPTION_OF:
            return CAPTION_OF[w]
    return weak


def _behind(text: str, end: int) -> str:
    m = regex.match(r"[\s.,;:)]*(\p{L}+)", text[end : end + 24])
    return m.group(1).lower() if m else "-"


def chains(text: str, lex: Lexicon) -> list[tuple[list[tuple[int, int, str]], list[list[int]], list[tuple]]]:
    """For each stretch with candidates: tokens (start, end, key), hashed features per token, candidates."""
    found = candidates(text, lex)
    if not found:
        return []
    lines = []
    if regex.search(r"\d{4}-\d\d-\d\dT", text):
        lines = [(m.start(), m.end()) for m in LOG_LINE.finditer(text)]
    found = sorted(c for c in found if not any(a <= c[0] < b for a, b in lines))
    groups: list[list[tuple]] = []
    reach = -1
    for c in found:
        if groups and c[0] < reach + 12:
            groups[-1].append(c)
        else:
            groups.append([c])
        reach = max(reach, c[1]) if len(groups[-1]) > 1 else c[1]
    out = []
    for group in groups:
        lo, hi = group[0][0], max(c[1] for c in group)
        a, b = max(0, lo - 14), min(len(text), hi + 14)
        tokens = [(m.start() + a, m.end() + a, m.group().lower()) for m in TOKEN.finditer(text[a:b])]
        marks: list[list[str]] = [["1"] for _ in tokens]
        for s, e, kind, form in group:
            cap, behind, digits = _caption(text, s), _behind(text, e), sum(ch.isdigit() for ch in text[s:e])
            how = []
            if kind in ("phone", "id_number"):  # which signs part the digits, how the first and the last group look
                parts, seps = regex.findall(r"[\p{L}\d]+", text[s:e]), "".join(sorted(set(regex.sub(r"[\p{L}\d]", "", text[s:e]))))
                how = [f"s{seps}", f"f{text[s]}{len(parts[0])}", f"s{seps}f{len(parts[0])}l{len(parts[-1])}n{len(parts)}", f"d{digits}s{seps}"]
            for i, (x, y, _) in enumerate(tokens):
                if s <= x and y <= e:
                    p = "B" if x == s or (i and tokens[i - 1][0] < s) else "I"
                    marks[i] += [f"{kind}{p}", f"{kind}{p}{form}", f"{kind}{p}c{cap}", f"{kind}{p}d{digits}c{cap}", f"{kind}{p}b{behind}", *(f"{kind}{p}{h}" for h in how)]
        for i, (_, _, key) in enumerate(tokens):
            marks[i].append("w" + (key if key.isalpha() else "9" * len(key)))
            if i:
                marks[i].append("p" + (tokens[i - 1][2] if tokens[i - 1][2].isalpha() else "#"))
        out.append((tokens, [[xxhash.xxh32_intdigest(f) % HASHED for f in own] for own in marks], group))
    return out


class Field:
    """The chain's weights, and inference with skip edges."""

    def __init__(self):
        self.w = np.zeros((HASHED, len(LABELS)))
        self.t = np.zeros((len(LABELS), len(LABELS)))
        for j, label in enumerate(LABELS):  # an I follows only B or I of its kind
            if label[0] == "I":
                for i, before in enumerate(LABELS):
                    if before[2:] != label[2:]:
                        self.t[i, j] = -30.0
        self.fixed = self.t < 0
        self.start = np.array([-30.0 if x[0] == "I" else 0.0 for x in LABELS])

    def unary(self, chain: tuple) -> np.ndarray:
        """Weights of a chain's features; a label of a kind needs a shape of that kind."""
        tokens, features, group = chain
        out = np.array([self.w[f].sum(axis=0) for f in features])
        bare = np.ones((len(tokens), len(KINDS)), dtype=bool)
        for s, e, kind, _ in group:
            bare[[i for i, (a, b, _) in enumerate(tokens) if s <= a and b <= e], KINDS.index(kind)] = False
        out[:, 1:][np.repeat(bare, 2, axis=1)] -= 30.0
        return out

    def marginals(self, unaries: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Forward-backward over chains of like length at once; also pairs' expectations and log Z."""
        out: list = [None] * len(unaries)
        pairs, z = np.zeros_like(self.t), np.zeros(len(unaries))
        order = sorted(range(len(unaries)), key=lambda i: len(unaries[i]))
        for lo in range(0, len(order), 128):
            own = order[lo : lo + 128]
            n, k = max(len(unaries[i]) for i in own), len(LABELS)
            u, live = np.zeros((len(own), n, k)), np.zeros((len(own), n), dtype=bool)
            for r, i in enumerate(own):
                u[r, : len(unaries[i])], live[r, : len(unaries[i])] = unaries[i], True
            a, b = np.zeros_like(u), np.zeros_like(u)
            a[:, 0] = u[:, 0] + self.start
            for s in range(1, n):
                a[:, s] = np.where(live[:, s, None], u[:, s] + _lse(a[:, s - 1, :, None] + self.t[None], 1), a[:, s - 1])
            for s in range(n - 2, -1, -1):
                b[:, s] = np.where(live[:, s + 1, None], _lse(self.t[None] + (u[:, s + 1] + b[:, s + 1])[:, None, :], 2), b[:, s + 1])
            total = _lse(a[:, -1], 1)
            p = np.exp(a + b - total[:, None, None])
            for s in range(1, n):
                e = np.exp(a[:, s - 1, :, None] + self.t[None] + (u[:, s] + b[:, s])[:, None, :] - total[:, None, None])
                pairs += (e * live[:, s, None, None]).sum(axis=0)
            for r, i in enumerate(own):
                out[i], z[i] = p[r, : len(unaries[i])], total[r]
        return out, pairs, z

    def train(self, chains_: list[tuple], gold: list[np.ndarray], epochs: int = 12, rate: float = 0.5) -> Field:
        rng = np.random.default_rng(SEED)
        gw, gt = np.full_like(self.w, 1e-2), np.full_like(self.t, 1e-2)
        order = np.arange(len(chains_))
        for _ in range(epochs):
            rng.shuffle(order)
            for lo in range(0, len(order), 128):
                own = order[lo : lo + 128]
                p, pairs, _ = self.marginals([self.unary(chains_[i]) for i in own])
                rows, grads = [], []
                seen = np.zeros_like(self.t)
                for m, i in zip(p, own):
                    d = m.copy()
                    d[np.arange(len(m)), gold[i]] -= 1
                    for f, g in zip(chains_[i][1], d):
                        rows += f
                        grads += [g] * len(f)
                    np.add.at(seen, (gold[i][:-1], gold[i][1:]), 1)
                touched, back = np.unique(np.array(rows), return_inverse=True)
                g = np.zeros((len(touched), len(LABELS)))
                np.add.at(g, back, np.array(grads))
                g = g / len(own) + 1e-4 * self.w[touched]
                gw[touched] += g**2
                self.w[touched] -= rate * g / np.sqrt(gw[touched])
                dt = np.where(self.fixed, 0, (pairs - seen) / len(own))
                gt += dt**2
                self.t -= rate * dt / np.sqrt(gt)
        return self

    def labels(self, docs: list[list[tuple]]) -> list[list[np.ndarray]]:
        """Label index of each token of each chain of each document, after skip messages."""
        flat = [(d, c) for d, own in enumerate(docs) for c in range(len(own))]
        unary = [self.unary(docs[d][c]) for d, c in flat]
        p, _, _ = self.marginals(unary)
        mentions: dict[tuple[int, str], list[tuple[int, int]]] = defaultdict(list)
        for x, (d, c) in enumerate(flat):
            tokens, _, group = docs[d][c]
            for i, key in mention_keys(tokens, group):
                if (x, i) not in mentions[d, key]:
                    mentions[d, key].append((x, i))
        skip = [(own, key[1][0] == "#") for key, own in mentions.items() if len(own) > 1]
        kind = np.array([0, *(1 + i for i in range(len(KINDS)) for _ in "BI")])
        same = [np.where(kind[:, None] == kind[None], s, 1.0) for s in (SKIP, SKIP_DIGITS)]
        sent: dict[tuple[int, int], np.ndarray] = {}
        for _ in range(ROUNDS if skip else 0):
            new: dict[tuple[int, int], np.ndarray] = {}
            for own, digits in skip:
                # cavity beliefs: what each mention thinks without what the others told it
                logs = [np.log(p[x][i] + 1e-9) - sent.get((x, i), 0.0) for x, i in own]
                beliefs = np.exp([v - v.max() for v in logs])
                beliefs /= beliefs.sum(axis=1, keepdims=True)
                total = beliefs.sum(axis=0)
                for j, at in enumerate(own):
                    heard = np.log(same[digits] @ ((total - beliefs[j]) / (len(own) - 1)))
                    new[at] = new[at] + heard if at in new else heard
            touched = sorted({x for x, _ in new})
            changed = {x: unary[x].copy() for x in touched}
            for (x, i), m in new.items():
                changed[x][i] += m
            q, _, _ = self.marginals([changed[x] for x in touched])
            moved = False
            for x, m in zip(touched, q):
                moved |= bool((m.argmax(axis=1) != p[x].argmax(axis=1)).any())
                p[x] = m
            sent = new
            if not moved:
                break
        out: list[list[np.ndarray]] = [[None] * len(own) for own in docs]
        for (d, c), m in zip(flat, p):
            out[d][c] = m.argmax(axis=1)
        return out


def mention_keys(tokens: list[tuple[int, int, str]], group: list[tuple]) -> Iterator[tuple[int, str]]:
    """(token, key) of what a skip edge may join: words without accents, and numbers by all their digits."""
    for s, e, kind, _ in group:
        inside = [i for i, (a, b, _) in enumerate(tokens) if s <= a and b <= e]
        for i in inside:
            if len(tokens[i][2]) >= 4 and tokens[i][2].isalpha():
                yield i, "".join(ch for ch in unicodedata.normalize("NFKD", tokens[i][2]) if not unicodedata.combining(ch))
        if kind in ("phone", "id_number") and inside:
            yield inside[0], "#" + "".join(tokens[i][2] for i in inside if tokens[i][2].isalnum())


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def spans(chain: tuple, labels: np.ndarray) -> list[tuple[int, int, str]]:
    """The field's runs of labels, split where a shape of the kind starts anew.

    The exact check: a name has two words, and a number is a whole group of digits.
    """
    tokens, _, group = chain
    starts = {k: {s for s, _, kind, _ in group if kind == k} for k in KINDS}
    whole = {(s, e) for s, e, kind, _ in group if kind in ("phone", "id_number")}
    runs: list[list] = []
    for i, y in enumerate(labels):
        label = LABELS[y]
        if label == "O":
            continue
        joined = runs and runs[-1][1] == i and runs[-1][2] == label[2:]
        anew = joined and tokens[i][0] in starts[label[2:]] and not any(s <= tokens[runs[-1][0]][0] and tokens[i][0] < e for s, e, kind, _ in group if kind == label[2:])
        if label[0] == "B" and not joined or label[0] == "B" and tokens[i][0] in starts[label[2:]] or not joined or anew:
            runs.append([i, i + 1, label[2:]])
        else:
            runs[-1][1] = i + 1
    out = []
    for i, j, kind in runs:
        while i < j and not tokens[i][2].isalnum() and tokens[i][2] not in "(+":
            i += 1
        while i < j and not tokens[j - 1][2].isalnum() and tokens[j - 1][2] not in ")ºª":
            j -= 1
        if i == j or (kind == "name" and sum(t[2].isalnum() for t in tokens[i:j]) < 2) or (kind in ("phone", "id_number") and (tokens[i][0], tokens[j - 1][1]) not in whole):
            continue
        out.append((tokens[i][0], tokens[j - 1][1], kind))
    return out


# ---------------------------------------------------------------- training sentences
# Parts of training sentences: what stands before and behind an item, by kind and language.
BEFORE = {
    "email": {"en": ["Forward it to ", "Reply at ", "my e-mail is ", "mail: ", "user=", "sign in as ", "Message <", "inbox ", "the account of ", ""], "de": ["Antworte an ", "meine E-Mail: ", "Nachricht bitte an "], "fr": ["Réponds à ", "mon courriel : ", "envoie tout à "], "es": ["Responde a ", "correo: ", "manda todo a "]},
    "phone": {"en": ["Phone ", "my number is ", "Dial ", "mobile: ", "reach us on ", "cell ", "they call back at ", "fax ", "ring me: ", "the landline of the office is ", ""], "de": ["Telefon ", "ruf an: ", "meine Nummer ist ", "Handy ", "erreichbar unter "], "fr": ["téléphone ", "mon numéro : ", "joignable au ", "portable "], "es": ["teléfono ", "mi número es ", "marca el ", "móvil "]},
    "id_number": {"en": ["passport no ", "the national id of the guest is ", "tax number ", "social security no. ", "identity card ", "id: ", "driving licence ", "insurance number (social security) "], "de": ["Reisepass ", "Personalausweis ", "Steuernummer ", "meine Sozialversicherungsnummer ist "], "fr": ["numéro de passeport ", "carte nationale d'identité ", "sécurité sociale ", "numéro fiscal, identité "], "es": ["pasaporte ", "documento de identidad ", "NIF ", "seguridad social "]},
    "address": {"en": ["My address is ", "Send parcels to ", "They live at ", "delivery to ", "we moved into ", "visit us at ", "house: ", "from ", "to ", ""], "de": ["Meine Adresse: ", "wohnhaft ", "Paket an ", "Besuch uns in ", ""], "fr": ["mon adresse : ", "nous habitons ", "colis pour ", "au ", ""], "es": ["mi dirección es ", "vivimos en ", "paquete a ", "está en ", ""]},
    "name": {"en": ["Ask ", "regards, ", "My dentist is ", "I met ", "with Mr ", "Dr. ", "guest list: ", "a contract for ", "thanks to ", "Ms ", "by ", "\u2014 ", ""], "de": ["Grüße von ", "Herr ", "zusammen mit ", "für "], "fr": ["Merci à ", "Monsieur ", "avec ", "par "], "es": ["Gracias a ", "doña ", "junto a ", "para "]},
}
BEHIND = ["", "", ".", ".", " now.", " please", ", thanks", " as agreed.", "!", "; then more", " and so on", " (new)", ">", " or later.", " for a while", "\n", " near the lake", " agreed.", ", who left early", " wrote back."]
# Numbers that are no personal ones; # takes a run of digits, 9 a digit.
MISLEADING = ["reservation # stays", "parcel no. #", "serial number # below", "invoice # unpaid", "model 75-#-49", "lot # of 99", "bus 99 leaves", "chapter 9", "page 99 of 999", "build 99.99.999.9", "version 9.99.99 out", "on 2024-06-19 at 19:25", "2025-09-99 99:99", "score 999.99 to 99.9", "host 10.99.99.1 down", "192.168.9.99 is silent", "part number 99-#-999 is gone", "ISBN 978-0-999-9999-9", "ISBN 000-0-#-#", "Rechnung # fehlt noch", "Bestellung # offen", "Artikel #", "dossier #", "commande # perdue", "facture # reçue", "pedido # listo", "ticket no #", "node=# ms=99.999", "ids 9999 9999 9999 left", "order number 9999-9999-999 pending", "order # is pending", "ratio 999.99/999.99 on page 9", "value 99.9/999.9", "share 0.999999", "9.9999999 of it", "999.9999/99.99", "part 99.9/99.99 done", "999,999,999.00 in all", "address 192.0.9.99 lost", "1.2.999.9999", "room 99", "case # closed", "trace # ok", "commit # was undone", "99 items", "step 9 of 999", "the batch # and the token #", "total 999,999.00 for 99 of them", "a number # was called out"]
_PLAIN = "then and please with today we at ten here also some more very".split()


def _sentences(lex: Lexicon, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, str]]]]:
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda shape: "".join(str(rng.integers(10)) if ch == "9" else ch for ch in shape)
    surnames = sorted(lex.family, key=lambda w: (-lex.family[w], w))[:TAUGHT] or ["berger", "novak", "harding", "lindqvist", "moreau", "castillo"]
    givens = sorted(lex.given)[:TAUGHT] or ["anna", "peter"]
    towns = sorted((t for t, c in lex.towns.items() if c >= 2), key=lambda t: (-lex.towns[t], t))[:TAUGHT] or ["millbrook", "oberau", "valcourt"]
    plain = (sorted(lex.common)[:: max(1, len(lex.common) // 400)] or _PLAIN) + _PLAIN
    cap = lambda s: " ".join("-".join(p[:1].upper() + p[1:] for p in w.split("-")) for w in s.split(" "))
    invented = lambda: "".join(pick("bdfgklmnprstvw") + pick("aeiou") for _ in range(int(rng.integers(2, 4)))) + pick(["", "n", "r", "s", "lt", "x"])
    # Usual ways to write numbers.
    phones = ["+44 (0)20 9999 9999", "020 9999 9999", "(020) 9999 9999", "07999 999 999", "07999-999-999", "07999 999999", "+44 7999 999999", "+1 999 999 9999", "1-999-999-9999", "(999) 999-9999", "999.999.9999", "999-999-9999", "999 999 9999", "+19999999999", "0033 199999999", "+33 1 99 99 99 99", "01.99.99.99.99", "01-99-99-99-99", "01 99 99 99 99", "030/99999-999", "(030) 99999 999", "0049 (0)30 99999999", "+49 30 99999 999", "03099999999", "+34 999 999 999", "699 99 99 99", "+34 99 999 99 99"]
    ids = {"en": ["X9999999", "KW9999999", "QQ999999B", "QQ 99 99 99 B", "qq 999999 c", "999-99-9999", "999 99 9999", "999.99.9999", "999999999", "9999-9999-99"], "de": ["99 999 999 999", "L9K999999", "99 999999 B 999", "99999999999"], "fr": ["1 99 99 99 999 999 99", "99AL99999", "199999999999999"], "es": ["99999999W", "99999999-G", "X9999999T", "99 9999999999", "9999-9999-99"]}

    def surname() -> str:
        return cap(pick(surnames) if rng.random() < 0.8 else invented())

    def name() -> str:
        s = surname()
        s = pick([s, s, s, s + "-" + cap(pick(surnames)), pick(["von ", "van der ", "de ", "da "]) + s])
        g = pick([cap(pick(givens)), cap(pick(givens)), pick(list("ABCDEFGHJKLMNPRST")) + "."])
        return pick([f"{g} {s}", f"{g} {s}", f"{g} {pick(list('ABCDEFG'))}. {s}", f"{cap(pick(surnames))}, {g}", f"{cap(pick(surnames))} {cap(pick(givens))}" if rng.random() < 0.3 else f"{g} {s}"])

    def email() -> str:
        g, s = unicodedata.normalize("NFKD", pick(givens)).encode("ascii", "ignore").decode() or "kim", pick(surnames)
        local = pick([f"{g}.{s}", f"{g}_{s}{rng.integers(99)}", f"{s}.{g[0]}", g[0] + s, s, f"{g}-{s}", f"{g}.{s}+box"])
        host = pick(["mail.example", "example.org", "team.example.org", "web.test", f"{invented()}.invalid", "büro.example", "example.net"])
        return pick([f"{local}@{host}", f"{local}@{host}", f"{local} @ {host}", f"{local} (at) {host.replace('.', ' (dot) ')}", f"{local}[at]{host.replace('.', '[dot]')}", f"{local} AT {host.replace('.', ' DOT ')}", f"{local} [at] {host.replace('.', ' [dot] ')}", f"{local} at {host.replace('.', ' dot ')}"])

    def address(lang: str) -> str:
        t, n, post = cap(pick(towns) if rng.random() < 0.85 else invented()), int(rng.integers(1, 190)), num("99999" if rng.random() < 0.5 else "00999")
        sep = pick([", ", ", ", "\n", " "])
        if lang == "de":
            return pick([f"{cap(pick(surnames))}straße {n}{sep}{post} {t}", f"{cap(invented())}weg {n}a, {t}", f"Alte Gasse {n}{sep}{post} {t}", f"Am alten Tor {n}, {post} {t}", f"{cap(invented())}platz {n}"])
        if lang == "fr":
            return pick([f"{n} rue des {cap(invented())}{sep}{post} {t}", f"{n}, impasse {cap(invented())}{sep}{post} {t}", f"{n} bis, boulevard de la {cap(invented())}, {t}"])
        if lang == "es":
            return pick([f"Calle {cap(invented())} {n}{sep}{post} {t}", f"Plaza de la {cap(invented())}, {n}, 2º B, {post} {t}", f"Avenida del {cap(invented())} {n}{sep}{post} {t}", f"C/ {cap(invented())}, {n}, {post} {t}"])
        street = f"{cap(pick(surnames) if rng.random() < 0.5 else invented())} {cap(pick(STREET_EN))}"
        end = pick(["", f" {post}", " " + num("ZZ9 9QX")])
        return pick([f"{n} {street}{sep}{t}{end}", f"Apt {n % 20}, {n} {street}, {t}{end}", f"{n}c {street}, Flat 4, {t}{end}", f"{n} {street}"])

    def misleading() -> str:
        kind = rng.random()
        if kind < 0.6:
            return regex.sub("#", lambda _: num(pick(["999999999", "99999999", "9999999", "9999999999", "9999"])), num(pick(MISLEADING)))
        g, w, n = cap(pick(givens)), pick(plain), int(rng.integers(2, 60))
        return pick([f"{g} {w} it", f"{g} and {cap(pick(givens))} {w}", f"{w} {g}, {cap(pick(givens))} and {cap(pick(givens))}", f"{w} {g}. {cap(invented())} was {w}", f"{g} {cap(w)}", f"{n} {w} {pick(STREET_EN)}", f"a {n} minutes walk", f"im {cap(invented())} {n}", f"{w} {cap(invented())} {w} {g}", f"{pick(list('ABCDEF'))}. {cap(w)} {w}", f"{g} {w} {cap(invented())}", f"row {n}, {cap(invented())}", f"{cap(w)}, {g} {w} it", f"{cap(w)}, {g} {w} {pick(plain)}", f"On {n % 30} {cap(invented())}, {g} {w}", f"{cap(invented())}, {g} {w}"])

    def unit() -> tuple[str, list[tuple[int, int, str]]]:
        if rng.random() < 0.4:
            return misleading(), []
        if rng.random() < 0.15:  # a card: items line by line, a name first
            parts = [("name", name()), ("address", address(pick(["en", "de", "fr", "es"]))), ("phone", num(pick(phones))), ("email", email())]
            parts = [parts[0], *(p for p in parts[1:] if rng.random() < 0.6)] if rng.random() < 0.8 else [("name", name()), ("name", name())]
            text, gold, between = pick(["\n", "", f"{pick(plain)}, "]), [], pick(["\n", "\n", " ", "; "])
            for kind, item in parts:
                gold.append((len(text), len(text) + len(item), kind))
                text += item + between
            return text, gold
        kind = pick(KINDS)
        lang = pick(["en", "en", "en", "de", "fr", "es"])
        item = {"email": email, "phone": lambda: num(pick(phones)), "id_number": lambda: num(pick(ids[lang])), "address": lambda: address(lang), "name": name}[kind]()
        before = pick(BEFORE[kind][lang]) if rng.random() < 0.75 or kind == "id_number" else f"{pick(plain)} "
        return before + item + pick(BEHIND), [(len(before), len(before) + len(item), kind)]

    out = []
    for _ in range(SENTENCES):
        text, gold = "", []
        for _ in range(int(rng.integers(1, 4))):
            if rng.random() < 0.5:
                text += " ".join(pick(plain) for _ in range(int(rng.integers(1, 6)))).capitalize() + pick([". ", "\n", " "])
            part, own = unit()
            gold += [(a + len(text), b + len(text), k) for a, b, k in own]
            text += part + pick([" ", "\n", ". ", "; ", " \u2014 "])
        case = rng.random()
        for turned in (text.lower() if case < 0.25 else text.upper() if case < 0.3 else text,):
            text = turned if len(turned) == len(text) else text
        out.append((text, gold))
    return out


def train(lex: Lexicon) -> Field:
    xs, ys = [], []
    for raw, gold in _sentences(lex):
        text, at = normalised(raw)
        if at is not None and len(text) != len(raw):
            continue
        for chain in chains(text, lex):
            y = np.zeros(len(chain[0]), dtype=int)
            for s, e, kind in gold:
                inside = [i for i, (a, b, _) in enumerate(chain[0]) if s <= a and b <= e]
                for n, i in enumerate(inside):
                    y[i] = LABELS.index(("B-" if n == 0 else "I-") + kind)
            xs.append(chain)
            ys.append(y)
    return Field().train(xs, ys) if xs else Field()


# ---------------------------------------------------------------- the corpus' lexicons
def _evidence(text: str, given: set[str]) -> set[str]:
    """What a text tells of words, a letter for the kind before each: l/u lower or upper case, t towns, f after a given name,
    g two capitalised words, i after an initial; h parts of joined names and p all that may be a town are only looked up."""
    if may_mail(text):
        text = EMAIL.sub(" @ ", text)
    own = {("l" if w[0].islower() else "u") + w.lower() for w in set(NAMEWORD.findall(text))}
    own |= {"h" + part for w in own if "-" in w or "'" in w or "’" in w for part in JOINT.split(FORE.sub("", w[1:])) if part}
    before = None
    for m in CAPITAL.finditer(text):
        if before is not None and m.start() - before.end() < 3:
            between, a, b = text[before.end() : m.start()], before.group(), m.group()
            if between == " ":
                if a.lower() in given:
                    own.add("f" + b.lower())
                elif len(a) > 1 and before.start() and text[before.start() - 1] == " " and text[m.end() : m.end() + 2] != ", ":
                    own.add(f"g{a.lower()} {b.lower()}")  # within a sentence, so that openers are no names
            elif between == ". " and len(a) == 1 and len(b) > 3:
                own.add("i" + b.lower())
        before = m
    for lang, phrase, strong in _towns(text):
        parts = phrase.lower().split(" ")
        heads = [" ".join(parts[:n]) for n in range(1, len(parts) + 1)]
        own |= {"p" + x for x in heads}
        if strong:  # an English town ends where the postcode starts
            own |= {"t" + x for x in (heads[-1:] if lang == "en" else heads)}
    return own


def _towns(text: str) -> Iterator[tuple[str, str, bool]]:
    """(language, words, beside a postcode) of what stands behind a street."""
    for lang in street_languages(text):
        for m in STREET[lang].finditer(text):
            tail = AFTER["en" if lang == "en" else "other"].match(text, m.end())
            if tail:
                yield lang, tail.group("town"), tail.group("post") is not None


class Lexicons(NamedTuple):
    """Tables of given names, family names (with counts) and towns (with counts) of the whole corpus; common words and name endings, which are bounded."""

    table: DataFrame  # kind (g, f, t), w, n
    common: set[str]
    heads: set[str]
    tails: set[str]


def evidence(texts: DataFrame, given: list[str]) -> DataFrame:
    """src, row_id, text, may (whether it has a digit, an e-mail's sign or an initial), own (its evidence), written once."""
    shared = texts.sparkSession.sparkContext.broadcast({g.lower() for g in given if g})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            may, own = [], []
            for t in pdf["text"]:
                text = normalised(t)[0] if t else ""
                may.append(bool(DIGITS.search(text)) or may_mail(text) or bool(INITIAL.search(text)))
                own.append(list(_evidence(text, shared.value)))
            yield pdf.assign(may=may, own=own)

    return written(spread(texts.select("src", "row_id", "text")).mapInPandas(run, "src string, row_id long, text string, may boolean, own array<string>"))


def lexicons(told: DataFrame, given: list[str]) -> Lexicons:
    """Counts over all texts' evidence, and the lexicons drawn from them, as tables."""
    spark = told.sparkSession
    listed = {g.lower() for g in given if g}
    each = told.select(F.explode(F.filter("own", lambda x: ~F.substring(x, 1, 1).isin("h", "p"))).alias("x"))
    counts = cut(each.groupBy("x").agg(F.count("*").alias("c")).select(F.substring("x", 1, 1).alias("k"), F.substring("x", F.lit(2), F.length("x")).alias("w"), "c"))
    of = lambda k: counts.where(F.col("k") == k).select("w", "c")
    upper = of("u").withColumnRenamed("c", "u")
    least = max(3, int(told.count() * COMMON_SHARE))
    # at most 1 / COMMON_SHARE times the words of an average text; names are mostly capitalised
    common = {r["w"] for r in of("l").where(F.col("c") >= least).join(upper, "w", "left").where("2 * c >= coalesce(u, 0)").select("w").collect()}
    plain = F.broadcast(spark.createDataFrame([(w,) for w in sorted(common | PARTICLES)], "w string"))
    strange = lambda df, c="w": df.join(plain.withColumnRenamed("w", c), c, "left_anti")
    # towns: a longer phrase is the town if most of its beginning's cases go on with it
    raw = of("t").where("c >= 2").withColumn("head", F.regexp_extract("w", "^(.*) [^ ]+$", 1))
    kept = raw.join(raw.select(F.col("w").alias("head"), F.col("c").alias("hc")), "head", "left").where("hc is null or c >= 0.5 * hc").select("w", "c")
    words_ = F.split("w", " ")
    begun = kept.select("c", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words_) - 1, F.lit(1))), lambda i: F.array_join(F.slice(words_, 1, i), " "))).alias("b"), "w").where("b <> w").groupBy(F.col("b").alias("w")).agg(F.max("c").alias("longer"))
    towns = kept.join(begun, "w", "left").where("longer is null or longer < 0.5 * c").select("w", F.col("c").alias("n"))
    # family names stand behind listed given names; months, sentence openers and the like mostly elsewhere
    behind = cut(strange(of("f").where("length(w) > 3")).join(upper, "w", "left").where("coalesce(u, 0) <= 50 * c"))

    def endings(names_: DataFrame) -> tuple[set[str], set[str]]:
        """First and last three letters that three names share: as many as there are letters, to the third power."""
        some = lambda part: {r[0] for r in names_.groupBy(part.alias("p")).count().where("count >= 3").collect()}
        return some(F.substring("w", 1, 3)), some(F.substring("w", -3, 3))

    heads, tails = endings(behind)
    alike = lambda c: F.substring(c, 1, 3).isin(list(heads)) & F.substring(c, -3, 3).isin(list(tails)) if heads and tails else F.lit(False)
    pair = of("g").select(F.split("w", " ")[0].alias("a"), F.split("w", " ")[1].alias("w"), "c").where(alike("w") & ~F.col("w").isin(list(listed) or [""]))
    pair = strange(strange(pair, "a"))
    # given names beyond the list stand where listed ones stand
    more = pair.groupBy("a").agg(F.countDistinct("w").alias("ws")).where("ws >= 2").join(upper.select(F.col("w").alias("a"), "u"), "a").where((F.col("u") >= 3) & ~F.col("a").isin(list(TITLES)) & ~alike("a")).select("a")
    more = cut(more)
    all_given = spark.createDataFrame([(g,) for g in sorted(listed)], "w string").unionByName(more.select(F.col("a").alias("w"))).distinct()
    extra = strange(of("i").where(alike("w"))).unionByName(pair.join(more, "a", "left_semi").where("length(w) > 3").select("w", "c"))
    family = behind.select("w", "c").unionByName(extra).groupBy("w").agg(F.sum("c").alias("n")).join(upper, "w", "left").join(all_given, "w", "left_anti")
    share = F.col("n") / F.greatest(F.lit(1), F.coalesce("u", F.lit(0)))
    family = cut(family.where(((F.col("n") >= 2) & (share >= 0.25)) | (alike("w") & (share >= 0.1))).select("w", "n"))
    table = all_given.select(F.lit("g").alias("kind"), "w", F.lit(1).cast("long").alias("n")).unionByName(family.select(F.lit("f").alias("kind"), "w", "n")).unionByName(towns.select(F.lit("t").alias("kind"), "w", "n"))
    return Lexicons(cut(table), common, *endings(family))


def taught(lex: Lexicons) -> Lexicon:
    """The most frequent names and towns, for training sentences (``TAUGHT`` of each kind)."""
    top = {k: {r["w"]: r["n"] for r in lex.table.where(F.col("kind") == k).orderBy(F.desc("n"), "w").limit(TAUGHT).collect()} for k in "gft"}
    return Lexicon(set(top["g"]), lex.common, top["f"], top["t"], lex.heads, lex.tails)


class Finder:
    """The field with what is known of the texts' words: one lexicon for all texts, or one for each call."""

    def __init__(self, lex: Lexicon, field: Field):
        self.lex, self.field = lex, field

    def find(self, texts: list[str | None], known: list[tuple[str, str, int]] | None = None) -> list[list[tuple[int, int, str, str]]]:
        """(start, end, kind, value) in each text; places refer to the text as given."""
        lex = self.lex
        if known is not None:
            of = lambda k: {w: n for kind, w, n in known if kind == k}
            lex = Lexicon(set(of("g")), lex.common, of("f"), of("t"), lex.heads, lex.tails)
        norm = [normalised(t) if t else ("", None) for t in texts]
        docs = [chains(t, lex) for t, _ in norm]
        labels = self.field.labels(docs)
        out = []
        for (text, at), own, ys in zip(norm, docs, labels):
            items = []
            for chain, y in zip(own, ys):
                for s, e, kind in spans(chain, y):
                    value = "".join(WORD.findall(text[s:e].lower()))
                    a, b = (s, e) if at is None else (at[s][0], at[e - 1][1])
                    items.append((a, b, kind, value))
            out.append(items)
        return out


def fit(texts: DataFrame, given: DataFrame) -> tuple[Finder, DataFrame, DataFrame]:
    """Lexicons from all texts, then the field from made sentences: the finder, the texts with their evidence, the table of words."""
    names_ = [r[0] for r in given.select("given_name").where("given_name is not null").distinct().collect()]  # a list kept by hand
    told = evidence(texts, names_)
    lex = lexicons(told, names_)
    return Finder(Lexicon(set(), lex.common, {}, {}, lex.heads, lex.tails), train(taught(lex))), told, lex.table


def _run(texts: DataFrame, given: DataFrame, schema: str, make, every: bool) -> DataFrame:
    """``make(rows, items)`` over the texts with their words looked up; without ``every`` only over texts that may hold an item."""
    finder, told, table = fit(texts, given)
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(finder)
    common = F.broadcast(spark.createDataFrame([(w,) for w in sorted(finder.lex.common)], "w string"))  # bounded by its share of the texts
    asked = told.select("src", "row_id", F.explode("own").alias("x")).where("substring(x, 1, 1) in ('l', 'u', 'h', 'p')").select("src", "row_id", F.substring("x", F.lit(2), F.length("x")).alias("w")).join(common, "w", "left_anti")
    looked = asked.join(table, "w").groupBy("src", "row_id").agg(F.collect_set(F.struct("kind", "w", "n")).alias("known"))
    named = told.select("src", "row_id", "text", "may").join(looked, ["src", "row_id"], "left")
    if not every:
        named = named.where(F.col("may") | F.exists("known", lambda x: x["kind"] == "g"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                known = {(r["kind"], r["w"], r["n"]) for own in part["known"] if own is not None for r in own}
                yield make(part, shared.value.find(part["text"].tolist(), list(known)))

    return named.select("src", "row_id", "text", "known").mapInPandas(run, schema)


def find_items(texts: DataFrame, given: DataFrame) -> DataFrame:
    """``src, row_id, kind, value`` of ``src, row_id, text``: one row per distinct item of a text."""

    def make(part: pd.DataFrame, found: list) -> pd.DataFrame:
        rows = [(s, r, k, v) for s, r, own in zip(part["src"], part["row_id"], found) for k, v in dict.fromkeys((k, v) for _, _, k, v in own)]
        return pd.DataFrame(rows, columns=["src", "row_id", "kind", "value"])

    return _run(texts, given, "src string, row_id long, kind string, value string", make, False)


def redact(text: str | None, items: list[tuple[int, int, str, str]]) -> str | None:
    """The text with a typed placeholder for each item and all else unchanged."""
    if text is None:
        return None
    out, last = [], 0
    for a, b, kind, _ in sorted(items):
        if a >= last:
            out += [text[last:a], PLACEHOLDER[kind]]
            last = b
    return "".join([*out, text[last:]])


def redact_texts(texts: DataFrame, given: DataFrame) -> DataFrame:
    """``src, row_id, redacted, n_items``."""

    def make(part: pd.DataFrame, found: list) -> pd.DataFrame:
        done = [redact(t, own) for t, own in zip(part["text"], found)]
        return part[["src", "row_id"]].assign(redacted=done, n_items=[len(own) for own in found])

    return _run(texts, given, "src string, row_id long, redacted string, n_items int", make, True)

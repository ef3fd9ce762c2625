"""Problem 2: personal information inside free text, by anchor expansion.

An Aho-Corasick automaton finds all anchors in one pass: at-signs in any spelling, schemes, digits, street words,
introductions of names, given names, and the words that tell account, transfer and ticket numbers from personal ones.
Deterministic local parsers expand each anchor to the item's borders and validate it. Found items are replaced by
placeholders of their type; all other text stays as it is.

Types: EMAIL, PHONE, ID, ADDRESS, NAME. Positions count characters from 1. Where items overlap, the earlier and then
the longer one stays. Defined results: null and empty texts hold no items; rows with a null id are left out; repeated
rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.text import lower

# Words that end a street's name.
STREET_WORDS = "street road row lane avenue marg cross approach drive close court crescent terrace square boulevard gali chowk salai path way colony layout nagar enclave".split()
# Words that begin a street's name in other languages, and endings of German street names.
STREET_BEGINNINGS = "rue|allée|chemin|impasse|quai|cours|place|avenue|boulevard|calle|avenida|paseo|plaza|carrer|carretera|via|viale|corso|piazza|vicolo|rua|travessa|praça|largo".split("|")
STREET_ENDINGS = "straße strasse str. weg platz allee gasse damm ufer".split()
# Small words inside such names.
STREET_PARTICLES = frozenset("de du des da do das dos del della dei degli di la le les los las el l' d' y e et von der am an im zum zur".split())
# Words that introduce a person's name. A name follows at once.
NAME_CUES = (
    "my name is", "name is", "this is", "i am", "i'm", "regards,", "sincerely,", "thanks,", "thank you,", "sent by", "signed by", "signed,", "spoke with", "spoke to", "talked to", "met with", "ask for",
    "asked for", "drawn by", "issued by", "dear", "hello", "hi", "joint holder", "holder", "nominee is", "nominee details are", "for kyc:", "kyc:", "my wife", "my husband", "my son", "my daughter", "my mother",
    "my father", "my brother", "my sister", "my spouse", "although", "contact person", "customer name", "name:", "me llamo", "mi nombre es", "soy", "je m'appelle", "je suis", "ich bin", "ich heiße", "mein name ist",
    "मेरा नाम", "mera naam", "mr.", "mr", "mrs.", "mrs", "ms.", "ms", "miss", "dr.", "dr", "shri", "smt.", "smt", "sri", "sr.", "sra.", "mme", "herr", "frau", "اسمي",
)
# Cues after which a given name may stand alone.
ALONE_CUES = frozenset("thank you,|thanks,|dear|hello|hi|mr.|mr|mrs.|mrs|ms.|ms|miss|dr.|dr|shri|smt.|smt|regards,|sincerely,|my name is|this is|sent by|me llamo|मेरा नाम".split("|"))
# Words after which only a full name of two capitalised words is taken for one.
WEAK_CUES = "to from with by told contact email met tenant landlord guarantor colleague neighbour beneficiary payee recipient".split()
# Titles, after which a surname may stand alone.
TITLES = frozenset("mr. mr mrs. mrs ms. ms miss dr. dr shri smt. smt sra. mme herr frau".split())
# Words that make a place or a firm of two capitalised words.
NO_SURNAMES = frozenset("""east west north south central hill hills port park plaza bay lake city town village island islands street road square market house tower station airport valley river beach county district
state states kingdom republic university college school hospital hotel group partners holdings capital york angeles francisco diego delhi kong plan fund gold silver plus prime credit pay""".split())
NO_FIRST_NAMES = frozenset("new san los las saint st north south east west upper lower great united hong sri abu el la port mount lake fort royal".split())
# Frequent given names.
GIVEN_NAMES = """aisha ahmed ali amit amina amir ana anita anna anil anjali ananya antonio arjun arun asha ashok bhavna carlos chen clara daniel david deepa deepak devan diego divya elena emma
fatima farah francesca gaurav geeta george gita grace hana hassan hemant ibrahim imran indira isabel ivan james jaya jean john jose joseph juan julia karan karim kavita kavya khalid kiran
lakshmi laila lata laura layla leela li lucia luis luca maria marie marta martin mary maya meena meera mehmet michael mina mohan mohammed nadia nasreen neha nikhil nina nisha noor olga
omar padma paul pavel pedro peter pooja prakash priya radha rahul raj rajesh rakesh ramesh rania ravi rekha rita ritu robert rohan rosa sabina samir sandeep sanjay sara sarah sergei
shanti simran sofia sunil sunita suresh tara thomas tomas uma usha vijay vikas vikram wei william yasmin yusuf zara zoya""".split()
# Words that never are part of a name, though they may follow a cue or stand capitalised.
NO_NAMES = frozenset("""a about after again all although am an and another any are as ask asked at be been before below between both bring but by call can care check come copy customer customers daily
date days dear desk does during each every for from further had has have he help her here his how i if in interest is it its kindly last late limit madam may me member members month months more most
mr ms mrs my name need new next no not nothing now of off office officer on once one only or other our out over please reach receipt regards reports right said same see she should since sir so some
soon staff starting still stop subject sure team thank thanks that the their then there these they this those though through to too two under unless until up urgent very was we were what when
whenever where whether which who whom why will with within without would year yes you your account accounts bank branch card loan deposit wallet line facility savings current credit gold home
vehicle education recurring term forex demat salary pension merchant escrow overdraft locker prepaid holder holders applicant applicants services service support manager hello hi kyc
january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday
branch counter centre center department unit group cell committee squad wing society firm firms ltd limited inc street road lane avenue y e et und""".split())
# Words before a number that is no phone and no personal number.
OTHER_NUMBER_CUES = ("utr", "transfer", "account", "a/c", "ticket", "reference", "ref", "branch code", "ifsc", "invoice", "order", "clause", "amount", "code", "inr", "rs.", "rs", "₹", "transaction", "txn", "khata", "खाता", "खाते", "cuenta", "compte", "konto")
ID_CUES = ("identity", "id number", "aadhaar", "aadhar", "pan", "passport", "kyc", "emirates id", "voter", "national id", "id no", "record shows", "asked for")
TOLL_FREE = re.compile(r"1800[\s-]?\d{3}[\s-]?\d{3,4}")

#: Characters before a number in which cues count, before a street word in which its name and house number are looked
#: for, and of the local part of an address (which has no more by its standard).
CUE_WINDOW, STREET_WINDOW, LOCAL_MAX = 28, 60, 64
SCHEMES = ("mailto:", "tel:", "sms:")
_AT = ("@", "(at)", "[at]", "{at}", " at ")
_LOCAL = re.compile(r"[A-Za-z0-9](?:[\w.%+'-]*[A-Za-z0-9_])?$")
_DOT = r"(?:\.|\s?[(\[{]dot[)\]}]\s?|\sdot\s)"
_DOMAIN = re.compile(rf"\s?([A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*)", re.I)
_DOMAIN_DOT = re.compile(_DOT, re.I)

_NUMBER = re.compile(r"(?<![\w₹])[+(]?\d[\d ().\-]*\d(?![\w])|(?<![\w])[A-Za-z]{1,5}\d{4,7}[A-Za-z]?(?!\w)")
_PHONES = tuple(
    re.compile(p)
    for p in (
        r"\+\d{1,3}[\s-]?\(\d{1,4}\)[\s-]?\d{3,4}[\s-]?\d{3,4}",
        r"\+\d{1,3}(?:[\s-]?\d{1,5}){1,4}",
        r"\(0\d{1,4}\)[\s-]?\d{3,4}[\s-]?\d{3,4}",
        r"0\d{2,4}[-\s]\d{6,8}",
        r"0\d{10}",
        r"[6-9]\d{9}",
        r"[6-9]\d{4}[.\s-]\d{5}",
        r"[6-9]\d{2}[\s-]\d{3}[\s-]\d{4}",
        r"[2-9]\d{2}[.-][2-9]\d{2}[.-]\d{4}",
        r"\([2-9]\d{2}\)\s?[2-9]\d{2}-\d{4}",
        r"0\d{2,4}[\s-]\d{3,4}[\s-]\d{3,4}",
        r"0\d(?:[\s.]\d{2}){4}",
    )
)
_IDS = tuple(re.compile(p, re.I) for p in (r"[2-9]\d{3}([ -])\d{4}\1\d{4}", r"[2-9]\d{11}", r"[A-Z]{5}\d{4}[A-Z]", r"[A-Z]\d{7}", r"[A-Z]{3}\d{7}", r"784-\d{4}-\d{7}-\d", r"\d{3}-\d{2}-\d{4}"))

_HOUSE = re.compile(
    r"(?:(?:(?:flat|apartment|apt\.?|unit|suite|room)(?:\s?no\.?)?\s?#?[A-Za-z]?\d+[A-Za-z]?,?\s+)?"
    r"(?:(?:plot|house|door|block|villa|tower|bungalow|h\.\s?no\.?|d\.\s?no\.?|no\.)(?:\s?no\.?)?\s*#?\d+[\w/-]*,?\s+)?"
    r"(?:sector\s?\d+[A-Za-z]?,?\s+)?"
    r"(?:(?:#\s?)?\d+(?:[/-][\dA-Za-z]+)*[A-Za-z]?,?\s+)?)$",
    re.I,
)
_PLACE = re.compile(r"(?:,\s*(?:near|opposite|opp\.|behind|beside)\s[^,;.\n]{2,40})?(?:,\s*[A-Z][\w'’-]+(?:\s[A-Z][\w'’-]+)?)?(?:\s*[-–]?\s*\d{6}(?!\d))?")
_STREET_NAME = re.compile(r"(?:[^\W\d_][\w'’.-]*\s+){1,4}$")

_INITIAL = re.compile(r"\s+([A-Za-z])\.?(?=\s)")
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*")


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    kinds: dict[str, list[str]] = {}
    anchors = ((_AT, "at"), (SCHEMES, "scheme"), ("0123456789", "digit"), (STREET_WORDS, "street"), (STREET_BEGINNINGS, "begins"), (STREET_ENDINGS, "ends"), (NAME_CUES, "cue"), (WEAK_CUES, "weak"), (GIVEN_NAMES, "given"), (OTHER_NUMBER_CUES, "other"), (ID_CUES, "id"))
    for words, kind in anchors:
        for w in words:
            kinds.setdefault(w, []).append(kind)
    for w, k in kinds.items():
        a.add_word(w, (w, k))
    a.make_automaton()
    return a


def _whole(text: str, start: int, end: int) -> bool:
    """Whether a match is no part of a longer word."""
    before, after = text[start - 1 : start], text[end : end + 1]
    return not (before.isalnum() and text[start].isalnum()) and not (after.isalnum() and text[end - 1].isalnum())


def _whole_word(text: str, start: int, end: int) -> bool:
    """Whether a cue is no part of a longer run of letters; digits may touch it."""
    return not (text[start - 1 : start].isalpha() and text[start].isalpha()) and not (text[end : end + 1].isalpha() and text[end - 1].isalpha())


def _email(text: str, low: str, start: int, end: int) -> tuple[int, int] | None:
    spelled = low[start:end] != "@"
    left = start
    if spelled and left and text[left - 1] == " ":
        left -= 1
    local = _LOCAL.search(text, max(0, left - LOCAL_MAX), left)
    domain = _DOMAIN.match(text, end, end + 256)
    if not local or not domain:
        return None
    dots = _DOMAIN_DOT.findall(domain[1])
    if not dots or low[start:end] == " at " and not any("dot" in d.lower() for d in dots):
        return None
    last = re.split(_DOMAIN_DOT, domain[1])[-1]
    return (local.start(), domain.end(1)) if len(last) >= 2 and last.isalpha() else None


def _address(text: str, low: str, start: int, end: int) -> tuple[int, int] | None:
    name = _STREET_NAME.search(text, max(0, start - STREET_WINDOW), start)
    if not name:
        return None
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text[name.start() : start])]
    offset = name.start()
    for first, _ in words:  # the longest street name that a house number precedes
        house = _HOUSE.search(text, max(0, offset + first - STREET_WINDOW), offset + first)
        if house and any(c.isdigit() for c in house[0]):
            own = text[offset + first : start].split()
            named = text[start].isupper() and own[0][0].isupper()
            marked = re.search(r"#|\d/|[a-z]{3}", house[0], re.I) and own[0].lower() not in NO_NAMES
            if named or marked:
                return house.start(), _PLACE.match(text, end).end()
    return None


_AFTER_NUMBER = re.compile(r"(?:,?\s*(?:n[º°.]|no\.?|nr\.?)?\s*)(\d{1,5}(?:\s?[a-zA-Z])?(?:[/-]\d{1,4})?)(?![\w])")
_BEFORE_NUMBER = re.compile(r"(?<![\w.,/-])\d{1,5}(?:\s?(?:bis|ter|[a-zA-Z]))?,?\s+$")
_TOWN = re.compile(r"(?:,\s*(?:[A-Z]{1,2}-)?\d{4,6}\s+[^\W\d_][\w'’-]+(?:\s[A-Z][\w'’-]+)?|,\s*[A-Z][\w'’-]+(?:\s[A-Z][\w'’-]+)?(?:\s+\d{4,6})?)?")
_ENDED = re.compile(r"[^\W\d_][\w'’-]*$")


_PARTICLE = re.compile(r"\s+(?:de|du|des|della|del|da|do|la|l'|d')")
AMBIGUOUS = frozenset("via place avenue boulevard plaza cours corso largo".split())


def _foreign_address(text: str, low: str, start: int, end: int, begins: bool) -> tuple[int, int] | None:
    """An address whose street word comes first (rue de la Paix) or ends its name (Hauptstraße), with a house number."""
    if begins:
        at, named = end, 0
        while (m := re.compile(r"\s+([^\W\d_][\w'’.-]*)").match(text, at)) and named < 5:
            small = low[m.start(1) : m.end(1)].split("'")[0] in STREET_PARTICLES or low[m.start(1) : m.start(1) + 2] in ("l'", "d'")
            if not small and not m[1][0].isupper():
                break
            named += 1
            at = m.end(1)
            if not small and text[at : at + 1] in ",.;":
                break
        before, after = _BEFORE_NUMBER.search(text, max(0, start - STREET_WINDOW), start), _AFTER_NUMBER.match(text, at)
        if not named or not (before or after):
            return None
        last = at if before else after.end()
        town = _TOWN.match(text, last).end()
        # Words that mean other things, too, need a particle behind them or a town at the end.
        if low[start:end] in AMBIGUOUS and not _PARTICLE.match(low, end) and town == last:
            return None
        return before.start() if before else start, town
    first = _ENDED.search(text, max(0, start - STREET_WINDOW), start)
    own = first.start() if first else start
    after = re.compile(r"\s+(\d{1,4}(?:\s?[a-zA-Z])?(?:[/-]\d{1,4})?)(?!\w)").match(text, end)
    if not after or not text[own].isupper() or own == start and text[start - 1 : start] not in (" ", "-"):
        return None
    return own, _TOWN.match(text, after.end()).end()


def _words_between(low: str, start: int, end: int) -> int:
    return len(re.findall(r"[^\W\d_]+|₹", low[start:end]))


def _number(text: str, low: str, start: int, end: int, cues: list[tuple[int, int, str]]) -> tuple[str, int, int] | None:
    """The personal number in a run of digits. ``cues``: (start, end, kind) of the cue words of the text."""
    value = text[start:end]
    if value.startswith("(") and ")" not in value:
        start, value = start + 1, value[1:]
    while value and value[-1] in " .-(":
        value = value[:-1]
    end = start + len(value)
    if TOLL_FREE.fullmatch(value.lstrip("+")):
        return None
    near = [c for c in cues if start - CUE_WINDOW <= c[0] and c[1] <= start]
    follows = re.search(r"(?:[^\W\d_][\w/. ]*?|₹)[\s:#.-]*$", low[max(0, start - CUE_WINDOW) : start])
    other = follows is not None and any(kind == "other" and _words_between(low, s, start) <= 3 for s, _, kind in near)
    if any(p.fullmatch(value) for p in _IDS):
        personal = any(kind == "id" for _, _, kind in near)
        if value.isdigit() and other and not personal:
            return None
        return "ID", start, end
    if any(p.fullmatch(value) for p in _PHONES):
        digits = sum(map(str.isdigit, value))
        if not 8 <= digits <= 15 or other and value.isdigit() and "+" not in value:
            return None
        return "PHONE", start, end
    return None


_LETTERS = re.compile(r"(?<!\w)[A-Za-z]{1,5}$")


def _numbers(text: str, low: str, digits: list[int], cues: list[tuple[int, int, str]]) -> Iterator[tuple[str, int, int]]:
    """Personal numbers, expanded from the digits that the automaton has found."""
    done = 0
    for i in digits:
        if i < done:
            continue
        m = None
        if i and text[i - 1].isalpha() and (left := _LETTERS.search(text, max(done, i - 6), i)):
            m = _NUMBER.match(text, left.start())
        elif i > done and text[i - 1] in "+(":
            m = _NUMBER.match(text, i - 1)
        m = m or _NUMBER.match(text, i)
        if not m:
            continue
        done = m.end()
        found = _number(text, low, m.start(), m.end(), cues)
        if found:
            yield found
            continue
        # A longer run may hold an item and something else, such as the end of a sentence and its successor.
        if m.end() - m.start() > 12:
            taken = -1
            for p, kind in (*((p, "ID") for p in _IDS), *((p, "PHONE") for p in _PHONES)):
                for part in re.finditer(rf"(?<![\d+(]){p.pattern}(?!\d)", m[0], p.flags):
                    if part.start() >= taken and (hit := _number(text, low, m.start() + part.start(), m.start() + part.end(), cues)) and hit[0] == kind:
                        yield hit
                        taken = part.end()


def _style(word: str) -> str:
    return "upper" if word.isupper() and len(word) > 1 else "title" if word[0].isupper() else "lower"


def _name(text: str, low: str, at: int, cue: str | None) -> tuple[int, int] | None:
    """The name that begins at ``at``, if there is one: given name, initial, surname."""
    first = _TOKEN.match(text, at)
    if not first:
        return None
    given = low[first.start() : first.end()]
    known = given in _GIVEN
    if given in NO_NAMES or not known and (len(given) < 2 or _style(first[0]) == "lower"):
        return None
    end = first.end()
    initial = _INITIAL.match(text, end)
    after = initial.end() if initial and low[initial.start(1)] not in ("a", "i", "y", "e", "o") or initial and text[initial.end() - 1] == "." else end
    second = _TOKEN.match(text, after + 1) if text[after : after + 1] == " " else None
    if second:
        style, word = _style(second[0]), low[second.start() : second.end()]
        fits = style == _style(first[0]) or style != "lower" and _style(first[0]) != "lower"
        if fits and word not in NO_NAMES and len(word) > 2 and (known or cue):
            return at, second.end()
    if not cue:
        return None
    if cue in TITLES and _style(first[0]) == "title" and given not in NO_SURNAMES and len(given) > 2:
        return at, end
    stop = text[end : end + 1]
    if known and cue in ALONE_CUES or known and stop in ".,;!?)\n" or known and not stop:
        return at, end
    if cue in ALONE_CUES and _style(first[0]) == "title" and cue not in ("this is", "hello", "hi") and stop in ",.!" and known:
        return at, end
    return None


_FULL_NAME = re.compile(r"\s+([^\W\d_][^\W\d_'’-]+(?:[-'’][^\W\d_]+)?)\s([^\W\d_][^\W\d_'’-]+(?:[-'’][^\W\d_]+)?)(?![\w-])(?!\s+[A-Z])")


def _full_name(text: str, at: int) -> tuple[int, int] | None:
    """Two capitalised words that are no place, firm or product and that no third one follows."""
    m = _FULL_NAME.match(text, at)
    if not m or not all(m[i].istitle() or m[i][0].isupper() and not m[i].isupper() for i in (1, 2)):
        return None
    one, two = m[1].lower(), m[2].lower()
    return None if {one, two} & NO_NAMES or one in NO_FIRST_NAMES or two in NO_SURNAMES or len(one) < 3 or len(two) < 3 else (m.start(1), m.end(2))


_GIVEN = frozenset(GIVEN_NAMES)
_GAP = re.compile(r"[\s:]*")
_TITLE = re.compile(r"(?:mr|mrs|ms|miss|dr|shri|smt|sri)\.?\s+", re.I)
_RANK = {"EMAIL": 0, "ADDRESS": 1, "ID": 2, "PHONE": 3, "NAME": 4}


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(type, start, end) of every item, start counted from 0, in order and without overlaps."""
    if not text:
        return []
    low = lower(text)
    found: list[tuple[str, int, int]] = []
    digits: list[int] = []
    cues: list[tuple[int, int, str]] = []
    for last, (word, kinds) in _automaton().iter(low):
        if "digit" in kinds:
            digits.append(last)
            continue
        start, end = last + 1 - len(word), last + 1
        if "scheme" in kinds and (m := re.compile(r"\+?\d[\d().-]{6,18}\d").match(text, end)) and word != "mailto:":
            found.append(("PHONE", m.start(), m.end()))
        if "id" in kinds:
            cues.append((start, end, "id"))
        if "other" in kinds and _whole_word(low, start, end):
            cues.append((start, end, "other"))
        if "at" in kinds:
            if span := _email(text, low, start, end):
                found.append(("EMAIL", *span))
            continue
        if "ends" in kinds and not low[end : end + 1].isalnum() and (span := _foreign_address(text, low, start, end, False)):
            found.append(("ADDRESS", *span))
        if not _whole(low, start, end):
            continue
        if "street" in kinds and (span := _address(text, low, start, end)):
            found.append(("ADDRESS", *span))
        elif "begins" in kinds and (span := _foreign_address(text, low, start, end, True)):
            found.append(("ADDRESS", *span))
        if "cue" in kinds:
            at = _GAP.match(text, end).end()
            if title := _TITLE.match(text, at):
                at = title.end()
            if at > end and (span := _name(text, low, at, word)):
                found.append(("NAME", *span))
        if "weak" in kinds and text[end : end + 1] == " " and (span := _full_name(text, end)):
            found.append(("NAME", *span))
        if "given" in kinds and (span := _name(text, low, start, None)):
            found.append(("NAME", *span))
    found += _numbers(text, low, digits, cues)
    found.sort(key=lambda f: (_RANK[f[0]] > 0, f[1], f[1] - f[2], _RANK[f[0]]))
    kept: list[tuple[str, int, int]] = []
    for kind, start, end in found:
        if all(end <= s or start >= e for _, s, e in kept):
            kept.append((kind, start, end))
    return sorted(kept, key=lambda f: f[1])


def redact(text: str | None) -> str | None:
    """The text with every item replaced by a placeholder such as <EMAIL>."""
    if not text:
        return text
    parts, at = [], 0
    for kind, start, end in find(text):
        parts += [text[at:start], f"<{kind}>"]
        at = end
    return "".join([*parts, text[at:]])


def _found(fields: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["turn_id", "field", "pii_type", "start_pos", "end_pos"]
        for b in batches:
            rows = [(i, f, kind, s + 1, e) for f in fields for i, t in zip(b["turn_id"].to_pylist(), b[f].to_pylist()) for kind, s, e in find(t)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names)

    return run


def _redacted(fields: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["turn_id"], *(pa.array([redact(t) for t in b[f].to_pylist()], pa.string()) for f in fields)], ["turn_id", *fields])

    return run


FIELDS = ("user_message", "bot_response")


def items(turns: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """turn_id, field, pii_type, start_pos, end_pos (both from 1, included) of every item. No text is shuffled."""
    rows = turns.where(F.col("turn_id").isNotNull()).select("turn_id", *fields)
    return rows.mapInArrow(_found(fields), "turn_id string, field string, pii_type string, start_pos long, end_pos long").distinct()


def redacted(turns: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """turn_id and the fields with placeholders in place of personal data."""
    rows = turns.where(F.col("turn_id").isNotNull()).select("turn_id", *fields)
    return rows.mapInArrow(_redacted(fields), "turn_id string, " + ", ".join(f"{f} string" for f in fields))

"""Personal data, disguised or not, as spans of the original text.

Plain emails, IP addresses, card and phone numbers are found as they stand
(base spans). Then transducers rewrite a copy of the text, one after another:
look-alike letters and digits to ASCII (one for one), invisible characters to
nothing, bracketed "at" and "dot" to @ and ., spelled dots between names and
spelled digits; then a plain "at" before a name with a spelled dot. Each keeps
the source offsets of what it replaced, so what is found in the copy maps back
to whole stretches of the source. Such a span is added unless a base span of its
kind covers it. After words that stand before "at" in prose (PROSE_BEFORE_AT) a
plain "at" is left alone, and English "at" doesn't go with "point".

Defined results. Null and empty texts have no spans. Texts of any length are
searched whole, in time proportional to their length. Rows are independent:
repeated rows, ties and further columns need no rule; an empty table gives an
empty table. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import on_workers, table

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind: string, start: long, end: long, base: boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits starts, which keeps this linear.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @ outwards: the longest local part to its left, the domain to its right."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, free := m.end()))
        at = text.find("@", max(at + 1, free))
    return out


def found(text: str) -> list[tuple[str, int, int]]:
    """Undisguised identifiers as (kind, start, end), by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return out


#: Cyrillic and Greek letters with the Latin ones they pass for.
_LOOK_ALIKES = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινρ", "aeopcyxijshdqwABEKMHOPCTYXIJSABEZHIKMNOPTYXoivp", strict=True))


def _table() -> dict[int, str]:
    """Characters that stand for one ASCII character: compatibility forms, digits of any script and look-alikes."""
    out = {ord(a): b for a, b in _LOOK_ALIKES.items()}
    for code in range(0x80, 0x20000):
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and plain.isascii() and plain.isprintable():
            out[code] = plain
        elif (digit := unicodedata.digit(chr(code), None)) is not None:
            out[code] = str(digit)
    return out


_ONE_FOR_ONE = _table()

_DIGIT_WORDS = {
    word: str(k)
    for language in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for k, word in enumerate(language.split())
}
_WORD = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))

#: Spelled dots become one of these until the last transducer, so that "at" can tell them from written dots. "point" is
#: told apart, since English prose has it after "at" ("at this point in time").
_DOT, _POINT = "\ue000", "\ue001"
_PRIVATE = {0xE000: "\ue002", 0xE001: "\ue002"}
_DOT_WORD, _AT_WORD = "dot|punkt|punto|point", "at|arobase|arroba"
_INVISIBLE = re.compile(r"[\u00ad\u200b-\u200f\u2060\ufeff]+")
#: Transducer of spelled signs and digits, each named group one rule. A match starts at a sign or a word, never at blanks; those before are
#: taken in afterwards, so that long runs of blanks are read once.
_SPELLED = re.compile(
    rf"(?P<at>[\[({{<]\s*(?:{_AT_WORD}|@)\s*[\])}}>]\s*)"
    rf"|(?P<dot>[\[({{<]\s*(?:{_DOT_WORD}|\.)\s*[\])}}>]\s*)"
    rf"|(?P<bare>(?<=\s)(?:{_DOT_WORD})\s+)(?=[A-Za-z0-9])"
    rf"|(?P<plus>\bplus\s+(?=(?:[0-9]|(?:{_WORD})\b)))"
    rf"|(?P<digits>\b(?:{_WORD})(?:[\s-]+(?:{_WORD}))*\b)",
    re.IGNORECASE,
)
#: Transducer of "at" between plain words, before a name that ends in letters after a dot, spelled or written.
_NAME = "[A-Za-z0-9-]+"
_AT = re.compile(
    rf"(?<=\s)(?:at\s+(?=(?P<domain>{_NAME}(?:[{_DOT}.]{_NAME})*[{_DOT}.][A-Za-z]{{2,}})\b)|(?:arobase|arroba)\s+(?={_NAME}(?:[{_DOT}{_POINT}.]{_NAME})*?[{_DOT}{_POINT}.][A-Za-z]{{2,}}\b))",
    re.IGNORECASE,
)
#: Words before an address, and what stands before a noun; in the four languages of digit words.
CUES = frozenset("address adresse an ask cc contact contactez correo courriel ecrivez email emails escribe escriba from is kontakt mail mailto mails message ping reach schreib schreibe schreiben send sent to via write écrivez écrire".split())
DETERMINERS = frozenset("a all an any das dem den der die each ein eine every her his its la las le les los more most my new no one our some that the their these this those un una une your".split())
#: Verbs, pronouns and particles that take "at" with a place; nouns aren't listed, as any may name a mailbox.
PLACE_WORDS = frozenset(
    "am are arrive arrived arrives available be been begin being bought buy by come dine done down everyone everything find found get go going got had happen happened has have he held her here him"
    " hosted i in is it join joined just later learn live lived lives located look looked looking looks me meet meets meeting met now off on online only open or order out play played posted published"
    " read registered retail sat saw see seen she sign sit smile sold someone speak spoke stand stare start started starts stay stayed still stop stopped studied studies study tell then there they time today together up"
    " us visit wait waited waiting was watch we were work worked working works yelled you".split()
)
#: Sites of mailboxes.
MAIL_SITES = frozenset("aol fastmail freenet gmail gmx hotmail icloud mail outlook posteo proton protonmail web yahoo yandex".split())


def likely(before: str, local: str, domain: str, after: str) -> bool:
    """Whether "local at domain" in plain words is an address rather than prose, by what is around it.

    Scored: a dot that is spelled 1, one that is written -1; a digit or sign in the
    local part 3, a word that goes with places -3; a cue among the two words before
    3 (not before such a word), a determiner there -2, a colon or bracket right before 2; a site of mailboxes
    2; an end after it, or nothing before and after, 1. More than 0 is an address.
    """
    score = 1 if _DOT in domain else -1
    if any(not c.isalpha() for c in local):
        score += 3
    elif local.lower() in PLACE_WORDS:
        score -= 3
    tail = before.rstrip()
    if tail.endswith((":", "(", "<", "[", "=", '"')):
        score += 2
    elif not tail.endswith((".", ",", ";", "!", "?", ")")) and "\n" not in before[len(tail) :]:
        near = [w.lower() for w in re.split(r"[.,;:!?()\n]", tail)[-1].split()[-2:]]
        score += 3 * (any(w in CUES for w in near) and local.lower() not in PLACE_WORDS) - 2 * any(w in DETERMINERS for w in near)
    score += 2 * (re.split(rf"[{_DOT}.]", domain.lower())[-2] in MAIL_SITES)
    return score + (not after.strip() or after[0] in ".,;:!?)>]\"\n") > 0


#: Cheap necessary condition besides digit words: a spelled dot or sign, a bracketed one, an invisible character. (A plain
#: "at" needs a dot in the next word or a spelled one as well.)
_SIGN = re.compile(rf"\bat\s+[A-Za-z0-9-]+\.[A-Za-z]|[\u00ad\u200b-\u200f\u2060\ufeff]|[\[({{<]\s*(?:[@.]|{_AT_WORD})|\b(?:{_DOT_WORD}|arobase|arroba|plus)\b", re.IGNORECASE)
_DIGIT_WORD = re.compile(rf"\b(?:{_WORD})\b", re.IGNORECASE)
_BESIDE = " \t\n\r\f\v().+-"


def hinted(text: str) -> bool:
    """Whether a disguise may be there: a sign, or a digit word beside a digit, + or another digit word."""
    if _SIGN.search(text):
        return True
    end = -1  # of the digit word before
    for m in _DIGIT_WORD.finditer(text):
        gap = text[max(end, 0) : m.start()]
        bare = gap.rstrip(_BESIDE)
        if (not bare and end >= 0) or bare[-1:].isdigit() or "+" in gap[len(bare) :]:
            return True
        end = m.end()
        if after := text[end : end + 64].lstrip(_BESIDE):
            if after[0].isdigit():
                return True
        elif re.compile(rf"[{re.escape(_BESIDE)}\s]*+\d").match(text, end):
            return True
    return False


class Rewritten:
    """A rewritten text that knows where its stretches come from."""

    def __init__(self, text: str, pieces: list[tuple[str, int, int]]):
        """pieces: (new text, start, length) of what is replaced, in order, not overlapping."""
        self.starts, self.sources, out, at, made = [], [], [], 0, 0
        for new, start, length in [*pieces, ("", len(text), 0)]:
            for piece, source, n, copied in ((text[at:start], at, start - at, True), (new, start, length, len(new) == length)):
                if piece:
                    self.starts.append(made)
                    self.sources.append((source, n, copied))
                    out.append(piece)
                    made += len(piece)
            at = start + length
        self.text = "".join(out)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The stretch of the source that made start to end."""

        def piece(at: int) -> tuple[int, int]:
            k = bisect_right(self.starts, at) - 1
            source, length, copied = self.sources[k]
            return (source + at - self.starts[k], source + at - self.starts[k] + 1) if copied else (source, source + length)

        return piece(start)[0], piece(end - 1)[1]


def _blanks_before(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1].isspace():
        at -= 1
    return at


def _plain(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()


def _invisible(text: str) -> list[tuple[str, int, int]]:
    return [("", m.start(), m.end() - m.start()) for m in _INVISIBLE.finditer(text)]


def _signs(text: str) -> list[tuple[str, int, int]]:
    """What stands for signs and digits, and what it becomes."""
    out, free = [], 0
    for m in _SPELLED.finditer(text):
        kind, start = m.lastgroup, m.start()
        if kind == "digits":
            # Spelled digits close up; each keeps the place of its word.
            words = [(w.group().lower(), m.start() + w.start(), len(w.group())) for w in re.finditer(r"[^\W\d_]+", m.group())]
            for k, (word, at, n) in enumerate(words):
                if k:
                    out.append(("", free, at - free))
                elif (start := _blanks_before(text, at, free)) < at and text[start - 1 : start] == "+":
                    out.append(("", start, at - start))
                out.append((_DIGIT_WORDS[word], at, n))
                free = at + n
            continue
        if kind != "plus":
            start = _blanks_before(text, start, free)
            if kind != "at" and not (_plain(text, start - 1) and _plain(text, m.end())):
                continue
        new = {"at": "@", "plus": "+"}.get(kind) or (_POINT if "point" in m.group().lower() else _DOT)
        out.append((new, start, m.end() - start))
        free = m.end()
    return out


def _ats(text: str) -> list[tuple[str, int, int]]:
    """Plain words for @."""
    out, free = [], 0
    for m in _AT.finditer(text):
        start = _blanks_before(text, m.start(), free)
        local = start
        while local > free and (text[local - 1] in _LOCAL or text[local - 1] in _DOT + _POINT):
            local -= 1
        if local == start or text[start - 1] in "." + _DOT + _POINT:
            continue
        domain = m["domain"]
        if domain is None or likely(text[max(0, local - 48) : local], text[local:start], domain, text[m.end() + len(domain) :][:8]):
            out.append(("@", start, m.end() - start))
            free = m.end()
    return out


def undisguised(text: str) -> list[tuple[str, int, int]]:
    """Identifiers of the rewritten text as (kind, start, end) of the source."""
    if "\ue000" in text or "\ue001" in text:
        text = text.translate(_PRIVATE)
    maps: list[Rewritten] = []
    for transducer in (_invisible, _signs, _ats):
        if pieces := transducer(text):
            maps.append(Rewritten(text, pieces))
            text = maps[-1].text
    out = []
    for kind, a, b in found(text.replace(_DOT, ".").replace(_POINT, ".")) if maps else []:
        for made in reversed(maps):
            a, b = made.source(a, b)
        out.append((kind, a, b))
    return out


def spans(text: str) -> list[tuple[str, int, int, bool]]:
    """All spans as (kind, start, end, base), by kind, then start, then end."""
    base = found(text)
    plain = text if text.isascii() else text.translate(_ONE_FOR_ONE)
    out = [(*x, True) for x in base]
    seen = set(base)
    maybe: list[tuple[str, int, int]] = []
    if plain != text:
        maybe += found(plain)
    if hinted(plain):
        maybe += undisguised(plain)
    if maybe:
        covers = {k: sorted((a, b) for kind, a, b in base if kind == k) for k in KINDS}
        for kind, a, b in maybe:
            k = bisect_right(covers[kind], (a, len(text) + 1)) - 1
            if (kind, a, b) not in seen and not (k >= 0 and covers[kind][k][1] >= b):
                seen.add((kind, a, b))
                out.append((kind, a, b, False))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), *x[1:3]))


def redacted(text: str) -> str:
    """The text with each stretch of spans replaced by its first kind in brackets."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, kind) for kind, a, b, _ in spans(text)):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def with_spans(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, then spans: an array of (kind, start, end, base)."""
    on_workers(df.sparkSession)

    @F.pandas_udf(SPANS)
    def of(texts: pd.Series) -> pd.Series:
        names = ("kind", "start", "end", "base")
        return pd.Series([[dict(zip(names, x, strict=True)) for x in spans(t)] for t in texts], dtype=object)

    return df.select(*keep, of(F.coalesce(F.col(text), F.lit(""))).alias("spans"))


def without_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the spans of its text replaced; null texts stay null."""
    on_workers(df.sparkSession)

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t) for t in texts], dtype=object)

    return df.withColumn(text, of(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: spans of every document, the base ones counted and digested."""
    df = with_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    join = lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return df.select(
        "doc_id", *map(number, KINDS), F.sha2(join(base).cast("binary"), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )

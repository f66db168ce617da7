"""Personal data replaced by keyed surrogates of the same kind and form."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import free_name, written

#: Entities whose surrogate had to be drawn again that are sent to every task; more are joined.
SENT = 100_000

# Forms of address and common given names, by gender.
TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor Sr Signor Don Господин",
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Señora Sra Señorita Signora Doña Госпожа",
    "n": "Dr Prof Professor Doctor Доктор",
}
GIVEN = {
    ("latin", "m"): "James John Robert Michael David Thomas Peter Paul Daniel Martin Andreas Stefan Lukas Pierre Jean Louis Carlos José Miguel Antonio",
    ("latin", "f"): "Mary Anna Linda Susan Laura Julia Sarah Emma Maria Petra Sabine Claire Sophie Camille Elena Carmen Lucía Isabel Teresa Marta",
    ("cyrillic", "m"): "Иван Пётр Алексей Сергей Дмитрий Андрей Михаил Николай",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана",
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας",
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία",
}
GENDER_OF = {name.lower(): g for (_, g), names in GIVEN.items() for name in names.split()}
#: Syllables that family names are built from, by script.
SYLLABLES = {
    "latin": "bar ben cal dor fen gar hol kes lan mar nor pel ros sal tam vel wes yar zim bru".split(),
    "cyrillic": "бар вол гор дем зар кор лан мар нов пет рос сав тим фед хар ша бел жар кру сим".split(),
    "greek": "παπ δημ γεω καρ νικ αλε μαρ λαμ σταθ θεο κων βας ραλ μιχ πετ ξεν φωτ χαρ ψαρ ζαχ".split(),
}
FAMILY_END = {"latin": "son", "cyrillic": "ов", "greek": "ίδης"}

WORD = r"[^\W\d_]"
NAME = rf"(?!(?:{'|'.join(' '.join(TITLES.values()).split())})\b)[^\W\d_a-z]{WORD}+(?:['’-]{WORD}+)*"
#: Kinds in order of precedence.
KINDS = {
    "secret": r"(?i:\b(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth)\b[\"']?\s*[=:]\s*[\"']?)(?P<secret>(?=[^\s\"']*\d)[^\s\"',;]{6,})",
    "key": r"\b(?P<key>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b",
    "email": r"(?<![\w.+%-])(?P<email>[\w.+%-]+@(?:[\w-]+\.)+[^\W\d_]{2,})",
    "iban": r"\b(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b",
    "ip6": r"(?<![\w:.])(?P<ip6>(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:])",
    "ip4": r"(?<![\w.])(?P<ip4>(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d))(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])",
    "card": r"(?<![\w-])(?P<card>[2-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\w-])",
    "phone": r"(?<![\w(])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0[1-9]\d{1,3}[ /-]\d{5,8})(?!\w)",
    "person": rf"\b(?P<title>{'|'.join(' '.join(TITLES.values()).split())})\b\.?[ \u00a0](?P<person>{NAME}(?:[ \u00a0]{NAME}){{0,2}})",
}
FINDER = re.compile("|".join(KINDS.values()))
#: Any text with an entity has one of these.
LIKELY = re.compile(rf"[@\d]|\b(?:{'|'.join(' '.join(TITLES.values()).split())})\b")


@dataclass(frozen=True)
class Entity:
    """A place in a text: what it is, its value in one form (for coreference), and its letters."""

    kind: str
    value: str
    start: int
    end: int
    text: str


def script_of(text: str) -> str:
    for c in text:
        if "\u0370" <= c <= "\u03ff" or "\u1f00" <= c <= "\u1fff":
            return "greek"
        if "\u0400" <= c <= "\u04ff":
            return "cyrillic"
    return "latin"


def _canonical(kind: str, text: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", text)
    if kind == "ip6":
        return str(ipaddress.IPv6Address(text))
    if kind == "email":
        return text.lower()
    return text.replace(" ", "") if kind == "iban" else text


def _real(kind: str, text: str) -> bool:
    """Whether a match of the pattern is an entity: cards keep Luhn's check, short addresses are addresses."""
    if kind == "card":
        return luhn_ok(re.sub(r"\D", "", text))
    if kind == "ip6" and "::" in text:
        groups = text.split(":")
        if max(map(len, groups)) < 3 or not any(c.isdigit() for c in text):
            return False  # a::b is a name in a program
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return False
    return True


def find(text: str | None) -> list[Entity]:
    """The entities of a text in order, without overlaps.

    Detected: values after a word for a password, token or key and ``=`` or
    ``:``; access keys with a known prefix; mail addresses; IBANs; IPv4; IPv6,
    written out or shortened by ``::`` (with a digit and a group of three or
    four); social security numbers ddd-dd-dddd; card numbers of 13 to 19 digits
    that pass Luhn's check; phone numbers with ``+``, as ddd-ddd-dddd, with an
    area code in brackets, or national ones with a leading zero (030 1234567);
    names after a form of address.  Not detected: names without one or in lower
    case, street addresses, dates of birth, numbers without any of these marks.

    A titled name gives one entity per word: the given names with their gender
    (by the title, else by the name), the last as a family name.  Later
    mentions of a found name's words in the same text are entities too.
    """
    if not text or not LIKELY.search(text):
        return []
    out: list[Entity] = []
    names: dict[str, str] = {}
    for m in FINDER.finditer(text):
        kind = m.lastgroup
        if not _real(kind, m[kind]):
            continue
        if kind != "person":
            out.append(Entity(kind, _canonical(kind, m[kind]), m.start(kind), m.end(kind), m[kind]))
            continue
        gender = next(g for g, titles in TITLES.items() if m["title"] in titles.split())
        parts = [(p[0], p.start()) for p in re.finditer(r"\S+", m["person"])]
        for i, (part, at) in enumerate(parts):
            last = i == len(parts) - 1
            own = gender if gender != "n" else GENDER_OF.get(part.lower(), "n")
            kind = f"{'family' if last else 'given_' + own}_{script_of(part)}"
            out.append(Entity(kind, part.lower(), m.start("person") + at, m.start("person") + at + len(part), part))
            names.setdefault(part, kind)
    if names:
        taken = [(e.start, e.end) for e in out]
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})(?!\w)", text):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                out.append(Entity(names[m[0]], m[0].lower(), m.start(), m.end(), m[0]))
        out.sort(key=lambda e: e.start)
    return out


class Drawer:
    """An endless keyed stream for one entity and attempt."""

    def __init__(self, secret: bytes, kind: str, value: str, attempt: int) -> None:
        self.head, self.secret, self.count, self.pool = f"{kind}\0{value}\0{attempt}".encode(), secret, 0, 0
        self.left = 1

    def below(self, n: int) -> int:
        if self.left < n << 64:
            self.pool = int.from_bytes(hmac.new(self.secret, self.head + b"\0%d" % self.count, hashlib.sha256).digest())
            self.left, self.count = 1 << 256, self.count + 1
        self.pool, out = divmod(self.pool, n)
        self.left //= n
        return out


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _shaped(value: str, d: Drawer) -> str:
    """Digits for digits, letters for letters of the same case and alphabet; all else stays."""
    hexadecimal = len(value) >= 8 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)
    out = []
    for c in value:
        if c.isdigit():
            out.append(str(d.below(10)))
        elif hexadecimal:
            out.append("abcdef"[d.below(6)].upper() if c.isupper() else "abcdef"[d.below(6)])
        elif c.isalpha():
            letter = "abcdefghijklmnopqrstuvwxyz"[d.below(26)] if script_of(c) == "latin" else "абвгдежзиклмнопрстуфхцчшэюя"[d.below(27)]
            out.append(letter.upper() if c.isupper() else letter)
        else:
            out.append(c)
    return "".join(out)


def surrogate(secret: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The replacement, in canonical form, of an entity's canonical value."""
    d = Drawer(secret, kind, value, attempt)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        ending = domain.rpartition(".")[2]
        ending = ending if ending in ("com", "net", "org") else "org"
        return f"{_shaped(local, d)}{'x' * (attempt > 20)}@{_shaped(domain.split('.')[0], d)}.example.{ending}"
    if kind == "phone":
        kept = 1 if value[0] in "17" else 2  # country code
        return value[:kept] + str(1 + d.below(9)) + "".join(str(d.below(10)) for _ in value[kept + 1 :])
    if kind == "card":
        body = value[0] + "".join(str(d.below(10)) for _ in value[2:])
        good = next(c for c in "0123456789" if luhn_ok(body + c))
        return body + (good if luhn_ok(value) else str((int(good) + 1 + d.below(9)) % 10))
    if kind == "ssn":
        return "9" + "".join(str(d.below(10)) for _ in value[1:])  # never issued
    if kind == "ip4":
        return f"10.{d.below(256)}.{d.below(256)}.{d.below(256)}"
    if kind == "ip6":
        return "2001:db8:" + ":".join(f"{d.below(65536):x}" for _ in range(6))
    if kind == "iban":
        body = value[:2] + "00" + _shaped(value[4:], d)
        check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
        check = check if iban_ok(value) else (check + 1 + d.below(90)) % 97
        return f"{value[:2]}{check:02d}{body[4:]}"
    if kind == "key":
        head = re.match(r"AKIA|ASIA|gh[pousr]_|sk-", value)[0]
        return head + _shaped(value[len(head) :], d)
    if kind.startswith("given"):
        _, gender, script = kind.split("_")
        pool = GIVEN[script, gender].split() if gender != "n" else GIVEN[script, "mf"[d.below(2)]].split()
        if attempt < 4:
            return pool[d.below(len(pool))].lower()
        return f"{pool[d.below(len(pool))]}-{pool[d.below(len(pool))]}{_syllables(script, d, attempt // 8)}".lower()
    if kind.startswith("family"):
        script = kind.split("_")[1]
        return _syllables(script, d, 2 + attempt // 4) + FAMILY_END[script]
    return _shaped(value, d)


def _syllables(script: str, d: Drawer, n: int) -> str:
    return "".join(SYLLABLES[script][d.below(len(SYLLABLES[script]))] for _ in range(n))


def in_form(canonical: str, kind: str, text: str) -> str:
    """A canonical surrogate in the form ``text`` has: its separators, its case."""
    if kind in ("phone", "card", "ssn", "iban"):
        left = iter(canonical)
        return "".join(next(left) if c.isalnum() else c for c in text)
    if kind.startswith(("given", "family")):
        if len(text) > 1 and text.isupper():
            return canonical.upper()
        return "-".join(p[:1].upper() + p[1:] for p in canonical.split("-")) if text[0].isupper() else canonical
    if kind == "email" and text.isupper():
        return canonical.upper()
    return canonical


def replace(text: str | None, chosen: Callable[[str, str], str]) -> tuple[str | None, int]:
    """(text with every entity replaced, number replaced); ``chosen`` gives (kind, value) its surrogate."""
    entities = find(text)
    if not entities:
        return text, 0
    out, at = [], 0
    for e in entities:
        out += [text[at : e.start], in_form(chosen(e.kind, e.value), e.kind, e.text)]
        at = e.end
    return "".join([*out, text[at:]]), len(entities)


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, value) of every entity of all texts, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = sorted({(e.kind, e.value) for one in batch.column(0) for e in find(one.as_py())})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([v for _, v in seen], pa.string())], ["kind", "value"])

    return docs.select(F.col(text).cast("string").alias("x")).mapInArrow(run, "kind string, value string").distinct()


def _drawn(secret: bytes, kind: Column, value: Column, attempt: Column) -> Column:
    @F.pandas_udf("string")
    def of(kinds: pd.Series, values: pd.Series, attempts: pd.Series) -> pd.Series:
        return pd.Series([surrogate(secret, k, v, a) for k, v, a in zip(kinds, values, attempts, strict=True)], dtype=object)

    return of(kind, value, attempt)


def _family(kind: Column) -> Column:
    """Kinds whose surrogates must differ from each other: all given names of a script are one."""
    return F.regexp_replace(kind, "^given_[mfn]_", "given_")


def draws(found: DataFrame, secret: bytes, rounds: int = 64) -> DataFrame:
    """(kind, value, attempt) of the entities whose first surrogate clashed.

    A surrogate may equal neither another entity's surrogate nor any entity
    that really occurs.  Of equal surrogates the one settled earlier stays,
    else the smallest entity; the others draw again, until none clashes.  All
    checks are joins and aggregates over the distinct entities.
    """
    real = found.select(_family(F.col("kind")).alias("f"), F.col("value").alias("s")).distinct()
    state = written(found.withColumn("attempt", F.lit(0)).withColumn("s", _drawn(secret, F.col("kind"), F.col("value"), F.col("attempt"))), "drawn")
    for _ in range(rounds):
        named = state.withColumn("f", _family(F.col("kind")))
        first = named.groupBy("f", "s").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("kind", "value"), F.struct("attempt", "kind", "value")).alias("holder"))
        shared = first.where("n > 1").select("f", "s", "holder")
        taken = first.join(real, ["f", "s"], "left_semi").select("f", "s")
        clash = named.join(shared, ["f", "s"]).where(~F.struct("kind", "value").eqNullSafe(F.col("holder"))).select("kind", "value")
        clash = clash.unionAll(named.join(taken, ["f", "s"], "left_semi").select("kind", "value")).distinct()
        clash = written(clash, "clash")
        if not clash.take(1):
            return state.where("attempt > 0").select("kind", "value", "attempt")
        again = state.join(clash, ["kind", "value"], "left_semi").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        again = again.withColumn("s", _drawn(secret, F.col("kind"), F.col("value"), F.col("attempt")))
        state = written(state.join(clash, ["kind", "value"], "left_anti").unionAll(again), "drawn")
    raise ValueError("too few surrogates of some kind for the entities found")


_SENT: dict[str, dict] = {}

RESULT = "struct<text:string,n:int>"


def protected(docs: DataFrame, secret: bytes, text: str = "text", count: str | None = None, sent: int = SENT) -> DataFrame:
    """``docs`` with every detected entity in ``text`` replaced; ``count`` names a column for how many were.

    A surrogate depends on the secret key, the kind and the canonical value
    alone, so one entity has one surrogate in all documents and all its
    spellings; different entities have different ones, and none occurs in the
    data.  Phone numbers, cards, IBANs keep length, separators and (in)valid
    check digits, names keep gender, script and case, addresses lie in
    reserved ranges.  NULL texts stay NULL, texts without entities stay as
    they are, repeated rows give equal results, an empty table an empty one.

    The entities are gathered once, each once; texts are not shuffled.  Few
    entities clash and need a later draw: up to ``sent`` of these go to every
    task; beyond that they are joined to the texts that hold them.
    """
    spark = docs.sparkSession
    later = draws(written(entities(docs, text), "entities"), secret)
    few = later.limit(sent + 1).collect()
    done, texts = free_name(docs, "done"), docs.schema[text].dataType
    if len(few) <= sent:
        table = spark.sparkContext.broadcast({(r["kind"], r["value"]): r["attempt"] for r in few})
        name = uuid.uuid4().hex

        @F.pandas_udf(RESULT)
        def of(texts: pd.Series) -> pd.DataFrame:
            if name not in _SENT:
                _SENT.clear()  # of an earlier job in this worker
                _SENT[name] = table.value
            attempts = _SENT[name]
            rows = [replace(t, lambda k, v: surrogate(secret, k, v, attempts.get((k, v), 0))) for t in texts]
            return pd.DataFrame({"text": [r[0] for r in rows], "n": [r[1] for r in rows]})

        out = docs.withColumn(done, of(F.col(text).cast("string")))
    else:
        out = _joined(docs, later, secret, text, done)
    out = out.withColumn(text, F.col(f"{done}.text").cast(texts))
    if count:
        out = out.withColumn(count, F.col(f"{done}.n"))
    return out.drop(done)


def _joined(docs: DataFrame, later: DataFrame, secret: bytes, text: str, done: str) -> DataFrame:
    """The same where the later draws are too many to send: each text is joined with its own."""

    @F.pandas_udf("array<struct<kind:string,value:string>>")
    def held(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "value": v} for k, v in sorted({(e.kind, e.value) for e in find(t)})] for t in texts])

    @F.pandas_udf(RESULT)
    def of(texts: pd.Series, own: pd.Series) -> pd.DataFrame:
        rows = []
        for t, draws_ in zip(texts, own, strict=True):
            attempts = {(x["kind"], x["value"]): x["attempt"] for x in draws_} if draws_ is not None else {}
            rows.append(replace(t, lambda k, v, attempts=attempts: surrogate(secret, k, v, attempts.get((k, v), 0))))
        return pd.DataFrame({"text": [r[0] for r in rows], "n": [r[1] for r in rows]})

    mark, own = free_name(docs, "mark"), free_name(docs, "own")
    marked = docs.withColumn(mark, F.xxhash64(F.col(text).cast("string")))
    mentions = marked.select(F.col(mark), F.explode(held(F.col(text).cast("string"))).alias("e")).select(mark, "e.kind", "e.value").distinct()
    by_text = mentions.join(later, ["kind", "value"]).groupBy(mark).agg(F.collect_list(F.struct("kind", "value", "attempt")).alias(own))
    return marked.join(by_text, mark, "left").withColumn(done, of(F.col(text).cast("string"), F.col(own))).drop(mark, own)

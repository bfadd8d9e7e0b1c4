"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them.

Candidates are the spans of the strict patterns (which always stay) and spans of looser ones: masked addresses, phone
numbers without a country code, card numbers of other lengths or with a wrong check digit, national identity numbers, and
secrets: access keys and tokens of well-known forms, private keys, and what is assigned to a name such as password or token.
On each, five labelers vote for, against or not at all: the strict pattern, the kind's own check, a gazetteer of endings
and number ranges, words of the context, and the characters next to it. Expectation-maximisation over the counts of
vote patterns of all documents estimates how each labeler votes on true and false spans of a kind; with its
posteriors a logistic span classifier is trained over votes, kind, length and share of digits. A loose
candidate stays if the classifier says so; candidates never overlap, strict ones first.

Only the table of pattern counts reaches the driver: kinds x 3^5 votes x 8 x 4 buckets at most, whatever the input.
No pattern bounds the length of what it finds, and each takes time in proportion to a text; texts of any length are read whole, one of
over a million characters by itself. Null text is empty and has no spans. Rows are treated one by one, so null and repeated ids and repeated rows
are kept; other columns are left alone. An empty table gives no rows, and a model that keeps no loose span.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import free_name, slices, with_text_columns

#: Kinds in the order of reports; the strict patterns know the first four.
KINDS = ("email", "ip", "card", "phone", "identity", "secret")
BASE = KINDS[:4]

# The strict patterns. A run of digits is tried from its start alone, which changes no match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_MASKED = re.compile(r"\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?(?=([A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?)[A-Za-z0-9-]++)++))")
_BARE_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_IDENTITY = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
#: Secrets: what a name tells (the value is group 1), forms that vendors publish, and private keys.
_NAMED = re.compile(r"(?i)(?:passw(?:or)?d|pwd|secret|token|api[_\x20-]?key|access[_\x20-]?key|credentials?)[\"']?\x20?(?:=>?|:=?)\x20?[\"']?([^\s\"'<>,;()]{8,})")
_ISSUED = re.compile(r"(?<![A-Za-z0-9_-])(?:A(?:KIA|SIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{20,}|xox[abeprs]-[A-Za-z0-9-]{10,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]*)")
_KEY_HEAD, _KEY_END = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), re.compile(r"-----END (?:[A-Z]+ )*PRIVATE KEY-----")

#: The gazetteers: endings of domains, calling codes, beginnings of card numbers, first octets that name no person's host.
_ENDINGS = frozenset("com org net edu gov int mil info biz io dev app eu uk de fr es it nl be ch at pl se no dk fi ie pt us ca mx br ar au nz jp cn in kr ru".split())
_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 420 971".split())
_ISSUERS = tuple("4 51 52 53 54 55 34 37 35 36 38 60 62 64 65 67 22 23 24 25 26 27".split())
_NO_HOST = frozenset(("0", "127", "255"))
_ISSUED_HEADS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "eyJ", "-----BEGIN")

_FOR = {
    "email": re.compile(r"mail|contact|write to|schreib|correo|courriel|@", re.I),
    "ip": re.compile(r"\bip\b|address|server|host|adresse|servidor|login", re.I),
    "card": re.compile(r"card|visa|credit|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"tel|phone|call|mobile|fax|anruf|handy|llam|appel", re.I),
    "identity": re.compile(r"ssn|social|security|identity|ausweis|dni|identit", re.I),
    "secret": re.compile(r"passw|pwd|secret|token|key|credential|auth|login", re.I),
}
_AGAINST = re.compile(r"version|release|build|isbn|order|invoice|serial|hash|token|sha", re.I)
_NO_SECRET = re.compile(r"example|sample|placeholder|dummy|redacted|commit|checksum|digest", re.I)
CONTEXT = 32


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 - 9 * (d > 4) if k % 2 else d
        total += d
    return total % 10 == 0


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Strict addresses, found from their sign: what stands left of it, back to the last match, and the domain right of it."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        right = _DOMAIN.match(text, at + 1) if start < at else None
        if right:
            yield start, right.end()
            end = right.end()
        at = text.find("@", max(at + 1, end))


def _only_digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def strict(text: str) -> list[tuple[str, int, int]]:
    """The base spans, by kind and start."""
    found = [("email", a, b) for a, b in _addresses(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = _only_digits(m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 8 <= len(_only_digits(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def _loose(text: str) -> Iterator[tuple[str, int, int]]:
    if "at" in text or "AT" in text:
        for m in _MASKED.finditer(text):
            start = m.start()
            while start > 0 and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                yield "email", start, m.end(1)
    if _DIGIT.search(text):
        for m in _IDENTITY.finditer(text):
            yield "identity", m.start(), m.end()
        for m in _CARD.finditer(text):
            if 13 <= len(_only_digits(m[0])) <= 19:
                yield "card", m.start(), m.end()
        for m in _BARE_PHONE.finditer(text):
            yield "phone", m.start(), m.end()
    for m in _NAMED.finditer(text) if "=" in text or ":" in text else ():
        if _DIGIT.search(m[1]):
            yield "secret", m.start(1), m.end(1)
    for m in _ISSUED.finditer(text):
        yield "secret", m.start(), m.end()
    head = _KEY_HEAD.search(text)
    while head:
        end = _KEY_END.search(text, head.end())
        if not end:
            break
        yield "secret", head.start(), end.end()
        head = _KEY_HEAD.search(text, end.end())


def _mixed(span: str) -> bool:
    """Digits and letters, and at least two bits a character as they are spread."""
    count = [span.count(c) for c in set(span)]
    spread = -sum(n * math.log2(n / len(span)) for n in count) / len(span)
    return spread >= 2 and any(c.isalpha() for c in span) and _DIGIT.search(span) is not None


def _votes(kind: str, text: str, start: int, end: int, is_strict: bool) -> tuple[int, ...]:
    """Strict pattern, check, gazetteer, context, neighbours: 2 for, 0 against, 1 no vote."""
    span = text[start:end]
    digits = _only_digits(span)
    if kind == "email":
        last = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        check, listed = (2 if not last.isdigit() else 0), (2 if last in _ENDINGS else 1)
    elif kind == "ip":
        check, listed = 2, (0 if span.split(".")[0] in _NO_HOST else 1)
    elif kind == "card":
        check, listed = (2 if _luhn(digits) else 0), (2 if digits.startswith(_ISSUERS) else 0)
    elif kind == "phone":
        check = 2 if 8 <= len(digits) <= 15 else 0
        listed = 1 if span[0] != "+" else (2 if digits.startswith(_CODES) else 0)
    elif kind == "secret":
        check, listed = (2 if _mixed(span) else 0), (2 if span.startswith(_ISSUED_HEADS) else 1)
    else:
        check, listed = (0 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 2), 1
    before = text[max(0, start - CONTEXT) : start]
    context = 2 if _FOR[kind].search(before) else 0 if (_NO_SECRET if kind == "secret" else _AGAINST).search(before) else 1
    left, right = text[start - 1 : start], text[end : end + 1]
    near = 0 if left.isalnum() or right.isalnum() else 2
    return 2 if is_strict else 1, check, listed, context, near


def _pattern(kind: str, text: str, start: int, end: int, is_strict: bool) -> int:
    """Kind, votes, length (8 buckets) and share of digits (4 buckets) in one number."""
    n = KINDS.index(kind)
    for v in _votes(kind, text, start, end, is_strict):
        n = n * 3 + v
    share = len(_DIGIT.findall(text[start:end])) / (end - start)
    return (n * 8 + min(7, (end - start) // 4)) * 4 + min(3, int(share * 4))


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, int]], list[int]]:
    """Strict spans, loose spans that overlap none of them nor each other (with their patterns), and all patterns."""
    base = strict(text)
    taken = sorted((a, b) for _, a, b in base)
    reach = list(accumulate((b for _, b in taken), max))  # how far the first ones go
    loose, end = [], -1
    for kind, a, b in sorted(_loose(text), key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        k = bisect_left(taken, (b, -1))
        if a >= end and not (k and reach[k - 1] > a):
            loose.append((kind, a, b, _pattern(kind, text, a, b, False)))
            end = b
    return base, loose, [_pattern(k, text, a, b, True) for k, a, b in base] + [s[3] for s in loose]


@dataclass(frozen=True)
class Model:
    """accepted: patterns whose loose spans stay. reliability: P(vote | true), P(vote | false) by kind and labeler."""

    accepted: frozenset[int] = frozenset()
    reliability: tuple = ()
    slopes: tuple[float, ...] = ()


def _unpack(patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    share, rest = patterns % 4, patterns // 4
    length, rest = rest % 8, rest // 8
    votes = np.zeros((len(patterns), 5), int)
    for k in range(4, -1, -1):
        votes[:, k], rest = rest % 3, rest // 3
    return rest, votes, length, share


def train(counts: dict[int, int], rounds: int = 50) -> Model:
    """Expectation-maximisation over pattern counts, then the span classifier."""
    if not counts:
        return Model()
    patterns, n = np.array(sorted(counts)), np.array([counts[k] for k in sorted(counts)], float)
    kind, votes, length, share = _unpack(patterns)
    true = np.clip(0.5 + 0.2 * (votes - 1).sum(1), 0.02, 0.98)  # to begin with, the majority
    reliability = np.zeros((len(KINDS), 5, 2, 3))
    for _ in range(rounds):
        prior = np.full(len(KINDS), 0.5)
        for k in range(len(KINDS)):
            own = kind == k
            prior[k] = (1 + (n * true)[own].sum()) / (2 + n[own].sum())
            for j in range(5):
                for v in range(3):
                    hit = own & (votes[:, j] == v)
                    # a labeler is held to be better than chance until its votes show otherwise
                    reliability[k, j, 1, v] = (n * true)[hit].sum() + (1, 2, 3)[v]
                    reliability[k, j, 0, v] = (n * (1 - true))[hit].sum() + (3, 2, 1)[v]
        reliability /= reliability.sum(3, keepdims=True)
        odds = np.log(prior / (1 - prior))[kind]
        for j in range(5):
            odds = odds + np.log(reliability[kind, j, 1, votes[:, j]] / reliability[kind, j, 0, votes[:, j]])
        now = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done, true = np.abs(now - true).max() < 1e-6, now
        if done:
            break
    features = np.concatenate(
        [np.eye(len(KINDS))[kind], *(np.eye(3)[votes[:, j]][:, [0, 2]] for j in range(5)), np.eye(8)[length], np.eye(4)[share]], axis=1
    )
    weight, slopes = n / n.sum() * len(n), np.zeros(features.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(features @ slopes, -30, 30)))
        slope = features.T @ (weight * (p - true)) + 0.1 * slopes
        bend = (features * (weight * p * (1 - p))[:, None]).T @ features + 0.1 * np.eye(len(slopes))
        step = np.linalg.solve(bend, slope)
        slopes = slopes - step
        if np.abs(step).max() < 1e-8:
            break
    kept = features @ slopes > 0
    return Model(frozenset(patterns[kept].tolist()), tuple(reliability.ravel()), tuple(slopes))


_SPAN = "array<struct<kind:string,start:long,end:long,pattern:long>>"
FIELDS = f"base array<struct<kind:string,start:long,end:long>>, loose {_SPAN}, patterns array<long>"


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, base and loose (candidate spans), patterns (of both)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        more = pa.struct([*kinds, pa.field("pattern", pa.int64())])
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                made = [candidates(t or "") for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in m[0]] for m in made], pa.list_(kinds)),
                        pa.array([[dict(zip(("kind", "start", "end", "pattern"), s, strict=True)) for s in m[1]] for m in made], pa.list_(more)),
                        pa.array([m[2] for m in made], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "base", "loose", "patterns"],
                )

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(find, f"doc_id long, {FIELDS}")


def learn(found: DataFrame) -> Model:
    """found: of `spans`. The counts of patterns are at most 46,656 rows, whatever the input."""
    counted = found.select(F.explode("patterns").alias("pattern")).groupBy("pattern").count()
    return train({r["pattern"]: r["count"] for r in counted.collect()})


def decided(found: DataFrame, model: Model) -> DataFrame:
    """doc_id, base, added (the loose spans that stay)."""
    kept = F.array(*[F.lit(p).cast("long") for p in sorted(model.accepted)]) if model.accepted else F.array().cast("array<long>")
    added = F.filter("loose", lambda s: F.array_contains(kept, s["pattern"]))
    plain = F.transform(added, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", "base", plain.alias("added"))


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with each span of a text replaced by its kind in angle brackets. The candidates are found anew, text by text."""
    name = free_name(docs, "redacted")

    def make(texts: list[str]) -> dict[str, pa.Array]:
        out = []
        for t in texts:
            base, loose, _ = candidates(t)
            parts, at = [], 0
            for kind, a, b in sorted([*base, *(s[:3] for s in loose if s[3] in model.accepted)], key=lambda s: (s[1], -s[2])):
                if b <= at:
                    continue
                parts += [t[at:a] if a > at else "", f"<{kind}>"]
                at = b
            out.append("".join([*parts, t[at:]]))
        return {name: pa.array(out, pa.string())}

    done = with_text_columns(docs, text, make, f"`{name}` string")
    return done.withColumn(text, F.when(F.col(text).isNotNull(), F.col(name))).drop(name)
